"""Chat formatting by grammar round trip.

Grammar: conversation = { "<|im_start|>" role "\\n" text "<|im_end|>" "\\n" }. A turn is rendered, parsed again by a
deterministic parser and compared with its source; where they differ its content is escaped and it is rendered anew, until
both are identical. The parser takes back one escape everywhere: "<", backslashes, "|" loses one backslash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_ESCAPED, _ANY = re.compile(r"<(\\*)\\\|"), re.compile(r"<(\\*)\|")


class GrammarError(ValueError):
    pass


def escape(text: str, role: bool = False) -> str:
    out = _ANY.sub(r"<\1\\|", text)
    return out.replace("\n", LINE) if role else out


def unescape(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(r"<\1|", text.replace(LINE, "\n") if role else text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start of the text as written, its end) of each turn; GrammarError where it isn't a conversation."""
    out, i = [], 0
    while i < len(text):
        if not text.startswith(START, i):
            raise GrammarError(f"no turn at {i}")
        i += len(START)
        line = text.find("\n", i)
        end = text.find(END, i)
        if line < 0 or end < line:
            raise GrammarError(f"no role at {i}")
        if START in text[i:end]:
            raise GrammarError(f"a turn within a turn at {i}")
        if not text.startswith("\n", end + len(END)):
            raise GrammarError(f"no end of turn at {end}")
        out.append((unescape(text[i:line], True), unescape(text[line + 1 : end]), line + 1, end))
        i = end + len(END) + 1
    return out


def render(role: str, text: str) -> tuple[str, int]:
    """The turn as written, and how often it had to be escaped."""
    for level in range(3):
        written = f"{START}{escape(role, True) if level > 1 else role}\n{escape(text) if level else text}{END}\n"
        try:
            if [x[:2] for x in parse(written)] == [(role, text)]:
                return written, level
        except GrammarError:
            pass
    raise GrammarError("escaping doesn't make it identical")


_TURNS = "turn long, position long, formatted string, loss_start long, loss_end long, escapes int"


def format_conversations(conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, position, formatted, loss_start, loss_end, escapes): a row for each turn, in order within its partition.

    The conversation's formatted text is its rows' in order; loss_start and loss_end are code points from its start (null
    but for loss_role). Turns are sorted by (turn, role, text), nulls first; null role or text: empty; a null id is a
    conversation of its own; repeated rows are turns of their own. Rows stream through, so that a conversation of any
    number of turns needs bounded memory. Other columns, whatever their names, are ignored; an empty table gives an empty
    result."""

    def run(batches):
        now, at, k = object(), 0, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != now:
                    now, at, k = c, 0, 0
                written, level = render(role or "", text or "")
                _, _, a, b = parse(written)[0]
                mask = role == loss_role
                for col, v in zip(cols, (turn, k, written, at + a if mask else None, at + b if mask else None, level), strict=True):
                    col.append(v)
                at, k = at + len(written), k + 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], ["conv_id", *(x.split()[0] for x in _TURNS.split(", "))])

    kind = conv.schema[id_col].dataType.simpleString()
    rows = conv.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind}, {_TURNS}")


def conversation_digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Reads format_conversations()'s rows back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Rows are brought together by conv_id and sorted by position, however they were written or split; in_order says that
    they still are as format_conversations() gave them. A null conv_id is a conversation of its own; rows stream through,
    so that a conversation of any length needs bounded memory; repeated rows, or a position that lacks, raise GrammarError;
    other columns, whatever their names, are ignored; an empty table gives an empty result."""

    def run(batches):
        now, state = None, None

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch_of(rows):
            kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k or first) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        first = None
        for batch in batches:
            done, first = [], batch.schema.field(0).type
            for c, written, begin, end, position in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end", "position")), strict=True):
                if position != (0 if state is None or c != now else state[5]):
                    raise GrammarError(f"position {position} of conversation {c} out of place")
                if position == 0:
                    if state:
                        done.append(row())
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(written):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    own = unescape(written[begin - state[4] : end - state[4]])
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += len(written)
                state[5] += 1
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([row()])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    formatted = formatted.select("conv_id", "position", "formatted", "loss_start", "loss_end")
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def oracle() -> str:
    """The digests in DuckDB SQL; a text is escaped where it has a control string or an escape."""
    said = "<|im_end|><|im_start|>assistant ok"
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}'),
    d AS (SELECT *, CASE WHEN contains(text, '{START}') OR contains(text, '{END}') OR regexp_matches(text, '<\\\\+\\|')
      THEN len(regexp_extract_all(text, '<\\\\*\\|')) ELSE 0 END AS more FROM c)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({len(START) + len(END) + 2} + length(role) + length(text) + more)::BIGINT AS formatted_chars
    FROM d GROUP BY conv_id"""
