"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents. In each round a queue is credited a quantum of window * share tokens, kept as a
fixed-point number, and sends whole documents as long as its credit lasts; what is left is carried as its deficit, through
windows, tasks and partitions alike. Credit never lapses while a queue has documents, so a document is sent in the first
round by which the queue's credits reach the document's end in it: round ceil(end / quantum), which needs the queue's prefix
sums only. The documents, sorted by (round, source, place in the queue), make one stream; places in it are running sums over
sorted ranges. The stream is cut at every multiple of the window, so all sequences but the last are full, and a document is
cut at these bounds alone. At the end of each round every queue that isn't empty has sent its credit but for less than its
next document; queues that have run dry leave their part to the others, in proportion to their shares.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_null_safe, materialise, text_slices

WINDOW, END_ID, BITS = 2048, 1, 16
#: Documents for each task of the sort.
TASK_ROWS = 1_000_000
#: Letters and marks on whose classes the two tokenizer libraries agree; other texts take the slower one.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ɏ–—‘-”…]*")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of byte_bpe_50k.json. Texts of plain characters go through the same ranks in tiktoken, four times as fast."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict = {}


def encoder(path: str, ranks: str | None) -> Encoder:
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = Encoder(path, ranks)
    return _ENCODERS[path, ranks]


def token_table(docs: DataFrame, path: str, ranks: str | None, end_id: int = END_ID, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, part, row, before, n, ids): ids as little-endian 16 or 32 bits (by the vocabulary's size), the row's
    number (tasks apart) and how many tokens of its source stand before it in its task."""

    def run(batches):
        enc, before, part = encoder(path, ranks), {}, TaskContext.get().partitionId()
        row = part << 40
        kind = np.uint16 if enc.slow.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in batches:
            ids, sources = batch.column(0), batch.column(1).to_pylist()
            for a, b, data, offsets in text_slices(batch.column(2)):
                raw, out, ns, at = data.tobytes(), [], [], []
                for k in range(b - a):
                    x = np.append(enc(raw[offsets[k] : offsets[k + 1]].decode()), np.uint32(end_id)).astype(kind)
                    s = sources[a + k]
                    at.append(before.get(s, 0))
                    before[s] = at[-1] + len(x)
                    ns.append(len(x))
                    out.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([part] * len(ns), pa.int32()), pa.array(range(row, row + len(ns)), pa.int64()), pa.array(at, pa.int64()), pa.array(ns, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "source", "part", "row", "before", "n", "ids"])
                row += len(ns)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, source string, part int, row long, before long, n long, ids binary")


def cut(place, length, window: int):
    """(chunk, offset in it, length, place) of chunks cut at the window bounds that they reach over."""
    cuts = (place + length - 1) // window - place // window + 1
    row = np.repeat(np.arange(len(place)), cuts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    bound = (place[row] // window + k) * window
    lo = np.maximum(bound, place[row])
    hi = np.minimum(bound + window, (place + length)[row])
    return row, lo - place[row], hi - lo, lo


_PIECES = "source string, start long, length long, ids binary, doc_tokens long"


def _long(b, *names):
    return [np.array(b.column(c).to_pylist(), np.int64) for c in names]


def _ids(b, n):
    """The batch's ids, one after the other, as 32 bits."""
    raw = b"".join(b.column("ids").to_pylist())
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n.sum() else np.uint32).astype("<u4")


def _binary(ids, length):
    offsets = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def _quanta(by_part: DataFrame, whole: int, shares: dict | None, power: float, window: int) -> DataFrame:
    """(source, q): each source's tokens of credit for a round, in units of 2^-BITS."""
    s = by_part.groupBy("source").agg(F.sum("n").alias("total"))
    s = materialise(s.select("source", F.pow(F.col("total") / F.lit(float(whole or 1)), F.lit(float(power))).alias("own")), "totals")
    share = F.col("own") / float(s.agg(F.sum(F.col("own").cast("decimal(38,18)"))).first()[0] or 1)  # decimals: reruns agree
    if shares:
        named = s.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "source string, given double")
        s, share = join_null_safe(s, named, ["source"], "left"), F.coalesce("given", share)
    s = materialise(s.select("source", F.greatest(share, F.lit(1e-9)).alias("share")), "shares")
    every = float(s.agg(F.sum(F.col("share").cast("decimal(38,18)"))).first()[0] or 1)
    return s.select("source", F.greatest(F.lit(1), F.ceil(F.lit(float(window)) * F.col("share") / F.lit(every) * float(1 << BITS))).cast("long").alias("q"))


def pack(docs: DataFrame, window: int = WINDOW, shares: dict | None = None, power: float = 1.0, path: str | None = None, ranks: str | None = None, end_id: int = END_ID, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Pieces of all documents: (doc_id, source, start, length, ids, doc_tokens, sequence_id, offset).

    ids: little-endian 32-bit ids. Target proportions: shares by source; sources that it lacks, or all without it, get
    (source's tokens / all tokens) ** power, scaled to a sum of 1: at 1 the queues run dry together, below 1 small sources
    come early. Every source has a queue. Null or empty text: the end id alone. A null source is a queue of its own, the
    last of a round; repeated rows, also of one id, are documents of their own; a null id stays null. Queues are in the
    order of tasks and rows. Other columns, whatever their names, are ignored; an empty table gives an empty result."""
    path = path or tokenizer_path()
    ranks = ranks or (tokenizer_path("byte_bpe_50k.tiktoken") if path == tokenizer_path() else None)
    tokens = materialise(token_table(docs, path, ranks, end_id, id_col, text_col, source_col), "tokens")
    by_part = materialise(tokens.groupBy("part", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "parts")
    whole, rows = (x or 0 for x in by_part.agg(F.sum("n"), F.sum("rows")).first())
    base = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    based = join_null_safe(by_part.select("part", "source", base.alias("base")), _quanta(by_part, whole, shares, power, window), ["source"])
    placed = join_null_safe(tokens.select("part", "source", "row", "before", "n"), materialise(based, "bases"), ["part", "source"])
    end = F.col("base") + F.col("before") + F.col("n")
    # a whole quotient: the first round whose credits reach the end
    turn = F.expr(f"(shiftleft(base + before + n, {BITS}) + q - 1) div q")
    order = ["round", F.col("source").isNull(), "source", "end"]
    # only the documents' lengths are sorted, not their tokens
    tasks = max(8, -(-rows // TASK_ROWS))
    ranges = placed.select("source", "row", "n", turn.alias("round"), end.alias("end")).repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("row", "n")
    kind = docs.schema[id_col].dataType.simpleString()

    def summed(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            upto = at + np.cumsum(_long(b, "n")[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), pa.array(np.concatenate(([at], upto))[:-1])], [*b.schema.names, "part", "before"])
            at = int(upto[-1]) if len(b) else at

    def windows(batches):
        for batch in batches:
            for a in range(0, len(batch), 500):
                b = batch.slice(a, 500)
                n, place = _long(b, "n", "place")
                row, off, length, place = cut(place, n, window)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("source").take(take), pa.array(off), pa.array(length), _binary(_ids(b, n), length), pa.array(n[row]), pa.array(place // window), pa.array(place % window)], ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    ranges = materialise(ranges.mapInArrow(summed, "row long, n long, part int, before long"), "ranges")
    counts = ranges.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each task of the sort
    bases = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    places = materialise(ranges.join(bases, "part").select("row", (F.col("base") + F.col("before")).alias("place")), "places")
    return tokens.join(places, "row").select("doc_id", "source", "n", "ids", "place").mapInArrow(windows, f"doc_id {kind}, {_PIECES}, sequence_id long, offset long")
