"""Quality rules: gradient-boosted trees over document statistics, as numpy node arrays, with monotonic constraints.

Two base rules reject outright; for the others the trees' probability of good quality decides. The trees are trained on the
driver on a bounded sample of labelled documents; statistics of all documents are computed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import SPACE, mix, span_hashes, windows, words
from .common import text_slices

#: Labelled documents that the trees are fitted on, at most about; chosen by a hash of their ids.
MAX_LABELLED = 20_000
#: Symbols counted, and the base rules' bounds.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 50, 50

FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "pipes", "distinct", "line_words")
#: -1: a larger value never raises the probability of good quality; 1: never lowers it.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "pipes": -1, "distinct": 1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!?.,;:"]] = True
_PIPE = np.zeros(256, bool)
_PIPE[ord("|")] = True


def _per_text(mask, offsets):
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _later(h, doc):
    """Which hashes occurred before in the same text, and which occur twice or more in it."""
    key = mix(h ^ (doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    later, twice = np.empty(len(s), bool), same.copy()
    twice[:-1] |= same[1:]
    out = np.empty(len(s), bool)
    later[order], out[order] = same, twice
    return later, out


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and features of each text."""
    n = len(offsets) - 1
    s, e, doc = words(data, offsets)
    n_words = np.bincount(doc, minlength=n)
    h = span_hashes(data, s, e)
    chars = _per_text(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    win, first = windows(h, doc, 3)
    _, twice = _later(win, doc[first])
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[first[twice] + k] = True
    ls, le, ldoc = words(data, offsets, _NEWLINE)
    solid = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int64)))
    some = solid[le] > solid[ls]
    ls, le, ldoc = ls[some], le[some], ldoc[some]
    dup, _ = _later(span_hashes(data, ls, le), ldoc)
    seen, _ = _later(h, doc)
    lines = np.bincount(ldoc, minlength=n)
    c = {"n_words": n_words, "word_chars": chars, "n_symbols": _per_text(_SYMBOL[data], offsets), "n_dup_lines": np.bincount(ldoc[dup], minlength=n), "n_repeat_words": np.bincount(doc[repeated], minlength=n)}
    w, k = np.maximum(1, n_words), np.maximum(1, chars)
    f = {
        "log_words": np.log1p(n_words), "mean_word": chars / w, "symbols": c["n_symbols"] / k, "dup_lines": c["n_dup_lines"] / np.maximum(1, lines), "repeats": c["n_repeat_words"] / w,
        "upper": _per_text(_UPPER[data], offsets) / k, "digits": _per_text(_DIGIT[data], offsets) / k, "punctuation": _per_text(_PUNCT[data], offsets) / k, "pipes": _per_text(_PIPE[data], offsets) / k,
        "distinct": 1 - np.bincount(doc[seen], minlength=n) / w, "line_words": n_words / np.maximum(1, lines),
    }
    return {k: v.astype(np.int64) for k, v in c.items()} | f


class Trees:
    """Flattened boosted trees: all nodes of all trees in arrays; leaves point at themselves."""

    def __init__(self, feature, threshold, left, right, value, roots, base, depth):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.roots, self.base, self.depth = roots, base, depth

    def logits(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 4.0, l2: float = 1.0) -> Trees:
    """Newton boosting of the log loss on quantile bins. A split on a constrained feature must keep its direction, and its
    children's values are bounded by the middle of the two, so that whole trees are monotonic."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    nodes: list[list] = []
    roots = []
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    z = np.full(len(y), base)

    def value(g, h, lo, hi):
        return float(min(max(-g / (h + l2), lo), hi))

    def grow(rows, g, h, level, lo, hi):
        me = len(nodes)
        own = value(g[rows].sum(), h[rows].sum(), lo, hi)
        nodes.append([0, np.inf, me, me, own * rate])
        best = None
        if level < depth and len(rows) > 1:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for k, cut in enumerate(cuts):
                if not len(cut):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, k], g[rows], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, k], h[rows], len(cut) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                left, right = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                ok = (hl > least / 4) & (hr > least / 4)
                if monotone[k]:
                    ok &= (right - left) * monotone[k] >= 0
                gain = np.where(ok, gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2), -np.inf)
                j = int(np.argmax(gain))
                if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                    best = (gain[j], k, j, left[j], right[j])
        if best:
            _, k, j, vl, vr = best
            mid = (vl + vr) / 2
            below = rows[binned[rows, k] <= j]
            above = rows[binned[rows, k] > j]
            bound = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[int(monotone[k])]
            a = grow(below, g, h, level + 1, *bound[0])
            b = grow(above, g, h, level + 1, *bound[1])
            nodes[me][:4] = [k, float(cuts[k][j]), a, b]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
        z = z + Trees(f, t, a, b, v, np.array(roots[-1:]), 0.0, depth).logits(x)
    f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else (np.zeros(0, int),) * 5
    return Trees(f, t, a, b, v, np.array(roots, int), base, depth)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _columns(st):
    return np.column_stack([st[f] for f in FEATURES])


def train_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees fitted on about max_labelled labelled documents at most (all, where there are fewer); None without any.

    labels: (doc_id, quality), 0 or 1; null ids, other values and ids with both labels don't count. The documents are those
    whose ids' hash falls under a bound, so that the sample has no order. Base-failed documents don't count, as they never
    reach the trees. Null texts are base-failed; documents that share an id count each; other columns are ignored."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    n = labels.count()
    if n > 0.95 * max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * 0.95 * max_labelled / n))
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("quality", "text")

    def run(batches):
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), np.int64)
            for a, b, data, offsets in text_slices(batch.column(1)):
                st = statistics(data, offsets)
                ok = ~base_failed(st)
                rows = _columns(st)[ok]
                yield pa.RecordBatch.from_arrays([pa.array(y[a:b][ok]), pa.array(list(rows), pa.list_(pa.float64()))], ["y", "x"])

    got = chosen.mapInArrow(run, "y long, x array<double>").toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(got.column("x").to_pylist())
    order = np.lexsort([*x.T, y])  # the same trees whatever the order of rows
    return fit_trees(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def base_failed(st) -> np.ndarray:
    return (st["n_words"] < LEAST_WORDS) | (100 * st["n_repeat_words"] > MOST_REPEATED * st["n_words"])


def quality_rules(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of each row.

    score: the trees' probability of good quality (1 without trees); kept: not base-failed and score at the threshold or
    above. carry names further columns of docs to return unchanged. Null, empty or wordless text: counts 0 and base-failed.
    Rows are treated one by one: repeated rows give repeated results; other columns, whatever their names, are ignored; an
    empty table gives an empty result."""

    def run(batches):
        for batch in batches:
            parts = []
            for _, _, data, offsets in text_slices(batch.column(1)):
                st = statistics(data, offsets)
                fail = base_failed(st)
                score = 1 / (1 + np.exp(-trees.logits(_columns(st)))) if trees else np.ones(len(fail))
                parts.append([*(st[c] for c in _COUNTS), fail, score, ~fail & (score >= threshold)])
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols), *batch.columns[2:]], ["doc_id", *_COUNTS, "base_failed", "score", "kept", *(f"carry{k}" for k in range(len(carry)))])

    kind = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f", carry{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)))
    out = picked.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + f", base_failed boolean, score double, kept boolean{kinds}")
    return out
