"""Features, verdicts, digests and caches against plain Python, where SQL has no word for them."""

from collections import Counter
from math import exp

import numpy as np
import pytest

from stratamol.llm import chat, common, media, quality, wordpiece

SCHEMA = "doc_id long, text string"


def slow_hash(thumb):
    """Average hash, cell by cell."""
    rows, cols = len(thumb), len(thumb[0])
    mean, out = sum(map(sum, thumb)) / (rows * cols), 0
    for i in range(8):
        for j in range(8):
            ys = range(min(i * rows // 8, rows - 1), min(rows, max((i + 1) * rows // 8, i * rows // 8 + 1)))
            xs = range(min(j * cols // 8, cols - 1), min(cols, max((j + 1) * cols // 8, j * cols // 8 + 1)))
            cell = sum(thumb[y][x] for y in ys for x in xs) / (len(ys) * len(xs))
            out = out * 2 + (cell > mean)
    return f"{out:016x}"


def test_media_features(spark):
    texts = [None, "", "a", "abc " * 100, "x" * 64 * 9, "é" * 5000, "The quick brown fox. " * 3000, "a"]
    got = {}
    for r in media.media_columns(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), keep_media=True).collect():
        got[r["doc_id"]] = r
        thumbs = media.luminance_thumbnails(media.parse(bytes(r["media"])))
        whole = np.concatenate([t.ravel() for t in thumbs]).reshape(-1, thumbs[0].shape[1])
        size, digest = r["feature"].split(":")
        assert size == f"{r['width']}x{r['height']}" and digest == slow_hash(whole.tolist())
        raw = (texts[r["doc_id"]] or "").encode()
        assert whole.tobytes()[: len(raw)] == raw
    same = [{k: v for k, v in got[i].asDict().items() if k != "doc_id"} for i in (0, 1)]
    assert same[0] == same[1]
    assert {k: v for k, v in got[2].asDict().items() if k != "doc_id"} == {k: v for k, v in got[7].asDict().items() if k != "doc_id"}
    assert len({got[i]["feature"] for i in range(2, 7)}) > 3


def walked(trees, x):
    z = trees.base
    for root in trees.roots:
        at = root
        while trees.left[at] != at:
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        z += trees.value[at]
    return z


def test_trees_node_by_node_and_kept(spark):
    rng = np.random.default_rng(4)
    x = rng.random((600, 4))
    trees = quality.fit_trees(x, (x[:, 0] + x[:, 1] ** 2 > 0.9).astype(float), np.array([1, 0, -1, 0]))
    fresh = rng.random((200, 4))
    assert np.allclose(trees.logits(fresh), [walked(trees, v) for v in fresh])
    rows = [(i, " ".join(f"w{v}" + "#|" * (i % 3) for v in rng.integers(0, 900, 40 + 3 * i))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a b c " * 60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(60)] + [(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    trees = quality.train_rules(docs, labels)
    text, kept = dict(rows), Counter()
    for r in quality.quality_rules(docs, trees).collect():
        raw = np.frombuffer((text[r["doc_id"]] or "").encode(), np.uint8)
        st = quality.statistics(raw, np.array([0, len(raw)]))
        p = 1 / (1 + exp(-walked(trees, [float(st[f][0]) for f in quality.FEATURES])))
        assert abs(r["score"] - p) < 1e-9 and r["kept"] == (not r["base_failed"] and p >= 0.5)
        kept[r["kept"]] += 1
    assert kept[True] > 5 and kept[False] > 5


def test_digests_of_rows_read_back_in_pieces(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} <|im_end|>" * (1 + t)) for c in (1, 2, None) for t in range(40)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(conv)
    want = sorted(map(str, chat.conversation_digests(formatted, in_order=True).collect()))
    formatted.repartition(7).write.parquet(str(tmp_path / "f"))
    again = spark.read.parquet(str(tmp_path / "f"))
    assert sorted(map(str, chat.conversation_digests(again).collect())) == want and len(want) == 3
    with pytest.raises(Exception, match="out of place"):
        chat.conversation_digests(again.where("position <> 3")).collect()
    with pytest.raises(Exception, match="out of place"):
        chat.conversation_digests(again.union(again)).collect()


def test_counts_hold_bounded_bytes(monkeypatch):
    monkeypatch.setattr(wordpiece, "CACHE", 100)
    c = wordpiece.Counts(wordpiece.Automaton(["a", "b", "ab"]))
    for k in range(500):
        word = bytes(97 + (k >> j) % 2 for j in range(9)) + b"ab" * (k % 60)
        assert c[word] == c.automaton.count(word.decode())
        assert sum(map(len, c)) <= 100 + wordpiece.LONGEST and all(len(w) <= wordpiece.LONGEST for w in c)


def test_release_keeps_what_is_read(spark):
    since = common.mark()
    a = common.materialise(spark.range(5).toDF("x"), "a")
    b = common.materialise(a.selectExpr("x + 1 AS x"), "b")
    common.release(since, keep=b)
    assert sorted(r[0] for r in b.collect()) == [1, 2, 3, 4, 5] and common.mark() == since + 1
    with pytest.raises(Exception):
        a.collect()
    common.release(since)
    assert common.mark() == since
