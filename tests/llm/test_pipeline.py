"""The pipeline stage by stage against brute force on the smallest tables."""

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from stratamol.llm import quality
from test_forms import walked
from test_jaccard import brute
from test_mixing import walk
from test_ops import WORD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram jaccard join", "mixing", "packing"]
    for df in stages[:-1]:
        assert tuple(df.columns) == corpus_pipeline.COLUMNS


def test_quality_stage(spark, stages):
    docs, kept = stages[0], {r["doc_id"] for r in stages[1].collect()}
    trees = quality.train_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for r in docs.collect():  # counted and walked one by one
        w = WORD.findall(r["text"] or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(w) < 50 or 2 * len(rep) > len(w):
            continue
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        st = quality.statistics(raw, np.array([0, len(raw)]))
        if walked(trees, [float(st[f][0]) for f in quality.FEATURES]) >= 0:
            want.add(r["doc_id"])
    assert kept == want
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    good = [i for i, q in labels.items() if q == 1 and words[i] >= 50]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and not any(i in kept for i, q in labels.items() if q == 0)


def test_jaccard_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {c for _, c in brute(rows).values()}
    assert Counter(r["doc_id"] for r in stages[2].collect()) == dict.fromkeys(want, 1)


def test_mixing_stage(stages):
    copies = {i: n for _, i, _, n in walk([(r["doc_id"], r["text"], r["source"]) for r in stages[2].collect()]) if n}
    assert Counter(r["doc_id"] for r in stages[3].collect()) == copies


def test_packing_stage(stages):
    n = Counter(r["doc_id"] for r in stages[3].collect())
    seen, spans = defaultdict(Counter), []
    for r in stages[4].collect():
        seen[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        spans.append((r["sequence_id"] * 2048 + r["offset"], r["length"]))
    assert set(seen) == set(n) and all(set(c.values()) == {n[d]} for d, c in seen.items())
    at = 0
    for a, k in sorted(spans):
        assert a == at
        at += k


def test_repeated_rows_and_nulls(spark, tmp_path):
    text = " ".join(f"word{i % 61} other{i % 7}" for i in range(60))
    rows = [(1, text, "en", "a", 1)] * 3 + [(2, text, "en", None, 1), (None, text, None, None, None), (3, None, "en", "a", 0), (4, " ".join(f"x{i} y{i * 7 % 101} and of the" for i in range(80)), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.jaccard_stage(spark, docs, SF).collect()]
    assert Counter(got) == {1: 1, 3: 1, 4: 1, None: 1}
    assert corpus_pipeline.run.__name__ == "run"
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0
