"""The pipeline's stages on rows where they once did less than the whole job."""

import random
from collections import Counter

import corpus_pipeline
from stratamol.llm import common, mixing
from test_jaccard import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_of_five_words(spark):
    rng, rows = random.Random(3), []
    for g, (n, e) in enumerate([(500, 11), (1000, 21), (500, 14), (60, 1), (40, 2)]):
        words = [f"g{g}w{i}" for i in range(n + 4)]
        other = list(words)
        for i in range(e):  # every changed word costs five shingles of its own
            other[4 + i * ((n - 4) // e) + rng.randrange(3)] = f"new{g}x{i}"
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(other))]
    want = {c for _, c in brute(rows, 5, 80).values()}
    assert {0, 10, 20, 21} <= want and not {1, 11} & want  # 0.802 and 0.810 in five words, 0.838 and 0.845 in four
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert Counter(r["doc_id"] for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()) == dict.fromkeys(want, 1)


def test_mix_keeps_rows_without_id_and_repeated_ids(spark):
    ids = [None if i % 3 == 0 else i // 4 if i % 4 < 2 else i for i in range(240)]  # some ids stand twice, with other texts
    rows = [(k, f"t{i} " * (1 + i % 13), "en", None if i % 5 == 0 else "ab"[i % 2], i) for i, k in enumerate(ids)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    of, n_words, taken = {(r[1], r[4]): r for r in rows}, {r[1]: len(r[1].split()) for r in rows}, Counter()
    got = Counter(map(tuple, corpus_pipeline.mixing_stage(spark, docs, "").collect()))
    assert all(of[r[1], r[4]] == r and n <= 3 for r, n in got.items())
    for r, n in got.items():
        taken[r[3]] += n * n_words[r[1]]
    mix = mixing.pareto_mix(docs).collect()
    assert sum(got.values()) == sum(r["copies"] for r in mix)
    for r in mix:
        assert abs(taken[r["source"]] - r["target"]) <= 13
    assert any(r[0] is None for r in got)


def test_near_copies_by_row(spark):
    def text(g, changed=0):
        return " ".join(f"new{g}x{i}" if i < changed else f"g{g}w{i}" for i in range(120))

    rows = [(1, text(1)), (1, text(2)), (2, text(1, 2)), (2, text(3)), (3, text(4)), (3, text(4)), (4, None), (4, None), (5, " "), (None, text(3)), (None, text(5))]
    want = [(1, text(1)), (1, text(2)), (2, text(3)), (3, text(4)), (4, None), (5, " "), (None, text(3)), (None, text(5))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(3)
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()) == Counter(want)


def test_near_copies_without_moving_texts(spark, tmp_path, monkeypatch):
    def text(g, changed=0):
        return " ".join(f"new{g}x{i}" if i < changed else f"g{g}w{i}" for i in range(120))

    rows = [(i // 2 if i % 5 else None, text(i % 40, i % 3), "en", "ab"[i % 2], 0) for i in range(300)] + [(7, None, "en", "a", 0)] * 2
    own = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_stage(spark, own, "").collect())
    assert 0 < sum(want.values()) < len(rows)
    own.write.parquet(str(tmp_path / "a b"))
    docs, written = spark.read.parquet(str(tmp_path / "a b")), []
    assert len(docs.inputFiles()) > 1
    kept = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: (written.append((name, df.columns)), kept(df, name))[1])
    monkeypatch.setattr(corpus_pipeline, "materialise", common.materialise)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.jaccard_stage(spark, docs, "")
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(corpus_pipeline, "BITMAPS", 0)
        assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written and not any("text" in columns for _, columns in written)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_rows_of_a_file_read_twice(spark, tmp_path):
    spark.createDataFrame([(1, "one", "en", "a", 0), (2, "two", "en", "a", 0)], SCHEMA).write.parquet(path := str(tmp_path / "twice"))
    docs = spark.read.parquet(path, path)
    n = docs.count()
    got = common.row_named(docs, corpus_pipeline.COLUMNS)
    assert len({r["row"] for r in got.collect()}) == got.count() == n
