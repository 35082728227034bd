"""Small structures are not sent to many cells, larger ones still are, to the same results."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamol.operators import aggregates, datasets, graph, residues, spatial
from stratamol.plans import catalog, extra  # noqa: F401

SF = "/root/testdata/sf0.001"
COLS = "structure_id string, atom_idx int, atom_name string, resname string, chain string, resid int, icode string, x double, y double, z double, element string, hetero boolean"


def grid(spark, sizes=(3, 20, 60, 1), seed=1):
    """Structures on whole numbers, with many equal distances and equal places."""
    rng = np.random.default_rng(seed)
    pts = {f"s{k}": rng.integers(0, 6, (n, 3)).astype(float) for k, n in enumerate(sizes)}
    rows = [(s, i, ["N", "CA", "C", "NZ"][i % 4], ["ALA", "LYS", "ASP", "LIG"][i // 4 % 4], "AB"[i % 8 > 5], i // 4, "", *map(float, p[i]), "NCOS"[i % 4], i // 4 % 4 == 3) for s, p in pts.items() for i in range(len(p))]
    return spark.createDataFrame(rows, COLS), pts


def rows(df):
    return sorted(map(tuple, df.collect()))


def brute_nearest(pts, k):
    out = set()
    for s, p in pts.items():
        d2 = ((p[:, None] - p[None]) ** 2).sum(2)
        for i in range(len(p)):
            out |= {(s, min(i, j), max(i, j), d2[i, j]) for j in sorted((j for j in range(len(p)) if j != i), key=lambda j: (d2[i, j], j))[:k]}
    return sorted(out)


@pytest.mark.parametrize("packed", [0, 20, 4096])
def test_nearest(spark, monkeypatch, packed):
    a, pts = grid(spark)
    monkeypatch.setattr(spatial, "PACKED", packed)
    monkeypatch.setattr(spatial, "HELD", 30)
    monkeypatch.setattr(spatial, "STRIP", 7)
    for k in (1, 4):
        assert rows(spatial.nearest(a, k, distances=True)) == brute_nearest(pts, k)
    assert spatial.nearest(a.where("false"), 4).count() == 0
    unnamed = a.unionByName(a.where("structure_id = 's0'").withColumn("structure_id", F.lit(None).cast("string")))
    assert rows(spatial.nearest(unnamed, 4)) == rows(spatial.nearest(a, 4))
    gone = a.withColumn("x", F.when(F.col("atom_idx") != 2, F.col("x")))  # a place without a number
    got = rows(spatial.nearest(gone, 4))
    monkeypatch.setattr(spatial, "PACKED", 0)
    assert got == rows(spatial.nearest(gone, 4))


@pytest.mark.parametrize("small", [0, 20, 128])
def test_pairs_by_size(spark, monkeypatch, small):
    a, _ = grid(spark)
    whole = a.where("structure_id <> 's1' or atom_idx < 8")
    monkeypatch.setattr(spatial, "SMALL", small)
    for f in (lambda cells: spatial.pairs(a, 3.0, cells=cells, extra=["element"]), lambda cells: spatial.cross_pairs(whole, a, 3.0, cells=cells, extra=["element"], other=["resid"], inclusive=True)):
        got = f(True)
        assert rows(got) == rows(f(False).select(got.columns))


def test_radius_edges_in_one_pass(spark):
    a, _ = grid(spark)
    none = spark.createDataFrame([], "structure_id string, i int, j int")  # explicit bonds, but no structure has any: the joined form
    for sep in (0, 2):
        got = datasets.graph_edges(a, "radius", 4.0, min_seq_sep=sep)
        assert got.count() and rows(got) == rows(datasets.graph_edges(a, "radius", 4.0, none, sep).select(got.columns))


def test_interactions_of_carried_ends(spark):
    a, _ = grid(spark)
    got = rows(graph.interactions(a, residues.contact_map(a, 6.0, carry=graph.ENDS)))
    assert got and got == rows(graph.interactions(a, residues.contact_map(a, 6.0)))


def test_descriptors_count_elements(spark):
    a, _ = grid(spark)
    counts = aggregates.element_counts(a)
    assert rows(aggregates.descriptors(a).select(counts.columns)) == rows(counts)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")
@pytest.mark.parametrize("name, most", [("interaction_columns", 3), ("nearest_large", 2), ("radius_graph", 1), ("residue_interactions", 3), ("descriptors", 4), ("pocket_chemistry", 1)])
def test_shuffles(spark, name, most):
    """Atoms are shuffled by their structure, once, and not once for each neighbouring cell."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.QUERIES[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    lines = [x for x in plan.splitlines() if " Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert len(lines) <= most and "explode" not in plan, plan
