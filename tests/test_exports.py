"""Axes, arrays, chemistry hooks, downloads, rendered reports and ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamol.functions import hooks
from stratamol.operators import aggregates, chemistry, exports, ranking, reports, select
from stratamol.sources import formats


@pytest.fixture(scope="module")
def atoms(spark):
    rng = np.random.default_rng(2)
    rows = [(s, k, "CNOS"[k % 4], *map(float, rng.normal(0, 1 + s, 3))) for s in range(4) for k in range(30)] + [(9, 0, "C", 1.0, 2.0, 3.0)]
    return spark.createDataFrame(rows, "structure_id long, atom_idx int, element string, x double, y double, z double").cache()


def test_principal_axes(atoms):
    moments = {r["structure_id"]: r for r in aggregates.geometry(atoms).collect()}
    for r in aggregates.principal_axes(atoms).collect():
        g = moments[r["structure_id"]]
        t = np.array([[g["ixx"], g["ixy"], g["ixz"]], [g["ixy"], g["iyy"], g["iyz"]], [g["ixz"], g["iyz"], g["izz"]]])
        axes = np.array([r["axis1"], r["axis2"], r["axis3"]])
        assert np.allclose(axes @ axes.T, np.eye(3)) and r["m1"] <= r["m2"] <= r["m3"]
        for m, a in zip((r["m1"], r["m2"], r["m3"]), axes, strict=True):
            assert np.allclose(t @ a, m * a, atol=1e-6) and next(v for v in a if abs(v) > 1e-9) > 0
    assert aggregates.principal_axes(atoms.limit(0)).count() == 0


def test_arrays_and_batches(spark):
    nodes = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 0, 4.0), ("c", 0, 5.0), ("c", 1, 6.0)], "structure_id string, atom_idx int, m double")
    edges = spark.createDataFrame([("a", 0, 2, 0.5), ("c", 0, 1, 0.25)], "structure_id string, i int, j int, d double")
    arrays = exports.graph_arrays(nodes, edges, ["m"], ["d"])
    got = {r["structure_id"]: r for r in arrays.collect()}
    assert got["a"]["x"] == [[1.0], [2.0], [3.0]] and got["a"]["edge_index"] == [[0, 2], [2, 0]] and got["a"]["edge_attr"] == [[0.5], [0.5]]
    assert got["b"]["edge_index"] == [[], []] and got["b"]["edge_attr"] == []
    seen = list(exports.batches(arrays.orderBy("structure_id"), 2))
    assert [b["keys"] for b in seen] == [[("a",), ("b",)], [("c",)]]
    assert seen[0]["batch"].tolist() == [0, 0, 0, 1] and seen[1]["edge_index"].tolist() == [[0, 1], [1, 0]]


def test_hooks_are_used(spark, monkeypatch):
    monkeypatch.setattr(hooks, "_BACKENDS", {})
    df = spark.createDataFrame([(1, "CO", 5.0), (2, "OC", 50.0), (3, "CC", float("nan")), (4, None, None)], "id int, smiles string, mw double")
    for call in (lambda: chemistry.canonical(df, "smiles"), lambda: chemistry.scaffold_split(df, "smiles", 0.1, 0.1), lambda: chemistry.read_smiles(df, "id", "smiles"), lambda: chemistry.template_bonds(df), lambda: chemistry.net_charge(df, "pka"), lambda: chemistry.property_filter(df, {"logp": 1.0}, "smiles")):
        with pytest.raises(hooks.MissingBackend):
            call()
    hooks.register("canonical_smiles", lambda c: F.array_join(F.array_sort(F.split(c, "")), ""))
    assert sorted(r["id"] for r in chemistry.dedup_molecules(df, "smiles", ["id"]).collect()) == [1, 3, 4]
    hooks.register("murcko_scaffold", lambda c: F.substring(c, 1, 1))
    split = {r["id"]: r["split"] for r in chemistry.scaffold_split(df, "smiles", 0.25, 0.25).collect()}
    assert split[1] == split[3]
    hooks.register("smiles_descriptors", lambda c: F.create_map(F.lit("logp"), F.length(c).cast("double")))
    assert sorted(r["id"] for r in chemistry.property_filter(df, {"mw": 10.0, "logp": 2.0}, "smiles").collect()) == [1, 3, 4]
    hooks.register("conformer", lambda c: F.transform(F.split(c, ""), lambda e: F.struct(e.alias("element"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))))
    assert [(r["structure_id"], r["atom_idx"], r["element"]) for r in chemistry.read_smiles(df.where("id = 1"), "id", "smiles").collect()] == [(1, 0, "C"), (1, 1, "O")]
    hooks.register("residue_pka", lambda a: a.select(F.lit("s").alias("structure_id"), F.lit(1).alias("charge")))
    assert chemistry.net_charge(df, "pka").collect()[0]["net_charge"] == 4
    with pytest.raises(ValueError):
        chemistry.net_charge(df, "other")


def test_fetch(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "1abc.pdb").write_text("ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  0.00           C\nEND\n")
    base, folder = f"file://{tmp_path}/web", str(tmp_path / "cache")
    got = formats.fetch(spark, ["1ABC"], folder, base=base).collect()
    assert [(r["structure_id"], r["atom_name"], r["x"]) for r in got] == [("1abc", "CA", 1.0)]
    (tmp_path / "web" / "1abc.pdb").unlink()
    assert formats.fetch_files(["1abc"], folder, base=base) == [f"{folder}/1abc.pdb"]
    with pytest.raises(ValueError):
        formats.fetch_files(["2abc"], folder, base=base)
    with pytest.raises(ValueError):
        formats.fetch_files(["1abc"], folder, "xyz")


def test_render(spark):
    t = {"a<b": spark.createDataFrame([(1, "x|<y>", 0.5), (2, None, None)], "k int, s string, d double")}
    page, text = reports.render(t, "T & U", rows=1), reports.render(t, "T & U", html=False)
    assert "a&lt;b (the first 1 rows)" in page and "x|&lt;y&gt;" in page and "<td>2" not in page
    assert "| 1 | x\\|<y> | 0.5 |" in text and "| 2 |  |  |" in text


def test_numbers_over_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS g").repartition(6)
    got = sorted((r["n"], r["g"], r["id"]) for r in ranking.numbered(df, ["g", F.col("id").desc()], "n").collect())
    want = sorted(((k % 7, -k) for k in range(5000)))
    assert [(n, g, -i) for n, g, i in got] == [(n, *w) for n, w in enumerate(want)]
    assert ranking.numbered(df.limit(0), ["id"], "n").count() == 0


def test_poses_that_cannot_be_read(spark):
    good = "x\n\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 C   0  0\nM  END\n"
    files = spark.createDataFrame([("lib.sdf", (good + "$$$$\nbad\n$$$$\n" + good + "$$$$\n").encode())], "path string, content binary")
    rows = formats.poses_of(files).orderBy("pose_id").collect()
    assert [(r["pose_id"], r["n_atoms"], r["parse_error"] is None) for r in rows] == [(1, 1, True), (2, None, False), (3, 1, True)]


def test_parents(atoms):
    a = atoms.where("structure_id = 1")
    select.same_parent(atoms, a, a.where("atom_idx < 3"))
    with pytest.raises(ValueError):
        select.same_parent(a, atoms)
