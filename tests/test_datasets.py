"""Datasets, presets, hooks, the front end and streams."""

import os
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamol import cli
from stratamol.functions import hooks
from stratamol.operators import aggregates, datasets, graph, presets, residues
from stratamol.streaming import frames

DATA, FIX = Path(os.environ.get("STRATAMOL_STRUCTURES", "structures")), Path(os.environ.get("STRATAMOL_EDGE_FILES", "edge_files"))
need = pytest.mark.skipif(not DATA.exists(), reason="needs the structure files")


@need
def test_build_dataset(spark, tmp_path):
    labels = spark.createDataFrame([("1shg", "1.5"), ("1ubq", "x")], "id string, label string")
    d = datasets.build(spark, str(DATA), labels=labels, pattern="1*.pdb")
    g = {r["structure_id"]: r for r in d["graphs"].collect()}
    assert g["1shg"]["label"] == 1.5 and g["1ubq"]["label"] is None and g["1ubq"]["label_text"] == "x" and g["1fqy"]["n_nodes"] == 1661
    assert d["edges"].where("structure_id = '1shg'").count() == 481
    graph.save_dataset(d["nodes"], d["edges"], d["graphs"], str(tmp_path / "ds"))
    back = graph.load_dataset(spark, str(tmp_path / "ds"))
    assert back["nodes"].count() == d["nodes"].count() and set(back) == {"nodes", "edges", "graphs"}
    keys = datasets.content_keys(spark, str(DATA / "1shg.pdb"), "a").collect()
    assert len(keys[0]["cache_key"]) == 40 and keys[0]["cache_key"] != datasets.content_keys(spark, str(DATA / "1shg.pdb"), "b").first()["cache_key"]


def small(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([("s", i, ["N", "CA", "C", "O"][i % 4], "ALA", "A", i // 4, "", *map(float, rng.normal(0, 2, 3)), "C", False) for i in range(16)], "structure_id string, atom_idx int, atom_name string, resname string, chain string, resid int, icode string, x double, y double, z double, element string, hetero boolean")


def test_edges(spark):
    a = small(spark)
    knn = datasets.graph_edges(a, "knn", 3)
    near = datasets.graph_edges(a, "radius", 2.0)
    assert knn.count() >= 24 and near.where("distance >= 2").count() == 0
    far = datasets.graph_edges(a, "radius", 2.0, min_seq_sep=2)
    assert 0 <= far.count() < near.count()
    with pytest.raises(ValueError):
        datasets.graph_edges(a, "x")


def test_presets(spark):
    c = presets.catalogue(spark).collect()
    assert {r["category"] for r in c} == {"descriptors", "graph", "coarse-grain"} and all(r["n_features"] == len(r["features"]) for r in c)
    a = small(spark)
    d = aggregates.descriptors(a)
    assert set(presets.descriptor_names()) <= set(d.columns)
    v = presets.vectors(d, [*presets.descriptor_names(), "missing"]).first()["features"]
    assert len(v) == len(presets.descriptor_names()) + 1 and v[-1] == 0 and v[0] == 16
    r = presets.residue_node_features(residues.residues(a), "ml").first().asDict()
    assert r["residue_ALA"] == 1 and r["residue_UNK"] == 0 and r["residue_size"] == 4
    e = presets.residue_edge_features(residues.contact_map(a), "ca", "ml").first()
    assert e["contact_ca"] == 1 and e["contact_min"] == 0
    for bad in (lambda: presets.edge_names("x"), lambda: presets.catalogue(spark, "x")):
        with pytest.raises(ValueError):
            bad()


def test_prepare_and_hits(spark):
    t = spark.createDataFrame([(i, f"k{i // 2}", str(i) if i else "bad", "ab"[i % 2]) for i in range(20)], "id int, key string, mw string, g string")
    p = datasets.prepare(t, "id", "key", ["mw"])
    assert p.count() == 10 and p.where("id = 0").first()["mw"] is None
    poses = spark.createDataFrame([(0, -9.0, [1, 2, 3]), (1, -8.0, [1, 2, 3, 4]), (2, -7.0, [9]), (3, -6.0, [])], "pose_id int, s double, bits array<int>")
    got = datasets.diverse_hits(poses, "s", False, "bits", threshold=0.7).orderBy("rank").collect()
    assert [r["pose_id"] for r in got] == [0, 2, 3]
    j = datasets.envelope(spark.createDataFrame([(1.0, float("nan"))], "a double, b double"), "x", "y", ["w"]).first()["json"]
    assert '"b":null' in j and '"warnings":["w"]' in j


def test_hooks():
    with pytest.raises(hooks.MissingBackend):
        hooks.backend("canonical_smiles")
    with pytest.raises(ValueError):
        hooks.register("nothing", str)
    hooks.register("canonical_smiles", F.upper)
    assert hooks.backend("canonical_smiles") is F.upper and hooks.available() == ["canonical_smiles"]
    hooks._BACKENDS.clear()


@need
def test_front_end(spark):
    def rows(*argv):
        return cli.run(cli.parser().parse_args(list(argv)), spark).collect()

    assert [r["name"] for r in rows("dock-rank", str(FIX / "docking_poses.sdf"), "--score", "minimizedAffinity")] == ["ligA_pose1", "ligB_pose1", "ligA_pose2"]
    assert rows("contacts", str(DATA / "1shg.pdb"))[0]["n_contacts"] == 5222
    assert len(rows("binding-site", str(DATA / "3ptb.pdb"), "--ligand", "BEN")) == 13
    assert rows("qc", str(DATA / "1ubq.pdb"))[0]["n_waters"] == 58
    assert len(rows("presets")) > 10 and rows("prepare", str(DATA / "1ubq.pdb"))[0]["ready"]


@need
def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("1shg.pdb", "1ubq.pdb"):
        shutil.copy(DATA / n, tmp_path / "in" / n)
    s = frames.stream_atoms(spark, str(tmp_path / "in")).groupBy("structure_id").agg(F.count("*").alias("n"))
    frames.run_to_parquet(s, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r["structure_id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1shg": 472, "1ubq": 660}
