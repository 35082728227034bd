"""Operators against plain numpy on small structures."""

import math
import os
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamol.functions import geometry as geo
from stratamol.functions import scalars
from stratamol.operators import aggregates, ensemble, graph, quality, ranking, residues, secondary, select, spatial, surface
from stratamol.sources import formats

DATA = Path(os.environ.get("STRATAMOL_STRUCTURES", "structures"))
COLS = "structure_id string, atom_idx int, atom_name string, resname string, chain string, resid int, icode string, x double, y double, z double, element string, hetero boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, COLS)


def cloud(spark, n=60, seed=0, names=("A", "B"), spread=4.0):
    rng = np.random.default_rng(seed)
    rows, points = [], {}
    for s in names:
        p = rng.normal(0, spread, (n, 3))
        points[s] = p
        rows += [(s, i, ["N", "CA", "C", "O"][i % 4], ["ALA", "LYS", "ASP"][i // 4 % 3], "AB"[i >= n // 2], i // 4, "", *map(float, p[i]), "NCCOHS"[i % 6], False) for i in range(n)]
    return table(spark, rows), points


def test_pairs_and_cells(spark):
    a, pts = cloud(spark)
    want = {(s, i, j) for s, p in pts.items() for i, j in combinations(range(len(p)), 2) if ((p[i] - p[j]) ** 2).sum() < 9}
    for cells in (False, True):
        assert {(r["structure_id"], r["i"], r["j"]) for r in spatial.pairs(a, 3.0, cells=cells).collect()} == want
    assert spatial.pairs(a, 0).count() == 0


def test_periodic(spark):
    a, pts = cloud(spark, 30)
    box = np.array([7.0, 8.0, 9.0])
    want = set()
    for s, p in pts.items():
        for i, j in combinations(range(len(p)), 2):
            d = p[i] - p[j]
            d -= box * np.rint(d / box)
            if (d**2).sum() < 4:
                want.add((s, i, j))
    assert {(r["structure_id"], r["i"], r["j"]) for r in spatial.pairs(a, 2.0, lengths=tuple(box)).collect()} == want
    rows = geo.lattice(7, 8, 9, 90, 90, 90)
    assert np.allclose(rows, np.diag(box))
    d = a.limit(1).select(*(v.alias(k) for k, v in zip("abc", geo.nearest_image_cell((F.lit(6.0), F.lit(-5.0), F.lit(1.0)), rows), strict=True))).first()
    assert np.allclose(tuple(d), (-1, 3, 1))


def test_shape(spark):
    a, pts = cloud(spark)
    for r in aggregates.shape_descriptors(a).collect():
        p = pts[r["structure_id"]]
        m = np.array([{"N": 14.007, "C": 12.011, "O": 15.999, "H": 1.008, "S": 32.06}["NCCOHS"[i % 6]] for i in range(len(p))])
        q = p - (m[:, None] * p).sum(0) / m.sum()
        inertia = (m * (q**2).sum(1)).sum() * np.eye(3) - (m[:, None] * q).T @ q
        assert np.allclose([r["m1"], r["m2"], r["m3"]], np.linalg.eigvalsh(inertia))
        lam = np.linalg.eigvalsh((m[:, None] * q).T @ q / m.sum())
        assert math.isclose(r["asphericity"], lam[2] - (lam[0] + lam[1]) / 2, rel_tol=1e-9) and math.isclose(r["acylindricity"], lam[1] - lam[0], rel_tol=1e-6)


def test_angles_and_rotation(spark):
    d = spark.range(1)
    p = [tuple(F.lit(float(x)) for x in v) for v in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))]
    r = d.select(geo.angle(*p[:3]).alias("a"), geo.dihedral(*p).alias("d"), *(v.alias(k) for k, v in zip("xyz", geo.rotated(p[1], p[0], (0, 0, 2), 90), strict=True))).first()
    assert math.isclose(r["a"], 90) and abs(r["d"]) < 1e-9 and np.allclose((r["x"], r["y"], r["z"]), (0, 1, 0))


def kabsch(p, q):
    p, q = p - p.mean(0), q - q.mean(0)
    u, s, vt = np.linalg.svd(p.T @ q)
    d = np.sign(np.linalg.det(u @ vt))
    r = u @ np.diag([1, 1, d]) @ vt
    return np.sqrt(((p @ r - q) ** 2).sum(1).mean())


def test_ensemble(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 3, (9, 3))
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    models = {1: base, 2: base @ turn + 5, 3: base + rng.normal(0, 0.3, base.shape), 4: base * [1, 1, -1]}
    a = spark.createDataFrame([("s", m, i, *map(float, p[i])) for m, p in models.items() for i in range(9)], "structure_id string, model_id int, atom_idx int, x double, y double, z double")
    for r in ensemble.rmsd_matrix(a).collect():
        assert abs(r["rmsd"] - kabsch(models[r["model_a"]], models[r["model_b"]])) < 1e-5
    back = {(r["model_id"], r["atom_idx"]): (r["x"], r["y"], r["z"]) for r in ensemble.aligned(a).collect()}
    assert np.allclose([back[2, i] for i in range(9)], base)
    c = {r["model_id"]: r for r in ensemble.cluster(ensemble.rmsd_matrix(a), n_clusters=2).collect()}
    assert c[1]["cluster"] == c[2]["cluster"] == c[3]["cluster"] != c[4]["cluster"]
    cc = {(r["i"], r["j"]): r["correlation"] for r in ensemble.cross_correlation(a).collect()}
    assert all(cc[i, i] == 1 for i in range(9)) and all(abs(v) <= 1 + 1e-9 for v in cc.values())
    assert ensemble.check_models(a).count() == 0


def brute_structure(N, CA, C, O, chain):
    n = len(N)
    link = [False] + [chain[i] == chain[i - 1] and np.linalg.norm(C[i - 1] - N[i]) < 2.5 for i in range(1, n)]
    hb = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and link[j] and np.linalg.norm(CA[i] - CA[j]) < 9:
                co = C[j - 1] - O[j - 1]
                h = N[j] + co / np.linalg.norm(co)
                inv = [1 / np.linalg.norm(v) for v in (O[i] - N[j], C[i] - h, O[i] - h, C[i] - N[j])]
                hb[i, j] = 0.42 * 0.2 * 332 * (inv[0] + inv[1] - inv[2] - inv[3]) < -0.5
    return hb


@pytest.mark.skipif(not DATA.exists(), reason="needs the structure files")
def test_secondary_structure(spark):
    a = formats.read_atoms(spark, str(DATA), pattern="*.pdb").cache()
    b = secondary.backbone(a).where("structure_id = '1ubq'").orderBy("r").collect()
    pts = {n: np.array([[r[f"{n}_{x}"] for x in "xyz"] for r in b]) for n in ("n", "ca", "c", "o")}
    hb = brute_structure(pts["n"], pts["ca"], pts["c"], pts["o"], [r["chain"] for r in b])
    got = secondary.hydrogen_bonds(secondary.backbone(a)).where("structure_id = '1ubq'").collect()
    assert {(r["i"], r["j"]) for r in got} == set(zip(*map(list, np.nonzero(hb)), strict=True))
    codes = secondary.assign(a)
    s = {r["structure_id"]: r for r in secondary.summary(codes).where("chain is null").collect()}
    assert s["1fqy"]["helix_share"] > 0.6 and s["1fqy"]["strand"] == 0 and s["1shg"]["strand_share"] > 0.35 and s["1shg"]["helix_share"] < 0.1
    ubq = "".join(r["code"] for r in codes.where("structure_id = '1ubq'").orderBy("r").collect())
    assert ubq[22:33].count("H") >= 10 and ubq[1:6].count("E") >= 4
    t = secondary.torsions(a).where("structure_id = '1ubq'").orderBy("r").collect()
    assert t[0]["phi"] is None and -75 < t[26]["phi"] < -50 and abs(abs(t[26]["omega"]) - 180) < 12
    assert secondary.per_atom(a, codes).where("structure_id = '1ubq' and code = 'H'").count() > 60
    seg = secondary.segments(codes).where("structure_id = '1ubq' and code = 'H'").orderBy("first").first()
    assert seg["n"] >= 10
    top = {r["structure_id"]: r for r in quality.topology(a).collect()}
    assert top["1ubq"]["n_missing_backbone"] == 0 and top["1ubq"]["n_breaks"] == 0
    assert quality.readiness(quality.topology(a)).where("structure_id = '1ubq'").first()["ready"]


def test_surface(spark):
    a = table(spark, [("s", 0, "C", "ALA", "A", 1, "", 0.0, 0.0, 0.0, "C", False), ("s", 1, "O", "ALA", "A", 1, "", 1.2, 0.0, 0.0, "O", False), ("t", 0, "C", "ALA", "A", 1, "", 0.0, 0.0, 0.0, "C", False)])
    got = {(r["structure_id"], r["atom_idx"]): r["sasa"] for r in surface.atom_surface(a).collect()}
    pts = np.array(geo.fibonacci_sphere(192))
    full = 4 * math.pi * 3.1**2
    open_c = (((pts * 3.1 - [1.2, 0, 0]) ** 2).sum(1) >= 2.92**2).sum()
    assert math.isclose(got["t", 0], full) and math.isclose(got["s", 0], full * open_c / 192)
    assert np.allclose(np.linalg.norm(pts, axis=1), 1) and np.allclose(pts.mean(0), 0, atol=0.01)


def test_graph(spark):
    a, _ = cloud(spark, 24, names=("A",))
    e = spatial.pairs(a, 4.0).select("structure_id", "i", "j")
    n = a.groupBy("structure_id").agg(F.count("*").cast("int").alias("n"))
    edges = [(r["i"], r["j"]) for r in e.collect()]
    adj = np.zeros((24, 24))
    for i, j in edges:
        adj[i, j] = adj[j, i] = 1
    p = adj / np.maximum(adj.sum(1), 1)[:, None]
    walk = {(r["atom_idx"], r["step"]): r["p"] for r in graph.random_walk(e, 3).collect()}
    pe = {r["atom_idx"]: r["pe"] for r in graph.encodings(e, n, 3, "walk").collect()}
    m = p.copy()
    for t in (1, 2, 3):
        assert np.allclose([walk.get((k, t), 0) for k in range(24)], np.diag(m)) and np.allclose([pe[k][t - 1] for k in range(24)], np.diag(m))
        m = m @ p
    lap = {r["atom_idx"]: r["pe"] for r in graph.encodings(e, n, 24).collect()}
    v = np.array([lap[k] for k in range(24)])
    full = graph.laplacian(24, *np.array(edges).T)
    assert np.allclose(v.T @ v, np.eye(24), atol=1e-8) and np.allclose(np.sort(np.diag(v.T @ full @ v)), np.linalg.eigvalsh(full))
    nodes, more = graph.with_global_node(graph.node_features(a), e, ["mass"])
    assert nodes.count() == 25 and more.count() == len(edges) + 48
    assert graph.guess_bond_orders(["C", "O", "O"], [(0, 1), (0, 2)]) == [2.0, 2.0] and graph.guess_bond_orders(["C", "C"], [(0, 1)]) == [3.0]


def test_ranking(spark):
    m = np.array([[0.0, 0], [0, 0], [10, 0], [0, 10], [5, 5]])
    assert ranking.maxmin(m, 3)[0] in (0, 1, 2, 3) and len(set(ranking.maxmin(m, 5))) == 5 and ranking.maxmin(m, 0) == []
    s = ranking.random_split(10, 0.2, 0.1)
    assert sorted(sum(s.values(), [])) == list(range(10)) and (len(s["test"]), len(s["validation"])) == (2, 1)
    assert ranking.diversity_split(m, 0.2, 0.2).count("test") == 1
    assert ranking.butina([{1, 2}, {0}, {0}, set()]) == [[0, 1, 2], [3]]
    d = spark.createDataFrame([(i, "abcd"[min(3, i // 4)]) for i in range(12)], "id int, g string")
    got = ranking.group_split(d, "g", 0.25, 0.25).groupBy("g").agg(F.count_distinct("split").alias("n")).collect()
    assert all(r["n"] == 1 for r in got)
    assert ranking.higher_is_better("CNNscore") == (True, False) and ranking.higher_is_better("x") == (False, True) and ranking.detect_field(["foo", "CNNscore", "Vina"]) == "Vina"
    p = spark.createDataFrame([(1, "a_pose1", -8.4, 0.91), (2, "a_pose2", -6.9, 0.55), (3, "b_pose1", -7.2, 0.73)], "pose_id int, name string, affinity double, cnn double")
    c = ranking.consensus(p, {"affinity": False, "cnn": True}, "name", "pose_id").orderBy("rank").collect()
    assert [(r["name"], r["mean_rank"]) for r in c] == [("a_pose1", 1.0), ("b_pose1", 2.0), ("a_pose2", 3.0)]
    best = ranking.rank_poses(p.withColumn("lig", scalars.ligand_key("name")), "affinity", False, ["pose_id"], ligand="lig").orderBy("rank").collect()
    assert [(r["lig"], r["rank"]) for r in best] == [("a", 1), ("b", 2)]
    assert p.select(ranking.tanimoto(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("t")).first()["t"] == 1 / 3


def test_selection(spark):
    a, _ = cloud(spark, 20, names=("A",))
    assert a.where(select.parse_selection("resname=ala and resid=0-1 and chain=A")).count() == 4
    assert a.where(select.parse_selection("residue_id=A:1")).count() == 4
    for bad in ("foo=1", "resid", "hetero=maybe"):
        with pytest.raises(ValueError):
            select.parse_selection(bad)
    t = select.take(a, [3, 3, 1]).orderBy("atom_idx").collect()
    assert [r["atom_name"] for r in t] == ["O", "O", "CA"]
    assert select.complement(a, None).count() == 0
    kept = a.where("atom_idx in (1, 3)").selectExpr("structure_id", "atom_idx", "case atom_idx when 1 then 0 else 1 end as new_idx")
    bonds = spark.createDataFrame([("A", 1, 3), ("A", 0, 1)], "structure_id string, i int, j int")
    assert [(r["i"], r["j"]) for r in select.subset_bonds(bonds, kept).collect()] == [(0, 1)]


def test_two_chains(spark):
    a = table(spark, [("s", 0, "CA", "ALA", "A", 1, "", 0.0, 0.0, 0.0, "C", False), ("s", 1, "CA", "ALA", "A", 2, "", 4.0, 0.0, 0.0, "C", False), ("s", 2, "CA", "ALA", "B", 1, "", 6.0, 0.0, 0.0, "C", False)])
    got = {(r["side"], r["resid"]): r["n_atom_contacts"] for r in residues.interface(a, "A", "B", 5.0).collect()}
    assert got == {("a", 2): 1, ("b", 1): 1}
    assert [tuple(r)[1:] for r in residues.chains(a).orderBy("position").collect()] == [("A", 0), ("B", 1)]


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.residue_label(F.lit("A"), F.lit("ASP"), F.lit(100), F.lit("A")).alias("a"), scalars.listed(F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("b"), scalars.listed(F.array(F.lit("x"))).alias("c"),
        scalars.stem(F.lit("/d/x.y.pdb.gz")).alias("d"), scalars.extension(F.lit("/d/x.CIF.gz")).alias("e"), scalars.sdf_tag(F.lit("> 1 <a<b>> (2)>")).alias("f"), scalars.number(F.lit("1e3")).alias("g"), scalars.number(F.lit("x")).alias("h"),
        scalars.simplified_structure(F.lit("HGIEBTS-")).alias("i"), scalars.acid_base_charge(F.lit("acid"), F.lit(4.0), F.lit(7.0)).alias("j"),
    ).first()
    assert tuple(r)[:5] == ("A:ASP100A", "x, y, and z", "x", "x.y", ".cif") and tuple(r)[5:] == ("a<b>> (2)", 1000.0, None, "HHHEE---", -1)
