"""Moves, measures, reports and CIF findings on small structures."""

import math

import pytest

from stratamol import cli
from stratamol.functions import geometry as geo
from stratamol.operators import reports, transforms
from stratamol.sources import formats

COLS = "structure_id string, atom_idx int, atom_name string, resname string, chain string, resid int, icode string, x double, y double, z double, element string, hetero boolean"


def square(spark):
    p = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    return spark.createDataFrame([("s", i, "CA", "ALA", "BA"[i % 2], i, "", *map(float, v), "CNCH"[i], False) for i, v in enumerate(p)], COLS)


def spots(df):
    return [tuple(round(r[c], 9) + 0.0 for c in "xyz") for r in df.orderBy("atom_idx").collect()]


def test_moves(spark):
    a = square(spark)
    assert spots(transforms.translated(a, (1, 2, 3)))[2] == (2, 3, 3)
    assert spots(transforms.centred(a)) == [(-0.5, -0.5, 0), (0.5, -0.5, 0), (0.5, 0.5, 0), (-0.5, 0.5, 0)]
    heavy = spots(transforms.centred(a, weighted=True))
    m = [12.011, 14.007, 12.011, 1.008]
    assert abs(sum(k * p[0] for k, p in zip(m, heavy))) < 1e-6
    assert spots(transforms.turned(a, "z", 90)) == [(1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 0)]
    assert transforms.turned(a.where("false"), "z", 90).count() == 0
    with pytest.raises(ValueError):
        transforms.turned(a, (0, 0, 0), 90)


def test_measures(spark):
    a = square(spark)
    got = [transforms.measured(a, list(range(n))).first() for n in (2, 3, 4)]
    assert [(r.kind, r.value, r.unit) for r in got] == [("distance", 1.0, "angstrom"), ("angle", 90.0, "degrees"), ("dihedral", 0.0, "degrees")]
    assert transforms.measured(a, [0, 9]).count() == 0
    with pytest.raises(ValueError):
        transforms.measured(a, [0])


def test_dihedral_with_an_end_on_the_axis(spark):
    rows = [(0.1, 0.1, 0.1, 0.3, 0.3, 0.3, 0.7, 0.7, 0.7, 1.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}{c} double" for p in "abcd" for c in "xyz"))
    assert df.select(geo.dihedral(*((geo.vec(p)) for p in "abcd")).alias("t")).first().t == 0.0


def test_summary_and_preflight(spark):
    a = square(spark)
    assert reports.summary_lines(a).first().summary == "s: 4 atoms | formula C2HN | chains A,B | size 1.0x1.0x0.0 A"
    codes = {r.code: set(r.workflows) for r in reports.preflight(a, deep=True).collect()}
    assert "missing_hydrogens" not in codes and codes["missing_backbone"] == {"graph", "descriptors", "contact_map"} and "truncated_sidechains" in codes
    assert {r.code for r in reports.preflight(a, "coarse_grain", deep=True).collect()} == set()
    with pytest.raises(ValueError):
        reports.preflight(a, "other")
    assert set(reports.structure_report(a)) == {"summary", "quality", "warnings", "descriptors", "contacts", "bonds", "ligands"}


def test_compared_structures(spark):
    a = square(spark)
    b = a.withColumn("x", a.x + (a.atom_idx == 3).cast("double") * 20)
    r = reports.compare_structures(a, b).first()
    assert (r.n_atoms_a, r.n_atoms_b, r.n_matched, r.max_deviation, r.worst) == (4, 4, 4, 20.0, "A:ALA3") and math.isclose(r.rmsd, 10.0)
    assert (r.common, r.lost, r.gained) == (3, 3, 0)


def test_ensemble_summary(spark):
    a = square(spark)
    from pyspark.sql import functions as F

    e = a.withColumn("model_id", F.lit(1)).unionByName(transforms.translated(a, (3, 4, 0)).withColumn("model_id", F.lit(2)))
    r = reports.ensemble_summary(e, align=False).first()
    assert r.n_models == 2 and math.isclose(r.max_rmsd, 5.0) and math.isclose(r.mean_rmsf, 2.5)


def test_pocket_text(spark):
    rows = [("s", 0, "CB", "PHE", "A", 7, "", 0.0, 0.0, 0.0, "C", False), ("s", 1, "OD1", "ASP", "A", 9, "", 0.0, 3.0, 0.0, "O", False), ("s", 2, "C1", "LIG", "B", 1, "", 3.0, 0.0, 0.0, "C", True), ("s", 3, "N1", "LIG", "B", 1, "", 0.0, 6.0, 0.0, "N", True)]
    text = reports.pocket_text(spark.createDataFrame(rows, COLS)).first().text
    assert text == "2 residues are near the ligand. Hydrophobic contacts: A:PHE7. Aromatic residues nearby: A:PHE7. Opposite charges: A:ASP9 (3.0 A)."


CIF = "data_x\nloop_\n_atom_site.type_symbol\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nC 1 2 3\nN 1 ? 3\n"


def test_cif_findings(spark, tmp_path):
    assert formats.cif_findings(CIF) == ["block x: row 2: _atom_site.cartn_y is '?'"]
    assert formats.cif_findings(CIF.replace("?", "2.5")) == []
    assert formats.cif_findings(CIF.replace("_atom_site.type_symbol\n", "").replace("C 1", "1").replace("N 1 ?", "1 2")) == ["block x: missing columns _atom_site.type_symbol", "no atom-site rows"]
    assert formats.cif_findings(CIF + "C 1\n")[0] == "block x: a row is cut short" and formats.cif_findings("", False) == ["no data block"]
    (tmp_path / "a.cif").write_text(CIF)
    (tmp_path / "b.mmcif").write_text(CIF.replace("?", "2"))
    (tmp_path / "c.txt").write_text("x")
    got = {r.source.rsplit("/", 1)[1]: r.valid for r in formats.validate_cif(spark, str(tmp_path)).collect()}
    assert got == {"a.cif": False, "b.mmcif": True}
    assert cli.run(cli.parser().parse_args(["validate-cif", str(tmp_path)]), spark).count() == 2
