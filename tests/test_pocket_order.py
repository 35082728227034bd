"""Texts on pockets name residues of one chain and number in the order of their atoms, as the SQL does in one thread."""

from stratamol.operators import reports, residues
from test_reports import COLS


def test_equal_places_by_atoms(spark):
    rows = [("s", 0, "N", "PHE", "N", 6, "", 0.0, 0.0, 0.0, "N", False), ("s", 1, "N", "GLY", "N", 6, "", 1.0, 0.0, 0.0, "N", False), ("s", 2, "N", "ALA", "N", 5, "", 2.0, 0.0, 0.0, "N", False), ("s", 3, "C", "PHE", "N", 6, "", 0.5, 0.0, 0.0, "C", False), ("s", 4, "N1", "LIG", "B", 1, "", 3.0, 0.0, 0.0, "N", True)]
    atoms = spark.createDataFrame(rows, COLS)
    text = "3 residues are near the ligand. Close polar atoms: N:ALA5 (1.0 A), N:PHE6 (3.0 A), and N:GLY6 (2.0 A)."
    assert reports.pocket_text(atoms).first().text == text
    assert "first_atom" not in residues.pocket(atoms).columns
    assert {(r.resname, r.first_atom) for r in residues.pocket(atoms, first_atom=True).collect()} == {("PHE", 0), ("GLY", 1), ("ALA", 2)}
