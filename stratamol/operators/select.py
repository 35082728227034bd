"""Selections and set algebra over atom tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elements import BACKBONE
from .spatial import cross_pairs

KEY = ["structure_id"]


def _among(col: Column, value, fold: bool = False) -> Column:
    values = list(value) if isinstance(value, Iterable) and not isinstance(value, str) else [value]
    return F.upper(col).isin([str(v).upper() for v in values]) if fold else col.isin(values)


def resid_condition(resid) -> Column:
    """One number, a list of numbers, or a pair as an inclusive range."""
    if isinstance(resid, tuple) and len(resid) == 2:
        return F.col("resid").between(*sorted(resid)) if resid[0] > resid[1] else F.col("resid").between(*resid)
    return _among(F.col("resid"), resid)


def residue_condition(selectors) -> Column:
    """Any of (chain, resid[, icode[, resname]]) with None as a wildcard; dicts name their parts."""
    names = ("chain", "resid", "icode", "resname")
    if isinstance(selectors, dict) or isinstance(selectors, tuple) and not isinstance(selectors[0], (tuple, dict)):
        selectors = [selectors]
    out = F.lit(False)
    for s in selectors:
        parts = s if isinstance(s, dict) else dict(zip(names, s, strict=False))
        one = F.lit(True)
        for k, v in parts.items():
            if v is not None:
                one = one & (F.upper(k) == str(v).upper() if k == "resname" else F.col(k) == v)
        out = out | one
    return out


def condition(element=None, chain=None, resname=None, atom_name=None, resid=None, icode=None, residue_id=None, hetero=None) -> Column:
    """All criteria given must hold; elements, residue and atom names fold case, chains and insertion codes don't."""
    c = F.lit(True)
    for name, value, fold in (("element", element, True), ("chain", chain, False), ("resname", resname, True), ("atom_name", atom_name, True), ("icode", icode, False)):
        if value is not None:
            c = c & _among(F.col(name), value, fold)
    if resid is not None:
        c = c & resid_condition(resid)
    if residue_id is not None:
        c = c & residue_condition(residue_id)
    if hetero is not None:
        c = c & (F.col("hetero") == bool(hetero))
    return c


def select(atoms: DataFrame, **criteria) -> DataFrame:
    return atoms.where(condition(**criteria))


def protein(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.col("hetero"))


def hetero_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.where("hetero")


def backbone(atoms: DataFrame) -> DataFrame:
    return select(atoms, atom_name=BACKBONE)


def alpha_carbons(atoms: DataFrame, exclude_hetero: bool = False) -> DataFrame:
    """Atoms named CA; calcium ions of that name too, unless excluded."""
    out = select(atoms, atom_name="CA")
    return protein(out) if exclude_hetero else out


def select_within(atoms: DataFrame, targets: DataFrame, radius: float, key: list[str] = KEY) -> DataFrame:
    """Atoms with any target nearer than radius in the same structure."""
    near = cross_pairs(atoms, targets, radius, key).select(*key, F.col("i").alias("atom_idx")).distinct()
    return atoms.join(near, [*key, "atom_idx"], "left_semi")


def same_parent(parent: DataFrame, *subsets: DataFrame, key: list[str] = KEY) -> None:
    """Raises unless every row of the subsets is an atom of parent, as set algebra needs; one narrow anti-join each."""
    for s in subsets:
        if subtract(s.select(*key, "atom_idx"), parent, key).limit(1).count():
            raise ValueError("set algebra needs subsets of one table of atoms")


def intersect(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    return a.join(b.select(*key, "atom_idx").distinct(), [*key, "atom_idx"], "left_semi")


def union(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    return a.unionByName(subtract(b, a, key))


def subtract(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    return a.join(b.select(*key, "atom_idx").distinct(), [*key, "atom_idx"], "left_anti")


def complement(a: DataFrame, parent: DataFrame | None, key: list[str] = KEY) -> DataFrame:
    """Parent's atoms that a lacks; a table without a parent has an empty complement."""
    return a.limit(0) if parent is None else subtract(parent, a, key)


def take(atoms: DataFrame, picks: list[int], key: list[str] = KEY) -> DataFrame:
    """Atoms by index, in the order given and as often, renumbered."""
    order = F.posexplode(F.array(*[F.lit(int(k)) for k in picks]))
    p = atoms.select(*key).distinct().select(*key, order.alias("new_idx", "atom_idx"))
    return atoms.join(p, [*key, "atom_idx"]).withColumn("atom_idx", F.col("new_idx")).drop("new_idx")


def subset_bonds(bonds: DataFrame, kept: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Bonds with both ends kept. kept: (key, atom_idx, new_idx)."""
    a = kept.select(*key, F.col("atom_idx").alias("i"), F.col("new_idx").alias("ni"))
    b = kept.select(*key, F.col("atom_idx").alias("j"), F.col("new_idx").alias("nj"))
    both = bonds.join(a, [*key, "i"]).join(b, [*key, "j"])
    return both.withColumns({"i": F.least("ni", "nj"), "j": F.greatest("ni", "nj")}).drop("ni", "nj")


_RANGE = re.compile(r"^(-?\d+)[-:](-?\d+)$")


def parse_value(key: str, value: str):
    """A selection's value: 10-20 or 10:20 as ranges, comma lists, A:10:A:SER residues, booleans for hetero."""
    if key == "resid":
        if m := _RANGE.match(value):
            return int(m[1]), int(m[2])
        return [int(v) for v in value.split(",")]
    if key == "residue_id":
        chain, resid, *rest = value.split(":")
        return (chain or None, int(resid), *[r or None for r in rest])
    if key == "hetero":
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"hetero is true or false, not {value!r}")
        return value.lower() in ("true", "1", "yes")
    return value.split(",")


def parse_selection(text: str) -> Column:
    """key=value and key=value ...; there is no or."""
    out: dict = {}
    for part in re.split(r"\s+and\s+", text.strip(), flags=re.I):
        key, eq, value = part.partition("=")
        key = key.strip().lower()
        if not eq or key not in ("element", "chain", "resname", "atom_name", "resid", "icode", "residue_id", "hetero"):
            raise ValueError(f"not a selection: {part!r}")
        out[key] = parse_value(key, value.strip())
    return condition(**out)
