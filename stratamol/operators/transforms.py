"""Rigid moves of whole structures and measures between chosen atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import mass
from ..functions.geometry import angle, dihedral, distance, rotated, vec
from .spatial import KEY

AXES = {"x": (1.0, 0.0, 0.0), "y": (0.0, 1.0, 0.0), "z": (0.0, 0.0, 1.0)}
KINDS = {2: ("distance", distance, "angstrom"), 3: ("angle", angle, "degrees"), 4: ("dihedral", dihedral, "degrees")}


def translated(atoms: DataFrame, vector: tuple[float, float, float]) -> DataFrame:
    return atoms.withColumns({c: F.col(c) + float(v) for c, v in zip("xyz", vector, strict=True)})


def _with_centre(atoms: DataFrame, weighted: bool, key: list[str]) -> DataFrame:
    """Atoms with the centre of their structure in __x, __y, __z: one aggregation and a join on the key, so that a large
    structure meets no single task."""
    m = mass("element") if weighted else F.lit(1.0)
    centre = atoms.groupBy(*key).agg(*((F.sum(m * F.col(c)) / F.sum(m)).alias(f"__{c}") for c in "xyz"))
    return atoms.join(centre, key)


def centred(atoms: DataFrame, weighted: bool = False, key: list[str] = KEY) -> DataFrame:
    """Each structure with its centroid, or with weighted its centre of mass, at the origin."""
    a = _with_centre(atoms, weighted, key)
    return a.withColumns({c: F.col(c) - F.col(f"__{c}") for c in "xyz"}).select(*atoms.columns)


def turned(atoms: DataFrame, axis: str | tuple[float, float, float], degrees: float, key: list[str] = KEY) -> DataFrame:
    """Each structure turned about an axis through its centroid."""
    a = _with_centre(atoms, False, key)
    p = rotated(vec(), vec("__"), AXES.get(axis, axis) if isinstance(axis, str) else axis, degrees)
    return a.withColumns(dict(zip("xyz", p, strict=True))).select(*atoms.columns)


def measured(atoms: DataFrame, chosen: list[int], key: list[str] = KEY) -> DataFrame:
    """(key, kind, value, unit): the distance, angle or dihedral of 2, 3 or 4 atoms by index; structures without all of
    them are left out, undefined angles are null."""
    if len(chosen) not in KINDS:
        raise ValueError("2 atoms make a distance, 3 an angle, 4 a dihedral")
    kind, measure, unit = KINDS[len(chosen)]
    at = F.col("atom_idx")
    cols = [F.max(F.when(at == i, F.col(c))).alias(f"p{k}_{c}") for k, i in enumerate(chosen) for c in "xyz"]
    g = atoms.where(at.isin(*chosen)).groupBy(*key).agg(*cols)
    g = g.dropna(subset=[f"p{k}_x" for k in range(len(chosen))])
    value = measure(*(vec(f"p{k}_") for k in range(len(chosen))))
    return g.select(*key, F.lit(kind).alias("kind"), value.alias("value"), F.lit(unit).alias("unit"))
