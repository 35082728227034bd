"""Operators on chemistry backends: each takes the function registered for it in functions.hooks, or raises MissingBackend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hooks
from . import ranking

KEY = ["structure_id"]


def read_smiles(df: DataFrame, id_col: str, smiles_col: str) -> DataFrame:
    """(structure_id, atom_idx, element, x, y, z) of a conformer of each SMILES; where the backend gives none, no rows."""
    made = df.select(F.col(id_col).alias("structure_id"), F.posexplode(hooks.backend("conformer")(F.col(smiles_col))).alias("atom_idx", "a"))
    return made.select("structure_id", "atom_idx", "a.element", "a.x", "a.y", "a.z")


def canonical(df: DataFrame, smiles_col: str, name: str = "canonical") -> DataFrame:
    return df.withColumn(name, hooks.backend("canonical_smiles")(F.col(smiles_col)))


def dedup_molecules(df: DataFrame, smiles_col: str, order: list[str]) -> DataFrame:
    """First row of each canonical form; rows that have none all stay."""
    return ranking.dedup(canonical(df, smiles_col, "__c"), "__c", order).drop("__c")


def scaffolds(df: DataFrame, smiles_col: str, name: str = "scaffold") -> DataFrame:
    return df.withColumn(name, hooks.backend("murcko_scaffold")(F.col(smiles_col)))


def scaffold_split(df: DataFrame, smiles_col: str, test: float, val: float) -> DataFrame:
    """Adds split; molecules of one scaffold stay together, largest scaffolds in train."""
    return ranking.group_split(scaffolds(df, smiles_col, "__s"), "__s", test, val).drop("__s")


def fingerprints(df: DataFrame, smiles_col: str, name: str = "bits") -> DataFrame:
    return df.withColumn(name, hooks.backend("morgan_fingerprint")(F.col(smiles_col)))


def smiles_descriptors(df: DataFrame, smiles_col: str, names: list[str]) -> DataFrame:
    """Adds a column for each named descriptor, null where the backend has none."""
    d = df.withColumn("__d", hooks.backend("smiles_descriptors")(F.col(smiles_col)))
    return d.withColumns({n: F.element_at("__d", n) for n in names}).drop("__d")


def property_filter(df: DataFrame, ceilings: dict[str, float], smiles_col: str | None = None) -> DataFrame:
    """Rows whose properties are under their ceilings, inclusive; null and NaN pass. Properties that df lacks come from the
    descriptors of smiles_col."""
    lack = [c for c in ceilings if c not in df.columns]
    if lack and smiles_col is None:
        raise ValueError(f"no columns {', '.join(lack)}, and no SMILES to make them from")
    d = smiles_descriptors(df, smiles_col, lack) if lack else df
    ok = F.lit(True)
    for c, top in ceilings.items():
        ok = ok & (F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) <= top))
    return d.where(ok).drop(*lack)


def protonated(df: DataFrame, smiles_col: str, name: str = "protonated") -> DataFrame:
    return df.withColumn(name, hooks.backend("protonate_smiles")(F.col(smiles_col)))


def featured(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Atoms with formal charges, valence and aromaticity."""
    return hooks.backend("chemical_features")(atoms, bonds)


def template_bonds(atoms: DataFrame) -> DataFrame:
    return hooks.backend("template_bonds")(atoms)


def residue_charges(atoms: DataFrame) -> DataFrame:
    return hooks.backend("residue_pka")(atoms)


def net_charge(atoms: DataFrame, protonation: str = "none", key: list[str] = KEY) -> DataFrame:
    """(key, net_charge, origin): the sum of formal charges as read, or of a backend's for standard and pka.

    Without a formal_charge column the sum is 0 and the origin none."""
    if protonation not in ("none", "standard", "pka"):
        raise ValueError(f"protonation is none, standard or pka, not {protonation!r}")
    if protonation != "none":
        charged = residue_charges(atoms)
        return charged.groupBy(*key).agg(F.sum("charge").cast("long").alias("net_charge"), F.lit(protonation).alias("origin"))
    has = "formal_charge" in atoms.columns
    total = F.sum(F.coalesce(F.col("formal_charge"), F.lit(0))) if has else F.lit(0)
    return atoms.groupBy(*key).agg(total.cast("long").alias("net_charge"), F.lit("as-read" if has else "none").alias("origin"))
