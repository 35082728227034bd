"""Quality inventories, findings with stable codes and readiness rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import AMINO_ACIDS, HEAVY_ATOMS, IONS, NUCLEOTIDES, WATER, case, is_element
from .residues import representatives, with_residue_index
from .secondary import gaps_and_breaks

KEY = ["structure_id"]
#: Atoms from which dense results are warned of.
LARGE = 10_000


def inventory(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row for each structure: residues, waters, ions, ligands, element and metadata tallies, models, occupancy."""
    a = with_residue_index(atoms, key)
    name = F.upper("resname")
    r = a.groupBy(*key, "residue_idx").agg(F.first(name).alias("resname"), F.bool_or("hetero").alias("het"))
    kinds = r.groupBy(*key).agg(
        F.count("*").alias("n_residues"), F.sum(F.col("resname").isin(*WATER).cast("long")).alias("n_waters"), F.sum((F.col("resname").isin(*IONS) & F.col("het")).cast("long")).alias("n_ions"),
        F.sum((F.col("het") & ~F.col("resname").isin(*WATER, *IONS)).cast("long")).alias("n_ligands"),
    )
    blank = F.trim(F.coalesce("element", F.lit(""))) == ""

    def tally(c):
        return F.sum(c.cast("long"))

    cols = [F.count("*").alias("n_atoms"), tally(blank).alias("n_blank_elements"), tally(~blank & ~is_element("element")).alias("n_unknown_elements"), tally(F.upper(F.trim("element")).isin("H", "D")).alias("n_hydrogens")]
    cols += [tally(F.coalesce(F.col(c), F.lit("")) == "").alias(f"n_without_{c}") for c in ("atom_name", "resname", "chain")]
    if "altloc" in atoms.columns:
        cols.append(tally(~F.coalesce(F.col("altloc"), F.lit("")).isin("", " ")).alias("n_altlocs"))
    if "occupancy" in atoms.columns:
        cols.append(tally(F.coalesce(F.col("occupancy"), F.lit(1.0)) < 1).alias("n_low_occupancy"))
    if "model_id" in atoms.columns:
        cols.append(F.count_distinct("model_id").alias("n_models"))
    return kinds.join(atoms.groupBy(*key).agg(*cols), key)


def findings(inv: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, code): a row for each rule that an inventory breaks."""
    has = set(inv.columns)
    rules = {
        "missing_metadata": "n_without_atom_name = n_atoms or n_without_resname = n_atoms or n_without_chain = n_atoms", "missing_hydrogens": "n_hydrogens = 0", "bad_elements": "n_blank_elements + n_unknown_elements > 0",
        "altlocs": "n_altlocs > 0" if "n_altlocs" in has else None, "low_occupancy": "n_low_occupancy > 0" if "n_low_occupancy" in has else None, "multiple_models": "n_models > 1" if "n_models" in has else None,
        "inferred_bonds": "n_explicit_bonds = 0" if "n_explicit_bonds" in has else None, "large_dense": f"n_atoms > {LARGE}",
    }
    codes = F.filter(F.array(*[F.when(F.expr(r), F.lit(c)) for c, r in rules.items() if r]), lambda x: x.isNotNull())
    return inv.select(*key, F.explode(codes).alias("code"))


def topology(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, n_polymer, n_nonstandard, n_missing_backbone, n_truncated, n_gaps, n_breaks): readiness of the polymer.

    Polymer: amino acids and nucleotides. Nonstandard: other non-water residues. Backbone: N, CA, C and O of amino acids.
    Truncated: fewer heavy atoms than the side chain needs."""
    a = with_residue_index(atoms, key)
    name, atom = F.upper("resname"), F.upper("atom_name")
    r = a.groupBy(*key, "residue_idx").agg(
        F.first(name).alias("resname"), F.count_distinct(F.when(atom.isin("N", "CA", "C", "O"), atom)).alias("bb"), F.sum((~F.upper("element").isin("H", "D")).cast("long")).alias("heavy"),
    )
    amino = F.col("resname").isin(*AMINO_ACIDS)
    polymer = amino | F.col("resname").isin(*NUCLEOTIDES)
    short = amino & (F.col("heavy") < case("resname", HEAVY_ATOMS, 0))
    flags = {"n_polymer": polymer, "n_nonstandard": ~polymer & ~F.col("resname").isin(*WATER), "n_missing_backbone": amino & (F.col("bb") < 4), "n_truncated": short}
    out = r.groupBy(*key).agg(*(F.sum(v.cast("long")).alias(k) for k, v in flags.items()))
    points = representatives(a, "ca", key).where(F.upper("resname").isin(*AMINO_ACIDS, *NUCLEOTIDES))
    g = gaps_and_breaks(points, key).groupBy(*key).agg(F.sum("n_gaps").alias("n_gaps"), F.sum("n_breaks").alias("n_breaks"))
    return out.join(g, key, "left").fillna(0, ["n_gaps", "n_breaks"])


def readiness(top: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, blockers, warnings, ready): missing backbone and chain breaks block; the rest warn."""

    def those(rules):
        return F.filter(F.array(*[F.when(F.col(f"n_{c}") > 0, F.lit(c)) for c in rules]), lambda x: x.isNotNull())

    out = top.select(*key, those(["missing_backbone", "breaks"]).alias("blockers"), those(["gaps", "truncated", "nonstandard"]).alias("warnings"))
    return out.withColumn("ready", F.size("blockers") == 0)
