"""Coarse-graining: beads from residues or index lists, their bonds and angles, what they leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elements import mass
from .residues import PARTS, with_residue_index

KEY = ["structure_id"]


def members(atoms: DataFrame, mapping: str | DataFrame = "residue_com", key: list[str] = KEY) -> DataFrame:
    """(key, residue_idx, bead_name, atom...): which bead each atom is in.

    mapping: residue_com or residue_centroid (a bead for each residue), backbone_sidechain (BB from N, CA, C, O and OXT, SC
    from the others but H), or a table (resname, atom_name, bead_name); residues that it lacks are one bead."""
    a = with_residue_index(atoms, key)
    name = F.upper("atom_name")
    if isinstance(mapping, DataFrame):
        m = mapping.select(F.upper("resname").alias("__r"), F.upper("atom_name").alias("__a"), "bead_name")
        known = mapping.select(F.upper("resname").alias("__r")).distinct().withColumn("__k", F.lit(True))
        a = a.withColumns({"__r": F.upper("resname"), "__a": name}).join(known, "__r", "left").join(m, ["__r", "__a"], "left")
        a = a.withColumn("bead_name", F.when(F.col("__k").isNull(), F.col("resname")).otherwise(F.col("bead_name")))
        return a.where("bead_name is not null").drop("__r", "__a", "__k")
    if mapping == "backbone_sidechain":
        bead = F.when(name.isin("N", "CA", "C", "O", "OXT"), "BB").when(F.upper("element") != "H", "SC")
        return a.withColumn("bead_name", bead).where("bead_name is not null")
    if mapping in ("residue_com", "residue_centroid"):
        return a.withColumn("bead_name", F.col("resname"))
    raise ValueError(f"unknown mapping {mapping!r}")


def beads(member: DataFrame, weighted: bool = True, key: list[str] = KEY) -> DataFrame:
    """(key, bead_idx, bead_name, residue..., x, y, z, n_atoms): mass-weighted or plain means, in residue order."""
    m = mass("element") if weighted else F.lit(1.0)
    g = member.groupBy(*key, "residue_idx", "bead_name").agg(*(F.first(c).alias(c) for c in PARTS), *((F.sum(m * F.col(x)) / F.sum(m)).alias(x) for x in "xyz"), F.count("*").alias("n_atoms"), F.min("atom_idx").alias("first_atom"))
    w = W.partitionBy(*key).orderBy("residue_idx", "first_atom", "bead_name")
    return g.withColumn("bead_idx", F.row_number().over(w) - 1).drop("first_atom")


def index_beads(atoms: DataFrame, lists: DataFrame, weighted: bool = True, key: list[str] = KEY) -> DataFrame:
    """Beads from a table (bead_idx, bead_name, atoms array) that holds for every structure; atoms may be in several."""
    m = mass("element") if weighted else F.lit(1.0)
    x = lists.select("bead_idx", "bead_name", F.explode("atoms").alias("atom_idx"))
    g = atoms.join(x, "atom_idx")
    return g.groupBy(*key, "bead_idx", "bead_name").agg(*((F.sum(m * F.col(c)) / F.sum(m)).alias(c) for c in "xyz"), F.count("*").alias("n_atoms"))


def bead_bonds(bead: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, i, j): beads of a residue in a row, and the first beads of neighbouring residues of one chain."""
    w = W.partitionBy(*key).orderBy("bead_idx")
    within = bead.withColumns({"j": F.lead("bead_idx").over(w), "nr": F.lead("residue_idx").over(w)}).where("nr = residue_idx").select(*key, F.col("bead_idx").alias("i"), "j")
    first = bead.groupBy(*key, "residue_idx").agg(F.min("bead_idx").alias("i"), F.first("chain").alias("chain"))
    v = W.partitionBy(*key).orderBy("residue_idx")
    along = first.withColumns({"j": F.lead("i").over(v), "nc": F.lead("chain").over(v)}).where("nc = chain").select(*key, "i", "j")
    return within.unionByName(along)


def bead_angles(bonds: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, i, at, j): pairs of bonds that share a bead, i < j."""
    both = bonds.select(*key, F.col("i").alias("at"), F.col("j").alias("end")).unionByName(bonds.select(*key, F.col("j").alias("at"), F.col("i").alias("end")))
    a, b = both.withColumnRenamed("end", "i"), both.withColumnRenamed("end", "j")
    return a.join(b, [*key, "at"]).where("i < j").select(*key, "i", "at", "j")


def dropped(atoms: DataFrame, member: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Atoms in no bead."""
    return atoms.join(member.select(*key, "atom_idx").distinct(), [*key, "atom_idx"], "left_anti")


def coverage(atoms: DataFrame, member: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, n_atoms, n_members, n_dropped); an atom of several beads counts in each."""
    n = atoms.groupBy(*key).agg(F.count("*").alias("n_atoms"))
    m = member.groupBy(*key).agg(F.count("*").alias("n_members"))
    d = dropped(atoms, member, key).groupBy(*key).agg(F.count("*").alias("n_dropped"))
    return n.join(m, key, "left").join(d, key, "left").fillna(0)


def virtual_sites(bead: DataFrame, sites: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, site_name, x, y, z) from a table (site_name, parents array of bead_idx, weights array or null): weighted means.

    Weights are normalised; a site whose weights add up to 0 has no place."""
    w = F.coalesce("weights", F.transform("parents", lambda p: F.lit(1.0)))
    s = sites.select("site_name", F.explode(F.arrays_zip(F.col("parents").alias("p"), w.alias("w"))).alias("z")).select("site_name", F.col("z.p").alias("bead_idx"), F.col("z.w").alias("w"))
    g = bead.join(s, "bead_idx").groupBy(*key, "site_name").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(x)).alias(x) for x in "xyz"))
    return g.select(*key, "site_name", *(F.when(F.col("w") != 0, F.col(x) / F.col("w")).alias(x) for x in "xyz"))


def unique_names(bead: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, bead_name, bead_idx) of names that occur once."""
    return bead.groupBy(*key, "bead_name").agg(F.min("bead_idx").alias("bead_idx"), F.count("*").alias("n")).where("n = 1").drop("n")


def group_names(bead: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Adds group_name: the bead's name, from the second on with _2, _3 and so on."""
    n = F.row_number().over(W.partitionBy(*key, "bead_name").orderBy("bead_idx"))
    return bead.withColumn("group_name", F.when(n == 1, F.col("bead_name")).otherwise(F.concat("bead_name", F.lit("_"), n.cast("string"))))


def labels(bead: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Adds label: the bead's name with its residue, like BB (12A ALA A), or name#bead_idx without any."""
    have = set(bead.columns)
    parts = [F.concat(F.col("resid").cast("string"), F.coalesce(F.col("icode"), F.lit("")))] if {"resid", "icode"} <= have else []
    parts += [F.nullif(F.col(c), F.lit("")) for c in ("resname", "chain") if c in have]
    residue = F.concat_ws(" ", *parts) if parts else F.lit("")
    return bead.withColumn("label", F.when(residue != "", F.concat("bead_name", F.lit(" ("), residue, F.lit(")"))).otherwise(F.concat("bead_name", F.lit("#"), F.col("bead_idx").cast("string"))))
