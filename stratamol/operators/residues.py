"""Residues as runs of atoms, contact maps over them, interfaces, ligands, binding sites and pockets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elements import AMINO_ACIDS, AROMATIC, IONS, POCKET_HYDROPHOBIC, WATER, charge_sign, mass
from .spatial import KEY, cross_pairs, pairs

PARTS = ["chain", "resid", "icode", "resname"]


def with_residue_index(atoms: DataFrame, key: list[str] = KEY, name: str = "residue_idx") -> DataFrame:
    """Numbers the runs of atoms with equal (chain, resid, icode, resname) from 0; a residue in two runs is two."""
    w = W.partitionBy(*key).orderBy("atom_idx")
    now = F.struct(*PARTS)
    new = F.when(F.row_number().over(w) == 1, 0).when(now.eqNullSafe(F.lag(now).over(w)), 0).otherwise(1)
    return atoms.withColumn("__new", new).withColumn(name, F.sum("__new").over(w).cast("int")).drop("__new")


def residues(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, residue_idx, chain, resid, icode, resname, first_atom, n_atoms)."""
    a = atoms if "residue_idx" in atoms.columns else with_residue_index(atoms, key)
    return a.groupBy(*key, "residue_idx").agg(*(F.first(c).alias(c) for c in PARTS), F.min("atom_idx").alias("first_atom"), F.count("*").alias("n_atoms"))


def chains(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, chain, position) in first-seen order."""
    c = atoms.groupBy(*key, "chain").agg(F.min("atom_idx").alias("first"))
    return c.select(*key, "chain", (F.row_number().over(W.partitionBy(*key).orderBy("first")) - 1).alias("position"))


def representatives(atoms: DataFrame, method: str = "ca", key: list[str] = KEY) -> DataFrame:
    """A point for each residue: its first CA, its centre of mass (com), or without a CA its centroid. atom_idx is residue_idx;
    hetero, where atoms have it, tells whether any atom is one."""
    a = atoms if "residue_idx" in atoms.columns else with_residue_index(atoms, key)
    ca = F.upper("atom_name") == "CA"
    m = mass("element")
    cols = {}
    for x in "xyz":
        if method == "ca":
            cols[x] = F.coalesce(F.min_by(F.when(ca, F.col(x)), F.when(ca, F.col("atom_idx"))), F.avg(x))
        elif method == "com":
            cols[x] = F.coalesce(F.sum(m * F.col(x)) / F.sum(m), F.avg(x))
        else:
            raise ValueError(f"method is ca or com, not {method!r}")
    own = [c for c in PARTS if c in a.columns]
    het = [F.bool_or("hetero").alias("hetero")] if "hetero" in a.columns else []
    return a.groupBy(*key, F.col("residue_idx").alias("atom_idx")).agg(*(F.first(c).alias(c) for c in own), *het, *(v.alias(k) for k, v in cols.items()))


def is_frequency(values: DataFrame, value: str, difference: bool = False, key: list[str] = KEY) -> DataFrame:
    """(key, is_frequency): whether a map holds other values than 0 and 1, or -1, 0 and 1 in a difference."""
    allowed = (-1.0, 0.0, 1.0) if difference else (0.0, 1.0)
    return values.groupBy(*key).agg(F.bool_or(~F.col(value).cast("double").isin(*allowed)).alias("is_frequency"))


def contact_map(atoms: DataFrame, cutoff: float = 8.0, level: str = "residue", method: str = "ca", min_seq_sep: int = 0, chain_mode: str = "all", key: list[str] = KEY, cells: bool = True, carry=()) -> DataFrame:
    """(key, i, j, d2) of contacts between atoms or residues, i < j.

    carry: columns of both ends, as i_ and j_, of atoms or of representatives(); not with method min. min_seq_sep drops pairs of one chain whose rows are nearer than that; chain_mode: all, intra or inter."""
    extra = list(dict.fromkeys(["chain", *carry]))
    if carry and level != "atom" and method == "min":
        raise ValueError("columns of residues are carried with method ca or com")
    if level == "atom":
        p = pairs(atoms, cutoff, key, cells, extra=extra)
    elif method == "min":
        a = with_residue_index(atoms, key)
        q = pairs(a, cutoff, key, cells, extra=["residue_idx", "chain"]).where("i_residue_idx <> j_residue_idx")
        p = q.groupBy(*key, F.col("i_residue_idx").alias("i"), F.col("j_residue_idx").alias("j")).agg(F.min("d2").alias("d2"), F.first("i_chain").alias("i_chain"), F.first("j_chain").alias("j_chain"))
    else:
        p = pairs(representatives(atoms, method, key), cutoff, key, cells, extra=extra)
    same = F.col("i_chain") == F.col("j_chain")
    if chain_mode not in ("all", "intra", "inter"):
        raise ValueError(f"chain_mode is all, intra or inter, not {chain_mode!r}")
    if chain_mode != "all":
        p = p.where(same if chain_mode == "intra" else ~same)
    if min_seq_sep > 0:
        p = p.where(~(same & (F.col("j") - F.col("i") < min_seq_sep)))
    return p.select(*key, "i", "j", "d2", *(f"{s}_{c}" for s in "ij" for c in carry))


def sequence_separation(edges: DataFrame, least: int) -> DataFrame:
    """Drops edges of one chain whose residue numbers differ by less; needs i_chain, j_chain, i_resid, j_resid."""
    near = (F.col("i_chain") == F.col("j_chain")) & (F.abs(F.col("i_resid") - F.col("j_resid")) < least)
    return edges.where(~near)


def contact_order(contacts: DataFrame, sizes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, contact_order): mean separation of contacts over the number of residues; sizes: (key, n)."""
    c = contacts.groupBy(*key).agg(F.sum(F.abs(F.col("j") - F.col("i"))).alias("s"), F.count("*").alias("c"))
    return sizes.join(c, key, "left").select(*key, F.coalesce(F.col("s") / (F.col("c") * F.col("n")), F.lit(0.0)).alias("contact_order"))


def map_difference(a: DataFrame, b: DataFrame, key: list[str] = KEY, value: str | None = None) -> DataFrame:
    """(key, i, j, value): a's values less b's, 0 where a pair is missing; without a value column contacts count 1."""
    on = [*key, "i", "j"]
    x = a.select(*on, (F.col(value) if value else F.lit(1.0)).alias("va"))
    y = b.select(*on, (F.col(value) if value else F.lit(1.0)).alias("vb"))
    both = x.join(y, on, "full").select(*on, (F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0))).alias("value"))
    return both.where("value <> 0")


def interface(atoms: DataFrame, chain_a: str, chain_b: str, cutoff: float = 5.0, key: list[str] = KEY) -> DataFrame:
    """(key, side, residue..., n_atom_contacts) of the residues of either chain in contact with the other."""
    a, b = atoms.where(F.col("chain") == chain_a), atoms.where(F.col("chain") == chain_b)
    p = cross_pairs(a, b, cutoff, key, extra=PARTS, other=PARTS)
    one = p.select(*key, F.lit("a").alias("side"), *(F.col(f"i_{c}").alias(c) for c in PARTS))
    two = p.select(*key, F.lit("b").alias("side"), *(F.col(f"j_{c}").alias(c) for c in PARTS))
    return one.unionByName(two).groupBy(*key, "side", *PARTS).agg(F.count("*").alias("n_atom_contacts"))


def chain_contact_matrix(atoms: DataFrame, cutoff: float = 5.0, key: list[str] = KEY) -> DataFrame:
    """(key, chain_a, chain_b, n_contacts) of every pair of chains, 0 where there are none."""
    c = atoms.select(*key, "chain").distinct()
    every = c.withColumnRenamed("chain", "chain_a").join(c.withColumnRenamed("chain", "chain_b"), key).where("chain_a < chain_b")
    p = pairs(atoms, cutoff, key, extra=["chain"]).where("i_chain <> j_chain")
    n = p.groupBy(*key, F.least("i_chain", "j_chain").alias("chain_a"), F.greatest("i_chain", "j_chain").alias("chain_b")).agg(F.count("*").alias("n_contacts"))
    return every.join(n, [*key, "chain_a", "chain_b"], "left").fillna(0, ["n_contacts"])


def ligands(atoms: DataFrame, exclude_water: bool = True, exclude_ions: bool = True, key: list[str] = KEY) -> DataFrame:
    """Runs of hetero atoms that are neither water nor ions."""
    r = residues(with_residue_index(atoms.where("hetero"), key), key)
    name = F.upper("resname")
    if exclude_water:
        r = r.where(~name.isin(*WATER))
    if exclude_ions:
        r = r.where(~name.isin(*IONS))
    return r


def binding_site(atoms: DataFrame, ligand=None, cutoff: float = 4.5, key: list[str] = KEY) -> DataFrame:
    """(key, residue..., min_distance, n_contacts, rank) of polymer residues nearer than cutoff to the ligand's atoms.

    ligand: a residue name or a condition on atoms; without one, all hetero atoms that are neither water nor ions. rank
    orders by distance, then by place."""
    het = atoms.where("hetero")
    if ligand is None:
        chosen = het.where(~F.upper("resname").isin(*WATER, *IONS))
    else:
        chosen = het.where(F.upper("resname") == ligand.upper() if isinstance(ligand, str) else ligand)
    p = cross_pairs(atoms.where(~F.col("hetero")), chosen, cutoff, key, extra=PARTS)
    site = p.groupBy(*key, *(F.col(f"i_{c}").alias(c) for c in PARTS)).agg(F.sqrt(F.min("d2")).alias("min_distance"), F.count("*").alias("n_contacts"), F.min("i").alias("first_atom"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy("min_distance", "first_atom"))
    return site.withColumn("rank", rank)


def unique_ligand(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, n_ligands, resname) where resname is set only for structures with one candidate."""
    r = ligands(atoms, key=key)
    return r.groupBy(*key).agg(F.count("*").alias("n_ligands"), F.first("resname").alias("resname")).withColumn("resname", F.when(F.col("n_ligands") == 1, F.col("resname")))


def site_atoms(atoms: DataFrame, site: DataFrame, key: list[str] = KEY) -> DataFrame:
    """All polymer atoms of a site's residues."""
    return atoms.where(~F.col("hetero")).join(site.select(*key, *PARTS), [*key, *PARTS], "left_semi")


def pocket(atoms: DataFrame, ligand: str | None = None, hbond: float = 3.5, salt: float = 4.0, hydrophobic: float = 4.5, aromatic: float = 5.5, key: list[str] = KEY, first_atom: bool = False) -> DataFrame:
    """(key, residue..., hydrophobic, aromatic, polar_distance, salt_distance) by proximity, cutoffs inclusive.

    A residue's closest polar pair is left out where it is the pair of its salt bridge. first_atom: adds a column of that
    name, the least index of its atoms in reach."""
    het = atoms.where("hetero")
    chosen = het.where(~F.upper("resname").isin(*WATER, *IONS)) if ligand is None else het.where(F.upper("resname") == ligand.upper())
    extra = [*PARTS, "element", "atom_name"]
    p = cross_pairs(atoms.where(~F.col("hetero")), chosen, max(hbond, salt, hydrophobic, aromatic), key, extra=extra, other=["element"], inclusive=True)
    name = F.upper("i_resname")
    carbon = (F.upper("i_element") == "C") & (F.upper("j_element") == "C")
    polar = F.upper("i_element").isin("N", "O", "F") & F.upper("j_element").isin("N", "O", "F")
    lig = F.when(F.upper("j_element") == "N", 1).when(F.upper("j_element") == "O", -1).otherwise(0)
    opposite = charge_sign(F.col("i_resname"), F.col("i_atom_name")) * lig < 0
    p = p.withColumns({
        "hyd": carbon & name.isin(*POCKET_HYDROPHOBIC) & (F.col("d2") <= hydrophobic**2),
        "aro": carbon & name.isin(*AROMATIC) & (F.col("d2") <= aromatic**2),
        "pol": F.when(polar & (F.col("d2") <= hbond**2), F.struct("d2", "i", "j")),
        "sal": F.when(opposite & (F.col("d2") <= salt**2), F.struct("d2", "i", "j")),
    })
    g = p.groupBy(*key, *(F.col(f"i_{c}").alias(c) for c in PARTS)).agg(F.bool_or("hyd").alias("hydrophobic"), F.bool_or("aro").alias("aromatic"), F.min("pol").alias("pol"), F.min("sal").alias("sal"), F.min("i").alias("first_atom"))
    alone = F.when(~(F.col("pol").eqNullSafe(F.col("sal"))), F.sqrt("pol.d2"))
    return g.select(*key, *PARTS, "hydrophobic", "aromatic", alone.alias("polar_distance"), F.sqrt("sal.d2").alias("salt_distance"), *["first_atom"] * first_atom)


def pocket_features(site: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Counts of site residues by amino acid and summaries of distances and contacts."""
    name = F.upper("resname")
    counts = [F.sum((name == a).cast("long")).alias(f"n_{a}") for a in AMINO_ACIDS]
    other = F.sum((~name.isin(*AMINO_ACIDS)).cast("long")).alias("n_OTHER")
    stats = [f(c).alias(f"{n}_{c}") for c in ("min_distance", "n_contacts") for n, f in (("min", F.min), ("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))]
    return site.groupBy(*key).agg(F.count("*").alias("n_residues"), *stats, *counts, other)
