"""Backbone geometry: hydrogen bonds, secondary structure, torsions, gaps, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import dihedral, dot, squared, sub, vec
from .residues import PARTS, with_residue_index
from .spatial import cross_pairs

KEY = ["structure_id"]
#: Charges and factor of the electrostatic energy, its bound, distance bounds.
Q1, Q2, FACTOR, BOUND, CA_BOUND, BREAK, CA_BREAK = 0.42, 0.20, 332.0, -0.5, 9.0, 2.5, 4.5
PRIORITY = "HEBGITS"


def backbone(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row for each residue with N, CA, C and O (the last of a name counts), numbered by r; linked: a peptide bond
    to the residue before, in the same chain."""
    a = with_residue_index(atoms, key)
    name = F.upper("atom_name")
    cols = [F.max_by(F.when(name == n, F.col(x)), F.when(name == n, F.col("atom_idx"))).alias(f"{n.lower()}_{x}") for n in ("N", "CA", "C", "O") for x in "xyz"]
    g = a.groupBy(*key, "residue_idx").agg(*(F.first(c).alias(c) for c in PARTS), *cols).where("n_x is not null and ca_x is not null and c_x is not null and o_x is not null")
    w = W.partitionBy(*key).orderBy("residue_idx")
    before = tuple(F.lag(f"c_{x}").over(w) for x in "xyz")
    linked = (F.lag("chain").over(w) == F.col("chain")) & (F.sqrt(squared(before, vec("n_"))) < BREAK)
    return g.withColumn("r", F.row_number().over(w) - 1).withColumn("linked", F.coalesce(linked, F.lit(False)))


def torsions(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, r, residue..., phi, psi, omega) in degrees, null at chain ends and breaks."""
    b = backbone(atoms, key)
    w = W.partitionBy(*key).orderBy("r")

    def at(name: str, step: int):
        return tuple(F.lag(f"{name}_{x}", step).over(w) if step > 0 else F.lead(f"{name}_{x}", -step).over(w) for x in "xyz")

    b = b.withColumns({f"p{n}_{x}": v for n in ("ca", "c") for x, v in zip("xyz", at(n, 1), strict=True)} | {f"nn_{x}": v for x, v in zip("xyz", at("n", -1), strict=True)})
    b = b.withColumn("next", F.coalesce(F.lead("linked").over(w), F.lit(False)))
    n, ca, c = vec("n_"), vec("ca_"), vec("c_")
    phi, omega, psi = dihedral(vec("pc_"), n, ca, c), dihedral(vec("pca_"), vec("pc_"), n, ca), dihedral(n, ca, c, vec("nn_"))
    return b.select(*key, "r", *PARTS, F.when(F.col("linked"), phi).alias("phi"), F.when(F.col("next"), psi).alias("psi"), F.when(F.col("linked"), omega).alias("omega"))


def hydrogen_bonds(b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, i, j): C=O of i to N-H of j by electrostatic energy; b is backbone()."""
    w = W.partitionBy(*key).orderBy("r")
    co = sub(vec("c_"), vec("o_"))
    n = F.sqrt(dot(co, co))
    unit = tuple(F.lag(F.try_divide(v, n)).over(w) for v in co)
    b = b.withColumns({f"h_{x}": F.when(F.col("linked"), F.col(f"n_{x}") + u) for x, u in zip("xyz", unit, strict=True)})
    place = [F.col("r").alias("atom_idx"), *(F.col(f"ca_{x}").alias(x) for x in "xyz")]
    i = b.select(*key, *place, *(f"{n}_{x}" for n in ("c", "o") for x in "xyz"))
    j = b.where("h_x is not null").select(*key, *place, *(f"{n}_{x}" for n in ("n", "h") for x in "xyz"))
    p = cross_pairs(i, j, CA_BOUND, key, extra=[f"{n}_{x}" for n in ("c", "o") for x in "xyz"], other=[f"{n}_{x}" for n in ("n", "h") for x in "xyz"]).where("i <> j")

    def near(a, c):
        return F.try_divide(F.lit(1.0), F.sqrt(squared(vec(a), vec(c))))

    energy = Q1 * Q2 * FACTOR * (near("i_o_", "j_n_") + near("i_c_", "j_h_") - near("i_o_", "j_h_") - near("i_c_", "j_n_"))
    return p.where(energy < BOUND).select(*key, "i", "j")


def _marked(flag: Column, low: int, high: int, w) -> Column:
    """Whether the flag stands low to high rows before."""
    return F.coalesce(F.max(flag.cast("int")).over(w.rowsBetween(-high, -low)), F.lit(0)) == 1


def assign(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, r, residue..., code): H, E, B, G, I, T, S or -, the first that holds."""
    b = backbone(atoms, key)
    hb = hydrogen_bonds(b, key)
    chain = b.select(*key, "r", "chain")
    a, z = chain.withColumnsRenamed({"r": "i", "chain": "ci"}), chain.withColumnsRenamed({"r": "j", "chain": "cj"})
    turns = hb.where("j - i in (3, 4, 5)").join(a, [*key, "i"]).join(z, [*key, "j"]).where("ci = cj")
    turns = turns.groupBy(*key, F.col("i").alias("r")).agg(*(F.bool_or(F.col("j") - F.col("i") == n).alias(f"t{n}") for n in (3, 4, 5)))
    last = b.groupBy(*key).agg((F.max("r")).alias("last"))
    # a bridge (i, j) needs two bonds: parallel (i-1, j) and (j, i+1), or (j-1, i) and (i, j+1); antiparallel (i, j) and
    # (j, i), or (i-1, j+1) and (j-1, i+1). Each bond names the pairs that it could be half of; one aggregation joins them.
    i, j = F.col("i"), F.col("j")
    halves = [(i + 1, j), (j - 1, i), (j, i + 1), (i, j - 1), (i, j), (j, i), (i + 1, j - 1), (j - 1, i + 1)]
    named = F.array(*[F.struct(x.alias("i"), y.alias("j"), F.lit(1 << k).alias("bit")) for k, (x, y) in enumerate(halves)])
    seen = hb.select(*key, F.explode(named).alias("p")).select(*key, "p.*").where("i >= 1 and j >= i + 3").groupBy(*key, "i", "j").agg(F.bit_or("bit").alias("bits"))
    both = F.lit(False)
    for mask in (3, 12, 48, 192):
        both = both | (F.col("bits").bitwiseAND(mask) == mask)
    bridges = seen.where(both).join(last, key).where("j <= last - 1")
    bridged = bridges.select(*key, F.explode(F.array("i", "j")).alias("r")).distinct().withColumn("bridged", F.lit(True))
    s = b.join(turns, [*key, "r"], "left").join(bridged, [*key, "r"], "left").fillna(False, ["t3", "t4", "t5", "bridged"])
    w = W.partitionBy(*key).orderBy("r")
    for n in (3, 4, 5):
        s = s.withColumn(f"s{n}", F.col(f"t{n}") & F.coalesce(F.lag(f"t{n}").over(w), F.lit(False)))
    ca2, ca4 = tuple(F.lag(f"ca_{x}", 2).over(w) for x in "xyz"), tuple(F.lead(f"ca_{x}", 2).over(w) for x in "xyz")
    v1, v2 = sub(vec("ca_"), ca2), sub(ca4, vec("ca_"))
    s = s.withColumn("cos", dot(v1, v2) / (F.sqrt(dot(v1, v1)) * F.sqrt(dot(v2, v2)) + 1e-9))
    side = F.coalesce(F.lag("bridged").over(w), F.lit(False)) | F.coalesce(F.lead("bridged").over(w), F.lit(False))
    s = s.withColumns({
        "H": _marked(F.col("s4"), 0, 3, w), "G": _marked(F.col("s3"), 0, 2, w), "I": _marked(F.col("s5"), 0, 4, w),
        "E": F.col("bridged") & side, "B": F.col("bridged") & ~side,
        "T": _marked(F.col("t3"), 1, 2, w) | _marked(F.col("t4"), 1, 3, w) | _marked(F.col("t5"), 1, 4, w),
        "S": F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos"))))) > 70.0,
    })
    code = F.lit("-")
    for c in reversed(PRIORITY):
        code = F.when(F.col(c), c).otherwise(code)
    return s.select(*key, "r", *PARTS, code.alias("code"))


def per_atom(atoms: DataFrame, codes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Each atom's residue code, - where it has none."""
    c = codes.groupBy(*key, *PARTS).agg(F.max_by("code", "r").alias("code"))
    return atoms.join(c, [*key, *PARTS], "left").fillna("-", ["code"])


def summary(codes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Counts and shares of helix, strand and coil by structure and, with chain set, by chain."""
    kind = F.when(F.col("code").isin("H", "G", "I"), "helix").when(F.col("code").isin("E", "B"), "strand").otherwise("coil")
    c = codes.withColumn("kind", kind)
    counts = [F.count("*").alias("n"), *(F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("helix", "strand", "coil"))]
    whole = c.groupBy(*key).agg(*counts).withColumn("chain", F.lit(None).cast("string"))
    out = whole.unionByName(c.groupBy(*key, "chain").agg(*counts))
    return out.withColumns({f"{k}_share": F.col(k) / F.col("n") for k in ("helix", "strand", "coil")})


def segments(codes: DataFrame, include_coil: bool = False, key: list[str] = KEY, order: str = "r") -> DataFrame:
    """(key, chain, code, first, last, n): runs of one code within a chain."""
    w = W.partitionBy(*key).orderBy(order)
    new = F.coalesce((F.lag("code").over(w) == F.col("code")) & (F.lag("chain").over(w) == F.col("chain")), F.lit(False))
    c = codes.withColumn("__n", (~new).cast("int")).withColumn("__s", F.sum("__n").over(w))
    g = c.groupBy(*key, "__s").agg(F.first("chain").alias("chain"), F.first("code").alias("code"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__s")
    return g if include_coil else g.where("code <> '-'")


def gaps_and_breaks(points: DataFrame, key: list[str] = KEY, bound: float = CA_BREAK) -> DataFrame:
    """(key, chain, n_gaps, n_breaks) of consecutive residues of a chain: numbers that skip, or neighbours too far apart.

    points: representatives with atom_idx in residue order."""
    w = W.partitionBy(*key, "chain").orderBy("atom_idx")
    step = F.col("resid") - F.lag("resid").over(w)
    d2 = squared(vec(), tuple(F.lag(x).over(w) for x in "xyz"))
    p = points.withColumns({"gap": F.coalesce(step > 1, F.lit(False)), "broken": F.coalesce((step == 1) & (d2 > bound * bound), F.lit(False))})
    return p.groupBy(*key, "chain").agg(F.sum(F.col("gap").cast("long")).alias("n_gaps"), F.sum(F.col("broken").cast("long")).alias("n_breaks"))
