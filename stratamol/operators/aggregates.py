"""Per-structure aggregates: geometry, composition, histograms, bonds, descriptors, scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elements import DEFAULT_ELEMENTS, charge_sign, covalent_radius, mass
from ..functions.geometry import inertia_anisotropy, shape, symmetric_eigenvalues
from .residues import representatives, with_residue_index
from .spatial import KEY, contact_counts, pairs


LARGEST_RADIUS = 1.76
#: No bond is longer at the usual tolerance.
BOND_REACH = 1.2 * 2 * LARGEST_RADIUS


def geometry(atoms: DataFrame, key: list[str] = KEY, more: dict | None = None) -> DataFrame:
    """(key, n_atoms, total_mass, c*, com_*, rg, dim_*, volume, compactness, ixx ... iyz) in one aggregation, which takes more
    aggregates by name.

    Second moments about the centre of mass follow from raw sums, shifted by the first atom to keep precision."""
    w = W.partitionBy(*key)
    a = atoms.withColumns({"m": mass("element")} | {f"o{x}": F.min_by(x, "atom_idx").over(w) for x in "xyz"})
    a = a.withColumns({f"r{x}": F.col(x) - F.col(f"o{x}") for x in "xyz"})
    sums = {f"s{x}": F.sum(F.col("m") * F.col(f"r{x}")) for x in "xyz"}
    sums |= {f"s{x}{y}": F.sum(F.col("m") * F.col(f"r{x}") * F.col(f"r{y}")) for x, y in ("xx", "yy", "zz", "xy", "xz", "yz")}
    means = {f"c{x}": F.avg(x) for x in "xyz"} | {f"dim_{x}": F.max(x) - F.min(x) for x in "xyz"} | {f"o{x}": F.first(f"o{x}") for x in "xyz"}
    g = a.groupBy(*key).agg(F.count("*").alias("n_atoms"), F.sum("m").alias("total_mass"), *(v.alias(k) for k, v in {**sums, **means, **(more or {})}.items()))
    m = F.col("total_mass")

    def second(x, y):
        return F.col(f"s{x}{y}") - F.col(f"s{x}") * F.col(f"s{y}") / m

    xx, yy, zz, xy, xz, yz = (second(*p) for p in ("xx", "yy", "zz", "xy", "xz", "yz"))
    volume = F.col("dim_x") * F.col("dim_y") * F.col("dim_z")
    return g.select(
        *key, "n_atoms", "total_mass", "cx", "cy", "cz", *((F.col(f"o{x}") + F.col(f"s{x}") / m).alias(f"com_{x}") for x in "xyz"),
        F.sqrt(F.greatest(F.lit(0.0), (xx + yy + zz) / m)).alias("rg"), "dim_x", "dim_y", "dim_z", volume.alias("volume"), F.when(volume > 0, F.col("n_atoms") / volume).otherwise(0.0).alias("compactness"),
        (yy + zz).alias("ixx"), (xx + zz).alias("iyy"), (xx + yy).alias("izz"), (-xy).alias("ixy"), (-xz).alias("ixz"), (-yz).alias("iyz"), *(more or {}),
    )


def shape_descriptors(atoms: DataFrame, key: list[str] = KEY, more: dict | None = None) -> DataFrame:
    """geometry() with principal moments, ascending, and the shape parameters made from them."""
    g = geometry(atoms, key, more)
    low, mid, high = symmetric_eigenvalues(*(F.col(c) for c in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")))
    g = g.withColumns({"m1": low, "m2": mid, "m3": high})
    m = [F.col(c) for c in ("m1", "m2", "m3")]
    return g.withColumns(shape(*m, F.col("total_mass")) | {"inertia_anisotropy": inertia_anisotropy(*m)})


def principal_axes(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, m1, m2, m3, axis1, axis2, axis3): moments of inertia, ascending, and their unit axes; an axis's first part that
    isn't 0 is positive. Where moments are equal their axes are any that fit."""
    import numpy as np
    import pandas as pd

    g = geometry(atoms, key).select(*key, "ixx", "iyy", "izz", "ixy", "ixz", "iyz")
    kinds = ", ".join(f"{k} {g.schema[k].dataType.simpleString()}" for k in key)

    def run(frames):
        for pdf in frames:
            t = pdf[["ixx", "ixy", "ixz", "ixy", "iyy", "iyz", "ixz", "iyz", "izz"]].to_numpy(float).reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(t)
            axes = vectors.transpose(0, 2, 1)
            first = np.take_along_axis(axes, (np.abs(axes) > 1e-9).argmax(2)[..., None], 2)
            axes = axes * np.where(first < 0, -1.0, 1.0)
            yield pd.concat([pdf[list(key)].reset_index(drop=True), pd.DataFrame({f"m{k + 1}": values[:, k] for k in range(3)} | {f"axis{k + 1}": list(axes[:, k]) for k in range(3)})], axis=1)

    return g.mapInPandas(run, f"{kinds}, m1 double, m2 double, m3 double, axis1 array<double>, axis2 array<double>, axis3 array<double>")


def formula(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, formula) in Hill order: C, then H even without C, then the others by symbol."""
    e = F.initcap(F.trim("element"))
    n = atoms.groupBy(*key, e.alias("e")).agg(F.count("*").alias("n")).where("e <> ''")
    rank = F.when(F.col("e") == "C", 0).when(F.col("e") == "H", 1).otherwise(2)
    part = F.concat("e", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "e", part.alias("p"))))
    return n.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("formula"))


def element_counts(atoms: DataFrame, elements=DEFAULT_ELEMENTS, key: list[str] = KEY) -> DataFrame:
    return atoms.groupBy(*key).agg(*(v.alias(k) for k, v in _element_sums(elements).items()))


def _element_sums(elements) -> dict:
    e = F.upper("element")
    return {f"count_{s}": F.sum((e == s).cast("long")) for s in elements}


def distance_histogram(atoms: DataFrame, bins: int = 10, low: float = 0.0, high: float = 20.0, key: list[str] = KEY) -> DataFrame:
    """(key, bin, n_pairs) over (low, high), the last bin closed; empty bins are left out."""
    p = pairs(atoms, high, key, inclusive=True).withColumn("d", F.sqrt("d2")).where(F.col("d") >= low)
    b = F.least(F.floor((F.col("d") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return p.groupBy(*key, b.alias("bin")).agg(F.count("*").alias("n_pairs"))


def bonds(atoms: DataFrame, explicit: DataFrame | None = None, tolerance: float = 1.2, key: list[str] = KEY, cells: bool = True) -> DataFrame:
    """(key, i, j, d2, source): explicit bonds where a structure has any, else pairs under tolerance times their radii."""
    a = atoms.withColumn("radius", covalent_radius("element"))
    p = pairs(a, tolerance * 2 * LARGEST_RADIUS, key, cells, extra=["radius"])
    near = F.sqrt("d2") < tolerance * (F.col("i_radius") + F.col("j_radius"))
    found = p.where(near).select(*key, "i", "j", "d2", F.lit("geometric").alias("source"))
    if explicit is None:
        return found
    given = explicit.select(*key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    ends = [atoms.select(*key, F.col("atom_idx").alias(s), *(F.col(c).alias(f"{s}{c}") for c in "xyz")) for s in "ij"]
    d2 = sum(((F.col(f"i{c}") - F.col(f"j{c}")) * (F.col(f"i{c}") - F.col(f"j{c}")) for c in "yz"), (F.col("ix") - F.col("jx")) * (F.col("ix") - F.col("jx")))
    given = given.join(ends[0], [*key, "i"]).join(ends[1], [*key, "j"]).select(*key, "i", "j", d2.alias("d2"), F.lit("explicit").alias("source"))
    return found.join(explicit.select(*key).distinct(), key, "left_anti").unionByName(given)


def bond_summary(bonds: DataFrame, key: list[str] = KEY) -> DataFrame:
    d = F.sqrt("d2")
    return bonds.groupBy(*key).agg(F.count("*").alias("n_bonds"), F.avg(d).alias("mean_length"), F.stddev_pop(d).alias("std_length"), F.min(d).alias("min_length"), F.max(d).alias("max_length"))


def polar_contacts(atoms: DataFrame, low: float = 2.5, high: float = 3.5, key: list[str] = KEY) -> DataFrame:
    """(key, n_polar): N and O pairs of different residues at low <= d < high; structures without any are left out."""
    a = with_residue_index(atoms, key).where(F.upper("element").isin("N", "O"))
    p = pairs(a, high, key, extra=["residue_idx"]).where((F.col("d2") >= low**2) & (F.col("i_residue_idx") != F.col("j_residue_idx")))
    return p.groupBy(*key).agg(F.count("*").alias("n_polar"))


def salt_bridges(atoms: DataFrame, cutoff: float = 4.0, key: list[str] = KEY) -> DataFrame:
    """(key, n_salt_bridges): residue pairs with opposite charged atoms within cutoff, inclusive."""
    a = with_residue_index(atoms, key).withColumn("sign", charge_sign(F.col("resname"), F.col("atom_name"))).where("sign <> 0")
    p = pairs(a, cutoff, key, extra=["residue_idx", "sign"], inclusive=True).where("i_sign * j_sign < 0")
    both = F.struct(F.least("i_residue_idx", "j_residue_idx").alias("a"), F.greatest("i_residue_idx", "j_residue_idx").alias("b"))
    return p.groupBy(*key).agg(F.count_distinct(both).alias("n_salt_bridges"))


def descriptors(atoms: DataFrame, elements=DEFAULT_ELEMENTS, bins: int = 10, high: float = 20.0, contact_cutoff: float = 5.0, residue_cutoff: float = 8.0, key: list[str] = KEY) -> DataFrame:
    """One feature row for each structure; features without rows are 0.

    All that comes from pairs of atoms is taken in one pass over them, all that comes from single ones in another."""
    counts = _element_sums(elements)
    out = shape_descriptors(atoms, key, counts)
    out = out.select(*(c for c in out.columns if c not in counts), *counts)
    out = out.join(_pair_features(atoms, bins, high, contact_cutoff, key), key, "left")
    rc = contact_counts(representatives(atoms, "ca", key), residue_cutoff, key)
    rc = rc.select(*key, F.col("n_atoms").alias("n_residues"), F.col("n_contacts").alias("residue_contacts"), F.col("density").alias("residue_contact_density"))
    out = out.join(rc, key, "left").fillna(0)
    n = F.col("n_atoms").cast("double")
    return out.withColumn("contact_density", F.when(n > 1, F.col("n_contacts") / (n * (n - 1) / 2)).otherwise(0.0))


def _pair_features(atoms: DataFrame, bins: int, high: float, contact_cutoff: float, key: list[str]) -> DataFrame:
    """(key, distance_hist_*, bonds as in bond_summary(), n_contacts, n_polar, n_salt_bridges) of structures with near pairs."""
    a = with_residue_index(atoms, key).withColumns({"radius": covalent_radius("element"), "polar": F.upper("element").isin("N", "O"), "sign": charge_sign(F.col("resname"), F.col("atom_name"))})
    p = pairs(a, max(high, contact_cutoff, BOND_REACH, 4.0), key, extra=["residue_idx", "radius", "polar", "sign"], inclusive=True).withColumn("d", F.sqrt("d2"))
    slot = F.when(F.col("d2") <= high * high, F.least(F.floor(F.col("d") / (high / bins)), F.lit(bins - 1)).cast("int"))
    p = p.withColumns({
        "slot": slot, "length": F.when(F.col("d") < 1.2 * (F.col("i_radius") + F.col("j_radius")), F.col("d")),
        "near": F.col("d2") < contact_cutoff * contact_cutoff, "apart": F.col("i_residue_idx") != F.col("j_residue_idx"),
        "bridge": F.when((F.col("d2") <= 16.0) & (F.col("i_sign") * F.col("j_sign") < 0), F.struct(F.least("i_residue_idx", "j_residue_idx").alias("a"), F.greatest("i_residue_idx", "j_residue_idx").alias("b"))),
    })
    polar = F.col("i_polar") & F.col("j_polar") & F.col("apart") & (F.col("d2") >= 6.25) & (F.col("d2") < 12.25)
    return p.groupBy(*key).agg(
        *(F.count_if(F.col("slot") == k).alias(f"distance_hist_{k}") for k in range(bins)), F.count("length").alias("n_bonds"), F.avg("length").alias("mean_length"), F.stddev_pop("length").alias("std_length"),
        F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.count_if("near").alias("n_contacts"), F.count_if(polar).alias("n_polar"), F.size(F.collect_set("bridge")).cast("long").alias("n_salt_bridges"),
    )


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std): population deviation, 1 where it is under 1e-8. One row for each feature."""
    agg = df.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in features]))
    return agg.select(rows.alias("r")).select("r.*")


def scaled(df: DataFrame, scaler: DataFrame, features: list[str], inverse: bool = False) -> DataFrame:
    """Features as (x - mean) / std, or back. The scaler's rows, one for each feature, go to the driver."""
    known = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    return df.withColumns({c: F.col(c) * known[c][1] + known[c][0] if inverse else (F.col(c) - known[c][0]) / known[c][1] for c in features})


def series_summary(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Mean, population deviation, extremes and last value of a series."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.max_by(value, order).alias("final"))


def available_fields(df: DataFrame, map_col: str, order: str) -> DataFrame:
    """(field, first) of all map keys, by where they are first seen."""
    return df.select(F.explode(F.map_keys(map_col)).alias("field"), order).groupBy("field").agg(F.min(order).alias("first"))
