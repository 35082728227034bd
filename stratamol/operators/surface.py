"""Solvent-accessible surface by test points on expanded spheres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import max_asa, vdw_radius
from ..functions.geometry import fibonacci_sphere
from .residues import with_residue_index
from .spatial import KEY, pairs

PI4 = 12.566370614359172


def atom_surface(atoms: DataFrame, probe: float = 1.4, n_points: int = 192, key: list[str] = KEY, cells: bool = True) -> DataFrame:
    """(key, atom_idx, sasa): the share of an atom's points inside no neighbour's sphere times the sphere's area.

    Each atom's neighbours are gathered once; its points are then tested in one expression, so that no row is made for a
    point."""
    a = atoms.withColumn("radius", vdw_radius("element") + probe)
    most = 2 * (2.31 + probe)
    p = pairs(a, most, key, cells, extra=["x", "y", "z", "radius"])
    both = p.unionByName(p.select(*key, F.col("j").alias("i"), F.col("i").alias("j"), "d2", *(F.col(f"{s}_{c}").alias(f"{t}_{c}") for s, t in ("ij", "ji") for c in ("x", "y", "z", "radius"))))
    near = both.where(F.col("d2") < (F.col("i_radius") + F.col("j_radius")) * (F.col("i_radius") + F.col("j_radius")))
    spheres = F.collect_list(F.struct((F.col("j_x") - F.col("i_x")).alias("x"), (F.col("j_y") - F.col("i_y")).alias("y"), (F.col("j_z") - F.col("i_z")).alias("z"), (F.col("j_radius") * F.col("j_radius")).alias("r2")))
    g = near.groupBy(*key, F.col("i").alias("atom_idx")).agg(spheres.alias("near"))
    points = F.array(*[F.struct(*(F.lit(v).alias(c) for c, v in zip("xyz", p, strict=True))) for p in fibonacci_sphere(n_points)])

    def inside(p):
        def one(s):
            d = [p[c] * F.col("radius") - s[c] for c in "xyz"]
            return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < s["r2"]

        return F.exists("near", one)

    open_points = F.size(F.filter(points, lambda p: ~inside(p)))
    full = F.col("radius") * F.col("radius") * PI4
    out = a.select(*key, "atom_idx", "radius").join(g, [*key, "atom_idx"], "left")
    return out.select(*key, "atom_idx", F.when(F.col("near").isNull(), full).otherwise(full * open_points / n_points).alias("sasa"))


def residue_surface(atoms: DataFrame, threshold: float = 0.20, key: list[str] = KEY, **options) -> DataFrame:
    """(key, residue_idx, residue..., sasa, rsa, exposed); rsa is null for residues without a largest area."""
    a = with_residue_index(atoms, key)
    s = a.join(atom_surface(atoms, key=key, **options), [*key, "atom_idx"])
    g = s.groupBy(*key, "residue_idx").agg(*(F.first(c).alias(c) for c in ("chain", "resid", "icode", "resname")), F.sum("sasa").alias("sasa"))
    rsa = F.col("sasa") / max_asa("resname")
    return g.withColumn("rsa", rsa).withColumn("exposed", F.coalesce(F.col("rsa") >= threshold, F.lit(False)))


def surface_summary(surface: DataFrame, key: list[str] = KEY) -> DataFrame:
    return surface.groupBy(*key).agg(F.sum("sasa").alias("total"), F.avg("sasa").alias("mean"), F.stddev_pop("sasa").alias("std"), F.max("sasa").alias("max"))
