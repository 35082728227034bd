"""Structure against structure: matched atoms, deviations, contact and descriptor differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["structure_id"]


def matched(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, atom_a, atom_b, residue..., p and q coordinates): atoms of equal (chain, resid, icode, name), first ones on both sides."""
    ident = ["chain", "resid", "icode", "name"]

    def first(df, s, t):
        d = df.withColumn("name", F.upper("atom_name"))
        r = F.row_number().over(W.partitionBy(*key, *ident).orderBy("atom_idx"))
        d = d.withColumn("__r", r).where("__r = 1")
        more = ["resname"] if s == "a" else []
        return d.select(*key, *ident, *more, F.col("atom_idx").alias(f"atom_{s}"), *(F.col(x).alias(f"{t}{x}") for x in "xyz"))

    return first(a, "a", "p").join(first(b, "b", "q"), [*key, *ident])


def deviations(pairs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, run, chain, resid, icode, resname, n, rmsd) over runs of matched atoms of one residue."""
    w = W.partitionBy(*key).orderBy("atom_a")
    now = F.struct("chain", "resid", "icode", "resname")
    new = F.when(F.coalesce(now.eqNullSafe(F.lag(now).over(w)), F.lit(False)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d2 = sum(((F.col(f"p{x}") - F.col(f"q{x}")) * (F.col(f"p{x}") - F.col(f"q{x}")) for x in "yz"), (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")))
    p = pairs.withColumn("__n", new).withColumn("run", F.sum("__n").over(w)).withColumn("d2", d2)
    return p.groupBy(*key, "run").agg(*(F.first(c).alias(c) for c in ("chain", "resid", "icode", "resname")), F.count("*").alias("n"), F.sqrt(F.avg("d2")).alias("rmsd"))


def largest(dev: DataFrame, n: int = 5, key: list[str] = KEY) -> DataFrame:
    """The n largest deviations; equal ones, but for the last bits of their squares, by their place."""
    r = F.row_number().over(W.partitionBy(*key).orderBy(F.round(F.col("rmsd") * F.col("rmsd"), 9).desc(), "run"))
    return dev.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def contact_changes(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, common, lost, gained): contacts (key, i, j) of a and b."""
    on = [*key, "i", "j"]
    both = a.select(*on).distinct().withColumn("ina", F.lit(1)).join(b.select(*on).distinct().withColumn("inb", F.lit(1)), on, "full")
    return both.groupBy(*key).agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("common", F.col("ina").isNotNull() & F.col("inb").isNotNull()), ("lost", F.col("inb").isNull()), ("gained", F.col("ina").isNull()))))


def descriptor_changes(a: DataFrame, b: DataFrame, features: list[str], key: list[str] = KEY) -> DataFrame:
    """(key, feature, a, b, delta), a row for each feature."""
    x = a.unpivot(key, features, "feature", "a")
    y = b.unpivot(key, features, "feature", "b")
    return x.join(y, [*key, "feature"]).withColumn("delta", F.col("b") - F.col("a"))
