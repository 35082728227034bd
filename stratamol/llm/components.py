"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark, materialise, release


def _mark(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return got["n"], got["x"]


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014) as aggregates and joins, so that no node's
    neighbours meet in one task. Each round is written to the shared folder. Self-loops and nulls are ignored;
    an empty table gives an empty result. Rounds go on until nothing changes, which takes about log2 of the longest path."""
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    since, e = mark(), materialise(e, "edges")
    seen, k = _mark(e), 0
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = materialise(small.where("a <> b").distinct(), f"round{k}")
        release(since, keep=e)
        new = _mark(e)
        if new == seen:
            break
        seen, k = new, k + 1
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
