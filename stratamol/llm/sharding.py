"""Rendezvous sharding of stable record keys over weighted shards, in DataFrame functions only.

A record's score for a shard is -ln(u) / weight, u from the md5 of record key and shard number; the least score wins. A new
shard only ever takes records into itself: no other score changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Blocks of a shard, each numbered on its own.
BLOCKS = 4096


def score(key: Column, shard: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def rendezvous(docs: DataFrame, shards: int = 24, weights: list[float] | None = None, grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds shard, slot and grown_shard (the shard if there were one more, of grown_weight) to (doc_id, size, text_crc32).

    size is the text's UTF-8 bytes plus 8, null text none. Slots count from 0 in each shard by block and doc_id; blocks
    are hashes of key and text. A null key is hashed as the word null; repeated rows share a shard and
    have slots of their own. Other columns, whatever their names, are ignored; an empty table gives an empty result."""
    weights = weights or [1.0] * shards
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("one positive weight for each shard")
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    d = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    scores = [score(F.col("key"), k, w) for k, w in enumerate(weights)]
    d = d.withColumn("best", F.array_min(F.array(*[F.struct(s.alias("s"), F.lit(k).alias("k")) for k, s in enumerate(scores)])))
    grown = F.when(score(F.col("key"), shards, grown_weight) < F.col("best.s"), F.lit(shards)).otherwise(F.col("best.k"))
    block = (F.conv(F.substring(F.md5(F.concat_ws("#", F.col("key"), F.lit("block"), F.col("text_crc32").cast("string"))), 1, 8), 16, 10).cast("long") % BLOCKS).cast("int")
    d = d.select("doc_id", "size", "text_crc32", F.col("best.k").alias("shard"), grown.alias("grown_shard"), block.alias("block"))
    d = materialise(d, "placed")
    counts = d.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select("shard", "block", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32"))
    d = d.withColumn("own", own).join(before, ["shard", "block"])
    return d.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")


def oracle(shards: int = 24) -> str:
    """The query in DuckDB SQL; crc32 runs over each text's bytes."""

    def u(k):
        return f"-ln((('0x' || substr(md5(key || '#' || {k}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"

    return f"""
    WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    a AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
    b AS (SELECT doc_id, key, len(h) // 2 + 8 AS size, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM a, t),
    c AS (SELECT *, list_transform(range({shards}), lambda k: {u("k")}) AS s, {u(shards)} AS more, ('0x' || substr(md5(key || '#block#' || text_crc32), 1, 8))::BIGINT % {BLOCKS} AS block FROM b),
    d AS (SELECT *, list_position(s, list_min(s)) - 1 AS shard FROM c)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1 AS slot,
      (CASE WHEN more < list_min(s) THEN {shards} ELSE shard END)::INT AS grown_shard FROM d"""
