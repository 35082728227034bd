"""The registered queries of the training-data operators and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, licences, media, mixing, packing, quality, sharding, urls, wordpiece
from .common import documents

#: op3's target mixture: proportions of the root of each source's tokens.
POWER = 0.5
SAID = "<|im_end|><|im_start|>assistant ok"


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(documents(spark, sf_dir)).drop("places")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(documents(spark, sf_dir), power=POWER)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir))


def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.rendezvous(documents(spark, sf_dir), 24)
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), 4, 85)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(conv.unionByName(own)), in_order=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = quality.train_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs, trees).drop("score")


def queries() -> dict:
    own = (op1_media_columns, op2_license_scan, op3_packing, op4_token_counts, op5_pareto_mixing, op6_rendezvous_sharding, op7_jaccard_join, op8_url_filter, op9_chat_formatting, op10_quality_rules)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licences.oracle(), "op5_pareto_mixing": mixing.oracle(), "op6_rendezvous_sharding": sharding.oracle(24), "op7_jaccard_join": jaccard.oracle(4, 85), "op9_chat_formatting": chat.oracle(),
    }
