"""Corpus pipeline: quality rules, n-gram Jaccard join, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamol.llm import jaccard, mixing, packing, quality
from stratamol.llm.common import mark, materialise, release, row_named

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: words of a shingle, least percentage of shared ones.
NEAR = (5, 80)
#: Bitmaps of kept rows, of 4 KB and up to 32,768 rows each, that are broadcast; beyond, texts are shuffled to meet them.
BITMAPS = 16_384


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The trees are trained on the labelled ones among docs.

    Rows are judged one by one, also without an id or with a repeated one. Null, empty and wordless texts go (under 50
    words); without labels only the base rules decide; an empty table gives an empty result; further columns are dropped."""
    trees = quality.train_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = quality.quality_rules(docs, trees, carry=COLUMNS).where("kept")
    return got.select(*(F.col(f"carry{k}").alias(c) for k, c in enumerate(COLUMNS)))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least doc_id. Rows without an id all stay.

    Near copies share 80 % of their five-word shingles (op7 keeps its own four words and 85 %). Groups are of rows: other
    texts under a removed row's id stay. Rows without words are in no group; equal ones of one id stay once. An empty table
    gives an empty result; further columns are dropped."""
    rows = row_named(docs, COLUMNS)
    found = jaccard.jaccard_components(rows, *NEAR, id_col="row").select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    named = rows.where("doc_id is not null").select("row", "doc_id", F.xxhash64("text").alias("h")).join(found, "row")
    alone = F.col("n_shingles") == 0
    group = [F.when(~alone, F.col("component_id")).alias("c"), F.when(alone, F.col("doc_id")).alias("i"), F.when(alone, F.col("h")).alias("t")]
    kept = named.groupBy(*group).agg(F.min(F.struct("doc_id", "h", "row"))["row"].alias("row"))
    # a bit for each row: texts aren't shuffled to meet them
    bucket, bit = F.bitmap_bucket_number("row").alias("bucket"), F.bitmap_bit_position("row").alias("bit")
    bits = materialise(kept.select(bucket, bit).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "kept")
    rows = rows.select("*", bucket, bit).join(F.broadcast(bits) if bits.count() <= BITMAPS else bits, "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    first = F.expr("shiftleft(1, cast(bit % 8 as int))").bitwiseAND(byte) != 0
    return rows.where(F.col("doc_id").isNull() | first).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it has copies in it, whatever its id, which may lack or repeat.

    A null source is a source of its own. Rows that the mix has no copy of go, those without words among them where their
    source has less than one copy of each. An empty table gives an empty result; further columns are dropped."""
    mix = mixing.pareto_mix(docs.select(*COLUMNS), carry=COLUMNS).where("copies > 0")
    out = mix.select("copies", *(F.col(f"carry{k}").alias(c) for k, c in enumerate(COLUMNS)))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2,048 tokens, sources in the proportions that the mix gave them.

    Every row is packed, also one without an id, a text or a source; copies are documents of their own. An empty table
    gives an empty result."""
    got = packing.pack(docs)
    return got.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_stage), ("n-gram jaccard join", jaccard_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Boosted trees and tokenizers have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
            # what the stage and the last one wrote has served
            release(since if before is None else before, keep=docs)
            before = mark() - 1
    return docs
