"""Structured streaming over frames: running per-key summaries against the first frame as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def running_series(frames: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    """(key, n, first_frame, first_value, last_value, mean, largest_shift): works on batch and streaming tables alike.

    The first frame is the one of least number, not of first arrival: min_by keeps it in the aggregation's state, so that
    late files change nothing once they are in."""
    g = frames.groupBy(key).agg(F.count("*").alias("n"), F.min(frame).alias("first_frame"), F.min_by(value, frame).alias("first_value"), F.max_by(value, frame).alias("last_value"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    shift = F.greatest(F.abs(F.col("high") - F.col("first_value")), F.abs(F.col("low") - F.col("first_value")))
    return g.withColumn("largest_shift", shift).drop("low", "high")


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> None:
    """Runs what is available through and writes it; complete results overwrite each other by batch."""

    def put(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(out)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """running_series over the events as a file stream, written and read back."""
    place = scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    run_to_parquet(running_series(events, "user_id", "event_id", "value"), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out")


def stream_atoms(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Atoms of coordinate files as they arrive in a folder; each file is one row of the source and parsed whole."""
    import pandas as pd

    from ..sources import formats

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    out += [[formats.stem(path), *(a.get(f) for f in formats.ATOM_FIELDS[1:-1]), None] for a in formats.parse_file(path, bytes(content))[0]]
                except ValueError as e:
                    out.append([formats.stem(path), *[None] * (len(formats.ATOM_FIELDS) - 2), str(e)])
            yield pd.DataFrame(out, columns=formats.ATOM_FIELDS).astype({c: "Int32" for c in ("model_id", "atom_idx", "serial", "resid", "formal_charge")} | {"hetero": "boolean"})

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, formats.ATOM_SCHEMA)
