"""Shared folders, materialised steps and Arrow text slices for the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: list[str] = []
_JVM: list = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="stratamol-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, so that lost executors can reread it.

    What is written stays until release(), or until the Python process ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/stratamol-{uuid.uuid4().hex}/{name}"
    if not _JVM:
        _JVM.extend((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()))
        atexit.register(release)
    _MADE.append(path.rsplit("/", 1)[0])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_named(df: DataFrame, columns: tuple[str, ...], name: str = "row") -> DataFrame:
    """The columns and a number for each row, the same whenever it is read.

    Rows of a plain Parquet table are named by file and place there, without writing them again; others are written."""
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            at = df.metadataColumn("_metadata")
            places = df.select(*columns, at["file_path"].alias("__file"), at["row_index"].alias("__at"))
        except AnalysisException:  # no files, or no Parquet
            places = None
        if places is not None:
            files = places.groupBy("__file").agg(F.count("*").alias("n"), (F.max("__at") + 1).alias("end"))
            # a row for each file, written once
            files = materialise(files.withColumn("__from", F.shiftleft(F.row_number().over(W.orderBy("__file")).cast("long"), 40)), "files")
            if not files.where("n <> end").limit(1).count():  # else a file is read twice
                return places.join(F.broadcast(files.select("__file", "__from")), "__file").select(*columns, (F.col("__from") + F.col("__at")).alias(name))
    return materialise(df.select(*columns).withColumn(name, F.monotonically_increasing_id()), "rows")


def mark() -> int:
    """How many tables materialise() has written and nothing has released: for release()."""
    return len(_MADE)


def release(since: int = 0, keep: DataFrame | list[DataFrame] | None = None) -> None:
    """Deletes what materialise() has written since mark(), but for the tables that keep reads.

    Call it once what builds on these tables is written; frames that still read them fail."""
    frames = keep if isinstance(keep, list) else [] if keep is None else [keep]
    kept = {x.rsplit("/", 2)[0] for f in frames for x in f.inputFiles()}
    stay = []
    while len(_MADE) > since:
        made = _MADE.pop()
        if any(x.endswith(made.rsplit("/", 1)[1]) for x in kept):
            stay.append(made)
            continue
        jvm, conf = _JVM
        path = jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(conf).delete(path, True)
    _MADE.extend(stay)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_slices(texts: pa.Array, most: int = (1 << 20) - 2):
    """Yields (first row, end row, bytes as uint8, offsets from 0) of at most `most` bytes, or of one longer text.

    Null texts count as empty. The bytes are a view of Arrow's buffer."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(arr)
    if not n:
        return
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; right's keys are dropped."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a number from 0 in the given order: ranges are sorted task by task and numbered from their counts."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    d = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id())
    d = materialise(d, "ranges").withColumn("__part", F.shiftright("__at", 33))
    counts = d.groupBy("__part").agg(F.count("*").alias("__n"))
    # a row for each task
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return d.join(before, "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")
