"""A session with the settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "stratamol", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; conf overrides or adds settings (underscores stand for dots)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in {**base, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stratamol-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
