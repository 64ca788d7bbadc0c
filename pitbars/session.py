"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. Time zone: all instants are UTC.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # timestamps with row-group statistics, so time ranges are pushed into scans
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # exact percentiles keep a value->count map per group; let more groups stay
    # in the hash map before Spark falls back to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
}

# fixed at session start: deep plans have more generated stages than the default cache of 100
STATIC_CONF = {"spark.sql.codegen.cache.maxEntries": "4096"}


def build_session(app: str = "pitbars", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(
            shared or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        )
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from the table.

    Used where several branches read the same intermediate table (bars, labels): the ticks
    are scanned once, a lost executor costs a re-read and not a re-run, later reads prune
    columns and push filters down, and joins see the table's real size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
