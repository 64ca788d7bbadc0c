"""Reading bars and ticks, writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import missing_months
from ..operators.bars import BAR_COLUMNS, dedupe_ticks

TICK_CSV_SCHEMA = T.StructType(
    [
        T.StructField("source_timestamp", T.StringType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("source_volume", T.FloatType()),
    ]
)
# fixed values: layout and zone of the tick archives (five hours behind UTC, no clock changes)
TICK_TIME_FORMAT = "yyyyMMdd HHmmssSSS"
TICK_TZ = "GMT-05:00"


def read_bars(
    spark: SparkSession,
    root: str,
    start: str,
    end: str,
    *,
    columns: Sequence[str] | None = None,
    check: bool = True,
) -> DataFrame:
    """Bars of the half-open range [start, end) from a table partitioned by symbol/year/month.

    Year and month bounds prune partitions and the timestamp range is pushed into the scan.
    ``check`` verifies required columns, that no month is absent for any symbol, and that the range is
    neither empty nor holds a duplicate (symbol, timestamp): a handful of aggregate rows
    reach the driver, never bars.
    """
    raw = spark.read.option("basePath", root).parquet(root)
    missing = sorted({"timestamp", *BAR_COLUMNS} - set(raw.columns))
    if missing:
        raise ValueError("bar table lacks column(s): " + ", ".join(missing))
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    df = raw
    if {"year", "month"} <= set(raw.columns):
        ym = F.col("year") * 12 + F.col("month")
        df = df.where((ym >= F.year(lo) * 12 + F.month(lo)) & (ym <= F.year(hi) * 12 + F.month(hi)))
    df = df.where((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
    if check:
        by = [c for c in ("symbol",) if c in df.columns]
        lost = [str(r[0])[:7] for r in missing_months(df, start, end).orderBy("month").collect()]
        lost += [
            f"{str(r['month'])[:7]} of {r[by[0]]}"
            for r in (missing_months(df, start, end, by).orderBy(*by, "month").collect() if by and not lost else ())
        ]
        if lost:
            raise ValueError(f"{len(lost)} missing month(s): " + ", ".join(lost))
        keys = [c for c in ("symbol", "timestamp") if c in df.columns]
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("range contains duplicate timestamps")
    return df.select(*columns) if columns else df


def read_ticks_csv(
    spark: SparkSession,
    path: str,
    *,
    symbol: str,
    pip_size: float,
    source_tz: str = TICK_TZ,
) -> DataFrame:
    """Headerless ``ts,bid,ask,volume`` files in a fixed zone as deduplicated UTC ticks.

    ``seq`` orders ticks at one instant by file and position in the file: a file is read in
    splits whose row numbers grow with their offset.
    """
    raw = spark.read.schema(TICK_CSV_SCHEMA).option("mode", "FAILFAST").csv(path)
    local = F.to_timestamp("source_timestamp", TICK_TIME_FORMAT)
    ticks = raw.select(
        F.lit(symbol).alias("symbol"),
        F.to_utc_timestamp(local, source_tz).alias("ts"),
        F.monotonically_increasing_id().alias("seq"),
        "bid", "ask",
        ((F.col("bid") + F.col("ask")) / 2).alias("mid"),
        ((F.col("ask") - F.col("bid")) / F.lit(pip_size)).cast("float").alias("spread_pips"),
        F.lit(1).alias("activity"),
    )
    return dedupe_ticks(ticks)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Parquet, zstd. Rows are clustered by the partition columns first, so each partition gets
    few files; AQE splits partitions that are too large for one task. Mode "partitions" replaces whole partitions that
    ``df`` has rows of and leaves the others: files appear when the job commits, so a write can be repeated."""
    out = df
    if partition_by:
        out = df.hint("rebalance", *partition_by)
    writer = out.write.mode("overwrite" if mode == "partitions" else mode).option("compression", "zstd")
    if mode == "partitions":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_bars(bars: DataFrame, path: str, *, only_missing: bool = False) -> None:
    """Bars partitioned by symbol, year and month. Months of ``bars`` replace those of the table as a whole, other months stay;
    so a write that runs twice, or again after a half-finished one, gives the same table. ``only_missing`` leaves months
    that are already there.
    """
    parts = ["symbol", "year", "month"]
    out = bars.withColumn("year", F.year("timestamp")).withColumn("month", F.month("timestamp"))
    if only_missing:
        spark = bars.sparkSession
        try:
            done = spark.read.parquet(path).select(*parts).distinct()
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        else:
            out = out.join(done, parts, "left_anti")
    write_table(out, path, parts, mode="partitions")
