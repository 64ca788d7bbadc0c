"""Ordered computation without one task per series.

A series (all bars of one symbol and timeframe) can hold a large share of all rows, so no
window here is partitioned by the series alone. Three patterns replace it, all exact:

* ``with_row_index``  positions from per-block row numbers plus a prefix sum of block counts;
* ``with_halo``       bounded frames: each block of rows also receives copies of the few
                      neighbouring rows its frames can reach;
* ``previous_row`` / ``running_total`` / ``running_peak``  unbounded frames: a window inside
                      the block plus one carried value per block.

Only the block summaries (one row per several thousand rows) are ordered per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros

DEFAULT_BLOCK_ROWS = 8192
DEFAULT_BLOCK_SECONDS = 30 * 86_400

START, HERE, END = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def time_block(ts: Column | str, seconds: int = DEFAULT_BLOCK_SECONDS) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def index_block(idx: Column | str, size: int = DEFAULT_BLOCK_ROWS) -> Column:
    c = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(c / F.lit(size)).cast("long")


def _attach_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, list(keys), "left")


def with_row_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    name: str = "bar_idx",
) -> DataFrame:
    """Zero-based position of each row in its series. ``block`` must be monotone in ``order``."""
    by = list(by)
    placed = df.withColumn("_blk", block).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by, "_blk").orderBy(*order))
    )
    counts = df.groupBy(*by, block.alias("_blk")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(START, -1)
    offsets = counts.select(*by, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(offsets, [*by, "_blk"])
        .withColumn(name, F.col("_off") + F.col("_rn") - 1)
        .drop("_blk", "_rn", "_off")
    )


def with_bar_index(
    bars: DataFrame, by: Sequence[str], seconds: int = DEFAULT_BLOCK_SECONDS
) -> DataFrame:
    """``bar_idx``: row position per series. A block has at most one bar per time step."""
    return with_row_index(bars, by, ["timestamp"], time_block("timestamp", seconds))


def with_halo(
    df: DataFrame, by: Sequence[str], back: int, ahead: int, size: int = DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Copy rows to every block whose frames (``back`` rows before, ``ahead`` after) reach them.

    Adds ``_blk`` (partition key for the windows) and ``_own`` (filter on it afterwards).
    """
    idx = F.col("bar_idx")
    first = F.greatest(F.lit(0), F.floor((idx - ahead) / F.lit(size))).cast("long")
    last = F.floor((idx + back) / F.lit(size)).cast("long")
    return df.withColumn("_blk", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_blk") == index_block("bar_idx", size)
    )


def halo_window(by: Sequence[str]):
    return Window.partitionBy(*by, "_blk").orderBy("bar_idx")


def drop_halo(df: DataFrame) -> DataFrame:
    """Keep each row once. Blocks past the end of a series own nothing and vanish here."""
    return df.where("_own").drop("_blk", "_own")


def previous_row(
    df: DataFrame,
    by: Sequence[str],
    on: str,
    cols: Sequence[str],
    name: str,
    size: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Struct ``name`` of ``cols`` from the previous row of the series in order of integer ``on``."""
    by = list(by)
    payload = F.struct(*cols)
    blk = index_block(on, size)
    inside = df.withColumn("_blk", blk).withColumn(
        name, F.lag(payload).over(Window.partitionBy(*by, "_blk").orderBy(on))
    )
    lasts = df.groupBy(*by, blk.alias("_blk")).agg(F.max_by(payload, F.col(on)).alias("_last"))
    carry = lasts.select(
        *by, "_blk", F.lag("_last").over(Window.partitionBy(*by).orderBy("_blk")).alias("_carry")
    )
    return (
        _attach_carry(inside, carry, [*by, "_blk"])
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop("_blk", "_carry")
    )


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, value: str, name: str
) -> DataFrame:
    """Cumulative sum of ``value`` per series, summed block by block."""
    by = list(by)
    w = Window.partitionBy(*by, "_blk").orderBy(*order).rowsBetween(START, HERE)
    inside = df.withColumn("_blk", block).withColumn("_run", F.sum(value).over(w))
    sums = df.groupBy(*by, block.alias("_blk")).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(START, -1)
    carry = sums.select(*by, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_c"))
    return (
        _attach_carry(inside, carry, [*by, "_blk"])
        .withColumn(name, F.col("_c") + F.coalesce("_run", F.lit(0.0)))
        .drop("_blk", "_run", "_c")
    )


def running_peak(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: str,
    name: str,
    origin: float = 0.0,
) -> DataFrame:
    """Cumulative maximum of ``value`` per series, starting from ``origin``."""
    by = list(by)
    w = Window.partitionBy(*by, "_blk").orderBy(*order).rowsBetween(START, HERE)
    inside = df.withColumn("_blk", block).withColumn("_run", F.max(value).over(w))
    tops = df.groupBy(*by, block.alias("_blk")).agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(START, -1)
    carry = tops.select(*by, "_blk", F.max("_m").over(before).alias("_c"))
    return (
        _attach_carry(inside, carry, [*by, "_blk"])
        .withColumn(name, F.greatest(F.lit(origin), "_c", "_run"))
        .drop("_blk", "_run", "_c")
    )
