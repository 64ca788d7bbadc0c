"""Ticks to bars, bars to anchored higher timeframes, coverage and eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import anchored_bucket, in_trading_week, iso, micros, minutes_after
from ..params import FX_BOUNDARY_HOUR, FX_TZ, TIMEFRAMES

SIDES = ("bid", "ask", "mid")
OHLC = ("open", "high", "low", "close")
PRICE_COLUMNS = [f"{s}_{f}" for s in SIDES for f in OHLC]
COUNT_COLUMNS = ["tick_count", "activity_count"]
SPREAD_COLUMNS = [
    "spread_open_pips", "spread_median_pips", "spread_p95_pips", "spread_max_pips",
]
BAR_COLUMNS = [
    "timestamp", *PRICE_COLUMNS, *COUNT_COLUMNS, *SPREAD_COLUMNS,
    "first_tick_timestamp", "last_tick_timestamp",
]
OPTIONAL_SUMS = [
    "up_quote_count", "down_quote_count", "flat_quote_count",
    "bid_change_count", "ask_change_count",
]


def dedupe_ticks(ticks: DataFrame, ignore: Sequence[str] = ("seq",)) -> DataFrame:
    """Drop exact repeats; ``ignore`` columns (the ingest sequence) keep their smallest value."""
    keys = [c for c in ticks.columns if c not in ignore]
    if not any(c in ticks.columns for c in ignore):
        return ticks.dropDuplicates(keys)
    kept = [F.min(c).alias(c) for c in ignore if c in ticks.columns]
    return ticks.groupBy(*keys).agg(*kept).select(*ticks.columns)


def dedupe_bars_keep_last(
    bars: DataFrame, by: Sequence[str] = ("symbol",), order: str = "seq", year: int | None = None
) -> DataFrame:
    """One bar per timestamp; the one with the largest ``order`` wins."""
    if year is not None:
        bars = bars.where(F.year("timestamp") == year)
    w = Window.partitionBy(*by, "timestamp").orderBy(F.col(order).desc())
    return bars.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ticks_to_bars(
    ticks: DataFrame,
    duration: str = "1 minute",
    by: Sequence[str] = ("symbol",),
    approximate_quantiles: bool = False,
) -> DataFrame:
    """Left-closed, left-labelled bid/ask/mid bars; buckets without ticks produce no row.

    ``ticks``: by, ts, seq, bid, ask, mid, spread_pips, activity. One partial and one final
    aggregate; ``seq`` breaks ties between ticks at the same instant. The exact median and
    95th percentile keep a value->count map per bucket; ``approximate_quantiles`` trades
    them for bounded sketches.
    """
    spread = F.col("spread_pips").cast("double")
    # one smallest and one largest (ts, seq) row give all opens and closes
    opening = F.min(F.struct("ts", "seq", "bid", "ask", "mid", spread.alias("spread"))).alias("_o")
    closing = F.max(F.struct("ts", "seq", "bid", "ask", "mid")).alias("_c")
    extremes = []
    for side in SIDES:
        extremes += [F.max(side).alias(f"{side}_high"), F.min(side).alias(f"{side}_low")]
    middle = F.array(F.lit(0.5), F.lit(0.95))
    quantiles = (
        F.percentile_approx(spread, middle, 10_000)
        if approximate_quantiles
        else F.percentile(spread, middle)
    )
    made = ticks.groupBy(*by, F.window("ts", duration).alias("_w")).agg(
        opening,
        closing,
        *extremes,
        F.count(F.lit(1)).alias("tick_count"),
        F.sum("activity").alias("activity_count"),
        quantiles.alias("_q"),
        F.max(spread).alias("spread_max_pips"),
    )
    ends = [F.col(f"_o.{s}").alias(f"{s}_open") for s in SIDES]
    ends += [F.col(f"_c.{s}").alias(f"{s}_close") for s in SIDES]
    return made.select(
        "*", F.col("_w.start").alias("timestamp"), *ends,
        F.col("_o.spread").alias("spread_open_pips"),
        F.col("_q")[0].alias("spread_median_pips"), F.col("_q")[1].alias("spread_p95_pips"),
        F.col("_o.ts").alias("first_tick_timestamp"), F.col("_c.ts").alias("last_tick_timestamp"),
    ).select(*by, *BAR_COLUMNS)


def trading_week_filter(
    df: DataFrame, ts: str = "timestamp", tz: str = FX_TZ, boundary_hour: int = FX_BOUNDARY_HOUR
) -> DataFrame:
    return df.where(in_trading_week(ts, tz, boundary_hour))


def rollup_bars(
    bars: DataFrame,
    timeframes: dict[str, int] | None = None,
    *,
    base_minutes: int = 5,
    by: Sequence[str] = ("symbol",),
    tz: str = FX_TZ,
    boundary_hour: int = FX_BOUNDARY_HOUR,
) -> DataFrame:
    """All higher timeframes in one aggregation, anchored to the local trading day.

    Each base bar is routed to one bucket per timeframe (a generate, not a join), so the
    base table is read and shuffled once however many timeframes are asked for. Missing
    base bars are not filled; ``coverage_ratio`` reports them.
    """
    frames = timeframes or TIMEFRAMES
    routes = []
    for name, minutes in frames.items():
        start, end = anchored_bucket("timestamp", minutes, tz, boundary_hour)
        routes.append(
            F.struct(F.lit(name).alias("timeframe"), start.alias("start"), end.alias("end"))
        )
    src = trading_week_filter(bars, "timestamp", tz, boundary_hour).withColumn(
        "_r", F.explode(F.array(*routes))
    )
    opens = [f"{side}_open" for side in SIDES] + ["spread_open_pips"]
    closes = [f"{side}_close" for side in SIDES]
    extremes = []
    for side in SIDES:
        extremes += [F.max(f"{side}_high").alias(f"{side}_high"), F.min(f"{side}_low").alias(f"{side}_low")]
    extra = [F.sum(c).alias(c) for c in OPTIONAL_SUMS if c in bars.columns]
    out = src.groupBy(
        *by,
        F.col("_r.timeframe").alias("timeframe"),
        F.col("_r.start").alias("bucket_start"),
        F.col("_r.end").alias("available_at"),
    ).agg(
        F.min(F.struct("timestamp", *opens)).alias("_o"),
        F.max(F.struct("timestamp", *closes)).alias("_c"),
        *extremes,
        F.sum("tick_count").alias("tick_count"),
        F.sum("activity_count").alias("activity_count"),
        F.median("spread_median_pips").alias("spread_median_pips"),
        F.max("spread_p95_pips").alias("spread_p95_pips"),
        F.max("spread_max_pips").alias("spread_max_pips"),
        F.count(F.lit(1)).alias("source_count"),
        *extra,
    )
    out = out.select(
        *by, "timeframe", F.col("bucket_start").alias("timestamp"), "available_at",
        *[
            F.col(f"{'_o' if f == 'open' else '_c'}.{s}_{f}") if f in ("open", "close") else F.col(f"{s}_{f}")
            for s in SIDES
            for f in OHLC
        ],
        *COUNT_COLUMNS, F.col("_o.spread_open_pips"), *SPREAD_COLUMNS[1:], "source_count",
        F.col("_o.timestamp").alias("first_source_timestamp"),
        F.col("_c.timestamp").alias("last_source_timestamp"),
        *[c for c in OPTIONAL_SUMS if c in bars.columns],
    )
    return with_coverage(out, base_minutes, by)


def with_coverage(bars: DataFrame, base_minutes: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Expected base-bar count from the elapsed time, coverage ratio and ``bar_id``."""
    elapsed = (micros("available_at") - micros("timestamp")) / F.lit(60_000_000 * base_minutes)
    out = bars.withColumn("expected_count", F.round(elapsed).cast("int")).withColumn(
        "coverage_ratio", F.col("source_count") / F.col("expected_count")
    ).withColumn("bar_id", F.concat_ws(":", "timeframe", iso("timestamp")))
    lead = [*by, "bar_id", "timeframe", "timestamp", "available_at"]
    return out.select(*lead, *[c for c in out.columns if c not in lead])


def as_timeframe(bars: DataFrame, timeframe: str, minutes: int) -> DataFrame:
    """Base bars in the shape of a higher timeframe (``available_at`` = end of the bar)."""
    out = bars.withColumn("timeframe", F.lit(timeframe)).withColumn(
        "available_at", minutes_after("timestamp", minutes)
    )
    return out.withColumn("bar_id", F.concat_ws(":", "timeframe", iso("timestamp")))


def eligible_bars(bars: DataFrame, min_coverage: float) -> DataFrame:
    """Flag bars that may take part in structure labels."""
    ok: Column = (
        (F.col("coverage_ratio") >= min_coverage)
        & F.col("atr").isNotNull()
        & (F.col("available_at") > F.col("timestamp"))
    )
    return bars.withColumn("structure_eligible", F.coalesce(ok, F.lit(False)))
