"""Indicators and labels that only need bounded neighbourhoods or point-in-time lookups.

Frames carry ``bar_idx`` (position in the series). Neighbours are positional, so weekends and
holes do not matter unless an operator says it needs contiguous bars.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import iso, micros, to_trade_direction
from .asof import asof, range_join
from .blocks import drop_halo, halo_window, previous_row, with_halo

BY = ("symbol", "timeframe")
TOUCH = 1e-12


def _trigger_eligible() -> Column:
    """Daily bars give context only; they never trigger an entry."""
    return F.col("timeframe") != "1D"


def true_range_atr(bars: DataFrame, period: int = 14, by: Sequence[str] = BY) -> DataFrame:
    """``true_range``, simple-mean ``atr`` (NULL until ``period`` rows) and ``body_atr``."""
    if period < 2:
        raise ValueError("ATR period must be at least two")
    w = halo_window(by)
    prev = F.lag("mid_close").over(w)
    tr = F.greatest(
        F.col("mid_high") - F.col("mid_low"),
        F.abs(F.col("mid_high") - prev),
        F.abs(F.col("mid_low") - prev),
    )
    frame = w.rowsBetween(-(period - 1), 0)
    out = with_halo(bars, by, period, 0).withColumn("true_range", tr)
    out = out.withColumn(
        "atr", F.when(F.count("true_range").over(frame) == period, F.avg("true_range").over(frame))
    )
    body = F.try_divide(F.abs(F.col("mid_close") - F.col("mid_open")), F.col("atr"))
    return drop_halo(out).withColumn("body_atr", body)


def pivot_columns(by: Sequence[str], left: int, right: int, pip_size: float) -> tuple[Column, Column, Column]:
    """Over rows with a halo: whether the window is whole and eligible, and the high and the low pivot (NULL: none)."""
    w = halo_window(by)
    full = w.rowsBetween(-left, right)
    after = w.rowsBetween(1, right)
    before = w.rowsBetween(-left, -1)
    whole = (F.count(F.lit(1)).over(full) == left + right + 1) & F.min("structure_eligible").over(full)

    def side(kind: str) -> Column:
        c = F.col(f"mid_{kind}")
        s = F.lit(1.0 if kind == "high" else -1.0)
        top = F.max(s * c).over(full)
        later = F.max(s * c).over(after)
        others = F.greatest(F.max(s * c).over(before), later)
        cells = [F.lag(c, k).over(w) for k in range(left, 0, -1)] + [c]
        cells += [F.lead(c, k).over(w) for k in range(1, right + 1)]
        equal = reduce(
            lambda a, b: a + b,
            [F.when(F.abs(s * x - top) <= TOUCH, 1).otherwise(0) for x in cells],
        )
        is_pivot = (F.abs(s * c - top) <= TOUCH) & (F.abs(later - top) > TOUCH)
        return F.when(
            is_pivot,
            F.struct(
                F.lit(kind).alias("kind"),
                c.alias("price"),
                equal.alias("plateau_size"),
                ((s * c - others) / pip_size).alias("extreme_margin_pips"),
            ),
        )

    return whole, side("high"), side("low")


def label_swings(
    bars: DataFrame,
    *,
    left: int = 2,
    right: int = 2,
    tolerance_pips: float = 1.0,
    pip_size: float = 0.0001,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Confirmed pivots: the bar is the extreme of its window and the last bar equal to it."""
    w = halo_window(by)
    whole, high, low = pivot_columns(by, left, right, pip_size)
    base = with_halo(
        bars.select(
            *by, "bar_idx", "bar_id", "timestamp", "available_at",
            "mid_high", "mid_low", "atr", "structure_eligible",
        ),
        by, left, right,
    )
    ids = [F.lag("bar_id", k).over(w) for k in range(left, 0, -1)] + [F.col("bar_id")]
    ids += [F.lead("bar_id", k).over(w) for k in range(1, right + 1)]
    pivots = drop_halo(
        base.withColumn("_whole", whole)
        .withColumn("_high", high)
        .withColumn("_low", low)
        .withColumn("confirmation_bar_id", F.lead("bar_id", right).over(w))
        .withColumn("_confirmed_at", F.lead("available_at", right).over(w))
        .withColumn("source_bar_ids", F.array(*ids))
    ).where("_whole and (_high is not null or _low is not null)")
    swings = (
        pivots.withColumn("_p", F.explode(F.array_compact(F.array("_high", "_low"))))
        .select(
            *by,
            F.concat(
                F.lit("swing:"), F.col("timeframe"), F.lit(":"), F.col("_p.kind"),
                F.lit(":"), iso("timestamp"), F.lit(f":r{right}"),
            ).alias("event_id"),
            F.concat(F.lit("swing_"), F.col("_p.kind")).alias("event_type"),
            F.col("timestamp").alias("event_at"),
            F.col("_confirmed_at").alias("available_at"),
            F.when(F.col("_p.kind") == "high", "up").otherwise("down").alias("direction"),
            F.col("_p.price").alias("price"),
            "atr",
            F.col("bar_idx").alias("pivot_index"),
            (F.col("bar_idx") + right).alias("confirmation_index"),
            F.lit(False).alias("ambiguous_equal"),
            (F.col("_p.plateau_size") > 1).alias("resolved_plateau"),
            F.col("_p.plateau_size").alias("plateau_size"),
            F.col("_p.extreme_margin_pips").alias("extreme_margin_pips"),
            "bar_id",
            "confirmation_bar_id",
            "source_bar_ids",
            F.lit(right).alias("confirmation_delay_bars"),
            _trigger_eligible().alias("entry_trigger_eligible"),
        )
    )
    return relate_swings(swings, tolerance_pips=tolerance_pips, pip_size=pip_size, by=by)


def swing_relation(delta: Column, tol: float) -> Column:
    """Relation of a swing to the one before of its kind, ``delta`` higher (NULL: there is none)."""
    high, first = F.col("event_type") == "swing_high", delta.isNull()
    return (
        F.when(high & first, "H0").when(first, "L0")
        .when(high & (delta > tol), "HH").when(high & (delta < -tol), "LH").when(high, "EQH")
        .when(delta > tol, "HL").when(delta < -tol, "LL").otherwise("EQL")
    )


def relate_swings(
    swings: DataFrame,
    *,
    tolerance_pips: float = 1.0,
    pip_size: float = 0.0001,
    by: Sequence[str] = BY,
) -> DataFrame:
    """HH/LH/EQH and HL/LL/EQL against the previous pivot of the same kind (first: H0/L0)."""
    out = previous_row(swings, [*by, "event_type"], "pivot_index", ["price", "event_id"], "_prev")
    delta = F.col("price") - F.col("_prev.price")
    relation = swing_relation(delta, tolerance_pips * pip_size)
    return (
        out.withColumn("structural_relationship", relation)
        .withColumn("relationship_delta_pips", delta / pip_size)
        .withColumn("previous_same_side_swing_id", F.col("_prev.event_id"))
        .drop("_prev")
    )


def series_length(bars: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return bars.groupBy(*by).agg((F.max("bar_idx") + 1).alias("_series_rows"))


def _gap_sides(first_high: Column, first_low: Column) -> Column:
    """Both possible gaps of a three-bar pattern; entries without a gap are removed."""
    up = F.when(
        F.col("mid_low") - first_high > 0,
        F.struct(
            F.lit("up").alias("direction"),
            first_high.alias("lower_bound"),
            F.col("mid_low").alias("upper_bound"),
            (F.col("mid_low") - first_high).alias("size"),
        ),
    )
    down = F.when(
        first_low - F.col("mid_high") > 0,
        F.struct(
            F.lit("down").alias("direction"),
            F.col("mid_high").alias("lower_bound"),
            first_low.alias("upper_bound"),
            (first_low - F.col("mid_high")).alias("size"),
        ),
    )
    return F.array_compact(F.array(up, down))


def formed_gaps(bars: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Every gap of three contiguous eligible bars, of any size (``_g``: direction, bounds, size)."""
    w = halo_window(by)
    frame = w.rowsBetween(-2, 0)
    cols = [
        *by, "bar_idx", "bar_id", "timestamp", "available_at",
        "mid_high", "mid_low", "atr", "structure_eligible",
    ]
    return drop_halo(
        with_halo(bars.select(*cols), by, 2, 0)
        .withColumn(
            "_ok",
            (F.count(F.lit(1)).over(frame) == 3)
            & F.min("structure_eligible").over(frame)
            & (F.lag("available_at", 2).over(w) == F.lag("timestamp", 1).over(w))
            & (F.lag("available_at", 1).over(w) == F.col("timestamp")),
        )
        .withColumn("_g", _gap_sides(F.lag("mid_high", 2).over(w), F.lag("mid_low", 2).over(w)))
        .withColumn(
            "source_bar_ids",
            F.array(F.lag("bar_id", 2).over(w), F.lag("bar_id", 1).over(w), F.col("bar_id")),
        )
    ).where("_ok").withColumn("_g", F.explode("_g"))


def label_gaps(
    bars: DataFrame,
    *,
    min_size_atr: float | Column = 0.10,
    max_age: int = 24,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Three-bar wick gaps on contiguous eligible bars, with partial fill, full fill and expiry."""
    ratio = min_size_atr if isinstance(min_size_atr, Column) else F.lit(float(min_size_atr))
    formed = formed_gaps(bars, by)
    gaps = formed.where(F.col("_g.size") >= ratio * F.col("atr")).select(
        *by,
        F.concat(
            F.lit("fvg:"), F.col("timeframe"), F.lit(":"), F.col("_g.direction"), F.lit(":"),
            iso("timestamp"), F.lit(":m"), ratio.cast("string"),
        ).alias("event_id"),
        F.lit("fair_value_gap").alias("event_type"),
        F.col("timestamp").alias("event_at"),
        "available_at",
        "_g.direction", "_g.lower_bound", "_g.upper_bound", "_g.size",
        (F.col("_g.size") / F.col("atr")).alias("size_atr"),
        "atr", "bar_idx", "bar_id", "source_bar_ids",
        _trigger_eligible().alias("entry_trigger_eligible"),
    )

    later = bars.where("structure_eligible").select(
        *by, F.col("bar_idx").alias("_i"), F.col("available_at").alias("_at"),
        F.col("mid_high").alias("_h"), F.col("mid_low").alias("_l"),
    )
    span = gaps.select(
        *by, "bar_idx", "direction", "lower_bound", "upper_bound",
        (F.col("bar_idx") + 1).alias("_from"), (F.col("bar_idx") + max_age + 1).alias("_to"),
    )
    path = range_join(span, later, by=by, start="_from", end="_to", on="_i", bucket_seconds=64)
    up = F.col("direction") == "up"
    partial = F.when(up, F.col("_l") < F.col("upper_bound")).otherwise(
        F.col("_h") > F.col("lower_bound")
    )
    full = F.when(up, F.col("_l") <= F.col("lower_bound")).otherwise(
        F.col("_h") >= F.col("upper_bound")
    )
    fills = path.groupBy(*by, "bar_idx", "direction").agg(
        F.min(F.when(partial, F.col("_at"))).alias("partial_fill_at"),
        F.min(F.when(full, F.col("_at"))).alias("full_fill_at"),
        F.min(F.when(full, F.col("_i") - F.col("bar_idx"))).alias("fill_delay_bars"),
    )
    out = gaps.join(fills, [*by, "bar_idx", "direction"], "left").join(
        series_length(bars, by), list(by)
    )
    status = (
        F.when(F.col("full_fill_at").isNotNull(), "filled")
        .when(F.col("_series_rows") - F.col("bar_idx") - 1 >= max_age, "expired")
        .otherwise("open_at_sample_end")
    )
    return out.withColumn("status", status).drop("_series_rows")


def label_gaps_simple(
    bars: DataFrame,
    *,
    minutes: int,
    timeframe: str,
    atr_period: int = 14,
    min_size_atr: float = 0.10,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Gaps for execution timing: contiguous bars, own ATR, no eligibility and no lifecycle."""
    w = halo_window(by)
    prev = F.lag("mid_close").over(w)
    tr = F.greatest(
        F.col("mid_high") - F.col("mid_low"),
        F.abs(F.col("mid_high") - prev),
        F.abs(F.col("mid_low") - prev),
    )
    step = F.lit(minutes * 60_000_000)
    frame = w.rowsBetween(-(atr_period - 1), 0)
    src = with_halo(
        bars.select(*by, "bar_idx", "timestamp", "mid_high", "mid_low", "mid_close"),
        by, max(atr_period, 2), 0,
    ).withColumn("_tr", tr)
    src = (
        src.withColumn(
            "atr", F.when(F.count("_tr").over(frame) == atr_period, F.avg("_tr").over(frame))
        )
        .withColumn(
            "_ok",
            (micros("timestamp") - F.lag(micros("timestamp"), 1).over(w) == step)
            & (F.lag(micros("timestamp"), 1).over(w) - F.lag(micros("timestamp"), 2).over(w) == step),
        )
        .withColumn("first_bar_at", F.lag("timestamp", 2).over(w))
        .withColumn("_g", _gap_sides(F.lag("mid_high", 2).over(w), F.lag("mid_low", 2).over(w)))
    )
    out = drop_halo(src).where("_ok and atr is not null").withColumn("_g", F.explode("_g"))
    side = to_trade_direction("_g.direction")
    return out.where(F.col("_g.size") >= min_size_atr * F.col("atr")).select(
        *by,
        F.lit(timeframe).alias("timeframe"),
        side.alias("direction"),
        "first_bar_at",
        F.col("timestamp").alias("third_bar_at"),
        F.timestamp_micros(micros("timestamp") + step).alias("available_at"),
        "_g.lower_bound", "_g.upper_bound", "_g.size", "atr",
        F.concat(F.lit(f"fvg:{timeframe}:"), side, F.lit(":"), iso("timestamp")).alias("fvg_id"),
    )


def _sweep_hits(
    bars: DataFrame, swings: DataFrame, min_excursion_atr: float, by: Sequence[str]
) -> DataFrame:
    """First bar of each swing whose wick passes it by the buffer, while it is the latest one."""
    kinds = F.array(F.lit("swing_high"), F.lit("swing_low"))
    probe = bars.where(
        F.col("structure_eligible") & F.col("atr").isNotNull() & (F.col("atr") > 0)
    ).select(
        *by, "bar_idx", "bar_id", "timestamp", "available_at", "atr", "body_atr",
        "mid_high", "mid_low", "mid_close", F.explode(kinds).alias("event_type"),
    )
    known = swings.withColumn("_known", F.col("available_at"))
    joined = asof(
        probe, known, left_on="timestamp", right_on="_known", by=[*by, "event_type"],
        cols={
            "event_id": "source_swing_id", "available_at": "source_swing_available_at",
            "price": "swept_level", "pivot_index": "_pivot",
        },
        ties=("event_id",),
    )
    high = F.col("event_type") == "swing_high"
    buffer = F.col("atr") * min_excursion_atr
    passes = F.when(high, F.col("mid_high") >= F.col("swept_level") + buffer).otherwise(
        F.col("mid_low") <= F.col("swept_level") - buffer
    )
    # one row per swing, combined map-side: the hit at the smallest position
    keys = [*by, "event_type", "_pivot"]
    rest = [c for c in joined.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col("bar_idx")).alias("_first")
    return joined.where(passes).groupBy(*keys).agg(first).select(*keys, "_first.*")


def label_sweeps(
    bars: DataFrame,
    swings: DataFrame,
    *,
    min_excursion_atr: float = 0.05,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Wick passes the latest confirmed swing and the close returns; two-sided bars are dropped."""
    hits = _sweep_hits(bars, swings, min_excursion_atr, by)
    high = F.col("event_type") == "swing_high"
    back = F.when(high, F.col("mid_close") <= F.col("swept_level")).otherwise(
        F.col("mid_close") >= F.col("swept_level")
    )
    per_bar = Window.partitionBy(*by, "bar_idx")  # at most two rows
    single = hits.where(back).withColumn("_sides", F.count(F.lit(1)).over(per_bar)).where("_sides = 1")
    excursion = F.when(high, F.col("mid_high") - F.col("swept_level")).otherwise(
        F.col("swept_level") - F.col("mid_low")
    )
    swept = F.when(high, "high").otherwise("low")
    return single.select(
        *by,
        F.concat(
            F.lit("sweep:"), F.col("timeframe"), F.lit(":"), iso("timestamp"), F.lit(":"), swept
        ).alias("event_id"),
        F.lit("liquidity_sweep").alias("primitive"),
        F.lit("liquidity_sweep").alias("event_type"),
        F.col("timestamp").alias("event_at"),
        "available_at",
        F.when(high, "short").otherwise("long").alias("direction"),
        F.when(high, "down").otherwise("up").alias("source_direction"),
        "atr", "body_atr", "bar_id", "bar_idx",
        "source_swing_id", "source_swing_available_at",
        swept.alias("swept_side"), "swept_level",
        (excursion / F.col("atr")).alias("wick_excursion_atr"),
    )


def sweep_stats(
    bars: DataFrame,
    swings: DataFrame,
    *,
    min_excursion_atr: float = 0.05,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Per series: excursions on each side and bars dropped as two-sided."""
    hits = _sweep_hits(bars, swings, min_excursion_atr, by)
    high = F.col("event_type") == "swing_high"
    back = F.when(high, F.col("mid_close") <= F.col("swept_level")).otherwise(
        F.col("mid_close") >= F.col("swept_level")
    )
    per_bar = hits.groupBy(*by, "bar_idx").agg(
        F.sum(F.when(high, 1).otherwise(0)).alias("_h"),
        F.sum(F.when(high, 0).otherwise(1)).alias("_l"),
        F.sum(F.when(back, 1).otherwise(0)).alias("_in"),
    )
    return per_bar.groupBy(*by).agg(
        F.sum("_h").alias("high_excursions"),
        F.sum("_l").alias("low_excursions"),
        F.sum(F.when(F.col("_in") > 1, 1).otherwise(0)).alias("ambiguous_bars"),
    )


def label_displacement(
    bars: DataFrame, *, min_body_atr: float = 0.8, by: Sequence[str] = BY
) -> DataFrame:
    """Eligible bars with a large directional body."""
    move = F.col("mid_close") - F.col("mid_open")
    big = bars.where(
        F.col("structure_eligible")
        & (F.col("body_atr") >= min_body_atr)
        & (F.abs(move) > TOUCH)
    )
    return big.select(
        *by,
        F.concat(F.lit("displacement:"), F.col("timeframe"), F.lit(":"), iso("timestamp")).alias(
            "event_id"
        ),
        F.lit("displacement").alias("primitive"),
        F.lit("displacement").alias("event_type"),
        F.col("timestamp").alias("event_at"),
        "available_at",
        F.when(move > 0, "long").otherwise("short").alias("direction"),
        F.when(move > 0, "up").otherwise("down").alias("source_direction"),
        "atr", "body_atr", "bar_id", "bar_idx",
    )


def union_events(breaks: DataFrame, sweeps: DataFrame, displacements: DataFrame) -> DataFrame:
    """Structure breaks, sweeps and displacements in one event schema."""
    b = breaks.where(F.col("event_type").isin("bos", "choch")).select(
        "symbol", "timeframe", "event_id",
        F.col("event_type").alias("primitive"), "event_type", "event_at", "available_at",
        to_trade_direction("direction").alias("direction"),
        F.col("direction").alias("source_direction"),
        "atr", "body_atr", "bar_id", "bar_idx",
        F.col("broken_swing_id").alias("source_swing_id"),
        F.col("broken_level").alias("swept_level"),
    )
    return b.unionByName(sweeps, allowMissingColumns=True).unionByName(
        displacements, allowMissingColumns=True
    )


def attach_event_features(
    events: DataFrame,
    base_bars: DataFrame,
    setup_bars: DataFrame,
    contexts: DataFrame,
    *,
    context_frames: tuple[str, str] = ("1H", "4H"),
    lookback: int = 4,
    body_bounds: tuple[float, float] = (0.8, 1.2),
    seed: int = 20260901,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Context alignment, body-size bucket and the four baseline directions of each event.

    ``missing_open_bar`` / ``missing_event_bar`` mark events whose session-open base bar or
    own bar is absent (an error row instead of an exception).
    """
    from ..functions.columns import hash_direction
    from .asof import asof_state

    opens = base_bars.select(
        *by, F.col("timestamp").alias("session_open_at"), F.col("mid_open").alias("session_open_mid")
    )
    series = [*by, "timeframe"]
    w = halo_window(series)
    prior = w.rowsBetween(-lookback, -1)
    bars = drop_halo(
        with_halo(
            setup_bars.select(
                *series, "bar_idx", "bar_id", "mid_high", "mid_low", "mid_close", "structure_eligible"
            ),
            series, lookback, 0,
        )
        .withColumn("_n", F.count(F.lit(1)).over(prior))
        .withColumn("_ok", F.min("structure_eligible").over(prior))
        .withColumn("_hi", F.max("mid_high").over(prior))
        .withColumn("_lo", F.min("mid_low").over(prior))
    ).select(*series, "bar_id", F.col("mid_close").alias("event_bar_close_mid"), "_n", "_ok", "_hi", "_lo")
    out = events.join(opens, [*by, "session_open_at"], "left").join(bars, [*series, "bar_id"], "left")
    first, second = context_frames
    out = asof_state(out, contexts, on="available_at", timeframe=first, name="h1_context", by=by)
    out = asof_state(out, contexts, on="available_at", timeframe=second, name="h4_context", by=by)

    want = F.when(F.col("direction") == "long", "bullish").otherwise("bearish")
    against = F.when(F.col("direction") == "long", "bearish").otherwise("bullish")
    h1, h4 = F.col("h1_context"), F.col("h4_context")
    sided = lambda c: c.isin("bullish", "bearish")
    close, start = F.col("event_bar_close_mid"), F.col("session_open_mid")
    full = (F.col("_n") == lookback) & F.col("_ok")
    lower, upper = body_bounds
    return (
        out.withColumn(
            "context_alignment",
            F.when((h1 == want) & (h4 == want), "both_aligned")
            .when((h1 == against) & (h4 == against), "both_opposed")
            .when(sided(h1) & sided(h4), "mixed")
            .otherwise("undetermined"),
        )
        .withColumn(
            "displacement_strength",
            F.when(F.col("body_atr") < lower, "below_0_8")
            .when(F.col("body_atr") < upper, "0_8_to_1_2")
            .otherwise("at_least_1_2"),
        )
        .withColumn("event_direction", F.col("direction"))
        .withColumn("seeded_random_direction", hash_direction("event_id", seed))
        .withColumn("session_momentum", F.when(close > start, "long").when(close < start, "short"))
        .withColumn(
            "session_mean_reversion", F.when(close > start, "short").when(close < start, "long")
        )
        .withColumn(
            "four_bar_close_breakout",
            F.when(full & (close > F.col("_hi")), "long").when(full & (close < F.col("_lo")), "short"),
        )
        .withColumn("baseline_feature_available_at", F.col("available_at"))
        .withColumn("missing_open_bar", start.isNull())
        .withColumn("missing_event_bar", close.isNull())
        .drop("_n", "_ok", "_hi", "_lo")
    )


def transition_counts(events: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Counts of consecutive bos/choch labels per series.

    ``events`` need ``bar_idx`` and ``event_seq`` (order of events on one bar, 0 or 1).
    """
    classified = events.where(F.col("event_type").isin("bos", "choch")).select(
        *by,
        (F.col("bar_idx") * 2 + F.col("event_seq")).alias("_pos"),
        F.concat_ws(":", "event_type", "direction").alias("_label"),
    )
    paired = previous_row(classified, by, "_pos", ["_label"], "_prev")
    return (
        paired.where("_prev is not null")
        .groupBy(*by, F.concat(F.col("_prev._label"), F.lit(" -> "), F.col("_label")).alias("transition"))
        .agg(F.count(F.lit(1)).alias("transition_count"))
    )
