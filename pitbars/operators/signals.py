"""Signals: selecting one decision per opportunity from events, zones and rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_trade_direction
from .asof import asof, asof_positive, range_join
from .blocks import drop_halo, halo_window, with_halo
from .calendars import assign_to_sessions
from .levels import zone_validity


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per group by a total order: ``min_by`` with partial aggregation (Spark plans it by sorting within tasks)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min_by(F.struct(*order, *rest), F.struct(*order))
    out = df.groupBy(*keys).agg(packed.alias("_first"))
    return out.select(*keys, *[F.col("_first")[c].alias(c) for c in [*order, *rest]]).select(
        *df.columns
    )


def structure_candidates(
    opportunities: DataFrame,
    breaks: DataFrame,
    *,
    setup: str,
    end_inclusive: bool = False,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Every BOS/CHoCH of the setup frame inside a session's observation window."""
    ev = breaks.where(
        (F.col("timeframe") == setup) & F.col("event_type").isin("bos", "choch")
    ).select(
        *by, F.col("event_id").alias("source_event_id"), "event_type", "event_at", "available_at",
        to_trade_direction("direction").alias("direction"), "atr",
        F.col("bar_id").alias("signal_bar_id"), "displacement_qualified",
    )
    joined = assign_to_sessions(ev, opportunities, by=by, end_inclusive=end_inclusive)
    return (
        joined.withColumn("decision_at", F.col("available_at"))
        .withColumn("feature_available_at", F.col("available_at"))
        .withColumnRenamed("event_at", "setup_bar_at")
        .drop("available_at")
        .withColumn(
            "signal_id",
            F.concat_ws(":", F.lit("candidate"), F.col("opportunity_id"), F.col("source_event_id")),
        )
    )


def select_signals(candidates: DataFrame, model_id: str) -> DataFrame:
    """First candidate per opportunity, stamped with the model."""
    picked = first_per_group(candidates, ["opportunity_id"], ["decision_at", "source_event_id"])
    return picked.withColumn("model_id", F.lit(model_id)).withColumn(
        "signal_id", F.concat_ws(":", F.lit("signal"), F.lit(model_id), F.col("opportunity_id"))
    )


def session_open_signals(
    opportunities: DataFrame,
    setup_bars: DataFrame,
    *,
    model_id: str,
    direction: Column | str,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """One signal per session at its open; sessions without a direction or a valid ATR drop out.

    ``direction`` is a column of ``opportunities`` or an expression over them.
    """
    d = F.col(direction) if isinstance(direction, str) else direction
    src = opportunities.withColumn("direction", d).where(F.col("direction").isNotNull())
    out = asof_positive(src, setup_bars, on="session_open_at", name="atr", by=by)
    return (
        out.where("atr is not null")
        .withColumn("decision_at", F.col("session_open_at"))
        .withColumn("feature_available_at", F.col("session_open_at"))
        .withColumn("model_id", F.lit(model_id))
        .withColumn("event_type", F.lit(model_id))
        .withColumn(
            "signal_id", F.concat_ws(":", F.lit("signal"), F.lit(model_id), F.col("opportunity_id"))
        )
    )


def zone_interaction_signals(
    opportunities: DataFrame,
    setup_bars: DataFrame,
    source_bars: DataFrame,
    snapshots: DataFrame,
    *,
    buffer_atr: float = 0.05,
    max_age: int = 500,
    end_inclusive: bool = False,
    model_id: str = "zone_interaction",
) -> DataFrame:
    """First bar of each session that breaks or rejects an active zone known at the bar's start.

    A zone snapshot is valid on an interval of source-bar positions; a setup bar has one
    position (its latest completed source bar), so the lookup is a position range join.
    """
    series = ["symbol", "timeframe"]
    prior = drop_halo(
        with_halo(
            setup_bars.select(
                *series, "bar_idx", "bar_id", "timestamp", "available_at",
                "mid_high", "mid_low", "mid_close", "atr",
            ),
            series, 1, 0,
        )
        .withColumn("_prev_close", F.lag("mid_close").over(halo_window(series)))
        .withColumn("_prev_end", F.lag("available_at").over(halo_window(series)))
    ).where("_prev_end = timestamp and atr > 0 and not isnan(atr)")
    prior = prior.drop("timeframe", "bar_idx", "_prev_end")
    inside = assign_to_sessions(
        prior.withColumnRenamed("timestamp", "event_at"), opportunities, end_inclusive=end_inclusive
    ).withColumnRenamed("event_at", "timestamp")
    placed = asof(
        inside, source_bars.select("symbol", F.col("available_at").alias("_end"), "bar_idx"),
        left_on="timestamp", right_on="_end", by=["symbol"], cols={"bar_idx": "_src_idx"},
    ).where("_src_idx is not null")
    valid = zone_validity(snapshots, max_age=max_age).select(
        "symbol", "zone_id", F.col("role").alias("zone_role"),
        F.col("lower_bound").alias("zone_lower_bound"),
        F.col("upper_bound").alias("zone_upper_bound"),
        F.col("center").alias("zone_center"),
        F.col("available_at").alias("feature_available_at"), "valid_from", "valid_to",
    )
    met = range_join(
        valid, placed, by=["symbol"], start="valid_from", end="valid_to", on="_src_idx",
        bucket_seconds=128,
    )
    lo, hi = F.col("zone_lower_bound"), F.col("zone_upper_bound")
    p, c, buf = F.col("_prev_close"), F.col("mid_close"), F.col("atr") * buffer_atr
    touches = (F.col("mid_low") <= hi) & (F.col("mid_high") >= lo)
    resist = F.col("zone_role") == "resistance"

    def choice(direction: str, name: str, rank: int) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), F.lit(direction).alias("direction"), F.lit(name).alias("event")
        )

    choices = F.array_compact(
        F.array(
            F.when(resist & (p <= hi + buf) & (c > hi + buf), choice("long", "resistance_breakout", 0)),
            F.when(resist & (p < lo) & touches & (c < lo), choice("short", "resistance_rejection", 1)),
            F.when(~resist & (p >= lo - buf) & (c < lo - buf), choice("short", "support_breakout", 0)),
            F.when(~resist & (p > hi) & touches & (c > hi), choice("long", "support_rejection", 1)),
        )
    )
    events = met.withColumn("_e", F.explode(choices)).withColumn(
        "_distance", F.abs(p - F.col("zone_center")) / F.col("atr")
    )
    opp = [c for c in opportunities.columns]
    pick = F.min(
        F.struct(
            "timestamp", "bar_id", "_distance", "_e.rank", "zone_id", "_e.direction", "_e.event",
            "available_at", "atr", "feature_available_at", "zone_role",
            "zone_lower_bound", "zone_upper_bound",
        )
    )
    return events.groupBy(*opp).agg(pick.alias("_s")).select(
        *opp,
        F.concat_ws(":", F.lit("signal"), F.lit(model_id), F.col("opportunity_id")).alias("signal_id"),
        F.lit(model_id).alias("model_id"),
        F.col("_s.available_at").alias("decision_at"),
        "_s.direction", F.col("_s.event").alias("event_type"),
        F.col("_s.bar_id").alias("signal_bar_id"), F.col("_s.timestamp").alias("setup_bar_at"),
        "_s.feature_available_at", "_s.atr", "_s.zone_id", "_s.zone_role",
        "_s.zone_lower_bound", "_s.zone_upper_bound",
    )


def _wanted() -> Column:
    return F.when(F.col("direction") == "long", "bullish").when(
        F.col("direction") == "short", "bearish"
    )


def align_filter(signals: DataFrame, context_columns: Iterable[str]) -> DataFrame:
    """Keep signals whose direction agrees with every attached context."""
    return signals.where(reduce(lambda a, b: a & b, [F.col(c) == _wanted() for c in context_columns]))


def confluence_filter(
    signals: DataFrame, gaps: DataFrame, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Displacement-qualified signals whose bar also closed a gap in the same direction."""
    keys = gaps.select(
        *by, F.col("bar_id").alias("signal_bar_id"),
        to_trade_direction("direction").alias("direction"),
    )
    return signals.where("displacement_qualified").join(
        keys, [*by, "signal_bar_id", "direction"], "left_semi"
    )


def _opposed(context: str) -> Column:
    return F.coalesce(
        ((F.col("direction") == "long") & (F.col(context) == "bearish"))
        | ((F.col("direction") == "short") & (F.col(context) == "bullish")),
        F.lit(False),
    )


RULES = {
    "displacement": lambda: F.col("displacement_qualified"),
    "h1_opposition_veto": lambda: ~_opposed("h1_context"),
    "h4_opposition_veto": lambda: ~_opposed("h4_context"),
}


def rule_filter(candidates: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Candidates passing every named rule; an unknown name is an error."""
    unknown = [r for r in rules if r not in RULES]
    if unknown:
        raise ValueError(f"Unknown filter rule: {unknown[0]}")
    return candidates.where(reduce(lambda a, b: a & b, [RULES[r]() for r in rules], F.lit(True)))


def first_by_filter(candidates: DataFrame, filters: dict[str, Sequence[str]]) -> DataFrame:
    """First passing candidate per (filter, opportunity), for all filters in one pass."""
    for rules in filters.values():
        rule_filter(candidates, rules)  # validates the names
    passed = F.array_compact(
        F.array(
            *[
                F.when(reduce(lambda a, b: a & b, [RULES[r]() for r in rules], F.lit(True)), F.lit(name))
                for name, rules in filters.items()
            ]
        )
    )
    tagged = candidates.withColumn("filter_id", F.explode(passed))
    return first_per_group(tagged, ["filter_id", "opportunity_id"], ["decision_at", "source_event_id"])


def fit_direction(
    outcomes: DataFrame,
    *,
    keys: Sequence[str] = ("session",),
    value: str = "net_r",
    fit_period: str | None = "construction",
) -> DataFrame:
    """Per session the direction with the higher mean outcome of ``fit_period``; a tie goes to long.

    Only rows of that period count (None: all rows), so what is chosen knows nothing of the periods it is applied to.
    """
    fitted = outcomes if fit_period is None else outcomes.where(F.col("period") == fit_period)
    means = fitted.groupBy(*keys, "direction").agg(F.avg(value).alias("construction_mean_net_r"))
    best = means.groupBy(*keys).agg(
        F.max_by(
            "direction",
            F.struct(F.col("construction_mean_net_r"), (F.col("direction") == "long").cast("int")),
        ).alias("_best")
    )
    return (
        means.join(best, list(keys))
        .withColumn("selected", F.col("direction") == F.col("_best"))
        .drop("_best")
    )


def fitted_signals(
    signals: DataFrame, fitted: DataFrame, *, keys: Sequence[str] = ("session",), model_id: str = "fitted"
) -> DataFrame:
    """The signals of every period whose direction ``fit_direction`` has selected for their session, as a model of their
    own. ``signals`` holds both directions of each opportunity; sessions that were not fitted give none."""
    chosen = fitted.where("selected").select(*keys, "direction")
    return signals.join(chosen, [*keys, "direction"]).withColumn("model_id", F.lit(model_id))


def funnel_counts(candidates: DataFrame, gaps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Candidates, aligned in each frame, aligned in both, and confluent, in one pass."""
    fits = _wanted()
    confluent = confluence_filter(align_filter(candidates, ["h1_context", "h4_context"]), gaps)
    flagged = candidates.join(
        confluent.select("signal_id").withColumn("_c", F.lit(1)), "signal_id", "left"
    )
    one = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    h1, h4 = F.col("h1_context") == fits, F.col("h4_context") == fits
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("structure_candidates"),
        one(h1).alias("h1_aligned_candidates"),
        one(h4).alias("h4_aligned_candidates"),
        one(h1 & h4).alias("h1_h4_aligned_candidates"),
        one(F.col("_c") == 1).alias("aligned_confluent_candidates"),
    )


def added_counts(current: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signals per model now and in a parent run, and the difference."""
    a = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("current_count"))
    b = parent.groupBy(*keys).agg(F.count(F.lit(1)).alias("parent_count"))
    out = a.join(b, list(keys), "full_outer").fillna(0, ["current_count", "parent_count"])
    return out.withColumn("added_count", F.col("current_count") - F.col("parent_count"))


def hour_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("model_id", "year", "session", "decision_local_hour").agg(
        F.count(F.lit(1)).alias("signal_count")
    )
