"""Entry funnel: immediate, coarse-gap and nested fine-gap entries with terminal statuses.

Every stage keeps two instants, the first stop/target resolution and the first mitigation, and
compares them; resolution wins on the same bar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import minutes_after, sign_of
from ..session import materialize
from .asof import asof, first_bar_after, range_join

IMMEDIATE, COARSE, NESTED = "e0_immediate", "e1_coarse_gap", "e2_nested_fine_gap"
_BASE = [
    "signal_id", "opportunity_id", "session", "session_date", "year", "period", "direction",
    "event_type", "decision_at", "cutoff_at", "mapping_status",
]


def _bar_view(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    return bars.select(
        *by, F.col("timestamp").alias("bar_at"), "bid_high", "bid_low", "ask_high", "ask_low"
    )


def _resolution() -> Column:
    """1 = stop touched, 2 = target touched, on the exit side; the stop has priority."""
    long = F.col("direction") == "long"
    stop = F.when(long, F.col("bid_low") <= F.col("_stop")).otherwise(F.col("ask_high") >= F.col("_stop"))
    target = F.when(long, F.col("bid_high") >= F.col("_target")).otherwise(
        F.col("ask_low") <= F.col("_target")
    )
    return F.when(stop, 1).when(target, 2)


def _scan(
    plans: DataFrame, bars: DataFrame, *, start: str, by: Sequence[str], end: str = "cutoff_at"
) -> DataFrame:
    """Per signal: first resolution (kind, time) and first mitigation on [start, end)."""
    slim = plans.select(
        *by, "signal_id", "direction", "_stop", "_target", "_near", start, end
    )
    path = range_join(slim, _bar_view(bars, by), by=by, start=start, end=end, on="bar_at")
    long = F.col("direction") == "long"
    near = F.when(long, F.col("ask_low") <= F.col("_near")).otherwise(F.col("bid_high") >= F.col("_near"))
    when_resolved = F.when(_resolution().isNotNull(), F.col("bar_at"))
    return path.groupBy("signal_id").agg(
        F.min(when_resolved).alias("_res_at"),
        F.min_by(_resolution(), when_resolved).alias("_res"),
        F.min(F.when(near, F.col("bar_at"))).alias("_mit_at"),
    )


def _entry_price() -> Column:
    return F.when(F.col("direction") == "long", F.col("_ask")).otherwise(F.col("_bid"))


def _inside() -> Column:
    s = sign_of("direction")
    return (s * (_entry_price() - F.col("_stop")) > 0) & (s * (F.col("_target") - _entry_price()) > 0)


def _resolved(code: Column) -> Column:
    return F.when(code == 1, "stop_before_entry").when(code == 2, "target_before_entry")


def _shape(df: DataFrame, model: str, by: Sequence[str]) -> DataFrame:
    names = [
        "coverage_status", "coarse_gap_id", "coarse_gap_available_at", "mitigation_bar_at",
        "fine_gap_id", "fine_gap_available_at", "entry_decision_at", "entry_at",
    ]
    for n in names:
        if n not in df.columns:
            kind = "string" if n.endswith(("_id", "status")) else "timestamp"
            df = df.withColumn(n, F.lit(None).cast(kind))
    return df.select(F.lit(model).alias("model_id"), *by, *_BASE, *names)


def entry_funnel(
    mappings: DataFrame,
    coarse_bars: DataFrame,
    fine_bars: DataFrame,
    coarse_gaps: DataFrame,
    fine_gaps: DataFrame,
    *,
    coarse_minutes: int = 5,
    fine_minutes: int = 1,
    target_atr: float = 2.0,
    by: Sequence[str] = ("symbol",),
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Three rows per mapped signal, one per entry model, each with its terminal status.

    Each stage reads its signals twice (to scan their paths and to keep them); ``cut``
    writes the stage's rows, so a plan does not repeat the stages before it.
    """
    by = list(by)
    s = sign_of("direction")
    valid = F.col("mapping_status") == "valid"
    e0 = _shape(
        mappings.withColumn(
            "coverage_status", F.when(valid, "entry").otherwise("invalid_parent_mapping")
        )
        .withColumn("entry_decision_at", F.when(valid, F.col("decision_at")))
        .withColumn("entry_at", F.when(valid, F.col("entry_at"))),
        IMMEDIATE, by,
    )

    plan = mappings.select(
        *by, *_BASE,
        F.col("structural_stop_price").alias("_stop"),
        (F.col("entry_reference_price") + s * (F.lit(target_atr) * F.col("atr"))).alias("_target"),
    )
    gaps = coarse_gaps.select(*by, "direction", "fvg_id", "available_at", "lower_bound", "upper_bound")
    plan = asof(
        plan, gaps, left_on="decision_at", right_on="available_at", by=[*by, "direction"],
        cols={
            "fvg_id": "_gid", "available_at": "_gat", "lower_bound": "_glo", "upper_bound": "_ghi",
        },
        ties=("fvg_id",), direction="forward",
    )
    has_gap = valid & F.col("_gid").isNotNull() & (F.col("_gat") < F.col("cutoff_at"))
    plan = (
        plan.withColumn("_has", F.coalesce(has_gap, F.lit(False)))
        .withColumn("_near", F.when(F.col("direction") == "long", F.col("_ghi")).otherwise(F.col("_glo")))
        .withColumn("coarse_gap_id", F.when(F.col("_has"), F.col("_gid")))
        .withColumn("coarse_gap_available_at", F.when(F.col("_has"), F.col("_gat")))
    )
    plan = cut(plan)
    live = plan.where("_has")
    unmet = F.when(~valid, "invalid_parent_mapping").when(~F.col("_has"), "no_directional_m5_fvg")
    decided_first = F.col("_res_at").isNotNull() & (
        F.col("_mit_at").isNull() | (F.col("_res_at") <= F.col("_mit_at"))
    )

    # E1: mitigation on coarse bars, next coarse bar is the entry
    e1 = plan.join(_scan(live, coarse_bars, start="_gat", by=by), "signal_id", "left")
    e1 = (
        e1.withColumn("mitigation_bar_at", F.when(~decided_first, F.col("_mit_at")))
        .withColumn("_from", minutes_after("mitigation_bar_at", coarse_minutes))
    )
    e1 = _enter(e1, coarse_bars, by)
    status = (
        F.when(unmet.isNotNull(), unmet)
        .when(decided_first, _resolved(F.col("_res")))
        .when(F.col("_mit_at").isNull(), "no_m5_mitigation_before_cutoff")
        .when(F.col("_entry_at").isNull(), "no_m5_entry_before_cutoff")
        .when(~_inside(), "entry_outside_stop_target")
        .otherwise("entry")
    )
    e1 = _finish(e1, status, COARSE, by)

    # E2: mitigation on fine bars, then the first overlapping fine gap, then the next fine bar
    e2 = plan.join(_scan(live, fine_bars, start="_gat", by=by), "signal_id", "left")
    e2 = e2.withColumn("mitigation_bar_at", F.when(~decided_first, F.col("_mit_at"))).withColumn(
        "_known", minutes_after("mitigation_bar_at", fine_minutes)
    )
    e2 = cut(e2)
    fg = fine_gaps.select(
        *by, "direction", F.col("fvg_id").alias("_fid"), F.col("available_at").alias("_fat"),
        F.col("first_bar_at").alias("_ffirst"), F.col("lower_bound").alias("_flo"),
        F.col("upper_bound").alias("_fhi"),
    )
    seek = e2.where("_known is not null and _known < cutoff_at").select(
        *by, "direction", "signal_id", "_known", "cutoff_at", "_glo", "_ghi"
    )
    nested = range_join(
        seek, fg, by=[*by, "direction"], start="_known", end="cutoff_at", on="_fat"
    ).where(
        (F.col("_ffirst") >= F.col("_known"))
        & (F.greatest("_flo", "_glo") < F.least("_fhi", "_ghi"))
    )
    pick = nested.groupBy("signal_id").agg(F.min(F.struct("_fat", "_fid")).alias("_f"))
    e2 = (
        e2.join(pick, "signal_id", "left")
        .withColumn("fine_gap_id", F.col("_f._fid"))
        .withColumn("fine_gap_available_at", F.col("_f._fat"))
        .drop("_f")
    )
    e2 = cut(e2)
    recheck = range_join(
        e2.where("fine_gap_available_at is not null").select(
            *by, "signal_id", "direction", "_stop", "_target", "_known", "fine_gap_available_at"
        ),
        _bar_view(fine_bars, by), by=by, start="_known", end="fine_gap_available_at", on="bar_at",
    )
    when_resolved = F.when(_resolution().isNotNull(), F.col("bar_at"))
    again = recheck.groupBy("signal_id").agg(F.min_by(_resolution(), when_resolved).alias("_again"))
    e2 = e2.join(again, "signal_id", "left").withColumn("_from", F.col("fine_gap_available_at"))
    e2 = _enter(e2, fine_bars, by)
    status = (
        F.when(unmet.isNotNull(), unmet)
        .when(decided_first, _resolved(F.col("_res")))
        .when(F.col("_mit_at").isNull(), "no_m1_mitigation_before_cutoff")
        .when(F.col("fine_gap_id").isNull(), "no_nested_m1_fvg_before_cutoff")
        .when(F.col("_again").isNotNull(), _resolved(F.col("_again")))
        .when(F.col("_entry_at").isNull(), "no_m1_entry_before_cutoff")
        .when(F.col("_entry_res").isNotNull(), _resolved(F.col("_entry_res")))
        .when(~_inside(), "entry_outside_stop_target")
        .otherwise("entry")
    )
    e2 = _finish(e2, status, NESTED, by)
    return e0.unionByName(e1).unionByName(e2)


def _enter(df: DataFrame, bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """First bar at or after ``_from`` before the cutoff, its opens and its own resolution.

    Rows without ``_from`` find no bar, so the lookup keeps every row and needs no join back.
    """
    named = {
        "ask_open": "_ask", "bid_open": "_bid",
        "bid_high": "bid_high", "bid_low": "bid_low", "ask_high": "ask_high", "ask_low": "ask_low",
    }
    out = first_bar_after(df, bars, on="_from", cols=named, by=by, before="cutoff_at")
    return (
        out.withColumn("_entry_res", _resolution())
        .withColumnRenamed("entry_at", "_entry_at")
        .drop("bid_high", "bid_low", "ask_high", "ask_low")
    )


def _finish(df: DataFrame, status: Column, model: str, by: Sequence[str]) -> DataFrame:
    out = df.withColumn("coverage_status", status)
    entered = F.col("coverage_status") == "entry"
    out = out.withColumn("entry_decision_at", F.when(entered, F.col("_from"))).withColumn(
        "entry_at", F.when(entered, F.col("_entry_at"))
    )
    return _shape(out, model, by)


def funnel_summary(funnel: DataFrame) -> DataFrame:
    return funnel.groupBy("model_id", "coverage_status").agg(F.count(F.lit(1)).alias("signal_count"))


def monthly_entries(funnel: DataFrame) -> DataFrame:
    return (
        funnel.where("coverage_status = 'entry'")
        .groupBy("model_id", F.substring("session_date", 1, 7).alias("month"))
        .agg(F.count(F.lit(1)).alias("entry_count"))
    )


def eligible_models(funnel: DataFrame, minimum: int = 120) -> DataFrame:
    counts = funnel.groupBy("model_id").agg(
        F.sum(F.when(F.col("coverage_status") == "entry", 1).otherwise(0)).alias("entry_count")
    )
    return counts.withColumn("eligible", F.col("entry_count") >= minimum)
