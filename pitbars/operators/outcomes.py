"""Path outcomes: what happened between a signal's entry and its cutoff.

A signal range-joins the base bars in [decision, cutoff) on (series, day). Its entry bar and
first-touch facts are aggregates over that bounded path (a session is under a day), so an
outcome costs one range join and one shuffle on the signal key, whatever the variants.

Quotes are viewed from the exit side: ``q_*`` is bid for longs and ask for shorts, ``q_fav``
and ``q_adv`` the favourable and adverse extremes. Entries use the other side's open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros, minutes_after, safe_div, sign_of
from ..params import Costs
from .asof import asof, first_bar_after, range_join, verify_source_event

KEY = "signal_id"
HIT_REASONS = {
    1: "stop_gap", 2: "target_gap", 3: "stop", 4: "target",
    5: "protected_stop_gap", 6: "protected_stop",
}
TARGET_CODES = (2, 4)


def signal_path(
    signals: DataFrame,
    bars: DataFrame,
    *,
    start: str = "decision_at",
    end: str = "cutoff_at",
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """One row per signal and base bar on its path, exit-side quotes, entry facts attached."""
    b = bars.select(
        *by, F.col("timestamp").alias("bar_at"),
        *[c for c in bars.columns if c.startswith(("bid_", "ask_"))],
    )
    long = F.col("direction") == "long"
    pick = lambda a, c: F.when(long, F.col(a)).otherwise(F.col(c))
    path = range_join(signals, b, by=by, start=start, end=end, on="bar_at")
    own = [c for c in signals.columns if c not in by]
    w = Window.partitionBy(KEY)
    return (
        path.select(
            *by, *own, "bar_at",
            sign_of("direction").alias("_sgn"),
            pick("bid_open", "ask_open").alias("q_open"),
            pick("bid_high", "ask_low").alias("q_fav"),
            pick("bid_low", "ask_high").alias("q_adv"),
            pick("bid_close", "ask_close").alias("q_close"),
            pick("ask_open", "bid_open").alias("_e_open"),
        )
        .withColumn("entry_at", F.min("bar_at").over(w))
        .withColumn("entry_reference_price", F.min_by("_e_open", "bar_at").over(w))
        .drop("_e_open")
    )


def _hit_code(stop: Column, target: Column, codes: Sequence[int] = (1, 2, 3, 4)) -> Column:
    """First rule that fires on a bar: stop at open, target at open, stop inside, target inside."""
    s = F.col("_sgn")
    gap_stop, gap_target, stop_in, target_in = codes
    return (
        F.when(s * (F.col("q_open") - stop) <= 0, gap_stop)
        .when(s * (F.col("q_open") - target) >= 0, gap_target)
        .when(s * (F.col("q_adv") - stop) <= 0, stop_in)
        .when(s * (F.col("q_fav") - target) >= 0, target_in)
    )


def _reason(code: Column, names: dict[int, str]) -> Column:
    out: Column = F.lit("time")
    for value, name in names.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def apply_costs(
    trades: DataFrame, costs: Costs = Costs(), slippage_pips: float | Column | None = None
) -> DataFrame:
    """Fills, pips, R and fixed-risk money from raw prices; risk is measured before slippage."""
    slip_pips = costs.slippage_pips_per_side if slippage_pips is None else slippage_pips
    slip_pips = slip_pips if isinstance(slip_pips, Column) else F.lit(float(slip_pips))
    s = sign_of("direction")
    pip = F.lit(costs.pip_size)
    commission = 2 * costs.commission_pips_per_side
    out = trades.withColumn("slippage_pips_per_side", slip_pips)
    slip = F.col("slippage_pips_per_side") * pip
    return (
        out.withColumn("entry_fill_price", F.col("entry_reference_price") + s * slip)
        .withColumn("exit_fill_price", F.col("raw_exit_price") - s * slip)
        .withColumn(
            "pnl_pips_before_commission",
            s * (F.col("exit_fill_price") - F.col("entry_fill_price")) / pip,
        )
        .withColumn("commission_pips_round_trip", F.lit(commission))
        .withColumn("net_pips", F.col("pnl_pips_before_commission") - commission)
        .withColumn("risk_pips", F.col("risk_price") / pip)
        .withColumn("net_r", F.col("net_pips") / F.col("risk_pips"))
        .withColumn("win", F.col("net_pips") > 0)
        .withColumn("fixed_risk_usd", F.lit(costs.fixed_risk_usd))
        .withColumn(
            "theoretical_lots",
            F.lit(costs.fixed_risk_usd) / (F.col("risk_pips") * costs.usd_per_pip_per_lot),
        )
        .withColumn("net_usd_at_fixed_risk", F.col("net_r") * costs.fixed_risk_usd)
    )


def apply_cost_scenarios(trades: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Primary and stress slippage side by side (``cost_case``); raw exits are the same."""
    cases = F.array(
        F.struct(F.lit("primary").alias("name"), F.lit(costs.slippage_pips_per_side).alias("slip")),
        F.struct(
            F.lit("stress").alias("name"), F.lit(costs.stress_slippage_pips_per_side).alias("slip")
        ),
    )
    wide = trades.withColumn("_case", F.explode(cases)).withColumn("cost_case", F.col("_case.name"))
    return apply_costs(wide, costs, F.col("_case.slip")).drop("_case")


def _first_touch_exits(
    path: DataFrame, keep: Sequence[str], bar_minutes: Column | int, cap_hit_exit: bool = False
) -> DataFrame:
    """Raw exit per group of ``keep`` columns; path rows carry stop_price, target_price, _code."""
    when_hit = F.when(F.col("_code").isNotNull(), F.col("bar_at"))
    agg = path.groupBy(*keep).agg(
        F.min(when_hit).alias("_hit_at"),
        F.min_by("_code", when_hit).alias("_hit"),
        F.min_by("q_open", when_hit).alias("_hit_open"),
        F.max("bar_at").alias("_last_at"),
        F.max_by("q_close", "bar_at").alias("_last_close"),
    )
    code = F.col("_hit")
    raw = (
        F.when(code.isin(1, 5), F.col("_hit_open"))
        .when(code.isin(*TARGET_CODES), F.col("target_price"))
        .when(code == 3, F.col("stop_price"))
        .when(code == 6, F.col("entry_reference_price"))
        .otherwise(F.col("_last_close"))
    )
    end_of = lambda at: minutes_after(at, bar_minutes)
    hit_exit = end_of("_hit_at")
    if cap_hit_exit:
        hit_exit = F.least(hit_exit, F.col("cutoff_at"))
    return (
        agg.withColumn("raw_exit_price", raw)
        .withColumn(
            "exit_at",
            F.when(code.isNotNull(), hit_exit).otherwise(
                F.least(end_of("_last_at"), F.col("cutoff_at"))
            ),
        )
        .withColumn("exit_code", code)
        .drop("_hit_at", "_hit", "_hit_open", "_last_at", "_last_close")
    )


def bracket_variants(
    signals: DataFrame,
    bars: DataFrame,
    variants: dict[str, tuple[Column, Column]],
    *,
    costs: Costs = Costs(),
    bar_minutes: Column | int = 5,
    start: str = "decision_at",
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """First-touch outcome of each signal under each variant (stop price, target price).

    The expressions may use signal columns, ``entry_reference_price`` and ``_sgn``. Signals
    without a bar before the cutoff, or with a stop on the wrong side, yield no row.
    """
    path = signal_path(signals, bars, start=start, by=by)
    specs = F.array(
        *[
            F.struct(F.lit(n).alias("id"), s.cast("double").alias("stop"), t.cast("double").alias("target"))
            for n, (s, t) in variants.items()
        ]
    )
    rows = (
        path.withColumn("_v", F.explode(specs))
        .withColumn("variant_id", F.col("_v.id"))
        .withColumn("stop_price", F.col("_v.stop"))
        .withColumn("target_price", F.col("_v.target"))
        .drop("_v")
    )
    s, entry = F.col("_sgn"), F.col("entry_reference_price")
    rows = rows.withColumn("risk_price", s * (entry - F.col("stop_price"))).where("risk_price > 0")
    rows = rows.withColumn("_code", _hit_code(F.col("stop_price"), F.col("target_price")))
    keep = [c for c in rows.columns if c not in ("bar_at", "q_open", "q_fav", "q_adv", "q_close", "_code")]
    out = _first_touch_exits(rows, keep, bar_minutes)
    out = out.withColumn("exit_reason", _reason(F.col("exit_code"), HIT_REASONS)).withColumn(
        "target_r_before_costs",
        safe_div(s * (F.col("target_price") - entry), F.col("risk_price")),
    )
    return apply_costs(out, costs).drop("_sgn", "exit_code")


def bracket_outcome(
    signals: DataFrame,
    bars: DataFrame,
    *,
    stop_atr: float = 1.0,
    target_r: float = 2.0,
    costs: Costs = Costs(),
    bar_minutes: int = 5,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """ATR stop and R-multiple target; needs a finite positive ``atr``."""
    ok = signals.where("atr > 0 and not isnan(atr) and atr < double('Infinity')")
    s, entry, dist = F.col("_sgn"), F.col("entry_reference_price"), F.lit(stop_atr) * F.col("atr")
    variants = {"bracket": (entry - s * dist, entry + s * (F.lit(target_r) * dist))}
    out = bracket_variants(ok, bars, variants, costs=costs, bar_minutes=bar_minutes, by=by)
    # risk is the stop distance itself, not the rounded difference of two prices
    return apply_costs(out.withColumn("risk_price", F.lit(stop_atr) * F.col("atr")), costs).drop(
        "variant_id"
    )


def structural_variants(
    mappings: DataFrame,
    bars: DataFrame,
    *,
    target_atr: float = 2.0,
    target_r: float = 2.0,
    costs: Costs = Costs(),
    bar_minutes: int = 5,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Structural stop with a fixed ATR target and with a risk-multiple target."""
    s, entry, stop = F.col("_sgn"), F.col("entry_reference_price"), F.col("structural_stop_price")
    risk = s * (entry - stop)
    src = mappings.where("mapping_status = 'valid'").drop("entry_at", "entry_reference_price")
    return bracket_variants(
        src, bars,
        {
            "structural_fixed_2atr": (stop, entry + s * (F.lit(target_atr) * F.col("atr"))),
            "structural_2r": (stop, entry + s * (F.lit(target_r) * risk)),
        },
        costs=costs, bar_minutes=bar_minutes, by=by,
    )


def delayed_entry_outcome(
    entries: DataFrame,
    mappings: DataFrame,
    bars: DataFrame,
    *,
    target_atr: float = 2.0,
    costs: Costs = Costs(),
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Outcome of delayed entries: structural stop kept, target fixed at the parent's entry.

    ``entries``: by, model_id, signal_id, entry_at, timeframe, bar_minutes. ``bars`` holds every
    resolution with a ``timeframe`` column; each entry only meets bars of its own.
    """
    s = sign_of("direction")
    plan = mappings.where("mapping_status = 'valid'").select(
        *by, "signal_id", "direction", "cutoff_at", "atr", "session", "session_date", "period",
        "opportunity_id", "structural_stop_price",
        (F.col("entry_reference_price") + s * (F.lit(target_atr) * F.col("atr"))).alias("_target"),
    )
    keyed = (
        entries.select(*by, "signal_id", F.col("model_id").alias("variant_model"), "timeframe",
                       "bar_minutes", F.col("entry_at").alias("planned_entry_at"))
        .join(plan, [*by, "signal_id"])
        .withColumn("parent_signal_id", F.col("signal_id"))
        .withColumn("signal_id", F.concat_ws("|", "variant_model", "signal_id"))
    )
    out = bracket_variants(
        keyed, bars, {"delayed": (F.col("structural_stop_price"), F.col("_target"))},
        costs=costs, bar_minutes=F.col("bar_minutes"), start="planned_entry_at",
        by=[*by, "timeframe"],
    )
    return (
        out.where("entry_at = planned_entry_at and target_r_before_costs > 0")
        .withColumnRenamed("variant_model", "model_id")
        .drop("variant_id", "_target")
    )


def protected_bracket(
    mappings: DataFrame,
    bars: DataFrame,
    *,
    target_atr: float = 2.0,
    trigger_atr: float = 1.0,
    costs: Costs = Costs(),
    bar_minutes: int = 5,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Static bracket and the variant that moves the stop to entry after a favourable trigger.

    The trigger counts on a bar that did not exit and acts from the next bar on the path; on
    the last bar it is triggered but never activated.
    """
    src = mappings.where("mapping_status = 'valid'").drop("entry_at", "entry_reference_price")
    path = signal_path(src, bars, by=by)
    s, entry = F.col("_sgn"), F.col("entry_reference_price")
    w = Window.partitionBy(KEY)
    path = (
        path.withColumn("stop_price", F.col("structural_stop_price"))
        .withColumn("risk_price", s * (entry - F.col("stop_price")))
        .where("risk_price > 0 and not isnan(risk_price)")
        .withColumn("target_price", entry + s * (F.lit(target_atr) * F.col("atr")))
        .withColumn("trigger_price", entry + s * (F.lit(trigger_atr) * F.col("atr")))
        .withColumn("_hard", _hit_code(F.col("stop_price"), F.col("target_price")))
        .withColumn("_safe", _hit_code(entry, F.col("target_price"), (5, 2, 6, 4)))
        .withColumn("_h", F.min(F.when(F.col("_hard").isNotNull(), F.col("bar_at"))).over(w))
        .withColumn(
            "_g", F.min(F.when(s * (F.col("q_fav") - F.col("trigger_price")) >= 0, F.col("bar_at"))).over(w)
        )
        .withColumn("_g", F.when(F.col("_h").isNull() | (F.col("_g") < F.col("_h")), F.col("_g")))
        .withColumn("_next", F.min(F.when(F.col("bar_at") > F.col("_g"), F.col("bar_at"))).over(w))
    )
    models = F.array(F.lit("static_bracket"), F.lit("break_even_after_trigger"))
    rows = path.withColumn("variant_id", F.explode(models))
    moved = F.col("variant_id") == "break_even_after_trigger"
    rows = (
        rows.withColumn(
            "_code",
            F.when(moved & (F.col("bar_at") > F.col("_g")), F.col("_safe")).otherwise(F.col("_hard")),
        )
        .withColumn(
            "trigger_observed_at",
            F.when(
                moved & F.col("_g").isNotNull(),  # least() would skip a NULL
                F.least(minutes_after("_g", bar_minutes), F.col("cutoff_at")),
            ),
        )
        .withColumn("protection_active_from", F.when(moved, F.col("_next")))
        .drop("_h", "_g", "_next", "_hard", "_safe")
    )
    keep = [c for c in rows.columns if c not in ("bar_at", "q_open", "q_fav", "q_adv", "q_close", "_code")]
    out = _first_touch_exits(rows, keep, bar_minutes, cap_hit_exit=True)
    names = {**HIT_REASONS, 1: "hard_stop_gap", 3: "hard_stop"}
    out = (
        out.withColumn("exit_reason", _reason(F.col("exit_code"), names))
        .withColumn("protection_triggered", F.col("trigger_observed_at").isNotNull())
        .withColumn("protection_activated", F.col("protection_active_from").isNotNull())
        .withColumn(
            "target_r_before_costs", F.lit(target_atr) * F.col("atr") / F.col("risk_price")
        )
    )
    return apply_costs(out, costs).drop("_sgn", "exit_code")


def structural_stop(
    signals: DataFrame,
    swings: DataFrame,
    breaks: DataFrame,
    bars: DataFrame,
    *,
    setup_minutes: int = 15,
    buffer_atr: float = 0.10,
    costs: Costs = Costs(),
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Stop beyond the latest opposing swing, measured on the base bars inside the swing bar."""
    from .asof import latest_opposing_swing

    out = verify_source_event(signals, breaks, by=by)
    out = latest_opposing_swing(out, swings, by=by)
    out = first_bar_after(
        out, bars, on="decision_at", before="cutoff_at", by=by,
        cols={"ask_open": "_ask", "bid_open": "_bid"},
    )
    spans = (
        out.where("structural_swing_event_at is not null")
        .select(*by, KEY, F.col("structural_swing_event_at").alias("_s"))
        .withColumn("_e", minutes_after("_s", setup_minutes))
    )
    inside = range_join(
        spans, bars.select(*by, "timestamp", "bid_low", "ask_high"), by=by, start="_s", end="_e",
        bucket_seconds=setup_minutes * 60,
    )
    levels = inside.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.min("bid_low").alias("_low"), F.max("ask_high").alias("_high")
    )
    out = out.join(levels, KEY, "left")
    s = sign_of("direction")
    long = F.col("direction") == "long"
    ready = (
        F.col("source_event_match")
        & F.col("structural_swing_id").isNotNull()
        & F.col("entry_at").isNotNull()
    )
    has_bars = ready & F.col("_n").isNotNull()
    level = F.when(long, F.col("_low")).otherwise(F.col("_high"))
    entry = F.when(long, F.col("_ask")).otherwise(F.col("_bid"))
    stop = level - s * (F.lit(buffer_atr) * F.col("atr"))
    distance = s * (entry - stop)
    status = (
        F.when(~F.col("source_event_match"), "source_event_mismatch")
        .when(F.col("structural_swing_id").isNull(), "missing_opposing_swing")
        .when(F.col("entry_at").isNull(), "missing_entry_bar")
        .when(F.col("_n").isNull(), "missing_swing_execution_bars")
        .when(F.isnan(distance) | (distance <= 0) | distance.isNull(), "stop_wrong_side_of_entry")
        .otherwise("valid")
    )
    out = (
        out.withColumn("mapping_status", status)
        .withColumn("entry_reference_price", F.when(has_bars, entry))
        .withColumn("swing_execution_bar_count", F.when(has_bars, F.col("_n")).otherwise(F.lit(0)))
        .withColumn("structural_unbuffered_level", F.when(has_bars, level))
        .withColumn("structural_buffer_atr", F.lit(buffer_atr))
        .withColumn("structural_stop_price", F.when(has_bars, stop))
        .withColumn("structural_stop_distance", F.when(has_bars, distance))
    )
    risk = F.col("structural_stop_distance") / F.lit(costs.pip_size)
    return (
        out.withColumn("structural_stop_atr", F.col("structural_stop_distance") / F.col("atr"))
        .withColumn("structural_risk_pips", risk)
        .withColumn(
            "theoretical_lots_at_fixed_risk",
            F.when(risk > 0, F.lit(costs.fixed_risk_usd) / (risk * costs.usd_per_pip_per_lot)),
        )
        .drop("_ask", "_bid", "_n", "_low", "_high")
    )


def _excursion_path(signals: DataFrame, bars: DataFrame, by: Sequence[str]) -> DataFrame:
    path = signal_path(signals.where("atr > 0 and not isnan(atr)"), bars, by=by)
    s, entry = F.col("_sgn"), F.col("entry_reference_price")
    zero = F.lit(0.0)
    return path.withColumn(
        "_adv", F.greatest(s * (entry - F.col("q_adv")) / F.col("atr"), zero)
    ).withColumn("_fav", F.greatest(s * (F.col("q_fav") - entry) / F.col("atr"), zero))


def excursions(signals: DataFrame, bars: DataFrame, *, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Largest adverse and favourable excursion in ATR up to the cutoff, stop disabled."""
    path = _excursion_path(signals, bars, by)
    keep = [*signals.columns, "entry_at", "entry_reference_price"]
    return path.groupBy(*keep).agg(
        F.count(F.lit(1)).alias("observed_bar_count"),
        F.max("bar_at").alias("last_observed_bar_at"),
        F.max("_adv").alias("max_adverse_excursion_atr"),
        F.max("_fav").alias("max_favorable_excursion_atr"),
    )


SEQUENCE_LABELS = (
    "neither_touched", "target_before_stop", "stop_without_later_target",
    "stop_then_target_later", "same_bar_ambiguous_stop_first",
)
STOP_FIRST_LABELS = (
    "stop_without_later_target", "stop_then_target_later", "same_bar_ambiguous_stop_first",
)


def threshold_sequence(
    signals: DataFrame,
    bars: DataFrame,
    *,
    stops: Sequence[float] = (1.0, 1.25, 1.5, 2.0),
    fixed_target: float = 2.0,
    rr_multiple: float = 2.0,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Which threshold came first for each stop and target mode; same-bar touches stay ambiguous."""
    grid = F.array(
        *[
            F.struct(F.lit(float(k)).alias("stop"), F.lit(m).alias("mode"), F.lit(float(t)).alias("target"))
            for k in stops
            for m, t in (("fixed_2atr", fixed_target), ("rr_preserving_2_to_1", k * rr_multiple))
        ]
    )
    path = _excursion_path(signals, bars, by).withColumn("_cell", F.explode(grid))
    path = path.select(
        *signals.columns, "bar_at", "_adv", "_fav",
        F.col("_cell.stop").alias("stop_atr"), F.col("_cell.mode").alias("target_mode"),
        F.col("_cell.target").alias("target_atr"),
    )
    first = path.groupBy(*signals.columns, "stop_atr", "target_mode", "target_atr").agg(
        F.min(F.when(F.col("_adv") >= F.col("stop_atr"), F.col("bar_at"))).alias("stop_touch_bar_at"),
        F.min(F.when(F.col("_fav") >= F.col("target_atr"), F.col("bar_at"))).alias("target_touch_bar_at"),
    )
    st, tg = F.col("stop_touch_bar_at"), F.col("target_touch_bar_at")
    label = (
        F.when(st.isNull() & tg.isNull(), "neither_touched")
        .when(st.isNull() | (tg < st), "target_before_stop")
        .when(tg.isNull(), "stop_without_later_target")
        .when(st < tg, "stop_then_target_later")
        .otherwise("same_bar_ambiguous_stop_first")
    )
    labelled = first.withColumn("sequence", label)
    w = Window.partitionBy(KEY)  # at most |grid| rows per signal
    base = F.max(
        F.when((F.col("stop_atr") == 1.0) & (F.col("target_mode") == "fixed_2atr"), F.col("sequence"))
    ).over(w)
    return labelled.withColumn("original_fixed_sequence", base).withColumn(
        "saved_original_premature",
        F.coalesce(
            (F.col("target_mode") == "fixed_2atr")
            & (F.col("original_fixed_sequence") == "stop_then_target_later")
            & (F.col("sequence") == "target_before_stop"),
            F.lit(False),
        ),
    )


def _event_paths(
    events: DataFrame, bars: DataFrame, horizon: int, by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Events with their entry bar, and those events joined to the bars up to ``horizon`` minutes."""
    ok = events.where("atr > 0 and not isnan(atr) and atr < double('Infinity')")
    entered = first_bar_after(
        ok, bars, on="available_at", cols={"mid_open": "_entry", "bar_idx": "_entry_idx"}, by=by
    ).where("entry_at is not null")
    span = entered.select(*by, "event_id", "atr", "entry_at", "_entry").withColumn(
        "_until", minutes_after("entry_at", horizon)
    )
    path = range_join(
        span,
        bars.select(*by, F.col("timestamp").alias("bar_at"), "mid_high", "mid_low"),
        by=by, start="entry_at", end="_until", on="bar_at", bucket_seconds=horizon * 60,
    )
    return entered, path


def forward_returns(
    events: DataFrame,
    bars: DataFrame,
    *,
    horizons: Sequence[int] = (15, 30, 60, 120, 240),
    rules: Sequence[str] = (
        "event_direction", "seeded_random_direction", "session_momentum",
        "session_mean_reversion", "four_bar_close_breakout",
    ),
    base_minutes: int = 5,
    pip_size: float = 0.0001,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Signed forward return, MFE and MAE per event, horizon and direction rule.

    The horizon runs from the actual entry bar; a row needs a bar exactly at its end and an
    unbroken path. One range join over the longest horizon serves all horizons.
    """
    entered, path = _event_paths(events, bars, max(horizons), by)
    up, down = F.col("mid_high") - F.col("_entry"), F.col("_entry") - F.col("mid_low")
    aggs = []
    for h in horizons:
        within = micros("bar_at") < micros("entry_at") + h * 60_000_000
        aggs += [
            F.count(F.when(within, F.lit(1))).alias(f"_n{h}"),
            F.max(F.when(within, up / F.col("atr"))).alias(f"_up{h}"),
            F.max(F.when(within, down / F.col("atr"))).alias(f"_dn{h}"),
        ]
    extremes = path.groupBy(*by, "event_id").agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_minutes"), F.col(f"_n{h}").alias("path_bar_count"),
                F.col(f"_up{h}").alias("_up"), F.col(f"_dn{h}").alias("_dn"),
            )
            for h in horizons
        ]
    )
    wide = (
        entered.join(extremes, [*by, "event_id"])
        .withColumn("_h", F.explode(cells))
        .select(*entered.columns, "_h.*")
        .withColumn("exit_at", minutes_after("entry_at", F.col("horizon_minutes")))
    )
    exits = bars.select(
        *by, F.col("timestamp").alias("exit_at"), F.col("mid_open").alias("_exit"),
        F.col("bar_idx").alias("_exit_idx"),
    )
    steps = F.col("horizon_minutes") / F.lit(base_minutes)
    exact = wide.join(exits, [*by, "exit_at"]).where(
        (F.col("path_bar_count") == steps) & (F.col("_exit_idx") - F.col("_entry_idx") == steps)
    )
    exact = exact.withColumn(
        "raw_forward_return_atr", (F.col("_exit") - F.col("_entry")) / F.col("atr")
    ).withColumn("_raw_pips", (F.col("_exit") - F.col("_entry")) / F.lit(pip_size))
    choices = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("predicted_direction")) for r in rules]
    )
    out = exact.withColumn("_c", F.explode(choices))
    s = sign_of("_c.predicted_direction")
    long = F.col("_c.predicted_direction") == "long"
    favourable = F.when(long, F.col("_up")).when(s.isNotNull(), F.col("_dn"))
    adverse = F.when(long, F.col("_dn")).when(s.isNotNull(), F.col("_up"))
    floor0 = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    keep = [c for c in events.columns if c not in rules]
    return out.select(
        *keep, "entry_at", "exit_at", "horizon_minutes", "path_bar_count",
        "_c.rule", "_c.predicted_direction", s.isNotNull().alias("emitted_prediction"),
        F.col("direction").alias("event_direction"),
        "raw_forward_return_atr",
        (s * F.col("raw_forward_return_atr")).alias("signed_forward_return_atr"),
        (s * F.col("_raw_pips")).alias("signed_forward_return_pips"),
        floor0(favourable).alias("mfe_atr"), floor0(adverse).alias("mae_atr"),
        F.year("event_at").alias("event_year"),
    )


def barrier_first(
    outcomes: DataFrame,
    bars: DataFrame,
    *,
    barrier_atr: float = 1.0,
    horizon: int = 240,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Which barrier an emitted prediction met first within the horizon.

    ``outcomes`` are ``forward_returns`` rows: only events with an exact path to the horizon count.
    """
    at_horizon = outcomes.where((F.col("horizon_minutes") == horizon) & F.col("emitted_prediction"))
    span = at_horizon.select(*by, "event_id", "atr", "entry_at", "exit_at").distinct()
    entry = asof(
        span, bars.select(*by, F.col("timestamp").alias("_ts"), "mid_open"),
        left_on="entry_at", right_on="_ts", by=by, cols={"mid_open": "_entry"},
    )
    path = range_join(
        entry, bars.select(*by, F.col("timestamp").alias("bar_at"), "mid_high", "mid_low"),
        by=by, start="entry_at", end="exit_at", on="bar_at", bucket_seconds=horizon * 60,
    )
    limit = F.lit(barrier_atr)
    touched = path.groupBy(*by, "event_id").agg(
        F.min(F.when((F.col("mid_high") - F.col("_entry")) / F.col("atr") >= limit, F.col("bar_at"))).alias("_up_at"),
        F.min(F.when((F.col("_entry") - F.col("mid_low")) / F.col("atr") >= limit, F.col("bar_at"))).alias("_dn_at"),
    )
    out = at_horizon.join(touched, [*by, "event_id"])
    long = F.col("predicted_direction") == "long"
    fav = F.when(long, F.col("_up_at")).otherwise(F.col("_dn_at"))
    adv = F.when(long, F.col("_dn_at")).otherwise(F.col("_up_at"))
    label = (
        F.when(fav.isNull() & adv.isNull(), "neither")
        .when(adv.isNull() | (fav < adv), "favorable_first")
        .when(fav.isNull() | (adv < fav), "adverse_first")
        .otherwise("same_bar_ambiguous")
    )
    return (
        out.withColumn("barrier_sequence", label)
        .withColumn("barrier_atr", F.lit(barrier_atr))
        .withColumn("barrier_horizon_minutes", F.lit(horizon))
        .drop("_up_at", "_dn_at")
    )
