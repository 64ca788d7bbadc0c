"""The study's questions on the driver tables, one named query per operator.

``events`` is the tick source: five series, 30-minute base bars (10-minute fine bars), frames
1H / 4H / 1D, signals on 1H with 4H and 1D context. ``orders`` is a second source whose ticks
share instants. Every query reads a whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_direction
from ..operators import asof, audit, bars, blocks, calendars, funnel, labels, levels
from ..operators import order_blocks as ob
from ..operators import outcomes as out
from ..operators import profile, rules, signals, stats, variants
from ..params import FILTER_RULES, SESSIONS, Costs, LabelParams
from ..session import configure, scratch_path
from ..sources import readers
from .present import present
from .tables import Study, event_ticks, order_ticks

PIP = 0.01
COSTS = Costs(pip_size=PIP)
FRAMES = {"1H": 60, "4H": 240, "1D": 1440}
PARAMS = LabelParams(min_coverage=0.5, pip_size=PIP)
CONTEXTS = ("4H", "1D")
RESAMPLES = 10_000


class EventStudy(Study):
    """Tables derived from ``events`` that several queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        super().__init__(
            event_ticks(spark, sf_dir, PIP), base_minutes=30, base_name="30min",
            frames=FRAMES, setup="1H", params=PARAMS,
        )

    @cached_property
    def fine(self) -> DataFrame:
        made = self._cut(bars.ticks_to_bars(self.ticks, "10 minutes"))
        return self._cut(bars.as_timeframe(blocks.with_bar_index(made, ["symbol"]), "10min", 10))

    @cached_property
    def coarse_gaps(self) -> DataFrame:
        return labels.label_gaps_simple(self.base, minutes=30, timeframe="30min")

    @cached_property
    def fine_gaps(self) -> DataFrame:
        return labels.label_gaps_simple(self.fine, minutes=10, timeframe="10min")

    @cached_property
    def sweeps(self) -> DataFrame:
        return labels.label_sweeps(self.bars, self.swings)

    @cached_property
    def displacements(self) -> DataFrame:
        return labels.label_displacement(self.bars)

    @cached_property
    def event_table(self) -> DataFrame:
        return self._cut(labels.union_events(self.breaks, self.sweeps, self.displacements))

    @cached_property
    def order_blocks(self) -> tuple[DataFrame, DataFrame]:
        return ob.label_order_blocks(
            self.bars, self.breaks, self.gaps, pip_size=PIP, timeframes=("1H", "4H"), cut=self._cut
        )

    @cached_property
    def zones(self) -> tuple[DataFrame, DataFrame]:
        return levels.cluster_levels(self.swings, self.bars)

    @cached_property
    def candidates(self) -> DataFrame:
        c = signals.structure_candidates(self.calendar(), self.breaks, setup="1H")
        c = asof.asof_state(c, self.context_table, on="decision_at", timeframe="4H", name="h1_context")
        c = asof.asof_state(c, self.context_table, on="decision_at", timeframe="1D", name="h4_context")
        return self._cut(c)

    @cached_property
    def context_table(self) -> DataFrame:
        return self._cut(self.contexts)

    @cached_property
    def first_signals(self) -> DataFrame:
        return signals.select_signals(self.candidates, "p3")

    @cached_property
    def open_signals(self) -> DataFrame:
        opp = asof.asof_pair(
            self.calendar(), self.bars.where("timeframe = '4H'"), on="session_open_at"
        )
        made = signals.session_open_signals(
            opp, self.setup_bars, model_id="p1", direction="pair_direction"
        )
        return self._cut(made.drop("pair_direction"))

    @cached_property
    def both_signals(self) -> DataFrame:
        opp = self.calendar()
        sides = [
            signals.session_open_signals(
                opp, self.setup_bars, model_id=f"fit_{d}", direction=F.lit(d)
            )
            for d in ("long", "short")
        ]
        return sides[0].unionByName(sides[1])

    @cached_property
    def trades(self) -> DataFrame:
        return self._cut(
            out.bracket_outcome(
                self.open_signals, self.base, stop_atr=0.5, target_r=1.0, costs=COSTS, bar_minutes=30
            ).withColumn("trade_id", F.concat_ws(":", F.lit("trade"), "signal_id"))
        )

    @cached_property
    def both_trades(self) -> DataFrame:
        return self._cut(
            out.bracket_outcome(
                self.both_signals, self.base, stop_atr=0.5, target_r=1.0, costs=COSTS, bar_minutes=30
            )
        )

    @cached_property
    def mappings(self) -> DataFrame:
        return self._cut(
            out.structural_stop(
                self.first_signals, self.swings.where("timeframe = '1H'"),
                self.breaks.where("timeframe = '1H'"), self.base, setup_minutes=60, costs=COSTS,
            )
        )

    @cached_property
    def structural_trades(self) -> DataFrame:
        return out.structural_variants(self.mappings, self.base, costs=COSTS, bar_minutes=30)

    @cached_property
    def protected(self) -> DataFrame:
        return self._cut(
            out.protected_bracket(
                self.mappings, self.base, target_atr=1.0, trigger_atr=0.5, costs=COSTS, bar_minutes=30
            )
        )

    @cached_property
    def funnel(self) -> DataFrame:
        return self._cut(
            funnel.entry_funnel(
                self.mappings, self.base, self.fine, self.coarse_gaps, self.fine_gaps,
                coarse_minutes=30, fine_minutes=10, cut=self._cut,
            )
        )

    @cached_property
    def excursions(self) -> DataFrame:
        return out.excursions(self.open_signals, self.base)

    @cached_property
    def sequences(self) -> DataFrame:
        return out.threshold_sequence(self.open_signals, self.base)

    @cached_property
    def features(self) -> DataFrame:
        ev = calendars.assign_to_sessions(
            self.event_table.where("timeframe = '1H'"), self.calendar(),
            until="cutoff_at", require_known_after_open=True,
        )
        f = labels.attach_event_features(
            ev, self.base, self.bars, self.context_table, context_frames=CONTEXTS
        )
        primary = signals.first_per_group(
            f.select("symbol", "primitive", "opportunity_id", "available_at", "event_id"),
            ["primitive", "opportunity_id"], ["available_at", "event_id"],
        ).select("symbol", "primitive", "event_id", F.lit(True).alias("_p"))
        return self._cut(
            f.join(primary, ["symbol", "primitive", "event_id"], "left")
            .withColumn("is_primary", F.coalesce("_p", F.lit(False)))
            .drop("_p")
        )

    @cached_property
    def forward(self) -> DataFrame:
        return self._cut(
            out.forward_returns(
                self.features, self.base, horizons=(30, 60, 120, 240), base_minutes=30, pip_size=PIP
            )
        )

    @cached_property
    def barriers(self) -> DataFrame:
        return out.barrier_first(self.forward, self.base, barrier_atr=0.5, horizon=240)

    @cached_property
    def panel(self) -> DataFrame:
        scored = self.both_trades.select("opportunity_id", "model_id", "net_r")
        return stats.opportunity_panel(self.calendar(), ("fit_long", "fit_short"), scored)


Query = tuple[Callable[[EventStudy], DataFrame], str]
CATALOG: dict[str, Query] = {}


def query(spec: str) -> Callable[[Callable[[EventStudy], DataFrame]], Callable[[EventStudy], DataFrame]]:
    def register(fn: Callable[[EventStudy], DataFrame]) -> Callable[[EventStudy], DataFrame]:
        CATALOG[fn.__name__] = (fn, spec)
        return fn

    return register


BAR_SPEC = " ".join(f"f:{c}" for c in bars.PRICE_COLUMNS) + (
    " i:tick_count i:activity_count f:spread_open_pips f:spread_median_pips f:spread_p95_pips f:spread_max_pips"
)
TICK_BAR_SPEC = f"symbol t:timestamp {BAR_SPEC} t:first_tick_timestamp t:last_tick_timestamp"


# --- bars -----------------------------------------------------------------------------------
@query(TICK_BAR_SPEC)
def tick_bars(s):
    return s.base


@query(TICK_BAR_SPEC)
def tick_bars_equal_times(s):
    return bars.ticks_to_bars(order_ticks(s.spark, s.sf_dir, PIP), "1440 minutes")


@query(
    f"symbol timeframe t:timestamp t:available_at {BAR_SPEC} i:source_count i:expected_count"
    " f:coverage_ratio t:first_source_timestamp t:last_source_timestamp bar_id"
)
def rollup_anchored(s):
    return s.bars


@query("symbol i:kept i:first_hour i:last_hour")
def trading_week(s):
    kept = bars.trading_week_filter(s.base)
    return kept.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("kept"), F.min(F.hour("timestamp")).alias("first_hour"),
        F.max(F.hour("timestamp")).alias("last_hour"),
    )


@query("symbol timeframe i:bar_idx t:timestamp f:true_range f:atr f:body_atr b:structure_eligible")
def atr_eligible(s):
    return s.bars


# --- sources --------------------------------------------------------------------------------
@query("symbol i:ticks f:bid_sum f:spread_sum")
def dedupe_ticks(s):
    once = bars.dedupe_ticks(s.ticks.unionByName(s.ticks.withColumn("seq", F.col("seq") + 1_000_000)))
    return once.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("ticks"), F.sum("bid").alias("bid_sum"), F.sum("spread_pips").alias("spread_sum")
    )


@query("symbol t:timestamp f:mid_close i:seq")
def dedupe_bars(s):
    old = s.base.withColumn("seq", F.lit(1)).withColumn("mid_close", F.lit(0.0))
    return bars.dedupe_bars_keep_last(old.unionByName(s.base.withColumn("seq", F.lit(2))), year=2024)


@query("symbol t:timestamp f:mid_open f:mid_close i:tick_count")
def read_bars_range(s):
    path = scratch_path(s.spark, "bars")
    readers.write_bars(s.base.drop("bar_idx", "timeframe", "available_at", "bar_id"), path)
    return readers.read_bars(s.spark, path, "2024-01-08", "2024-01-22")


@query("symbol t:timestamp f:mid_open f:mid_high f:mid_low f:mid_close i:tick_count")
def write_bars_months(s):
    """Half a month first, then all months over it, then only missing ones and all again: the table is that of one write."""
    path = scratch_path(s.spark, "bars")
    made = s.base.drop("bar_idx", "timeframe", "available_at", "bar_id")
    readers.write_bars(made.where("timestamp < '2024-01-16'"), path)
    readers.write_bars(made, path)
    readers.write_bars(made, path, only_missing=True)
    readers.write_bars(made, path)
    return s.spark.read.parquet(path)


@query("symbol t:ts f:bid f:ask f:mid f:spread_pips")
def read_tick_archive(s):
    path = scratch_path(s.spark, "ticks")
    stamp = F.date_format(F.from_utc_timestamp("ts", readers.TICK_TZ), "yyyyMMdd HHmmssSSS")
    s.ticks.select(stamp, "bid", "ask", F.lit(0)).write.csv(path)
    return readers.read_ticks_csv(s.spark, path, symbol="ALL", pip_size=PIP)


# --- calendar and point-in-time joins -----------------------------------------------------
@query("symbol opportunity_id session session_date i:year period t:session_open_at t:observation_end_at t:cutoff_at")
def sessions(s):
    return s.calendar(full=False)


@query("opportunity_id t:observation_end_at t:cutoff_at")
def sessions_full(s):
    return s.calendar()


@query("opportunity_id event_id primitive t:event_at t:available_at direction")
def session_events(s):
    return calendars.assign_to_sessions(
        s.event_table.where("timeframe = '1H'"), s.calendar(), until="cutoff_at",
        require_known_after_open=True,
    )


@query("opportunity_id event_id")
def opening_events(s):
    return calendars.assign_to_sessions(
        s.event_table.where("timeframe = '1H'"), s.calendar(full=False), end_inclusive=True
    )


@query("model_id i:year session decision_local_hour i:signal_count")
def local_hours(s):
    return signals.hour_counts(calendars.local_hour(s.first_signals, SESSIONS))


@query("symbol t:timestamp state")
def asof_context(s):
    return asof.asof_state(s.base, s.context_table, on="timestamp", timeframe="4H", name="state")


@query("opportunity_id f:atr")
def asof_atr(s):
    return asof.asof_positive(s.calendar(), s.setup_bars, on="session_open_at")


@query("opportunity_id pair_direction")
def momentum_pair(s):
    return asof.asof_pair(s.calendar(), s.bars.where("timeframe = '4H'"), on="session_open_at")


@query("symbol event_id t:available_at t:entry_at f:entry_mid")
def first_bar_after(s):
    return asof.first_bar_after(
        s.event_table, s.base, on="available_at", cols={"mid_open": "entry_mid"}
    )


@query("opportunity_id structural_swing_id structural_swing_relationship")
def opposing_swing(s):
    return asof.latest_opposing_swing(s.first_signals, s.swings.where("timeframe = '1H'"))


@query("signal_id b:source_event_match")
def source_event(s):
    return asof.verify_source_event(s.candidates, s.breaks)


# --- labels ---------------------------------------------------------------------------------
@query(
    "symbol timeframe event_id event_type t:event_at t:available_at direction f:price f:atr i:pivot_index"
    " i:confirmation_index i:plateau_size f:extreme_margin_pips bar_id confirmation_bar_id structural_relationship"
)
def swings(s):
    return s.swings


@query(
    "symbol timeframe event_id event_type t:event_at t:available_at direction regime_before regime_after"
    " broken_level_role broken_swing_id f:broken_level f:close f:atr b:displacement_qualified bar_id i:event_seq"
)
def regime_breaks(s):
    return s.breaks


@query(
    "symbol timeframe event_id t:event_at t:available_at previous_state state cause latest_high_swing_id"
    " latest_low_swing_id protected_high_swing_id protected_low_swing_id"
)
def regime_contexts(s):
    return s.context_table


@query(
    "symbol timeframe event_id t:event_at t:available_at direction f:lower_bound f:upper_bound f:size f:size_atr"
    " t:partial_fill_at t:full_fill_at f:fill_delay_bars status"
)
def gaps(s):
    return s.gaps


@query("symbol direction t:first_bar_at t:third_bar_at t:available_at f:lower_bound f:upper_bound f:size f:atr fvg_id")
def gaps_simple(s):
    return s.coarse_gaps


@query("symbol direction t:first_bar_at t:available_at f:size f:atr fvg_id")
def gaps_simple_fine(s):
    return s.fine_gaps


@query("symbol timeframe zone_id role f:center f:lower_bound f:upper_bound i:touch_count t:available_at b:active swing_id")
def zone_touches(s):
    return s.zones[1]


@query(
    "symbol timeframe zone_id role f:center f:lower_bound f:upper_bound f:half_width i:touch_count t:created_at"
    " t:active_at t:last_touch_at i:age_bars_at_sample_end i:bars_since_last_touch status_at_sample_end"
)
def level_zones(s):
    return s.zones[0]


OB_SPEC = (
    "symbol timeframe event_id t:event_at direction anchor_break_id t:candidate_at candidate_bar_id i:candidate_index"
    " i:anchor_index f:lower_bound f:upper_bound f:width_pips b:fvg_confluent i:overlap_with_prior_zone_count"
    " i:nested_with_prior_zone_count f:terminal_delay_bars i:observed_bars status"
    " t:first_touch_at t:midpoint_touch_at t:full_mitigation_at t:invalidation_at"
)


@query(OB_SPEC)
def order_blocks(s):
    return s.order_blocks[0]


@query("symbol timeframe anchor_break_id b:candidate_found candidate_bar_id status")
def order_block_anchors(s):
    return s.order_blocks[1]


@query(
    "symbol timeframe event_id t:event_at t:available_at direction f:atr source_swing_id"
    " t:source_swing_available_at swept_side f:swept_level f:wick_excursion_atr"
)
def sweeps(s):
    return s.sweeps


@query("symbol timeframe i:high_excursions i:low_excursions i:ambiguous_bars")
def sweep_stats(s):
    return labels.sweep_stats(s.bars, s.swings)


@query("symbol timeframe event_id t:event_at t:available_at direction f:body_atr")
def displacement(s):
    return s.displacements


@query("symbol timeframe event_id primitive t:event_at t:available_at direction f:atr f:body_atr bar_id")
def events_union(s):
    return s.event_table


@query(
    "symbol event_id opportunity_id h1_context h4_context context_alignment displacement_strength seeded_random_direction"
    " session_momentum session_mean_reversion four_bar_close_breakout f:session_open_mid f:event_bar_close_mid b:is_primary"
)
def event_features(s):
    return s.features


@query("symbol i:event_id coin")
def hash_coin(s):
    return s.ticks.select("symbol", F.col("seq").alias("event_id"), hash_direction(F.col("seq").cast("string"), 20260901).alias("coin"))


@query("symbol timeframe transition i:transition_count")
def transitions(s):
    return labels.transition_counts(s.breaks)


# --- signals --------------------------------------------------------------------------------
@query(
    "opportunity_id source_event_id event_type t:setup_bar_at t:decision_at direction f:atr b:displacement_qualified"
    " h1_context h4_context"
)
def structure_candidates(s):
    return s.candidates


@query("signal_id opportunity_id source_event_id t:decision_at direction")
def first_signal(s):
    return s.first_signals


@query("signal_id opportunity_id t:decision_at direction f:atr")
def session_open_signals(s):
    return s.open_signals


@query(
    "opportunity_id t:setup_bar_at t:decision_at direction event_type zone_id zone_role f:zone_lower_bound"
    " f:zone_upper_bound f:atr t:feature_available_at"
)
def zone_signals(s):
    snaps = s.zones[1].where("timeframe = '4H'")
    return signals.zone_interaction_signals(
        s.calendar(), s.setup_bars, s.bars.where("timeframe = '4H'"), snaps
    )


@query("opportunity_id source_event_id direction h1_context")
def aligned_candidates(s):
    return signals.align_filter(s.candidates, ["h1_context"])


@query("opportunity_id source_event_id direction")
def confluent_candidates(s):
    return signals.confluence_filter(s.candidates, s.gaps)


@query("filter_id opportunity_id source_event_id t:decision_at direction")
def rule_filters(s):
    return signals.first_by_filter(s.candidates, FILTER_RULES)


@query("session direction f:construction_mean_net_r b:selected")
def fit_direction(s):
    return signals.fit_direction(s.both_trades)


@query("signal_id opportunity_id session direction model_id")
def fitted_signals(s):
    return signals.fitted_signals(s.both_signals, signals.fit_direction(s.both_trades))


@query("session i:structure_candidates i:h1_aligned_candidates i:h4_aligned_candidates i:h1_h4_aligned_candidates i:aligned_confluent_candidates")
def funnel_counts(s):
    return signals.funnel_counts(s.candidates, s.gaps, ["session"])


@query("session i:current_count i:parent_count i:added_count")
def added_counts(s):
    opening = signals.structure_candidates(
        s.calendar(full=False), s.breaks, setup="1H", end_inclusive=True
    )
    return signals.added_counts(s.candidates, opening, ["session"])


# --- outcomes -------------------------------------------------------------------------------
TRADE_SPEC = (
    "signal_id t:entry_at t:exit_at f:entry_reference_price f:stop_price f:target_price exit_reason"
    " f:risk_pips f:net_pips f:net_r b:win"
)


@query(TRADE_SPEC)
def bracket(s):
    return s.trades


@query("variant_id " + TRADE_SPEC)
def bracket_variants(s):
    return s.structural_trades


@query("cost_case signal_id variant_id f:net_pips f:net_r b:win")
def cost_scenarios(s):
    raw = s.structural_trades.select(
        "signal_id", "variant_id", "direction", "entry_reference_price", "raw_exit_price", "risk_price"
    )
    return out.apply_cost_scenarios(raw, COSTS)


PROTECTED_SPEC = (
    "variant_id signal_id t:entry_at t:exit_at f:entry_reference_price f:raw_exit_price exit_reason"
    " t:trigger_observed_at t:protection_active_from b:protection_triggered b:protection_activated f:net_r"
)


@query(PROTECTED_SPEC)
def protected_bracket(s):
    return s.protected


@query(
    "signal_id mapping_status structural_swing_id t:entry_at f:entry_reference_price f:structural_unbuffered_level"
    " f:structural_stop_price f:structural_stop_atr f:theoretical_lots_at_fixed_risk i:swing_execution_bar_count"
)
def struct_stop(s):
    return s.mappings


FUNNEL_SPEC = (
    "model_id signal_id coverage_status coarse_gap_id t:coarse_gap_available_at t:mitigation_bar_at fine_gap_id"
    " t:fine_gap_available_at t:entry_decision_at t:entry_at"
)


@query(FUNNEL_SPEC)
def entry_funnel(s):
    return s.funnel


@query("model_id coverage_status i:signal_count")
def entry_funnel_summary(s):
    return funnel.funnel_summary(s.funnel)


@query("model_id signal_id t:entry_at t:exit_at f:entry_reference_price f:stop_price f:target_price exit_reason f:net_r")
def delayed_entry(s):
    spec = F.when(F.col("model_id") == funnel.COARSE, F.struct(F.lit("30min").alias("tf"), F.lit(30).alias("m"))).otherwise(
        F.struct(F.lit("10min").alias("tf"), F.lit(10).alias("m"))
    )
    entries = (
        s.funnel.where((F.col("coverage_status") == "entry") & (F.col("model_id") != funnel.IMMEDIATE))
        .withColumn("_b", spec)
        .select("symbol", "model_id", "signal_id", "entry_at", F.col("_b.tf").alias("timeframe"), F.col("_b.m").alias("bar_minutes"))
    )
    done = out.delayed_entry_outcome(entries, s.mappings, s.base.unionByName(s.fine), costs=COSTS)
    return done.withColumn("signal_id", F.col("parent_signal_id"))


@query(
    "signal_id t:entry_at f:entry_reference_price i:observed_bar_count t:last_observed_bar_at"
    " f:max_adverse_excursion_atr f:max_favorable_excursion_atr"
)
def excursion(s):
    return s.excursions


@query("signal_id f:stop_atr target_mode f:target_atr sequence t:stop_touch_bar_at t:target_touch_bar_at original_fixed_sequence b:saved_original_premature")
def threshold_grid(s):
    return s.sequences


@query(
    "symbol event_id primitive rule predicted_direction b:emitted_prediction i:horizon_minutes t:entry_at t:exit_at"
    " f:raw_forward_return_atr f:signed_forward_return_atr f:mfe_atr f:mae_atr"
)
def forward_returns(s):
    return s.forward


@query("symbol event_id primitive rule predicted_direction barrier_sequence")
def barriers(s):
    return s.barriers


# --- statistics -----------------------------------------------------------------------------
@query("opportunity_id model_id b:traded f:net_r")
def panel(s):
    return s.panel


METRIC_SPEC = (
    "period scope value i:opportunity_count i:trade_count i:win_count f:participation_rate f:total_net_r"
    " f:mean_trade_net_r f:median_trade_net_r f:win_rate f:profit_factor f:mean_opportunity_net_r"
)


@query(METRIC_SPEC)
def scope_metrics(s):
    return stats.metrics(
        s.trades, s.calendar(), keys=["period"],
        scopes={"session": "session", "direction": "direction", "exit_reason": "exit_reason"},
    )


@query("symbol f:maximum_drawdown_r")
def drawdown(s):
    return stats.max_drawdown(s.trades, keys=["symbol"])


@query("event_type month i:event_count")
def calendar_counts(s):
    return stats.calendar_counts(s.breaks, keys=["event_type"], years=(2024, 2025), unit="month")


@query("timeframe month i:event_count")
def active_zone_counts(s):
    active = s.zones[0].where("touch_count >= 2")
    return stats.calendar_counts(active, keys=["timeframe"], ts="active_at", years=[2024], unit="month")


@query("event_type year i:event_count")
def calendar_year_counts(s):
    return stats.calendar_counts(s.breaks, keys=["event_type"])


@query("session month i:trade_count f:win_rate f:total_net_r f:mean_trade_net_r")
def monthly(s):
    return stats.monthly_summary(s.trades, ["session"])


@query("symbol f:best_month_share")
def best_month(s):
    return stats.best_month_share(stats.monthly_summary(s.trades, ["symbol"]), ["symbol"])


@query("session exit_reason i:trade_count f:total_net_r f:mean_trade_net_r")
def exit_summary(s):
    return stats.exit_summary(s.trades, ["session"])


@query("symbol timeframe measure i:count f:median f:p05 f:p95")
def describe(s):
    return stats.describe(s.bars, ["atr", "body_atr", "coverage_ratio"], ["symbol", "timeframe"])


@query("scope value i:signal_count f:stop_atr_q25 f:stop_atr_median f:stop_atr_q75 f:stop_atr_q90 f:stop_atr_max f:theoretical_lots_median f:theoretical_lots_minimum")
def stop_distances(s):
    return stats.stop_distance_summary(s.mappings)


@query(
    "period scope value i:signal_count f:mae_atr_q25 f:mfe_atr_q25 f:mae_atr_q50 f:mfe_atr_q50 f:mae_atr_q75"
    " f:mfe_atr_q75 f:mae_atr_q90 f:mfe_atr_q90 f:mae_ge_1_0_atr_rate f:mae_ge_1_25_atr_rate f:mfe_ge_1_0_atr_rate"
)
def excursion_summary(s):
    return stats.excursion_summary(s.excursions)


@query(
    "period scope value f:stop_atr target_mode f:target_atr i:signal_count i:stop_first_count"
    " i:strict_premature_stop_count f:strict_premature_stop_rate i:saved_original_premature_count"
    " i:target_before_stop_count f:target_before_stop_rate i:neither_touched_count"
)
def sequence_summary(s):
    return stats.sequence_summary(s.sequences)


@query(
    "sample scope value primitive rule i:horizon_minutes i:event_count i:prediction_count f:prediction_coverage"
    " f:mean_signed_return_atr f:median_signed_return_atr f:positive_return_rate f:mean_mfe_atr f:mean_mae_atr"
)
def outcome_summary(s):
    return stats.outcome_summary(s.forward)


@query(
    "sample primitive rule i:event_count i:favorable_first_count i:adverse_first_count i:same_bar_ambiguous_count"
    " i:neither_count i:resolved_count f:favorable_first_rate_resolved"
)
def barrier_summary(s):
    return stats.barrier_summary(s.barriers)


@query("opportunity_id membership f:net_r_baseline f:net_r_candidate f:net_r_difference")
def paired_difference(s):
    t = s.both_trades
    return stats.paired_difference(
        t.where("direction = 'long'"), t.where("direction = 'short'"), ["opportunity_id"]
    )


@query("primitive baseline i:paired_count f:event_mean_atr f:baseline_mean_atr f:mean_paired_increment_atr")
def paired_baselines(s):
    return stats.paired_baselines(s.forward)


@query("model_id i:row_count i:cluster_count f:estimate f:ci_lower f:ci_upper")
def bootstrap_ci(s):
    return stats.cluster_bootstrap(
        s.panel, cluster="session_date", value="net_r", resamples=RESAMPLES
    )


@query("session i:row_count i:cluster_count f:estimate f:ci_lower f:ci_upper")
def paired_bootstrap(s):
    p = s.panel
    keys = ["opportunity_id", "session", "session_date"]
    pairs = stats.paired_difference(
        p.where("model_id = 'fit_long'"), p.where("model_id = 'fit_short'"), keys
    ).where("membership = 'both'")
    return stats.cluster_bootstrap(
        pairs, cluster="session_date", value="net_r_difference", keys=["session"], resamples=RESAMPLES
    )


@query("primitive i:event_count f:null_mean f:null_p025 f:null_p975")
def sign_null(s):
    base = s.forward.where("is_primary and rule = 'event_direction' and horizon_minutes = 60")
    return stats.random_sign_null(
        base, value="raw_forward_return_atr", resamples=RESAMPLES,
        row_id=F.concat_ws(":", "symbol", "event_id"),
    )


@query("timeframe i:member_count i:token_high i:token_low")
def set_fingerprint(s):
    return stats.set_fingerprint(s.bars, F.concat_ws(":", "symbol", "bar_id"), ["timeframe"])


# --- audits ---------------------------------------------------------------------------------
@query(
    "symbol i:bar_count i:bid_violation_count i:ask_violation_count i:mid_violation_count i:crossed_close_count"
    " i:duplicate_timestamp_count i:missing_column_count t:first_timestamp t:last_timestamp b:valid"
)
def check_bars(s):
    return audit.check_bars(s.base, required=bars.BAR_COLUMNS)


@query(
    "symbol i:expected_months i:available_months i:missing_months i:bar_count t:first_timestamp t:last_timestamp"
    " i:duplicate_timestamp_count i:crossed_close_count f:spread_median_pips f:spread_p95_pips f:spread_max_pips b:valid"
)
def coverage_audit(s):
    return audit.coverage_audit(s.base, "2024-01-01", "2024-03-01")


@query("symbol i:rebuilt_count i:canonical_count i:membership_failure_count i:mid_close_mismatch_count i:tick_count_mismatch_count b:valid")
def reconcile(s):
    return audit.reconcile(s.fine, s.base, minutes=30)


@query("symbol timeframe i:primary_count i:comparison_count i:intersection_count f:jaccard_agreement")
def jaccard_gaps(s):
    wide = labels.label_gaps(s.bars, min_size_atr=0.20)
    return audit.jaccard(s.gaps, wide, ["event_at", "direction"], ["symbol", "timeframe"])


@query("variant i:primary_count i:comparison_count i:intersection_count f:jaccard_agreement")
def sensitivity(s):
    keys = ["symbol", "timeframe", "event_at", "direction"]
    one = lambda r: labels.label_swings(s.bars, right=r, tolerance_pips=1.0, pip_size=PIP).select(*keys)
    return audit.sensitivity({"right2": s.swings.select(*keys), "right1": one(1), "right3": one(3)}, "right2", keys)


@query("symbol timeframe event_id f:iou")
def interval_iou(s):
    body, _ = ob.label_order_blocks(
        s.bars, s.breaks, s.gaps, pip_size=PIP, timeframes=("1H", "4H"), geometry="body_range"
    )
    return audit.interval_iou(s.order_blocks[0], body, ["symbol", "timeframe", "event_id"])


@query("symbol timeframe i:compared_count f:mean_iou f:median_iou")
def iou_summary(s):
    return audit.iou_summary(interval_iou(s))


@query("variant i:primary_count i:comparison_count i:intersection_count f:jaccard_agreement")
def gap_sensitivity(s):
    keys = ["symbol", "timeframe", "event_at", "direction"]
    at = lambda least: labels.label_gaps(s.bars, min_size_atr=least).select(*keys)
    return audit.sensitivity({"atr10": s.gaps.select(*keys), "atr0": at(0.0), "atr20": at(0.2)}, "atr10", keys)


@query("variant i:primary_count i:comparison_count i:intersection_count f:jaccard_agreement")
def order_block_grid(s):
    """Lookback 3 and 9, age 25 and 100 against 6 and 50; the status is part of the key, as age changes nothing else."""
    keys = ["symbol", "timeframe", "anchor_break_id", "candidate_bar_id", "status"]
    made = lambda **k: ob.label_order_blocks(
        s.bars, s.breaks, s.gaps, pip_size=PIP, timeframes=("1H", "4H"), cut=s._cut, **k
    )[0].select(*keys)
    grid = {"primary": s.order_blocks[0].select(*keys), "lookback3": made(lookback=3), "lookback9": made(lookback=9)}
    grid |= {"age25": made(max_age=25), "age100": made(max_age=100)}
    return audit.sensitivity(grid, "primary", keys)


@query(
    "concept symbol timeframe parameter primary_value comparison_value i:primary_count i:comparison_count i:intersection_count"
    " f:jaccard_agreement"
)
def label_sensitivity(s):
    return variants.label_sensitivity(
        s.bars, s.swings, s._cut(s.breaks), s.params, timeframes=("1H", "4H"), cut=s._cut
    )


@query("model_id month i:entry_count")
def monthly_entries(s):
    return funnel.monthly_entries(s.funnel)


@query("model_id i:entry_count b:eligible")
def eligible_models(s):
    """Models with at least ten entries (the study's 120 suit two years, the driver's events one month)."""
    return funnel.eligible_models(s.funnel, 10)


@query("symbol timeframe i:primary_count i:comparison_count i:intersection_count f:jaccard_agreement")
def order_block_sensitivity(s):
    short, _ = ob.label_order_blocks(
        s.bars, s.breaks, s.gaps, pip_size=PIP, timeframes=("1H", "4H"), lookback=3
    )
    return audit.jaccard(
        s.order_blocks[0], short, ["anchor_break_id", "candidate_bar_id"], ["symbol", "timeframe"]
    )


@query("invariant i:failure_count")
def constraints(s):
    sig, tr = s.open_signals, s.trades
    return audit.constraint_audit(
        audit.row_rules(
            s.bars,
            [
                ("bar_available_after_start", F.col("available_at") <= F.col("timestamp")),
                ("bar_ohlc_order", audit.ohlc_violation("mid")),
            ],
        ),
        audit.row_rules(
            s.swings,
            [
                ("swing_available_after_event", F.col("available_at") <= F.col("event_at")),
                ("swing_confirmation_delay", F.col("confirmation_index") - F.col("pivot_index") != F.col("confirmation_delay_bars")),
            ],
        ),
        audit.row_rules(
            tr,
            [
                ("entry_not_before_decision", F.col("entry_at") < F.col("decision_at")),
                ("entry_before_cutoff", F.col("entry_at") >= F.col("cutoff_at")),
                ("exit_by_cutoff", F.col("exit_at") > F.col("cutoff_at")),
                ("positive_risk", F.col("risk_pips") <= 0),
                ("losing_trades", ~F.col("win")),
            ],
        ),
        audit.unique_rule(s.bars, "unique_bar_id", ["symbol", "bar_id"]),
        audit.unique_rule(s.base, "one_bar_per_series", ["symbol"]),
        audit.subset_rule(tr, sig, "trades_subset_of_signals", ["signal_id"]),
        audit.subset_rule(s.calendar(), s.candidates, "opportunities_with_candidate", ["opportunity_id"]),
        audit.reproduction_rules(
            tr, s.excursions, "excursion_entry", ["signal_id"], ["entry_at", "entry_reference_price"]
        ),
        audit.count_rule(tr, "trade_count_is_100", 100),
        audit.schema_rule(s.candidates, "no_outcome_columns", ["net_r", "pnl", "win"]),
    )


RULES = "invariant i:failure_count"


@query(RULES)
def rules_labels(s):
    tables = {"bars": s.bars, "swings": s.swings, "gaps": s.gaps, "order_blocks": s.order_blocks[0]}
    return rules.check_rules(tables, rules.label_rules())


@query(RULES)
def rules_signals(s):
    aligned = aligned_candidates(s)
    tables = {"signals": s.open_signals, "trades": s.trades, "structure": s.candidates, "aligned": aligned}
    return rules.check_rules(tables | {"confluent": signals.confluence_filter(aligned, s.gaps)}, rules.signal_rules())


@query(RULES)
def rules_filters(s):
    return rules.check_rules({"selected": rule_filters(s), "candidates": s.candidates}, rules.filter_rules(2024))


@query(RULES)
def rules_sequences(s):
    """The parents' stop of one ATR and target of two are those of the paths that must reproduce their exits."""
    parents = out.bracket_outcome(s.open_signals, s.base, stop_atr=1.0, target_r=2.0, costs=COSTS, bar_minutes=30)
    original = s.sequences.where("stop_atr = 1 and target_mode = 'fixed_2atr'")
    tables = {"excursions": s.excursions, "paths": s.sequences, "original": original, "parents": parents}
    return rules.check_rules(tables, rules.sequence_rules(paths_per_signal=8))


@query(RULES)
def rules_structural(s):
    variants = {v: s.structural_trades.where(F.col("variant_id") == v) for v in ("structural_fixed_2atr", "structural_2r")}
    parents = out.bracket_outcome(s.first_signals, s.base, stop_atr=1.0, target_r=2.0, costs=COSTS, bar_minutes=30)
    tables = {"mappings": s.mappings, "parents": parents, **variants}
    return rules.check_rules(tables, rules.structural_rules("construction", list(variants)))


@query(RULES)
def rules_coverage(s):
    return rules.check_rules({"coverage": s.funnel}, rules.coverage_rules("construction"))


@query(RULES)
def rules_primitives(s):
    tables = {"events": s.features, "primary": s.features.where("is_primary"), "outcomes": s.forward}
    return rules.check_rules(tables, rules.primitive_rules(2024))


@query(RULES)
def rules_protection(s):
    stressed = out.protected_bracket(
        s.mappings, s.base, target_atr=1.0, trigger_atr=0.5,
        costs=replace(COSTS, slippage_pips_per_side=3 * COSTS.slippage_pips_per_side), bar_minutes=30,
    )
    tables = {"mappings": s.mappings, "valid": s.mappings.where("mapping_status = 'valid'")}
    for cost, trades in (("primary", s.protected), ("stress", s._cut(stressed))):
        tables[cost] = trades
        moved = F.col("variant_id") == "break_even_after_trigger"
        tables |= {f"{cost}_static": trades.where(~moved), f"{cost}_protected": trades.where(moved)}
    return rules.check_rules(tables, rules.protection_rules(2024))


@query("symbol timeframe i:overlapping_timestamp_count")
def label_overlap(s):
    return audit.label_overlap({"swing": s.swings, "break": s.breaks, "gap": s.gaps})


@query("scope value gate f:gate_value f:threshold b:passed")
def gates(s):
    m = stats.metrics(s.trades, s.calendar(), keys=["period"])
    limits = {
        "trade_count": (">=", 60.0), "mean_trade_net_r": (">", 0.0), "profit_factor": (">", 1.0),
    }
    g = audit.gate_table(m.withColumnRenamed("value", "_value"), limits, ["scope", "_value"])
    return g.withColumnRenamed("value", "gate_value").withColumnRenamed("_value", "value")


@query("winner")
def gate_winner(s):
    m = stats.trade_measures()
    measured = s.both_trades.groupBy("model_id").agg(*m)
    verdict = audit.gate_verdict(
        audit.gate_table(measured, {"trade_count": (">=", 10.0)}, ["model_id"]), ["model_id"]
    )
    return audit.winner(
        measured, verdict, key="model_id", value="mean_trade_net_r", tie_order=["fit_long", "fit_short"]
    )


@query("symbol timeframe event_type i:event_count i:bar_count i:eligible_bar_count f:share_of_bars")
def label_profile(s):
    return audit.label_profile(s.bars, s.breaks)


@query(
    "symbol timeframe concept attribute value i:event_count f:share "
    + " ".join(f"i:{m}_count f:{m}_mean f:{m}_p05 f:{m}_median f:{m}_p95" for m in profile.MEASURES)
)
def profile_of_labels(s):
    tables = {"swing": s.swings, "break": s.breaks, "gap": s.gaps, "zone": s.zones[0], "order_block": s.order_blocks[0]}
    return profile.label_profile(tables, PIP, cut=s._cut)


@query("opportunity_id only_in")
def set_difference(s):
    return audit.key_difference(s.calendar(), s.open_signals, ["opportunity_id"])


_STUDIES: dict[tuple[str, str], EventStudy] = {}


def study(spark: SparkSession, sf_dir: str, fresh: bool = False) -> EventStudy:
    """The study of one input in one session; its written tables serve every query."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _STUDIES:
        _STUDIES[key] = EventStudy(spark, sf_dir)
    return _STUDIES[key]


def run(name: str, spark: SparkSession, sf_dir: str, fresh: bool = False) -> DataFrame:
    fn, spec = CATALOG[name]
    return present(fn(study(spark, sf_dir, fresh)), spec)

