"""Named rule sets (invariants) as declarations, compiled to few passes.

A rule names the tables it needs. ``check_rules`` turns all row and count rules of a table into one conditional aggregate
of it, and all rules that compare keys (unique, subset, reproduction) into one tagged union a key: every table adds its
keys, one grouping by the key tells which tables hold it and with what values. No pair of tables is joined, and a rule
that holds stays in the result with 0.

The sets below restate the invariant catalogue of the study: clocks, values, keys, subsets, reproduction, scope, schema.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import TOUCH
from .outcomes import SEQUENCE_LABELS, STOP_FIRST_LABELS


@dataclass(frozen=True)
class Row:
    """Rows of ``table`` on which the SQL condition ``bad`` is true."""

    table: str
    name: str
    bad: str


@dataclass(frozen=True)
class Unique:
    """Rows of ``table`` that share their key with another row."""

    table: str
    name: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Subset:
    """Distinct keys of ``child`` that ``parent`` lacks."""

    child: str
    parent: str
    name: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Same:
    """Keys that only one of two tables holds (``name``_membership), and keys whose values differ.

    ``values`` maps a rule name to the SQL expressions of both sides; numbers named in ``close`` may differ by ``TOUCH``.
    A missing side or value is a difference.
    """

    left: str
    right: str
    name: str
    keys: tuple[str, ...]
    values: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    close: tuple[str, ...] = ()


@dataclass(frozen=True)
class Count:
    """How far the rows of ``left`` are from ``times`` the rows of ``right``."""

    left: str
    right: str
    name: str
    times: int = 1


@dataclass(frozen=True)
class Schema:
    """Columns of ``table`` whose name holds a forbidden part; no row is read."""

    table: str
    name: str
    forbidden: tuple[str, ...]


Rule = Row | Unique | Subset | Same | Count | Schema


def names(rules: Sequence[Rule]) -> list[str]:
    """All rule names a set reports."""
    out = []
    for r in rules:
        out += [f"{r.name}_membership", *r.values] if isinstance(r, Same) else [r.name]
    return out


def _long(counts: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("invariant"), c.cast("long").alias("_n")) for n, c in columns.items()]
    return counts.select(F.inline(F.array(*cells)))


def _row_pass(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame | None:
    aggs: dict[str, Column] = {}
    for r in rules:
        if isinstance(r, Row) and r.table == table:
            aggs[r.name] = F.count_if(F.coalesce(F.expr(r.bad), F.lit(False)))
        if isinstance(r, Count):
            side = (r.left == table) - r.times * (r.right == table)
            if side:
                aggs[r.name] = F.count(F.lit(1)) * side
    if not aggs:
        return None
    cols = {n: f"_r{i}" for i, n in enumerate(aggs)}
    return _long(df.agg(*[c.alias(cols[n]) for n, c in aggs.items()]), {n: F.col(cols[n]) for n in aggs})


def _key_pass(tables: Mapping[str, DataFrame], keys: tuple[str, ...], rules: Sequence[Rule]) -> DataFrame:
    wanted: dict[str, list[str]] = defaultdict(list)
    for r in rules:
        if isinstance(r, Same):
            wanted[r.left] += [a for a, _ in r.values.values()]
            wanted[r.right] += [b for _, b in r.values.values()]
        else:
            for t in (r.table,) if isinstance(r, Unique) else (r.child, r.parent):
                wanted[t] += []
    value = {}
    for t, exprs in wanted.items():
        for e in dict.fromkeys(exprs):
            value[t, e] = f"_v{len(value)}"
    tag = {t: f"_n{i}" for i, t in enumerate(wanted)}
    parts = []
    for t in wanted:
        own = [F.expr(e).alias(v) for (u, e), v in value.items() if u == t]
        parts.append(tables[t].select(*keys, F.lit(1).alias(tag[t]), *own))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    held = union.groupBy(*keys).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in tag.values()], *[F.max(v).alias(v) for v in value.values()]
    )
    aggs: dict[str, Column] = {}
    for r in rules:
        if isinstance(r, Unique):
            aggs[r.name] = F.sum(F.when(F.col(tag[r.table]) > 1, F.col(tag[r.table])).otherwise(0))
        elif isinstance(r, Subset):
            aggs[r.name] = F.count_if((F.col(tag[r.child]) > 0) & (F.col(tag[r.parent]) == 0))
        else:
            left, right = F.col(tag[r.left]) > 0, F.col(tag[r.right]) > 0
            aggs[f"{r.name}_membership"] = F.count_if(left != right)
            for n, (a, b) in r.values.items():
                x, y = F.col(value[r.left, a]), F.col(value[r.right, b])
                same = F.abs(x - y) <= TOUCH if n in r.close else x == y
                aggs[n] = F.count_if((left | right) & ~F.coalesce(same, F.lit(False)))
    cols = {n: f"_r{i}" for i, n in enumerate(aggs)}
    counted = held.agg(*[F.coalesce(c, F.lit(0)).alias(cols[n]) for n, c in aggs.items()])
    return _long(counted, {n: F.col(cols[n]) for n in aggs})


def check_rules(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """(invariant, failure_count), one row a rule, rules that hold with 0.

    Keys that are null count as equal. Of repeated keys a reproduction compares the largest values; that keys are repeated
    is the matter of ``Unique``.
    """
    if len(set(names(rules))) < len(names(rules)):
        raise ValueError("rule names must differ")
    needed = {t for r in rules for k, t in vars(r).items() if k in ("table", "left", "right", "child", "parent")}
    if missing := needed - set(tables):
        raise ValueError(f"rules need tables {sorted(missing)}")
    parts = [p for t in sorted(needed) if (p := _row_pass(tables[t], t, rules)) is not None]
    by_keys: dict[tuple[str, ...], list[Rule]] = defaultdict(list)
    for r in rules:
        if isinstance(r, Unique | Subset | Same):
            by_keys[r.keys].append(r)
    parts += [_key_pass(tables, keys, own) for keys, own in by_keys.items()]
    for r in rules:
        if isinstance(r, Schema):
            hits = sum(any(part in c.lower() for part in r.forbidden) for c in tables[r.table].columns)
            one = tables[r.table].sparkSession.range(1)
            parts.append(one.select(F.lit(r.name).alias("invariant"), F.lit(hits).cast("long").alias("_n")))
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.groupBy("invariant").agg(F.abs(F.sum("_n")).alias("failure_count"))


# --- the rule sets ----------------------------------------------------------------------------

EVENT = ("symbol", "timeframe", "event_id")
#: Parts of column names that tell an outcome.
OUTCOME_PARTS = ("net_r", "net_pips", "pnl", "win", "profit_factor", "exit_price", "return")


def _listed(labels: Sequence[str]) -> str:
    return ", ".join(f"'{x}'" for x in labels)


def label_rules() -> list[Rule]:
    """Bars and labels: unique ids, availability after the event, order of prices, confirmation and lifecycle clocks.

    Tables: bars, swings, gaps, order_blocks.
    """
    rules: list[Rule] = [
        Unique("bars", "unique_bar_id", ("symbol", "bar_id")),
        Row("bars", "bar_available_after_start", "not (available_at > timestamp)"),
        Row(
            "bars", "bar_ohlc_order",
            "mid_high < greatest(mid_open, mid_close) or mid_low > least(mid_open, mid_close) or mid_high < mid_low",
        ),
        Row("swings", "swing_confirmation_delay", "confirmation_index - pivot_index <> confirmation_delay_bars"),
        Row("order_blocks", "order_block_candidate_before_anchor", "candidate_at >= event_at or candidate_available_at > event_at"),
    ]
    for table in ("swings", "gaps", "order_blocks"):
        rules.append(Unique(table, f"{table}_unique_event_id", EVENT))
        rules.append(Row(table, f"{table}_available_after_event", "not (available_at > event_at)"))
    lives = {
        "gaps": ("partial_fill_at", "full_fill_at"),
        "order_blocks": ("first_touch_at", "midpoint_touch_at", "full_mitigation_at", "invalidation_at"),
    }
    for table, clocks in lives.items():
        rules += [Row(table, f"{table}_{c}_after_availability", f"not ({c} > available_at)") for c in clocks]
    return rules


def signal_rules() -> list[Rule]:
    """Signals and their trades. Tables: signals, trades, structure, aligned, confluent (each a subset of the one before)."""
    keys = ("opportunity_id", "direction")
    return [
        Row("signals", "feature_available_by_decision", "feature_available_at > decision_at"),
        Row("signals", "decision_not_before_session", "decision_at < session_open_at"),
        Row("signals", "decision_within_observation", "decision_at > observation_end_at"),
        Row("trades", "entry_not_before_decision", "entry_at < decision_at"),
        Row("trades", "entry_before_cutoff", "entry_at >= cutoff_at"),
        Row("trades", "exit_by_cutoff", "exit_at > cutoff_at"),
        Row("trades", "positive_risk", "not (risk_pips > 0)"),
        Unique("trades", "one_trade_per_model_session", ("model_id", "opportunity_id")),
        Subset("trades", "signals", "trades_subset_of_signals", ("signal_id",)),
        Subset("aligned", "structure", "aligned_subset_of_structure", keys),
        Subset("confluent", "aligned", "confluent_subset_of_aligned", keys),
        Schema("signals", "forbidden_feature_columns", ("order_block", "h1_sr")),
    ]


def filter_rules(year: int) -> list[Rule]:
    """Filtered signals before their outcomes are known. Tables: selected, candidates."""
    return [
        Row("selected", "construction_rows_only", f"not (year <=> {year})"),
        Row("selected", "feature_available_by_decision", "feature_available_at > decision_at"),
        Unique("selected", "one_signal_per_filter_session", ("filter_id", "opportunity_id")),
        Subset("selected", "candidates", "selected_from_parent_candidates", ("opportunity_id", "source_event_id")),
        Schema("selected", "coverage_contains_forbidden_columns", OUTCOME_PARTS),
    ]


def sequence_rules(paths_per_signal: int) -> list[Rule]:
    """Excursions and threshold paths against the parent trades. Tables: excursions, paths, original, parents.

    ``original`` are the paths of the parents' own stop and target, from which their kind of exit must follow.
    """
    stopped = f"sequence in ({_listed(sorted(STOP_FIRST_LABELS))})"
    return [
        Count("excursions", "parents", "one_excursion_per_parent_trade"),
        Unique("excursions", "duplicate_excursion_signal", ("signal_id",)),
        Row("excursions", "non_positive_atr", "atr is null or isnan(atr) or not (atr > 0) or atr = double('infinity')"),
        Row("excursions", "negative_excursion", "max_adverse_excursion_atr < 0 or max_favorable_excursion_atr < 0"),
        Row("excursions", "entry_before_decision", "entry_at < decision_at"),
        Row("excursions", "path_reaches_cutoff", "last_observed_bar_at >= cutoff_at"),
        Count("paths", "excursions", "threshold_path_count", paths_per_signal),
        Row("paths", "unknown_sequence", f"not coalesce(sequence in ({_listed(sorted(SEQUENCE_LABELS))}), false)"),
        Same(
            "parents", "excursions", "parent_signal", ("signal_id",),
            {
                "entry_timestamp_reproduction": ("entry_at", "entry_at"),
                "entry_price_reproduction": ("entry_reference_price", "entry_reference_price"),
            },
            ("entry_price_reproduction",),
        ),
        Same(
            "parents", "original", "original_path", ("signal_id",),
            {
                "original_stop_touch_reproduction": ("exit_reason like 'stop%'", stopped),
                "original_target_touch_reproduction": ("exit_reason like 'target%'", "sequence = 'target_before_stop'"),
            },
        ),
    ]


def structural_rules(period: str, variants: Sequence[str]) -> list[Rule]:
    """Structural stops against the parent trades. Tables: mappings, parents, and one of trades for each of ``variants``."""
    rules: list[Rule] = [
        Count("mappings", "parents", "mapping_count_matches_parent"),
        Unique("mappings", "duplicate_mapping_signal", ("signal_id",)),
        Row("mappings", "source_event_reproduced", "not coalesce(source_event_match, false)"),
        Row("mappings", "invalid_structural_mapping", "not (mapping_status <=> 'valid')"),
        Row("mappings", "swing_available_after_decision", "structural_swing_available_at > decision_at"),
        Row("mappings", "swing_pivot_not_before_decision", "structural_swing_event_at >= decision_at"),
        Row("mappings", "stage_period_isolation", f"not (period <=> '{period}')"),
    ]
    for v in variants:
        rules.append(Count(v, "parents", f"{v}_trade_count_matches_parent"))
        rules.append(Unique(v, f"{v}_one_trade_per_session", ("opportunity_id",)))
        rules.append(Row(v, f"{v}_period_isolation", f"not (period <=> '{period}')"))
    rules.append(
        Same(
            variants[0], "parents", "parent_trade", ("signal_id",),
            {
                "entry_timestamp_reproduction": ("entry_at", "entry_at"),
                "entry_price_reproduction": ("entry_reference_price", "entry_reference_price"),
            },
            ("entry_price_reproduction",),
        )
    )
    return rules


def coverage_rules(period: str) -> list[Rule]:
    """The delayed-entry funnel. Table: coverage (one row a model and signal), all models in one table."""
    entered = "coverage_status = 'entry'"
    return [
        Schema("coverage", "coverage_return_columns_forbidden", OUTCOME_PARTS),
        Unique("coverage", "duplicate_model_opportunity", ("model_id", "opportunity_id")),
        Row("coverage", "entry_before_decision", f"{entered} and entry_at < entry_decision_at"),
        Row("coverage", "entry_at_or_after_cutoff", f"{entered} and entry_at >= cutoff_at"),
        Row("coverage", "non_construction_row", f"not (period <=> '{period}')"),
        Row("coverage", "mitigation_before_gap_available", f"{entered} and mitigation_bar_at < coarse_gap_available_at"),
        Row("coverage", "refinement_before_mitigation", f"{entered} and fine_gap_available_at <= mitigation_bar_at"),
    ]


def primitive_rules(year: int) -> list[Rule]:
    """Event primitives and their forward returns. Tables: events, primary, outcomes."""
    return [
        Row("events", "event_year_is_construction", f"not (year(event_at) <=> {year})"),
        Row("events", "positive_event_atr", "not (atr > 0)"),
        Row("events", "event_available_after_bar_start", "not (available_at > event_at)"),
        Row(
            "events", "sweep_source_available_by_event_bar_start",
            "primitive = 'liquidity_sweep' and source_swing_available_at > event_at",
        ),
        Row("events", "baseline_available_by_event_decision", "baseline_feature_available_at > available_at"),
        Unique("primary", "one_primary_event_per_primitive_session", ("primitive", "opportunity_id")),
        Row("outcomes", "outcome_year_is_construction", f"not (event_year <=> {year})"),
        Row("outcomes", "entry_not_before_availability", "entry_at < available_at"),
        Row("outcomes", "exact_horizon_exit", "unix_micros(exit_at) - unix_micros(entry_at) <> 60000000L * horizon_minutes"),
        Row("outcomes", "positive_outcome_atr", "not (atr > 0)"),
        Subset("primary", "events", "primary_subset_of_all_events", ("symbol", "event_id")),
    ]


def protection_rules(year: int) -> list[Rule]:
    """Static against protected trades under two costs. Tables: mappings, valid, and for both costs (primary, stress) all
    trades and those of each variant: primary, stress, primary_static, primary_protected, stress_static, stress_protected.
    """
    rules: list[Rule] = [Row("mappings", "evaluation_year_only_mappings", f"not (year <=> {year})")]
    for cost in ("primary", "stress"):
        rules.append(Row(cost, f"{cost}_evaluation_year_only", f"not (year <=> {year})"))
        rules.append(Row(cost, f"{cost}_exit_by_cutoff", "exit_at > cutoff_at"))
        for v in ("static", "protected"):
            rules.append(Count(f"{cost}_{v}", "valid", f"{cost}_{v}_trade_count"))
            rules.append(Unique(f"{cost}_{v}", f"{cost}_{v}_duplicate_signal", ("signal_id",)))
    prices = ("entry_reference_price", "stop_price", "target_price")
    rules.append(
        Same(
            "primary_static", "primary_protected", "variant", ("signal_id",),
            {"variant_entry_time_identical": ("entry_at", "entry_at"), **{f"variant_{c}_identical": (c, c) for c in prices}},
            tuple(f"variant_{c}_identical" for c in prices),
        )
    )
    rules += [
        Row("primary_protected", "protection_starts_after_trigger_bar", "protection_activated and protection_active_from < trigger_observed_at"),
        Row(
            "primary_protected", "protected_exit_requires_prior_activation",
            "exit_reason in ('protected_stop', 'protected_stop_gap') and (protection_active_from is null or protection_active_from >= exit_at)",
        ),
        Same(
            "primary", "stress", "friction", ("signal_id", "variant_id"),
            {
                "friction_raw_exit_identical": ("raw_exit_price", "raw_exit_price"),
                "friction_exit_time_identical": ("exit_at", "exit_at"),
                "friction_exit_reason_identical": ("exit_reason", "exit_reason"),
            },
            ("friction_raw_exit_identical",),
        ),
    ]
    return rules
