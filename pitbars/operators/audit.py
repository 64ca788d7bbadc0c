"""Checks, reconciliation, agreement measures and gates. Every result is a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .bars import PRICE_COLUMNS, SIDES
from .labels import TOUCH
from .quantiles import with_quantiles


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))


def ohlc_violation(side: str) -> Column:
    o, h, l, c = (F.col(f"{side}_{f}") for f in ("open", "high", "low", "close"))
    return (h < l) | (h < o) | (h < c) | (l > o) | (l > c)


def duplicate_rows(df: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first per key, counted per ``group``."""
    per_key = df.groupBy(*group, *[k for k in keys if k not in group]).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*group).agg(F.sum(F.col("_n") - 1).alias("duplicate_count"))


def check_bars(
    bars: DataFrame, by: Sequence[str] = ("symbol",), required: Sequence[str] = ()
) -> DataFrame:
    """Per series: OHLC order violations, duplicate timestamps, extent, missing columns, verdict."""
    missing = sorted(set(required) - set(bars.columns))
    measured = bars.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bar_count"),
        *[_count_if(ohlc_violation(s)).alias(f"{s}_violation_count") for s in SIDES],
        _count_if(F.col("ask_close") < F.col("bid_close")).alias("crossed_close_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )
    out = measured.join(duplicate_rows(bars, [*by, "timestamp"], by), list(by))
    bad = reduce(lambda a, b: a + b, [F.col(f"{s}_violation_count") for s in SIDES])
    return (
        out.withColumnRenamed("duplicate_count", "duplicate_timestamp_count")
        .withColumn("missing_column_count", F.lit(len(missing)))
        .withColumn(
            "valid",
            (bad == 0) & (F.col("duplicate_timestamp_count") == 0) & F.lit(not missing),
        )
    )


def month_grid(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per calendar month in [start, end), made without touching ``df``'s rows."""
    return df.sparkSession.sql(f"select explode({_months(start, end)}) as month")


def _months(start: str, end: str) -> str:
    return f"sequence(trunc(date'{start}','MM'), date_sub(date'{end}', 1), interval 1 month)"


def _year_month(day: str) -> tuple[int, int]:
    return int(day[:4]), int(day[5:7])


def missing_months(
    bars: DataFrame, start: str, end: str, by: Sequence[str] = ()
) -> DataFrame:
    """Months of the half-open range without a bar; with ``by``, the months each series lacks."""
    month = F.trunc(F.to_date("timestamp"), "MM")
    if not by:
        return month_grid(bars, start, end).join(bars.select(month.alias("month")).distinct(), "month", "left_anti")
    found = bars.groupBy(*by).agg(F.collect_set(month).alias("_has"))
    return found.select(*by, F.explode(F.array_except(F.expr(_months(start, end)), "_has")).alias("month"))


def coverage_audit(
    bars: DataFrame, start: str, end: str, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Per series: months expected and missing, counts and the spread summary of the half-open range.

    All three spread statistics describe the one column ``spread_median_pips``.
    """
    inside = bars.where(
        (F.col("timestamp") >= F.lit(start).cast("timestamp"))
        & (F.col("timestamp") < F.lit(end).cast("timestamp"))
    )
    (y0, m0), (y1, m1) = _year_month(start), _year_month(end)
    expected = (y1 - y0) * 12 + m1 - m0 + (0 if end[8:10] in ("", "01") else 1)
    found = inside.groupBy(*by).agg(
        F.count_distinct(F.trunc(F.to_date("timestamp"), "MM")).alias("available_months"),
        F.count(F.lit(1)).alias("bar_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        _count_if(F.col("ask_close") < F.col("bid_close")).alias("crossed_close_count"),
        F.max("spread_median_pips").alias("spread_max_pips"),
    )
    spread = {"spread_median_pips": 0.5, "spread_p95_pips": 0.95}
    found = with_quantiles(found, inside, by, {"spread_median_pips": spread})
    out = found.join(duplicate_rows(inside, [*by, "timestamp"], by), list(by)).withColumn(
        "expected_months", F.lit(expected)
    )
    return (
        out.withColumnRenamed("duplicate_count", "duplicate_timestamp_count")
        .withColumn("missing_months", F.col("expected_months") - F.col("available_months"))
        .withColumn(
            "valid",
            (F.col("missing_months") == 0)
            & (F.col("duplicate_timestamp_count") == 0)
            & (F.col("crossed_close_count") == 0),
        )
    )


def reconcile(
    fine: DataFrame,
    coarse: DataFrame,
    *,
    minutes: int = 5,
    atol: float = TOUCH,
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Rebuild coarse bars from fine ones and count differences; an unmatched row counts everywhere."""
    t = F.col("timestamp")
    aggs = []
    for s in SIDES:
        aggs += [
            F.min_by(f"{s}_open", t).alias(f"{s}_open"), F.max(f"{s}_high").alias(f"{s}_high"),
            F.min(f"{s}_low").alias(f"{s}_low"), F.max_by(f"{s}_close", t).alias(f"{s}_close"),
        ]
    rebuilt = (
        fine.groupBy(*by, F.window("timestamp", f"{minutes} minutes").alias("_w"))
        .agg(*aggs, F.sum("tick_count").alias("tick_count"))
        .select(*by, F.col("_w.start").alias("timestamp"), *PRICE_COLUMNS, "tick_count")
        .dropna()
    )
    values = [*PRICE_COLUMNS, "tick_count"]
    a = rebuilt.select(*by, "timestamp", F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in values])
    b = coarse.select(*by, "timestamp", F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in values])
    joined = a.join(b, [*by, "timestamp"], "full_outer")
    same = {
        c: (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= (0 if c == "tick_count" else atol)) for c in values
    }
    differs = {c: ~F.coalesce(ok, F.lit(False)) for c, ok in same.items()}
    out = joined.groupBy(*by).agg(
        F.count("_a").alias("rebuilt_count"), F.count("_b").alias("canonical_count"),
        _count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("membership_failure_count"),
        *[_count_if(d).alias(f"{c}_mismatch_count") for c, d in differs.items()],
    )
    total = reduce(lambda x, y: x + y, [F.col(f"{c}_mismatch_count") for c in values])
    return out.withColumn("valid", (F.col("membership_failure_count") == 0) & (total == 0))


def jaccard(
    a: DataFrame, b: DataFrame, keys: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Distinct keys of each side, intersection and agreement (1.0 when both are empty)."""
    cols = [*group, *[k for k in keys if k not in group]]
    tagged = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    flags = tagged.groupBy(*cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    both = F.col("_a") * F.col("_b")
    out = flags.groupBy(*group).agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("primary_count"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("comparison_count"),
        F.coalesce(F.sum(both), F.lit(0)).alias("intersection_count"),
    )
    union = F.col("primary_count") + F.col("comparison_count") - F.col("intersection_count")
    return out.withColumn(
        "jaccard_agreement",
        F.when(union > 0, F.col("intersection_count") / union).otherwise(F.lit(1.0)),
    )


def sensitivity(
    labels: dict[str, DataFrame], primary: str, keys: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Agreement of every variant's label keys with the primary variant's, in one aggregation.

    Variants are tagged and unioned; the primary's keys are copied to each comparison, so the
    whole grid is one shuffle of distinct keys.
    """
    others = [name for name in labels if name != primary]
    cols = [*group, *[k for k in keys if k not in group]]
    rows = labels[primary].select(
        *cols, F.explode(F.array(*[F.lit(o) for o in others])).alias("variant"),
        F.lit(1).alias("_a"), F.lit(0).alias("_b"),
    )
    for name in others:
        rows = rows.unionByName(
            labels[name].select(*cols, F.lit(name).alias("variant"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
        )
    flags = rows.groupBy("variant", *cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    out = flags.groupBy("variant", *group).agg(
        F.sum("_a").alias("primary_count"), F.sum("_b").alias("comparison_count"),
        F.sum(F.col("_a") * F.col("_b")).alias("intersection_count"),
    )
    union = F.col("primary_count") + F.col("comparison_count") - F.col("intersection_count")
    return out.withColumn(
        "jaccard_agreement",
        F.when(union > 0, F.col("intersection_count") / union).otherwise(F.lit(1.0)),
    )


def interval_iou(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("event_id",)
) -> DataFrame:
    """Per id present on both sides, overlap over hull (0 when disjoint)."""
    right = b.select(*keys, F.col("lower_bound").alias("_lo"), F.col("upper_bound").alias("_hi"))
    inter = F.greatest(
        F.least("upper_bound", "_hi") - F.greatest("lower_bound", "_lo"), F.lit(0.0)
    )
    hull = F.greatest("upper_bound", "_hi") - F.least("lower_bound", "_lo")
    return a.select(*keys, "lower_bound", "upper_bound").join(right, list(keys)).withColumn(
        "iou", safe_div(inter, hull)
    ).drop("_lo", "_hi")


def iou_summary(overlaps: DataFrame, by: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Compared intervals per group with the mean and the exact median of ``interval_iou``."""
    found = overlaps.groupBy(*by).agg(F.count("iou").alias("compared_count"), F.avg("iou").alias("mean_iou"))
    return with_quantiles(found, overlaps, list(by), {"iou": {"median_iou": 0.5}})


Rule = tuple[str, Column]


def row_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(invariant, failure_count) for conditions that mark a bad row; one pass over ``df``."""
    counted = df.agg(*[_count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules])
    cells = F.array(
        *[F.struct(F.lit(n).alias("invariant"), F.col(n).cast("long").alias("failure_count")) for n, _ in rules]
    )
    return counted.select(F.explode(cells).alias("_c")).select("_c.*")


def unique_rule(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Rows that share their key with another row."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("failure_count")).select(
        F.lit(name).alias("invariant"), F.col("failure_count").cast("long").alias("failure_count")
    )


def subset_rule(child: DataFrame, parent: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Distinct child keys absent from the parent."""
    lost = child.select(*keys).distinct().join(parent.select(*keys), list(keys), "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("failure_count")).select(
        F.lit(name).alias("invariant"), "failure_count"
    )


def reproduction_rules(
    a: DataFrame, b: DataFrame, name: str, keys: Sequence[str], columns: Sequence[str], atol: float = TOUCH
) -> DataFrame:
    """Membership and per-column differences between two tables that must agree."""
    left = a.select(*keys, F.lit(1).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    right = b.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = left.join(right, list(keys), "full_outer")
    rules: list[Rule] = [(f"{name}_membership", F.col("_l").isNull() | F.col("_r").isNull())]
    kinds = dict(a.dtypes)
    for c in columns:
        x, y = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        same = F.abs(x - y) <= atol if kinds[c] in ("double", "float") else x == y
        rules.append((f"{name}_{c}", ~F.coalesce(same, F.lit(False))))
    return row_rules(joined, rules)


def count_rule(df: DataFrame, name: str, expected: int) -> DataFrame:
    return df.agg(F.abs(F.count(F.lit(1)) - F.lit(expected)).alias("failure_count")).select(
        F.lit(name).alias("invariant"), "failure_count"
    )


def schema_rule(df: DataFrame, name: str, forbidden: Sequence[str]) -> DataFrame:
    """Columns whose name contains a forbidden part (a schema check: no rows are read)."""
    hits = [c for c in df.columns if any(part in c.lower() for part in forbidden)]
    return df.sparkSession.range(1).select(
        F.lit(name).alias("invariant"), F.lit(len(hits)).cast("long").alias("failure_count")
    )


def constraint_audit(*parts: DataFrame) -> DataFrame:
    """All rules in one table; passing rules stay in with 0."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def label_overlap(labels: dict[str, DataFrame], by: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Availability times shared by more than one label, per series."""
    tagged = reduce(
        lambda a, b: a.unionByName(b), [df.select(*by, "available_at") for df in labels.values()]
    )
    shared = tagged.groupBy(*by, "available_at").agg(F.count(F.lit(1)).alias("_n"))
    return shared.groupBy(*by).agg(_count_if(F.col("_n") > 1).alias("overlapping_timestamp_count"))


def gate_table(
    measured: DataFrame, thresholds: dict[str, tuple[str, float]], keys: Sequence[str]
) -> DataFrame:
    """Long gate table. ``thresholds``: column -> (comparison, limit); NULL never passes."""
    ops: dict[str, Callable[[Column, float], Column]] = {
        ">": lambda c, x: c > x, ">=": lambda c, x: c >= x,
        "<": lambda c, x: c < x, "<=": lambda c, x: c <= x, "=": lambda c, x: c == x,
    }
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"),
                F.lit(float(limit)).alias("threshold"),
                F.coalesce(ops[op](F.col(name).cast("double"), F.lit(float(limit))), F.lit(False)).alias("passed"),
            )
            for name, (op, limit) in thresholds.items()
        ]
    )
    return measured.select(*keys, F.explode(cells).alias("_g")).select(*keys, "_g.*")


def gate_verdict(gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gates.groupBy(*keys).agg(
        F.every("passed").alias("passed"),
        _count_if(~F.col("passed")).alias("failed_count"),
    )


def winner(
    measured: DataFrame, verdict: DataFrame, *, key: str, value: str, tie_order: Sequence[str] = ()
) -> DataFrame:
    """Best passing ``key`` by ``value``; ties go to the earlier entry of ``tie_order``."""
    rank: Column = F.lit(len(tie_order))
    for i, name in enumerate(tie_order):
        rank = F.when(F.col(key) == name, i).otherwise(rank)
    passed = measured.join(verdict.where("passed").select(key), key, "left_semi")
    return passed.agg(F.max_by(key, F.struct(F.col(value), -rank)).alias("winner"))


def label_profile(
    bars: DataFrame, events: DataFrame, by: Sequence[str] = ("symbol", "timeframe")
) -> DataFrame:
    """Events per series and type, with their share of all bars of the series."""
    n = bars.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bar_count"), _count_if(F.col("structure_eligible")).alias("eligible_bar_count")
    )
    k = events.groupBy(*by, "event_type").agg(F.count(F.lit(1)).alias("event_count"))
    return k.join(n, list(by)).withColumn("share_of_bars", F.col("event_count") / F.col("bar_count"))


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric difference of two key sets with the side each key came from."""
    left = a.select(*keys).distinct()
    right = b.select(*keys).distinct()
    return (
        left.join(right, list(keys), "left_anti").withColumn("only_in", F.lit("first"))
        .unionByName(right.join(left, list(keys), "left_anti").withColumn("only_in", F.lit("second")))
    )
