"""Profile of labels: how many, in which states, how late and how large, by series and over all series.

All label tables are stacked into one narrow table. One aggregation with grouping sets counts every attribute (type,
direction, status, relationship) in every scope; the quantiles of the measures come from a second one, over the same sets,
that combines equal values first. Both are joined by set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import value_quantiles

ATTRIBUTES = ("event_type", "direction", "status", "relationship")
MEASURES = ("delay", "size", "width")
POINTS = {"p05": 0.05, "median": 0.5, "p95": 0.95}
#: Columns a set may group by, in the order of the bits of the grouping id (the last column is the lowest bit).
_GROUPED = ("symbol", "timeframe", "concept", *ATTRIBUTES)

#: Where each label table has the attributes and measures, as SQL; ``pip`` stands for the pip size.
CONCEPTS: dict[str, dict[str, str]] = {
    "swing": {
        "event_type": "event_type", "direction": "direction", "relationship": "structural_relationship",
        "delay": "confirmation_delay_bars",
    },
    "break": {
        "event_type": "event_type", "direction": "direction", "relationship": "concat(regime_before, '->', regime_after)",
        "status": "if(displacement_qualified, 'displacement', 'no_displacement')", "size": "body_atr",
    },
    "gap": {
        "direction": "direction", "status": "status", "delay": "fill_delay_bars", "size": "size_atr",
        "width": "(upper_bound - lower_bound) / pip",
    },
    "zone": {
        "event_type": "role", "status": "status_at_sample_end", "delay": "bars_since_last_touch", "size": "touch_count",
        "width": "(upper_bound - lower_bound) / pip",
    },
    "order_block": {
        "event_type": "anchor_event_type", "direction": "direction", "status": "status",
        "delay": "terminal_delay_bars", "size": "candidate_to_anchor_bars", "width": "width_pips",
    },
}


def stacked(labels: Mapping[str, DataFrame], pip_size: float) -> DataFrame:
    """(symbol, timeframe, concept, attributes, measures) of all labels; what a concept lacks is NULL."""
    parts = []
    for concept, df in labels.items():
        own = CONCEPTS[concept]
        text = [F.expr(own.get(a, "null")).cast("string").alias(a) for a in ATTRIBUTES]
        numbers = [F.expr(own.get(m, "null")).cast("double").alias(m) for m in MEASURES]
        src = df.withColumn("pip", F.lit(pip_size))
        parts.append(src.select("symbol", "timeframe", F.lit(concept).alias("concept"), *text, *numbers))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _sets() -> list[list[str]]:
    scopes = (["symbol", "timeframe", "concept"], ["timeframe", "concept"])
    return [[*scope, *attr] for scope in scopes for attr in ([], *[[a] for a in ATTRIBUTES])]


def _named(sets: DataFrame, gid: Column) -> list[Column]:
    """Scope, attribute and value of a grouping set's row, none of them NULL."""
    grouped = lambda c: gid.bitwiseAND(1 << (len(_GROUPED) - 1 - _GROUPED.index(c))) == 0
    attribute, value = F.lit("all"), F.lit("all")
    for a in ATTRIBUTES:
        attribute = F.when(grouped(a), F.lit(a)).otherwise(attribute)
        value = F.when(grouped(a), F.coalesce(F.col(a), F.lit("none"))).otherwise(value)
    symbol = F.when(grouped("symbol"), F.coalesce(F.col("symbol"), F.lit("none"))).otherwise(F.lit("all"))
    return [symbol.alias("symbol"), "timeframe", "concept", attribute.alias("attribute"), value.alias("value")]


KEYS = ["symbol", "timeframe", "concept", "attribute", "value"]


def label_profile(
    labels: Mapping[str, DataFrame], pip_size: float, cut: Callable[[DataFrame], DataFrame] = materialize
) -> DataFrame:
    """One row per scope (a series, or "all" symbols of a timeframe), concept, attribute and value.

    ``event_count``, ``share`` of the concept's events in the scope, and for each measure its count, mean, 5 %, 50 % and
    95 % points. Attribute "all" is the concept as a whole; a value a label lacks is "none". ``labels`` are keyed by the
    names of ``CONCEPTS``.
    """
    events = cut(stacked(labels, pip_size))
    found = events.groupingSets([[F.col(c) for c in s] for s in _sets()], *[F.col(c) for c in _GROUPED]).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("event_count"),
        *[F.count(m).alias(f"{m}_count") for m in MEASURES],
        *[F.avg(m).alias(f"{m}_mean") for m in MEASURES],
    )
    counts = found.select(
        *_named(found, F.col("_gid")), "event_count", *[f"{m}_{x}" for m in MEASURES for x in ("count", "mean")]
    )
    whole = counts.where("attribute = 'all'").select(*KEYS[:3], F.col("event_count").alias("_whole"))
    measured = F.inline(F.array(*[F.struct(F.lit(m).alias("_measure"), F.col(m).alias("_v")) for m in MEASURES]))
    long = events.select(*_GROUPED, measured).where(F.col("_v").isNotNull())
    pair = [F.col("_measure"), F.col("_v")]
    equal = long.groupingSets([[*[F.col(c) for c in s], *pair] for s in _sets()], *[F.col(c) for c in _GROUPED], *pair).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_c")
    )
    values = equal.select(*_named(equal, F.shiftright("_gid", 2)), "_measure", "_v", "_c")
    q = value_quantiles(cut(values), [*KEYS, "_measure"], POINTS, cut=cut)
    wide = q.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("_measure") == m, F.col(p))).alias(f"{m}_{p}") for m in MEASURES for p in POINTS]
    )
    return (
        counts.join(whole, KEYS[:3])
        .withColumn("share", F.col("event_count") / F.col("_whole"))
        .drop("_whole")
        .join(wide, KEYS, "left")
    )
