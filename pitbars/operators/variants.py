"""Agreement of labels under other parameters with those of the primary setting, for all families in one plan (A5).

No family is labelled once a variant. Where a parameter only decides which rows stay (size of gaps, tolerance of relations,
lookback and age of order blocks), the widest setting is labelled and every variant is read off it; where it changes a
recurrence (break buffer, zone tolerance), the variant is one more column of the series key, so variants are further
series of the same pass. All label keys then meet in one grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros, safe_div
from ..params import VARIANTS, LabelParams
from ..session import materialize
from .blocks import drop_halo, index_block, previous_row, with_halo, with_row_index
from .labels import BY, formed_gaps, pivot_columns, swing_relation
from .levels import cluster_levels
from .order_blocks import _lifecycle, _ranked_anchors
from .quantiles import with_quantiles
from .regime import breaks_from_segments, structure_segments

GEOMETRIES = ("full_wick_range", "body_range")


def variant_values(params: LabelParams, concept: str) -> list:
    """Value of the primary setting, then those it is compared with."""
    _, field, others = VARIANTS[concept]
    return [getattr(params, field), *others]


def _keys(df: DataFrame, concept: str, by: Sequence[str], no: Column, *key: str) -> DataFrame:
    parts = [micros(c) if c.endswith("_at") else F.col(c) for c in key]
    return df.select(
        F.lit(concept).alias("concept"), *by, no.cast("int").alias("_no"),
        F.concat_ws("|", *[p.cast("string") for p in parts]).alias("_key"),
    )


def _held(conditions: Sequence[Column]) -> Column:
    """One row for each variant (its number) whose condition holds."""
    return F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])))


def _spread(df: DataFrame, values: Sequence[float]) -> DataFrame:
    """Each row once a variant, with its number and value."""
    cells = F.array(*[F.struct(F.lit(i).alias("_no"), F.lit(float(v)).alias("_value")) for i, v in enumerate(values)])
    return df.select("*", F.inline(cells))


def swing_keys(bars: DataFrame, params: LabelParams, by: Sequence[str] = BY) -> DataFrame:
    """Pivots confirmed after other numbers of bars: every number has its frames over one sorted window with one halo."""
    rights = variant_values(params, "swing")
    src = with_halo(
        bars.select(*by, "bar_idx", "timestamp", "mid_high", "mid_low", "structure_eligible"),
        by, params.swing_left, max(rights),
    )
    found = []
    for no, right in enumerate(rights):
        whole, high, low = pivot_columns(by, params.swing_left, right, params.pip_size)
        for kind, pivot in (("high", high), ("low", low)):
            hit = F.struct(F.lit(no).alias("_no"), F.lit(kind).alias("_kind"))
            found.append(F.when(whole & pivot.isNotNull(), hit))
    hits = drop_halo(src.withColumn("_hits", F.array_compact(F.array(*found))))
    flat = hits.select(*by, F.col("timestamp").alias("event_at"), F.inline("_hits"))
    return _keys(flat, "swing", by, F.col("_no"), "event_at", "_kind")


def relationship_keys(swings: DataFrame, params: LabelParams, by: Sequence[str] = BY) -> DataFrame:
    """Relations under other tolerances: the previous swing is the same for all, so it is looked up once."""
    near = previous_row(swings, [*by, "event_type"], "pivot_index", ["price"], "_prev")
    delta = F.col("price") - F.col("_prev.price")
    told = F.array(
        *[
            F.struct(F.lit(no).alias("_no"), swing_relation(delta, t * params.pip_size).alias("_relation"))
            for no, t in enumerate(variant_values(params, "swing_relationship"))
        ]
    )
    flat = near.select(*by, "event_at", "direction", F.inline(told))
    return _keys(flat, "swing_relationship", by, F.col("_no"), "event_at", "direction", "_relation")


def break_keys(
    bars: DataFrame, swings: DataFrame, params: LabelParams, by: Sequence[str] = BY,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Breaks under other buffers, each buffer a series of its own."""
    values, series = variant_values(params, "structure_break"), ["_no", *by]
    wide, known = _spread(bars, values), _spread(swings, values).drop("_value")
    segments = structure_segments(wide, known, buffer_atr=F.col("_value"), by=series, cut=cut)
    breaks = breaks_from_segments(
        segments, wide.drop("_value"), displacement_body_atr=params.displacement_body_atr, by=series
    )
    return _keys(breaks, "structure_break", by, F.col("_no"), "event_at", "direction", "event_type")


def gap_keys(bars: DataFrame, params: LabelParams, by: Sequence[str] = BY) -> DataFrame:
    """Gaps of other least sizes: formed once, kept by each size they reach."""
    least = variant_values(params, "fair_value_gap")
    held = _held([F.col("_g.size") >= F.lit(float(v)) * F.col("atr") for v in least])
    flat = formed_gaps(bars, by).select(
        *by, F.col("timestamp").alias("event_at"), "_g.direction", held.alias("_no")
    )
    return _keys(flat, "fair_value_gap", by, F.col("_no"), "event_at", "direction")


def zone_keys(bars: DataFrame, swings: DataFrame, params: LabelParams, by: Sequence[str] = BY) -> DataFrame:
    """Swings in active level zones under other tolerances, each tolerance a series of its own."""
    values = variant_values(params, "support_resistance")
    _, snapshots = cluster_levels(
        _spread(swings, values), _spread(bars, values), tolerance_atr=F.col("_value"),
        max_age=params.zone_max_age, min_touches=params.zone_min_touches, by=["_no", *by],
    )
    return _keys(snapshots.where("active"), "support_resistance", by, F.col("_no"), "swing_id")


def widest_order_blocks(
    bars: DataFrame, breaks: DataFrame, params: LabelParams, timeframes: Sequence[str], by: Sequence[str] = BY,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Zones of the largest lookback with both geometries and their fate within the largest age.

    The candidate is the last opposing candle, so a smaller lookback keeps exactly the zones no farther from it: the first
    anchor of a candle is also its nearest. A smaller age keeps a terminal event exactly when it is no later.
    """
    by = list(by)
    lookback = max(variant_values(params, "order_block_candidate"))
    age = max(variant_values(params, "order_block_lifecycle"))
    bars = bars.where(F.col("timeframe").isin(*timeframes))
    zones = _ranked_anchors(bars, breaks, lookback, timeframes, by).where("_rank = 1").select(
        *by, F.col("event_id").alias("anchor_break_id"), "event_at", "direction", "event_seq",
        F.col("bar_idx").alias("anchor_index"), "_c.candidate_index", "_c.candidate_bar_id", "_c.candidate_at",
        F.col("_c.wick_low").alias("lower_bound"), F.col("_c.wick_high").alias("upper_bound"),
        "_c.body_low", "_c.body_high",
    )
    zones = cut(with_row_index(zones, by, ["anchor_index", "event_seq"], index_block("anchor_index"), "_ord"))
    rows = bars.groupBy(*by).agg((F.max("bar_idx") + 1).alias("_series_rows"))
    life = _lifecycle(bars, zones, age, by).select(*by, "_ord", "invalidation_at", "terminal_delay_bars")
    return zones.join(life, [*by, "_ord"], "left").join(rows, by).withColumn(
        "_away", F.col("anchor_index") - F.col("candidate_index")
    )


def candidate_keys(zones: DataFrame, params: LabelParams, by: Sequence[str] = BY) -> DataFrame:
    held = _held([F.col("_away") <= v for v in variant_values(params, "order_block_candidate")])
    flat = zones.select(*by, "anchor_break_id", "candidate_bar_id", held.alias("_no"))
    return _keys(flat, "order_block_candidate", by, F.col("_no"), "anchor_break_id", "candidate_bar_id")


def lifecycle_keys(zones: DataFrame, params: LabelParams, by: Sequence[str] = BY) -> DataFrame:
    """Zones of the primary lookback with their status at the end of other ages."""
    rest = F.col("_series_rows") - F.col("anchor_index") - 1

    def status(age: int) -> Column:
        ended = F.col("terminal_delay_bars") <= age
        return (
            F.when(ended & F.col("invalidation_at").isNotNull(), "invalidated").when(ended, "fully_mitigated")
            .when(rest >= age, "expired").otherwise("active_at_sample_end")
        )

    told = F.array(
        *[
            F.struct(F.lit(no).alias("_no"), status(age).alias("status"))
            for no, age in enumerate(variant_values(params, "order_block_lifecycle"))
        ]
    )
    flat = zones.where(F.col("_away") <= params.ob_lookback).select(*by, "direction", "candidate_at", F.inline(told))
    return _keys(flat, "order_block_lifecycle", by, F.col("_no"), "direction", "candidate_at", "status")


def variant_agreement(keys: DataFrame, params: LabelParams, by: Sequence[str] = BY) -> DataFrame:
    """Counts and agreement of every variant with the primary one, per concept and series, from one table of keys.

    A series has a row for each comparison of a concept if any variant of the concept labels it.
    """
    by = list(by)
    most = max(len(others) for _, _, others in VARIANTS.values())
    has = [F.max(F.when(F.col("_no") == k, 1).otherwise(0)).alias(f"_has{k}") for k in range(most + 1)]
    flags = keys.groupBy("concept", *by, "_key").agg(*has)
    totals = [F.sum("_has0").alias("primary_count")]
    for k in range(1, most + 1):
        totals.append(F.sum(f"_has{k}").alias(f"_n{k}"))
        totals.append(F.sum(F.col("_has0") * F.col(f"_has{k}")).alias(f"_both{k}"))
    cells = []
    for concept, (parameter, _, _) in VARIANTS.items():
        primary, *others = variant_values(params, concept)
        for k, value in enumerate(others, 1):
            cells.append(
                F.when(
                    F.col("concept") == concept,
                    F.struct(
                        F.lit(parameter).alias("parameter"), F.lit(str(primary)).alias("primary_value"),
                        F.lit(str(value)).alias("comparison_value"), F.col(f"_n{k}").alias("comparison_count"),
                        F.col(f"_both{k}").alias("intersection_count"),
                    ),
                )
            )
    out = flags.groupBy("concept", *by).agg(*totals).select(
        "concept", *by, "primary_count", F.inline(F.array_compact(F.array(*cells)))
    )
    union = F.col("primary_count") + F.col("comparison_count") - F.col("intersection_count")
    share = F.when(union > 0, F.col("intersection_count") / union).otherwise(F.lit(1.0))
    return out.withColumn("jaccard_agreement", share)


def geometry_agreement(
    zones: DataFrame, params: LabelParams, by: Sequence[str] = BY,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Median overlap of the two geometries of each zone; both lie in one row, so no zones are matched."""
    by = list(by)
    inner = F.least("upper_bound", "body_high") - F.greatest("lower_bound", "body_low")
    hull = F.greatest("upper_bound", "body_high") - F.least("lower_bound", "body_low")
    rows = zones.where(F.col("_away") <= params.ob_lookback).select(
        *by, safe_div(F.greatest(inner, F.lit(0.0)), hull).alias("iou")
    )
    n = F.count(F.lit(1))
    found = rows.groupBy(*by).agg(
        n.alias("primary_count"), n.alias("comparison_count"), n.alias("intersection_count")
    )
    return with_quantiles(found, rows, by, {"iou": {"jaccard_agreement": 0.5}}, cut=cut).select(
        F.lit("order_block_geometry").alias("concept"), *by, "primary_count", F.lit("zone_geometry").alias("parameter"),
        F.lit(GEOMETRIES[0]).alias("primary_value"), F.lit(GEOMETRIES[1]).alias("comparison_value"),
        "comparison_count", "intersection_count", "jaccard_agreement",
    )


def label_sensitivity(
    bars: DataFrame, swings: DataFrame, breaks: DataFrame, params: LabelParams, *,
    timeframes: Sequence[str] = ("15min", "1H", "4H"), by: Sequence[str] = BY,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """All eight families: concept, series, parameter, both values, counts, agreement.

    Pass written ``bars``, ``swings`` and primary ``breaks``: each is read by several families. Agreement is the share of
    label keys found under both settings, for the geometry the median overlap.
    """
    by = list(by)
    zones = cut(widest_order_blocks(bars, breaks, params, timeframes, by, cut))
    parts = [
        swing_keys(bars, params, by), relationship_keys(swings, params, by), break_keys(bars, swings, params, by, cut),
        gap_keys(bars, params, by), zone_keys(bars, swings, params, by), candidate_keys(zones, params, by),
        lifecycle_keys(zones, params, by),
    ]
    keys = reduce(lambda a, b: a.unionByName(b), parts)
    return variant_agreement(keys, params, by).unionByName(geometry_agreement(zones, params, by, cut))
