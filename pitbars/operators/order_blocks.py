"""Order blocks: the last opposing candle before a displacement break, and what became of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import iso
from ..session import materialize
from .asof import range_join
from .blocks import START, drop_halo, halo_window, index_block, with_halo, with_row_index
from .labels import BY, series_length

#: Zones of one window of the running counts.
PACK = 8192
#: Bits of a digit of a place.
DIGIT_BITS = 3


def _candidates(bars: DataFrame, lookback: int, by: Sequence[str]) -> DataFrame:
    """Per bar and direction, the last eligible opposing candle within ``lookback`` bars before it."""
    before = halo_window(by).rowsBetween(-lookback, -1)
    bar = F.struct(
        F.col("bar_idx").alias("candidate_index"),
        F.col("bar_id").alias("candidate_bar_id"),
        F.col("timestamp").alias("candidate_at"),
        F.col("available_at").alias("candidate_available_at"),
        F.col("mid_low").alias("wick_low"), F.col("mid_high").alias("wick_high"),
        F.least("mid_open", "mid_close").alias("body_low"),
        F.greatest("mid_open", "mid_close").alias("body_high"),
    )
    falls = F.col("structure_eligible") & (F.col("mid_close") < F.col("mid_open"))
    rises = F.col("structure_eligible") & (F.col("mid_close") > F.col("mid_open"))
    src = with_halo(
        bars.select(
            *by, "bar_idx", "bar_id", "timestamp", "available_at",
            "mid_open", "mid_high", "mid_low", "mid_close", "structure_eligible",
        ),
        by, lookback, 0,
    )
    out = drop_halo(
        src.withColumn("_up", F.last(F.when(falls, bar), ignorenulls=True).over(before)).withColumn(
            "_down", F.last(F.when(rises, bar), ignorenulls=True).over(before)
        )
    )
    return out.select(*by, "bar_idx", "_up", "_down")


def _shifted(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


def _places(zones: DataFrame, by: Sequence[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per zone the places of its lower and upper bound among all bounds of the series, and the bits places take.

    Equal values: lower bounds first, so that zones that touch overlap. Equal lower bounds stand by falling upper bound
    and equal upper bounds by falling lower bound, equal zones in opposite orders, so that of two zones that nest one has
    the smaller place at exactly one end. Bounds are ordered in ranges of the whole key, never by series.
    """
    lo, hi, o = F.col("lower_bound"), F.col("upper_bound"), F.col("_ord")
    ends = zones.select(
        *by, "_ord",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_side"), lo.alias("_v"), (-hi).alias("_t"), o.alias("_u")),
                F.struct(F.lit(1).alias("_side"), hi.alias("_v"), (-lo).alias("_t"), (-o).alias("_u")),
            )
        ),
    )
    order = ["_v", "_side", "_t", "_u"]
    ranged = cut(ends.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    placed = with_row_index(ranged, by, order, F.col("_range").cast("long"), "_place")
    sizes = zones.groupBy(*by).agg(F.length(F.bin(2 * F.count(F.lit(1)))).alias("_bits"))
    pick = lambda side: F.max(F.when(F.col("_side") == side, F.col("_place")))
    return placed.groupBy(*by, "_ord").agg(pick(0).alias("_lo"), pick(1).alias("_hi")).join(sizes, list(by))


def _rank_rows(places: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points and questions of the counts "how many earlier zones have a smaller place", one row per digit of the place.

    ``_set`` 0 holds lower and 1 upper bounds; 2 holds upper bounds in the binary tree of the lower bound's place: a point
    lies in the left nodes above it, a question asks the left siblings of its path. A place is read in digits; a question
    counts points with the same digits before and a smaller digit. So a zone has rows in proportion to the square of the
    logarithm of the number of zones.
    """
    lo, hi = F.col("_lo"), F.col("_hi")
    levels = F.sequence(F.lit(0), F.col("_bits") - 1)
    bit = lambda k: _shifted(lo, k).bitwiseAND(F.lit(1).cast("long"))

    def item(kind: str, group: int, place: Column, level: Column | None = None, node: Column | None = None) -> Column:
        zero = F.lit(0)
        return F.struct(
            F.lit(kind).alias("_ask"), F.lit(group).alias("_set"), (zero if level is None else level).alias("_level"),
            (zero.cast("long") if node is None else node).alias("_node"), place.alias("_place"),
        )

    items = F.concat(
        F.array(
            item("", 0, lo), item("", 1, hi),
            item("lo_lo", 0, lo), item("lo_hi", 0, hi), item("hi_lo", 1, lo), item("hi_hi", 1, hi),
        ),
        F.transform(F.filter(levels, lambda k: bit(k) == 0), lambda k: item("", 2, hi, k, _shifted(lo, k))),
        F.transform(F.filter(levels, lambda k: bit(k) == 1), lambda k: item("both", 2, hi, k, _shifted(lo, k) - 1)),
    )
    digits = F.ceil(F.col("_bits") / DIGIT_BITS).cast("int")
    rows = places.select(*by, "_ord", digits.alias("_n"), F.inline(items)).select(
        *by, "_ord", "_ask", "_set", "_level", "_node", "_place",
        F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_at"),
    )
    low = F.col("_at") * DIGIT_BITS
    return rows.select(
        *by, "_ord", "_ask", "_set", "_level", "_node", "_at",
        _shifted(F.col("_place"), low + DIGIT_BITS).alias("_before"),
        _shifted(F.col("_place"), low).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long")).cast("int").alias("_digit"),
    ).where(F.when(F.col("_ask") == "", F.col("_digit") < (1 << DIGIT_BITS) - 1).otherwise(F.col("_digit") > 0))


def _prior_overlaps(
    zones: DataFrame, by: Sequence[str], cut: Callable[[DataFrame], DataFrame] = materialize, block: int = PACK
) -> DataFrame:
    """Per zone, how many earlier zones overlap it in price, and how many nest with it.

    No zone meets another. Overlapping are those that neither end below nor start above the zone; nested are all that
    don't lie lower at both ends or higher at both ends. Both follow from counts of earlier zones with a smaller place of
    the lower bound, of the upper bound, and of both. Earlier points are counted by running sums over blocks of creation
    order, with the sums of earlier blocks carried on, so no window holds a series.
    """
    by = list(by)
    rows = cut(_rank_rows(cut(_places(zones, by, cut)), by)).withColumn("_block", index_block("_ord", block))
    cell = [*by, "_set", "_level", "_node", "_at", "_before"]
    point = F.col("_ask") == ""
    names = [f"_c{d}" for d in range((1 << DIGIT_BITS) - 1)]
    own = [F.when(point & (F.col("_digit") == d), 1).otherwise(0) for d in range(len(names))]
    # a zone's question stands before its own point
    w = Window.partitionBy(*cell, "_block").orderBy("_ord", point).rowsBetween(START, -1)
    below = sum(
        (F.when(F.col("_digit") > d, F.coalesce(F.sum(x).over(w), F.lit(0))).otherwise(0) for d, x in enumerate(own)), F.lit(0)
    )
    inside = rows.withColumn("_inside", below).where(~point)
    totals = rows.groupBy(*cell, "_block").agg(*[F.sum(x).alias(n) for n, x in zip(names, own, strict=True)])
    before = Window.partitionBy(*cell).orderBy("_block").rowsBetween(START, -1)
    carried = totals.select(*cell, "_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])
    found = inside.join(carried.where("_block > 0"), [*cell, "_block"], "left")
    n = F.col("_inside") + sum(
        (F.when(F.col("_digit") > d, F.coalesce(F.col(c), F.lit(0))).otherwise(0) for d, c in enumerate(names)), F.lit(0)
    )
    counts = found.groupBy(*by, "_ord").agg(
        *[F.sum(F.when(F.col("_ask") == k, n).otherwise(0)).alias(f"_{k}") for k in ("lo_lo", "lo_hi", "hi_lo", "hi_hi", "both")]
    )
    return counts.select(
        *by, "_ord",
        (F.col("_lo_hi") - F.col("_hi_lo")).alias("overlap_with_prior_zone_count"),
        (F.col("_lo_lo") + F.col("_hi_hi") - 2 * F.col("_both")).alias("nested_with_prior_zone_count"),
    )


def _ranked_anchors(
    bars: DataFrame, breaks: DataFrame, lookback: int, timeframes: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Breaks that can found a zone, each with its candidate candle and its rank among those that share the candle."""
    anchors = breaks.where(
        F.col("timeframe").isin(*timeframes)
        & F.col("event_type").isin("bos", "choch")
        & F.col("displacement_qualified")
    ).select(
        *by, "event_id", "event_type", "event_at", "available_at", "direction",
        "bar_idx", "bar_id", "event_seq",
    )
    found = (
        anchors.join(_candidates(bars, lookback, by), [*by, "bar_idx"], "left")
        .withColumn("_c", F.when(F.col("direction") == "up", F.col("_up")).otherwise(F.col("_down")))
        .withColumn("_known", F.col("_c").isNotNull())
        .drop("_up", "_down")
    )
    # anchors sharing a candidate lie within ``lookback`` bars of it: small partitions
    w = Window.partitionBy(*by, "direction", "_c.candidate_index").orderBy("bar_idx", "event_seq")
    return found.withColumn("_rank", F.when(F.col("_known"), F.row_number().over(w)))


def label_order_blocks(
    bars: DataFrame,
    breaks: DataFrame,
    gaps: DataFrame,
    *,
    lookback: int = 6,
    max_age: int = 50,
    geometry: str = "full_wick_range",
    pip_size: float = 0.0001,
    timeframes: Sequence[str] = ("15min", "1H", "4H"),
    by: Sequence[str] = BY,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> tuple[DataFrame, DataFrame]:
    """(zones, anchor audit). One zone per direction and candidate candle.

    The ranked anchors and the zones are each read by several branches; ``cut`` writes them.
    """
    by = list(by)
    if geometry not in ("full_wick_range", "body_range"):
        raise ValueError(f"Unsupported order block geometry: {geometry}")
    bars = bars.where(F.col("timeframe").isin(*timeframes))
    ranked = cut(_ranked_anchors(bars, breaks, lookback, timeframes, by))
    audit = ranked.select(
        *by,
        F.concat(F.lit("ob-anchor:"), F.col("event_id"), F.lit(f":lb{lookback}")).alias("event_id"),
        F.lit("order_block_anchor_audit").alias("event_type"),
        "event_at", "available_at", "direction",
        F.col("event_id").alias("anchor_break_id"),
        F.col("event_type").alias("anchor_event_type"),
        F.col("_known").alias("candidate_found"),
        F.col("_c.candidate_bar_id").alias("candidate_bar_id"),
        F.when(~F.col("_known"), "no_opposing_candle")
        .when(F.col("_rank") > 1, "duplicate_candidate")
        .otherwise("created").alias("status"),
    )
    low, high = (
        ("wick_low", "wick_high") if geometry == "full_wick_range" else ("body_low", "body_high")
    )
    zones = ranked.where("_rank = 1").select(
        *by, F.col("event_id").alias("anchor_break_id"),
        F.col("event_type").alias("anchor_event_type"),
        "event_at", "available_at", "direction", "event_seq", "bar_id",
        F.col("bar_idx").alias("anchor_index"),
        "_c.candidate_index", "_c.candidate_bar_id", "_c.candidate_at", "_c.candidate_available_at",
        F.col(f"_c.{low}").alias("lower_bound"), F.col(f"_c.{high}").alias("upper_bound"),
    )
    zones = cut(
        with_row_index(zones, by, ["anchor_index", "event_seq"], index_block("anchor_index"), "_ord")
    )
    life = _lifecycle(bars, zones, max_age, by)
    confluence = gaps.groupBy(*by, "event_at", "direction").agg(
        F.sort_array(F.collect_list("event_id")).alias("fvg_event_ids")
    )
    out = (
        zones.join(life, [*by, "_ord"], "left")
        .join(_prior_overlaps(zones, by, cut), [*by, "_ord"], "left")
        .join(confluence, [*by, "event_at", "direction"], "left")
        .join(series_length(bars, by), by)
    )
    observed = F.least(F.lit(max_age), F.col("_series_rows") - F.col("anchor_index") - 1)
    status = (
        F.when(F.col("invalidation_at").isNotNull(), "invalidated")
        .when(F.col("full_mitigation_at").isNotNull(), "fully_mitigated")
        .when(observed >= max_age, "expired")
        .otherwise("active_at_sample_end")
    )
    return (
        out.select(
            *by,
            F.concat(
                F.lit("order-block:"), F.col("timeframe"), F.lit(":"), F.col("direction"),
                F.lit(":"), iso("candidate_at"),
            ).alias("event_id"),
            F.lit("order_block").alias("event_type"),
            "event_at", "available_at", "direction", "anchor_break_id", "anchor_event_type",
            "candidate_at", "candidate_available_at", "candidate_bar_id", "candidate_index",
            "anchor_index",
            (F.col("anchor_index") - F.col("candidate_index")).alias("candidate_to_anchor_bars"),
            "lower_bound", "upper_bound",
            ((F.col("lower_bound") + F.col("upper_bound")) / 2).alias("midpoint"),
            ((F.col("upper_bound") - F.col("lower_bound")) / pip_size).alias("width_pips"),
            F.lit(geometry).alias("zone_geometry"),
            F.col("fvg_event_ids").isNotNull().alias("fvg_confluent"),
            F.coalesce("fvg_event_ids", F.expr("cast(array() as array<string>)")).alias("fvg_event_ids"),
            F.coalesce("overlap_with_prior_zone_count", F.lit(0)).cast("long").alias(
                "overlap_with_prior_zone_count"
            ),
            F.coalesce("nested_with_prior_zone_count", F.lit(0)).cast("long").alias(
                "nested_with_prior_zone_count"
            ),
            "first_touch_at", "midpoint_touch_at", "full_mitigation_at", "invalidation_at",
            "terminal_delay_bars", observed.alias("observed_bars"), status.alias("status"),
            F.lit(True).alias("entry_trigger_eligible"),
            "bar_id",
            F.array("candidate_bar_id", "bar_id").alias("source_bar_ids"),
        ),
        audit,
    )


def _lifecycle(bars: DataFrame, zones: DataFrame, max_age: int, by: Sequence[str]) -> DataFrame:
    """First touch, midpoint, full mitigation and invalidation up to the first terminal bar."""
    later = bars.where("structure_eligible").select(
        *by, F.col("bar_idx").alias("_i"), F.col("available_at").alias("_at"),
        F.col("mid_high").alias("_h"), F.col("mid_low").alias("_l"), F.col("mid_close").alias("_c"),
    )
    span = zones.select(
        *by, "_ord", "anchor_index", "direction", "lower_bound", "upper_bound",
        (F.col("anchor_index") + 1).alias("_from"),
        (F.col("anchor_index") + max_age + 1).alias("_to"),
    )
    path = range_join(span, later, by=by, start="_from", end="_to", on="_i", bucket_seconds=64)
    lo, hi = F.col("lower_bound"), F.col("upper_bound")
    mid = (lo + hi) / 2
    up = F.col("direction") == "up"

    def side(long_rule: Column, short_rule: Column) -> Column:
        return F.when(up, long_rule).otherwise(short_rule)

    rules = {
        "first_touch_at": (F.col("_l") <= hi) & (F.col("_h") >= lo),
        "midpoint_touch_at": side(F.col("_l") <= mid, F.col("_h") >= mid),
        "full_mitigation_at": side(F.col("_l") <= lo, F.col("_h") >= hi),
        "invalidation_at": side(F.col("_c") < lo, F.col("_c") > hi),
    }
    ended = rules["full_mitigation_at"] | rules["invalidation_at"]
    firsts = path.groupBy(*by, "_ord").agg(
        *[F.min(F.when(rule, F.col("_at"))).alias(name) for name, rule in rules.items()],
        F.min(F.when(ended, F.col("_i") - F.col("anchor_index"))).alias("terminal_delay_bars"),
        F.min(F.when(ended, F.col("_at"))).alias("_stop"),
    )
    clipped = [
        F.when(F.col("_stop").isNull() | (F.col(n) <= F.col("_stop")), F.col(n)).alias(n)
        for n in rules
    ]
    return firsts.select(*by, "_ord", *clipped, "terminal_delay_bars")
