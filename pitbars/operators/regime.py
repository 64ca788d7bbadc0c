"""Market-structure regime and breaks, without scanning a series in one task.

The rule is stateful: a bar that closes beyond the latest swing breaks it, a break against
the regime through its protected swing (a change of character) suspends the regime until both
latest swings have confirmed again. Most of that state does not depend on the path:

* the latest swings at a bar are a point-in-time lookup;
* between two swing confirmations (a *segment*) the levels are fixed, so only the first close
  above the high (``u``) and the first close below the low (``d``) can matter;
* a swing is still unbroken when no earlier segment with the same swing had such a close;
* the regime is a function of the two swing relationships unless suspended.

Only the suspension is a recurrence: a possible change of character at bar ``e`` is real when
the older of its two latest swings confirmed after the previous real one. ``_real_changes``
solves it block by block: per block the outcome for the at most three distinguishable entry
states, then the entry states along the block table, then the rows of each block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import iso
from ..session import materialize
from .asof import asof
from .blocks import DEFAULT_BLOCK_ROWS, START, index_block, previous_row
from .labels import BY, _trigger_eligible

NEVER = -1


def _relation_regime(high: Column, low: Column) -> Column:
    return (
        F.when(high.isNull() | low.isNull(), "undetermined")
        .when((high == "HH") & (low == "HL"), "bullish")
        .when((high == "LH") & (low == "LL"), "bearish")
        .when((high == "EQH") & (low == "EQL"), "balance")
        .when((high == "H0") | (low == "L0"), "undetermined")
        .otherwise("transition")
    )


def _with_latest_swings(bars: DataFrame, swings: DataFrame, by: Sequence[str]) -> DataFrame:
    out = bars
    for kind, prefix in (("swing_high", "h"), ("swing_low", "l")):
        side = swings.where((F.col("event_type") == kind) & ~F.col("ambiguous_equal"))
        out = asof(
            out, side.withColumnRenamed("confirmation_index", "_conf"),
            left_on="bar_idx", right_on="_conf", by=by,
            cols={
                "_conf": f"{prefix}_conf", "price": f"{prefix}_price",
                "structural_relationship": f"{prefix}_rel", "event_id": f"{prefix}_id",
                "bar_id": f"{prefix}_bar_id",
            },
        )
    return out


def _fold(rows: Column, start: Column) -> Column:
    """Last real change after walking ``rows`` (ordered by position) from entry state ``start``."""
    return F.aggregate(
        rows, start.cast("long"), lambda last, x: F.when(x["m"] > last, x["e"]).otherwise(last)
    )


def _real_changes(cands: DataFrame, by: Sequence[str], size: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Positions ``e`` of the changes of character that really happen.

    ``cands``: by, seg (segment start), m (older of the two confirmations), e (bar). A block
    covers ``size`` bars, so its array is bounded. Entry states that lie between the same two
    values of ``m`` behave alike, and values of ``m`` before the block start are at most two.
    """
    by = list(by)
    blocks = (
        cands.withColumn("_blk", index_block("seg", size))
        .groupBy(*by, "_blk")
        .agg(F.array_sort(F.collect_list(F.struct("seg", "m", "e"))).alias("_rows"))
    )
    ms = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform("_rows", lambda x: x["m"]),
                lambda m: m < F.col("_blk") * F.lit(size),
            )
        )
    )
    blocks = blocks.withColumn("_cuts", ms)
    entries = F.concat(F.array(F.lit(NEVER).cast("long")), F.col("_cuts"))
    summary = blocks.select(
        *by, "_blk", "_cuts",
        F.transform(
            entries, lambda s: F.nullif(_fold(F.col("_rows"), s), s)
        ).alias("_exits"),  # NULL: the entry state passes through unchanged
    )
    step = lambda last, b: F.coalesce(
        F.element_at(b["exits"], (F.size(F.filter(b["cuts"], lambda c: c <= last)) + 1).cast("int")),
        last,
    )
    chain = summary.groupBy(*by).agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("_blk").alias("blk"), F.col("_cuts").alias("cuts"), F.col("_exits").alias("exits"))
            )
        ).alias("_chain")
    )
    init = F.struct(
        F.lit(NEVER).cast("long").alias("last"),
        F.expr("cast(array() as array<struct<blk:bigint,entry:bigint>>)").alias("seen"),
    )
    walked = F.aggregate(
        "_chain",
        init,
        lambda acc, b: F.struct(
            step(acc["last"], b).alias("last"),
            F.array_append(
                acc["seen"], F.struct(b["blk"].alias("blk"), acc["last"].alias("entry"))
            ).alias("seen"),
        ),
    )
    entry = chain.select(*by, F.explode(walked["seen"]).alias("_e")).select(
        *by, F.col("_e.blk").alias("_blk"), F.col("_e.entry").alias("_entry")
    )
    init_rows = F.struct(
        F.col("_entry").alias("last"),
        F.expr("cast(array() as array<bigint>)").alias("real"),
    )
    real = F.aggregate(
        "_rows",
        init_rows,
        lambda acc, x: F.when(
            x["m"] > acc["last"],
            F.struct(x["e"].alias("last"), F.array_append(acc["real"], x["e"]).alias("real")),
        ).otherwise(acc),
    )
    return blocks.join(entry, [*by, "_blk"]).select(*by, F.explode(real["real"]).alias("e"))


def structure_segments(
    bars: DataFrame,
    swings: DataFrame,
    *,
    buffer_atr: float | Column = 0.05,
    by: Sequence[str] = BY,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """One row per segment: levels, first closes beyond them, regime at its start, real change.

    The segment table is read by three branches; ``cut=materialize`` computes it once.
    """
    by = list(by)
    buffer = buffer_atr if isinstance(buffer_atr, Column) else F.lit(float(buffer_atr))
    slim = bars.select(*by, "bar_idx", "mid_close", "atr", "structure_eligible", buffer.alias("_buf"))
    on = _with_latest_swings(slim, swings, by).where("h_conf is not null or l_conf is not null")
    width = F.col("atr") * F.col("_buf")
    live = F.col("structure_eligible") & F.col("atr").isNotNull()
    above = live & (F.col("mid_close") > F.col("h_price") + width)
    below = live & (F.col("mid_close") < F.col("l_price") - width)
    keys = [
        "h_conf", "h_price", "h_rel", "h_id", "h_bar_id",
        "l_conf", "l_price", "l_rel", "l_id", "l_bar_id", "_buf",
    ]
    seg = (
        on.withColumn("seg", F.greatest("h_conf", "l_conf"))
        .groupBy(*by, "seg", *keys)
        .agg(
            F.min(F.when(above, F.col("bar_idx"))).alias("u"),
            F.min(F.when(below, F.col("bar_idx"))).alias("d"),
        )
    )
    # unbroken when no earlier segment of the same swing closed beyond it
    earlier = lambda side: (
        Window.partitionBy(*by, f"{side}_conf").orderBy("seg").rowsBetween(START, -1)
    )
    seg = (
        seg.withColumn("h_active", F.col("h_conf").isNotNull() & F.min("u").over(earlier("h")).isNull())
        .withColumn("l_active", F.col("l_conf").isNotNull() & F.min("d").over(earlier("l")).isNull())
        .withColumn("_rel", _relation_regime(F.col("h_rel"), F.col("l_rel")))
        .withColumn("m", F.least("h_conf", "l_conf"))
        .withColumn(
            "e", F.when(F.col("_rel") == "bullish", F.col("d")).when(F.col("_rel") == "bearish", F.col("u"))
        )
    )
    seg = cut(seg)
    cands = seg.where("e is not null").select(*by, "seg", "m", "e")
    real = _real_changes(cands, by, block_rows)
    seg = asof(
        seg, real, left_on="seg", right_on="e", by=by, cols={"e": "_last_change"},
        allow_equal=False, block=block_rows,
    )
    both = F.col("h_conf").isNotNull() & F.col("l_conf").isNotNull()
    suspended = both & (F.coalesce("_last_change", F.lit(NEVER)) >= F.col("m"))
    return (
        seg.withColumn("regime", F.when(suspended, "transition").otherwise(F.col("_rel")))
        .withColumn(
            "change_at", F.when(F.col("regime").isin("bullish", "bearish"), F.col("e"))
        )
        .drop("_rel", "_last_change", "m", "e")
    )


def breaks_from_segments(
    segments: DataFrame,
    bars: DataFrame,
    *,
    displacement_body_atr: float = 0.80,
    by: Sequence[str] = BY,
) -> DataFrame:
    """At most one upward and one downward break per segment, classified."""
    by = list(by)
    r, u, d = F.col("regime"), F.col("u"), F.col("d")
    bull, bear = r == "bullish", r == "bearish"
    up_before = F.when(bear, "bearish").when(bull & (d < u), "transition").otherwise(r)
    down_before = F.when(bull, "bullish").when(bear & (u < d), "transition").otherwise(r)

    def event(direction: str) -> Column:
        up = direction == "up"
        at, side = (u, "h") if up else (d, "l")
        with_trend, against = (bull, bear) if up else (bear, bull)
        other = d if up else u
        level = "high" if up else "low"
        exists = F.when(against, at.isNotNull()).otherwise(at.isNotNull() & F.col(f"{side}_active"))
        still = with_trend & (other.isNull() | (at <= other))
        kind = F.when(against, "choch").when(still, "bos").otherwise("unclassified_break")
        role = F.when(against, f"protected_{level}").when(still, f"continuation_{level}").otherwise(
            f"active_{level}"
        )
        before = up_before if up else down_before
        return F.when(
            exists,
            F.struct(
                at.alias("bar_idx"), F.lit(direction).alias("direction"), kind.alias("event_type"),
                role.alias("broken_level_role"), before.alias("regime_before"),
                F.when(against, "transition").otherwise(before).alias("regime_after"),
                F.col(f"{side}_id").alias("broken_swing_id"),
                F.col(f"{side}_rel").alias("broken_swing_relationship"),
                F.col(f"{side}_price").alias("broken_level"),
                F.col(f"{side}_bar_id").alias("_swing_bar"),
                # order of two breaks on one bar: with the regime first, then against it
                F.when(bear, 1 if up else 0).otherwise(0 if up else 1).alias("event_seq"),
            ),
        )

    flat = segments.withColumn(
        "_e", F.explode(F.array_compact(F.array(event("up"), event("down"))))
    ).select(*by, "_buf", "_e.*")
    src = bars.select(
        *by, "bar_idx", "bar_id", "timestamp", "available_at", "mid_close", "atr", "body_atr"
    )
    return flat.join(src, [*by, "bar_idx"]).select(
        *by,
        F.concat(
            F.lit("break:"), F.col("timeframe"), F.lit(":"), F.col("direction"), F.lit(":"),
            iso("timestamp"), F.lit(":b"), F.col("_buf").cast("string"),
        ).alias("event_id"),
        "event_type",
        F.col("timestamp").alias("event_at"),
        "available_at", "direction", "regime_before", "regime_after", "broken_level_role",
        "broken_swing_id", "broken_swing_relationship", "broken_level",
        F.col("mid_close").alias("close"),
        "atr", F.col("_buf").alias("buffer_atr"), "body_atr",
        F.coalesce(F.col("body_atr") >= displacement_body_atr, F.lit(False)).alias(
            "displacement_qualified"
        ),
        "bar_id", "bar_idx", "event_seq",
        F.array("_swing_bar", "bar_id").alias("source_bar_ids"),
        _trigger_eligible().alias("entry_trigger_eligible"),
    )


def contexts_from_segments(
    segments: DataFrame, bars: DataFrame, *, by: Sequence[str] = BY, block_rows: int = DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Rows where the regime at a bar's end differs from the regime at its start.

    The first eligible bar of a series always yields an ``initialization`` row. A change that
    happens on an ineligible bar (a confirmation there) is not reported, as in the study.
    """
    by = list(by)
    seg = segments.withColumn(
        "_end", F.when(F.col("change_at").isNotNull(), "transition").otherwise(F.col("regime"))
    )
    seg = previous_row(seg, by, "seg", ["_end"], "_before", block_rows)
    opening = F.coalesce(F.col("_before._end"), F.lit("undetermined"))
    at_start = F.col("change_at") == F.col("seg")
    ids = [F.col("h_id"), F.col("l_id")]
    first = F.struct(
        F.col("seg").alias("bar_idx"), opening.alias("previous_state"),
        F.when(at_start, "transition").otherwise(F.col("regime")).alias("state"),
        F.when(at_start, "choch").otherwise("swing_confirmation").alias("cause"),
    )
    inner = F.when(
        F.col("change_at") > F.col("seg"),
        F.struct(
            F.col("change_at").alias("bar_idx"), F.col("regime").alias("previous_state"),
            F.lit("transition").alias("state"), F.lit("choch").alias("cause"),
        ),
    )
    moves = seg.select(
        *by, *ids, F.explode(F.array_compact(F.array(first, inner))).alias("_m")
    ).select(*by, "h_id", "l_id", "_m.*")

    live = bars.where(F.col("structure_eligible") & F.col("atr").isNotNull())
    starts = live.groupBy(*by).agg(F.min("bar_idx").alias("bar_idx"))
    present = segments.select(*by).distinct()
    init = asof(
        starts.join(present, by, "left_semi"),
        moves.select(*by, F.col("bar_idx").alias("_at"), "state", "h_id", "l_id"),
        left_on="bar_idx", right_on="_at", by=by, cols=["state", "h_id", "l_id"], block=block_rows,
    ).select(
        *by, "h_id", "l_id", "bar_idx",
        F.lit(None).cast("string").alias("previous_state"),
        F.coalesce("state", F.lit("undetermined")).alias("state"),
        F.lit("initialization").alias("cause"),
    )
    changed = moves.where("state <> previous_state").join(
        init.select(*by, "bar_idx"), [*by, "bar_idx"], "left_anti"
    )
    rows = changed.unionByName(init.select(*changed.columns))
    src = live.select(*by, "bar_idx", "bar_id", "timestamp", "available_at")
    state = F.col("state")
    return rows.join(src, [*by, "bar_idx"]).select(
        *by,
        F.concat(
            F.lit("context:"), F.col("timeframe"), F.lit(":"), iso("timestamp"), F.lit(":"), state
        ).alias("event_id"),
        F.lit("context_state_change").alias("event_type"),
        F.col("timestamp").alias("event_at"),
        "available_at", "previous_state", "state", "cause",
        F.col("h_id").alias("latest_high_swing_id"),
        F.col("l_id").alias("latest_low_swing_id"),
        F.when(state == "bearish", F.col("h_id")).alias("protected_high_swing_id"),
        F.when(state == "bullish", F.col("l_id")).alias("protected_low_swing_id"),
        F.when(F.col("timeframe") == "1D", "regime_only").otherwise("structure_context").alias(
            "context_role"
        ),
        "bar_id", "bar_idx",
        _trigger_eligible().alias("entry_trigger_eligible"),
    )


def label_regime(
    bars: DataFrame,
    swings: DataFrame,
    *,
    buffer_atr: float | Column = 0.05,
    displacement_body_atr: float = 0.80,
    by: Sequence[str] = BY,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> tuple[DataFrame, DataFrame]:
    """(breaks, contexts) of every series. Pass written ``bars`` and ``swings``: both are read
    by several branches."""
    seg = cut(
        structure_segments(
            bars, swings, buffer_atr=buffer_atr, by=by, block_rows=block_rows, cut=cut
        )
    )
    return (
        breaks_from_segments(seg, bars, displacement_body_atr=displacement_body_atr, by=by),
        contexts_from_segments(seg, bars, by=by, block_rows=block_rows),
    )
