"""Point-in-time joins and the bucketed range join.

``asof`` looks up, for each left row, the latest (or next) right row of the same series. The
rows of both sides are unioned and scanned in order inside time blocks; a block that holds no
right row before a left row uses the value carried in from the last earlier block that has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import micros, sign_of
from .blocks import DEFAULT_BLOCK_ROWS, DEFAULT_BLOCK_SECONDS, HERE, START

DAY_SECONDS = 86_400


def _position(df: DataFrame, column: str) -> Column:
    """The ordering value as a long: microseconds for instants, itself for integers."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("long")


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    by: Sequence[str],
    cols: Sequence[str] | dict[str, str],
    ties: Sequence[str] = (),
    direction: str = "backward",
    allow_equal: bool = True,
    block: int | None = None,
    found: str | None = None,
) -> DataFrame:
    """Left rows with ``cols`` of the nearest right row; NULL where there is none.

    ``backward``: latest right row with ``right_on <= left_on`` (``<`` if not allow_equal).
    ``forward``: first right row with ``right_on >= left_on``. Among right rows at the same
    position the last (backward) or first (forward) in ``ties`` order is taken.
    ``block`` is the block length in units of the ordering column (microseconds or rows);
    results do not depend on it.
    """
    by = list(by)
    names = cols if isinstance(cols, dict) else {c: c for c in cols}
    instants = isinstance(
        left.schema[left_on].dataType, (T.TimestampType, T.TimestampNTZType)
    )
    span = block or (DEFAULT_BLOCK_SECONDS * 1_000_000 if instants else DEFAULT_BLOCK_ROWS)
    sign = 1 if direction == "backward" else -1

    payload = F.struct(*[F.col(src).alias(dst) for src, dst in names.items()])
    tie = F.struct(*[F.col(c) for c in ties]) if ties else F.struct(F.lit(0).alias("_t0"))
    keep = [c for c in left.columns if c not in by]

    r = right.where(F.col(right_on).isNotNull()).select(
        *by,
        (_position(right, right_on) * sign).alias("_pos"),
        tie.alias("_tie"),
        payload.alias("_pay"),
    )
    r = r.withColumn("_blk", F.floor(F.col("_pos") / F.lit(span)).cast("long"))
    l = left.select(
        *by,
        (_position(left, left_on) * sign).alias("_pos"),
        F.struct(*[F.col(c) for c in keep]).alias("_row"),
    ).withColumn("_blk", F.floor(F.col("_pos") / F.lit(span)).cast("long"))

    left_side = 1 if allow_equal else -1
    both = r.select(*by, "_blk", "_pos", F.lit(0).alias("_side"), "_tie", "_pay").unionByName(
        l.select(*by, "_blk", "_pos", F.lit(left_side).alias("_side"), "_row"),
        allowMissingColumns=True,
    )
    tie_order = F.col("_tie").asc() if sign == 1 else F.col("_tie").desc()
    w = Window.partitionBy(*by, "_blk").orderBy("_pos", "_side", tie_order).rowsBetween(START, HERE)
    scanned = both.withColumn("_hit", F.last("_pay", ignorenulls=True).over(w)).where(
        F.col("_row").isNotNull()
    )

    # one value per block, spread over the following blocks up to the next block that has one
    order = F.struct("_pos", "_tie")
    pick = (
        F.max_by("_pay", order)
        if sign == 1
        else F.max_by("_pay", F.struct(F.col("_pos"), F.lit(0)))
    )
    if sign == -1 and ties:
        # smallest tie among the rows at the block's largest (negated) position
        top = r.groupBy(*by, "_blk").agg(F.max("_pos").alias("_pos"))
        last = (
            r.join(top, [*by, "_blk", "_pos"])
            .groupBy(*by, "_blk")
            .agg(F.min_by("_pay", F.col("_tie")).alias("_carry"))
        )
    else:
        last = r.groupBy(*by, "_blk").agg(pick.alias("_carry"))
    nxt = F.lead("_blk").over(Window.partitionBy(*by).orderBy("_blk"))
    spans = last.withColumn("_next", nxt)
    carry = spans.where("_next is not null").select(
        *by, F.explode(F.sequence(F.col("_blk") + 1, F.col("_next"))).alias("_blk"), "_carry"
    )
    tail = spans.where("_next is null").select(
        *by, F.col("_blk").alias("_tail_blk"), F.col("_carry").alias("_tail")
    )
    out = scanned.join(carry, [*by, "_blk"], "left").join(tail, by, "left")
    hit = F.coalesce(
        F.col("_hit"),
        F.col("_carry"),
        F.when(F.col("_blk") > F.col("_tail_blk"), F.col("_tail")),
    )
    flag = [hit.isNotNull().alias(found)] if found else []
    return out.select(
        *by,
        *[F.col("_row")[c].alias(c) for c in keep],
        *[hit[c].alias(c) for c in names.values()],
        *flag,
    )


def asof_state(
    left: DataFrame,
    contexts: DataFrame,
    *,
    on: str,
    timeframe: str,
    name: str,
    by: Sequence[str] = ("symbol",),
    default: str = "undetermined",
) -> DataFrame:
    """Latest context state of one timeframe as of ``on``; ``default`` before the first."""
    right = contexts.where(F.col("timeframe") == timeframe).select(*by, "available_at", "state")
    out = asof(left, right, left_on=on, right_on="available_at", by=by, cols={"state": name})
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def asof_positive(
    left: DataFrame,
    bars: DataFrame,
    *,
    on: str,
    value: str = "atr",
    name: str = "atr",
    by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Value of the latest completed bar, only if that value is finite and above zero."""
    right = bars.select(*by, "available_at", F.col(value).alias("_v"))
    out = asof(left, right, left_on=on, right_on="available_at", by=by, cols={"_v": name})
    ok = F.col(name).isNotNull() & ~F.isnan(name) & (F.col(name) > 0) & (
        F.col(name) < float("inf")
    )
    return out.withColumn(name, F.when(ok, F.col(name)))


def asof_pair(
    left: DataFrame, bars: DataFrame, *, on: str, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """``pair_direction``: sign of the last completed close change as of ``on`` (NULL if none).

    ``bars`` need ``bar_idx``; the previous bar is the previous row, whatever its time.
    """
    from .blocks import drop_halo, halo_window, with_halo

    slim = bars.select(*by, "bar_idx", "available_at", "mid_close")
    pairs = drop_halo(
        with_halo(slim, by, 1, 0).withColumn("_prev", F.lag("mid_close").over(halo_window(by)))
    ).select(*by, "available_at", "mid_close", "_prev")
    out = asof(
        left, pairs, left_on=on, right_on="available_at", by=by,
        cols={"mid_close": "_last_close", "_prev": "_prev_close"},
    )
    rule = F.when(F.col("_last_close") > F.col("_prev_close"), "long").when(
        F.col("_last_close") < F.col("_prev_close"), "short"
    )
    return out.withColumn("pair_direction", rule).drop("_last_close", "_prev_close")


def first_bar_after(
    left: DataFrame,
    bars: DataFrame,
    *,
    on: str,
    cols: dict[str, str],
    by: Sequence[str] = ("symbol",),
    before: str | None = None,
) -> DataFrame:
    """First bar starting at or after ``on`` (and before ``before``); NULL columns if none."""
    names = {"timestamp": "entry_at", **cols}
    out = asof(
        left, bars.select(*by, *names), left_on=on, right_on="timestamp", by=by,
        cols=names, direction="forward",
    )
    if before is None:
        return out
    late = F.col("entry_at") >= F.col(before)
    for name in names.values():
        if name != "entry_at":
            out = out.withColumn(name, F.when(~late, F.col(name)))
    return out.withColumn("entry_at", F.when(~late, F.col("entry_at")))


def range_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    start: str,
    end: str,
    on: str = "timestamp",
    include_start: bool = True,
    how: str = "inner",
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Rows of ``right`` inside [start, end) of each left row, as an equi-join on time buckets.

    A left row is copied to the few buckets its interval touches and a right row lies in
    exactly one bucket, so every match appears once and the plan has no nested loop.
    ``on``, ``start`` and ``end`` may be instants or row positions (then ``bucket_seconds``
    counts rows). Column names other than ``by`` must not clash.
    """
    by = list(by)
    instants = isinstance(left.schema[start].dataType, T.TimestampType)
    width = F.lit(bucket_seconds * (1_000_000 if instants else 1))
    lo = F.floor(_position(left, start) / width).cast("long")
    hi = F.floor((_position(left, end) - 1) / width).cast("long")
    spread = left.withColumn(
        "_bucket", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array(lo)))
    )
    placed = right.withColumn("_bucket", F.floor(_position(right, on) / width).cast("long"))
    lower = F.col(on) >= F.col(start) if include_start else F.col(on) > F.col(start)
    if how == "inner":
        return (
            spread.join(placed, [*by, "_bucket"])
            .where(lower & (F.col(on) < F.col(end)))
            .drop("_bucket")
        )
    raise ValueError("only the inner range join is offered; left-join the aggregate back instead")


def latest_opposing_swing(
    signals: DataFrame,
    swings: DataFrame,
    *,
    by: Sequence[str] = ("symbol",),
    cols: dict[str, str] | None = None,
) -> DataFrame:
    """Latest confirmed swing low for longs / high for shorts, known and past at ``decision_at``."""
    names = cols or {
        "event_id": "structural_swing_id",
        "event_type": "structural_swing_type",
        "structural_relationship": "structural_swing_relationship",
        "event_at": "structural_swing_event_at",
        "available_at": "structural_swing_available_at",
    }
    side = F.when(F.col("direction") == "long", "swing_low").otherwise("swing_high")
    right = swings.where(F.col("event_at") < F.col("available_at")).withColumn(
        "_side_key", F.col("event_type")
    ).withColumn("_known", F.col("available_at"))
    out = asof(
        signals.withColumn("_side_key", side), right,
        left_on="decision_at", right_on="_known", by=[*by, "_side_key"], cols=names,
        ties=("confirmation_index", "pivot_index", "event_id"),
    )
    return out.drop("_side_key")


def verify_source_event(
    signals: DataFrame, breaks: DataFrame, *, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """``source_event_match``: the named break exists with the same type, time and direction."""
    src = breaks.select(
        *by,
        F.col("event_id").alias("source_event_id"),
        F.col("event_type").alias("_type"),
        F.col("available_at").alias("_at"),
        F.when(F.col("direction") == "up", 1.0).otherwise(-1.0).alias("_sgn"),
    )
    match = (
        (F.col("_type") == F.col("event_type"))
        & (F.col("_at") == F.col("decision_at"))
        & (F.col("_sgn") == sign_of("direction"))
    )
    return (
        signals.join(src, [*by, "source_event_id"], "left")
        .withColumn("source_event_match", F.coalesce(match, F.lit(False)))
        .drop("_type", "_at", "_sgn")
    )
