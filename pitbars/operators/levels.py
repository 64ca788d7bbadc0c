"""Support/resistance zones: greedy online clustering of confirmed swing prices.

The rule is sequential per (series, role): a swing joins the nearest live zone, which moves
that zone's centre. It runs in epochs of ``epoch_bars`` positions: an epoch's group holds its
own swings plus the zones still alive at its start (a zone dies ``max_age`` bars after its
last touch, and a bar confirms one swing per role, so at most ``max_age`` zones live on). All
series advance together; no group ever holds more than one epoch, and a lost executor
costs one epoch because finished epochs are written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import index_block, previous_row, with_row_index
from .labels import BY

EPOCH_BARS = 262_144
_STATE = [
    "created_index", "center", "lower_bound", "upper_bound", "half_width", "touch_count",
]


def _cluster_group(keys: Sequence[str], max_age: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["confirmation_index", "created_index"], kind="stable")
        old = group[group["touch_count"] > 0].sort_values("created_index")
        # columns of ``live``: created, centre, lower, upper, half width, touches, last touch
        live = old[_STATE + ["confirmation_index"]].to_numpy(dtype="float64").tolist()
        new = group[group["touch_count"] == 0]
        out = []
        for at, price, tol in zip(new["confirmation_index"], new["price"], new["tolerance"]):
            live = [z for z in live if at - z[6] <= max_age]
            best = None
            if live:
                centre = np.array([z[1] for z in live])
                reach = np.maximum(tol, np.array([z[4] for z in live]))
                gap = np.abs(price - centre)
                near = np.where(gap <= reach, gap, np.inf)
                k = int(near.argmin())
                best = live[k] if np.isfinite(near[k]) else None
            if best is None:
                best = [float(at), price, price - tol, price + tol, tol, 1.0, at]
                live.append(best)
            else:
                n = best[5]
                best[1] = (best[1] * n + price) / (n + 1)
                best[2] = min(best[2], price - tol)
                best[3] = max(best[3], price + tol)
                best[4] = max(best[1] - best[2], best[3] - best[1])
                best[5] = n + 1
                best[6] = at
            out.append([at, *best[:6]])
        frame = pd.DataFrame(out, columns=["confirmation_index", *_STATE])
        for key in keys:
            frame[key] = group[key].iloc[0]
        for c in ("confirmation_index", "created_index", "touch_count"):
            frame[c] = frame[c].astype("int64")
        return frame[[*keys, "confirmation_index", *_STATE]]

    return run


def cluster_levels(
    swings: DataFrame,
    bars: DataFrame,
    *,
    tolerance_atr: float | Column = 0.20,
    max_age: int = 500,
    min_touches: int = 2,
    by: Sequence[str] = BY,
    epoch_bars: int = EPOCH_BARS,
) -> tuple[DataFrame, DataFrame]:
    """(zones, snapshots); one snapshot per accepted swing, after the update it caused."""
    by = list(by)
    keys = [*by, "role"]
    ratio = tolerance_atr if isinstance(tolerance_atr, Column) else F.lit(float(tolerance_atr))
    touches = (
        swings.where(~F.col("ambiguous_equal"))
        .withColumn(
            "role", F.when(F.col("event_type") == "swing_high", "resistance").otherwise("support")
        )
        .withColumn("tolerance", F.col("atr") * ratio)
        .where("tolerance > 0 and not isnan(tolerance) and tolerance < double('Infinity')")
    )
    slim = touches.select(
        *keys, "confirmation_index", "price", "tolerance",
        F.lit(0).cast("long").alias("created_index"),
        *[F.lit(0.0).alias(c) for c in _STATE[1:5]],
        F.lit(0).cast("long").alias("touch_count"),
    )
    types = {k: slim.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join(
        [f"{k} {types[k]}" for k in keys]
        + ["confirmation_index long, created_index long"]
        + [f"{c} double" for c in _STATE[1:5]]
        + ["touch_count long"]
    )
    top = swings.agg(F.max("confirmation_index")).first()[0] or 0
    epochs = top // epoch_bars + 1
    if epochs > 1:
        slim = materialize(slim)
    step = _cluster_group(keys, max_age)
    done: DataFrame | None = None
    part: DataFrame | None = None
    for k in range(epochs):
        start = k * epoch_bars
        todo = slim
        if epochs > 1:
            todo = slim.where(
                (F.col("confirmation_index") >= start)
                & (F.col("confirmation_index") < start + epoch_bars)
            )
        if done is not None:
            # zones that can still be joined: last snapshot of each, touched recently enough
            recent = done.where(F.col("confirmation_index") >= start - max_age)
            last = F.max_by(
                F.struct("confirmation_index", *_STATE[1:]), F.col("confirmation_index")
            ).alias("_z")
            alive = (
                recent.groupBy(*keys, "created_index").agg(last)
                .select(*keys, "created_index", "_z.*")
                .withColumn("price", F.lit(0.0))
                .withColumn("tolerance", F.lit(0.0))
            )
            todo = todo.unionByName(alive)
        part = todo.groupBy(*keys).applyInPandas(step, schema)
        if epochs > 1:
            part = materialize(part)
        done = part if done is None else done.unionByName(part)
    return _describe_zones(done, touches, bars, max_age, min_touches, by)


def _describe_zones(
    moves: DataFrame,
    touches: DataFrame,
    bars: DataFrame,
    max_age: int,
    min_touches: int,
    by: list[str],
) -> tuple[DataFrame, DataFrame]:
    keys = [*by, "role"]
    births = moves.where("touch_count = 1").select(*keys, "created_index")
    numbered = with_row_index(
        births, by, ["created_index", "role"], index_block("created_index"), "_n"
    )
    ids = numbered.select(
        *keys, "created_index",
        F.concat(
            F.lit("zone:"), F.concat_ws(":", F.col("timeframe"), F.col("role")), F.lit(":"),
            F.lpad((F.col("_n") + 1).cast("string"), 6, "0"),
        ).alias("zone_id"),
    )
    source = touches.select(
        *keys, "confirmation_index", "event_at", "available_at", "direction",
        F.col("event_id").alias("swing_id"), F.col("bar_id").alias("source_bar_id"),
    )
    snapshots = (
        moves.join(ids, [*keys, "created_index"])
        .join(source, [*keys, "confirmation_index"])
        .withColumn("active", F.col("touch_count") >= min_touches)
        .withColumn("event_type", F.lit("zone_touch"))
    )
    last = F.col("confirmation_index")
    ends = bars.groupBy(*by).agg(F.max("bar_idx").alias("_final"))
    zones = (
        snapshots.groupBy(*keys, "zone_id", "created_index")
        .agg(
            *[
                F.max_by(c, last).alias(c)
                for c in ("center", "lower_bound", "upper_bound", "half_width")
            ],
            F.max("touch_count").alias("touch_count"),
            F.min("event_at").alias("created_at"),
            F.min("available_at").alias("created_available_at"),
            F.min(F.when(F.col("active"), F.col("available_at"))).alias("active_at"),
            F.max("event_at").alias("last_touch_at"),
            F.max("available_at").alias("last_available_at"),
            F.max("confirmation_index").alias("last_touch_index"),
        )
        .join(ends, by)
        .withColumn("age_bars_at_sample_end", F.col("_final") - F.col("created_index"))
        .withColumn("bars_since_last_touch", F.col("_final") - F.col("last_touch_index"))
        .withColumn(
            "status_at_sample_end",
            F.when(F.col("_final") - F.col("last_touch_index") > max_age, "expired").otherwise(
                "active_or_candidate"
            ),
        )
        .drop("_final")
    )
    return zones, snapshots


def zone_validity(
    snapshots: DataFrame, *, max_age: int = 500, by: Sequence[str] = BY
) -> DataFrame:
    """Active snapshots as half-open position intervals [touch, next touch of the zone or expiry)."""
    active = snapshots.where("active")
    nxt = previous_row(
        active.withColumn("_neg", -F.col("confirmation_index")), [*by, "zone_id"], "_neg",
        ["confirmation_index"], "_next",
    )
    end = F.least(
        F.coalesce(F.col("_next.confirmation_index"), F.col("confirmation_index") + max_age + 1),
        F.col("confirmation_index") + max_age + 1,
    )
    return nxt.withColumn("valid_from", F.col("confirmation_index")).withColumn(
        "valid_to", end
    ).drop("_neg", "_next")

