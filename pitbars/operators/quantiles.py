"""Exact linear-interpolated quantiles of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here equal values are combined first. While a
group holds more values than one task may sort, a sketch cuts it into value ranges, the ranges are counted, and only those
that hold a wanted rank go on, each as a group of its own. The sketch steers the work; the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import HERE, START

#: Ranges a group is cut into at a time, and the distinct values one task may sort.
RANGES = 64
MOST_SORTED = 100_000


def _spot(p: float) -> Column:
    return F.lit(float(p)) * (F.col("_rows") - 1)


def _largest(live: DataFrame, part: Sequence[str], most: int) -> int:
    """Values of the largest part; all of them where they are few (a table tells its number of rows without a scan)."""
    if (n := live.count()) <= most:
        return n
    return live.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def narrow(
    values: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    ranges: int = RANGES,
    most: int = MOST_SORTED,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """(keys, _part, _rows, _skip, _v, _c): the values among which the wanted ranks lie, in parts of at most ``most`` values.

    ``values`` holds each distinct value (_v) of a group once, with its count (_c). ``_rows`` is the group's number of rows,
    ``_skip`` how many of them lie below the part. Each round cuts a part to about a ``ranges``-th of its values.
    """
    keys = list(keys)
    rows = values.groupBy(*keys).agg(F.sum("_c").alias("_rows"))
    first, live = values, values.join(rows, keys).select(
        *keys, F.lit(0).cast("long").alias("_part"), "_rows", F.lit(0).cast("long").alias("_skip"), "_v", "_c"
    )
    part = [*keys, "_part"]
    probes = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    while (_largest(live, part, most) if first is None else _largest(first, keys, most)) > most:
        first = None
        sketch = live.groupBy(*part).agg(F.array_distinct(F.percentile_approx("_v", probes, 20 * ranges)).alias("_cuts"))
        placed = live.join(sketch, part).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
        totals = placed.groupBy(*part, "_rows", "_skip", "_range").agg(F.sum("_c").alias("_t"))
        before = Window.partitionBy(*part).orderBy("_range").rowsBetween(START, -1)  # <= ranges rows
        totals = totals.withColumn("_start", F.col("_skip") + F.coalesce(F.sum("_t").over(before), F.lit(0)))
        wanted = F.lit(False)
        for p in probabilities:
            for rank in (F.floor(_spot(p)), F.ceil(_spot(p))):
                wanted = wanted | ((rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_t")))
        hit = totals.where(wanted).select(*part, "_range", "_start")
        live = cut(
            placed.join(hit, [*part, "_range"]).select(
                *keys, (F.col("_part") * ranges + F.col("_range")).alias("_part"), "_rows", F.col("_start").alias("_skip"), "_v", "_c"
            )
        )
    return live


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    *,
    ranges: int = RANGES,
    most: int = MOST_SORTED,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """``keys`` plus one column per entry of ``quantiles`` (name -> probability), NULLs ignored."""
    keys = list(keys)
    v = cut(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return value_quantiles(v, keys, quantiles, ranges=ranges, most=most, cut=cut)


def value_quantiles(
    values: DataFrame,
    keys: Sequence[str],
    quantiles: dict[str, float],
    *,
    ranges: int = RANGES,
    most: int = MOST_SORTED,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """``group_quantiles`` of a table that holds each distinct value (_v) of a group once, with its count (_c)."""
    keys = list(keys)
    live = narrow(values, keys, list(quantiles.values()), ranges, most, cut)
    w = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(START, HERE)
    ranked = live.withColumn("_end", F.col("_skip") + F.sum("_c").over(w))
    aggs = []
    for name, p in quantiles.items():
        for tag, rank in (("lo", F.floor(_spot(p))), ("hi", F.ceil(_spot(p)))):
            here = (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{tag}_{name}"))
    found = ranked.groupBy(*keys, "_rows").agg(*aggs)
    out = []
    for name, p in quantiles.items():
        part = _spot(p) - F.floor(_spot(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo * (1 - part) + hi * part).alias(name))
    return found.select(*keys, *out)


def with_quantiles(
    aggregated: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, dict[str, float]],
    **options,
) -> DataFrame:
    """``aggregated`` with quantile columns of several measures of ``df`` (measure -> name -> p).

    All measures share one pass: they are stacked into a long table keyed by measure.
    """
    keys = list(keys)
    cells = F.array(
        *[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in wanted]
    )
    long = df.withColumn("_cell", F.explode(cells)).select(
        *keys, F.col("_cell.m").alias("_measure"), F.col("_cell.v").alias("_x")
    )
    probs = sorted({p for names in wanted.values() for p in names.values()})
    label = {p: f"_q{i}" for i, p in enumerate(probs)}
    q = group_quantiles(long, [*keys, "_measure"], "_x", {label[p]: p for p in probs}, **options)
    picked = [
        F.max(F.when(F.col("_measure") == m, F.col(label[p]))).alias(name)
        for m, names in wanted.items()
        for name, p in names.items()
    ]
    return aggregated.join(q.groupBy(*keys).agg(*picked), keys, "left")
