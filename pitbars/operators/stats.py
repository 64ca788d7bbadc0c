"""Panels, scoped metrics, paired differences, resampling and set fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import COINS, coins, col, draw, id_token, profit_factor, safe_div
from ..session import materialize
from .blocks import running_peak, running_total, time_block, with_row_index
from .outcomes import SEQUENCE_LABELS, STOP_FIRST_LABELS
from .quantiles import group_quantiles, with_quantiles


def opportunity_panel(
    opportunities: DataFrame, models: Sequence[str], outcomes: DataFrame, value: str = "net_r"
) -> DataFrame:
    """Every opportunity under every model; no trade scores 0.0."""
    wide = opportunities.withColumn(
        "model_id", F.explode(F.array(*[F.lit(m) for m in models]))
    )
    scored = outcomes.select("opportunity_id", "model_id", F.col(value).alias("_v"))
    return (
        wide.join(scored, ["opportunity_id", "model_id"], "left")
        .withColumn("traded", F.col("_v").isNotNull())
        .withColumn("net_r", F.coalesce("_v", F.lit(0.0)))
        .drop("_v")
    )


def by_scope(df: DataFrame, scopes: dict[str, str], fixed: Sequence[str] = ()) -> DataFrame:
    """One row per scope a row belongs to: columns ``scope`` and ``value``; overall is ``all``.

    The narrow form of grouping sets: rows are expanded map-side and combined before the
    shuffle, and each scope can have its own denominator afterwards.
    """
    cells = [F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("value"))]
    for scope, column in scopes.items():
        cells.append(
            F.when(
                F.col(column).isNotNull(),
                F.struct(F.lit(scope).alias("scope"), F.col(column).cast("string").alias("value")),
            )
        )
    return df.withColumn("_s", F.explode(F.array_compact(F.array(*cells)))).select(
        "*", F.col("_s.scope").alias("scope"), F.col("_s.value").alias("value")
    ).drop("_s")


def trade_measures(value: str = "net_r", win: str = "win") -> list[Column]:
    v = F.col(value)
    return [
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(F.col(win), 1).otherwise(0)).alias("win_count"),
        F.sum(v).alias("total_net_r"),
        F.avg(v).alias("mean_trade_net_r"),
        F.avg(F.col(win).cast("double")).alias("win_rate"),
        profit_factor(value).alias("profit_factor"),
    ]


def metrics(
    outcomes: DataFrame,
    opportunities: DataFrame,
    *,
    scopes: dict[str, str] | None = None,
    keys: Sequence[str] = ("model_id", "period"),
    medians: Sequence[str] = (),
) -> DataFrame:
    """Scoped trade metrics over the common denominator of all opportunities.

    The denominator is the session's own count only for the session scope, else the period's.
    """
    scopes = scopes or {"session": "session", "direction": "direction"}
    group = [*keys, "scope", "value"]
    rows = by_scope(outcomes, scopes)
    middle = {"net_r": {"median_trade_net_r": 0.5}, **{c: {f"median_{c}": 0.5} for c in medians}}
    core = with_quantiles(rows.groupBy(*group).agg(*trade_measures()), rows, group, middle)
    period = [k for k in keys if k in opportunities.columns]
    denominators = by_scope(
        opportunities, {"session": "session"} if "session" in scopes else {}
    ).groupBy(*period, F.col("scope").alias("_ds"), F.col("value").alias("_dv")).agg(
        F.count(F.lit(1)).alias("opportunity_count")
    )
    own = F.col("scope") == "session"
    out = (
        core.withColumn("_ds", F.when(own, "session").otherwise("overall"))
        .withColumn("_dv", F.when(own, F.col("value")).otherwise("all"))
        .join(denominators, [*period, "_ds", "_dv"], "left")
        .drop("_ds", "_dv")
    )
    n = F.col("opportunity_count")
    return out.withColumn("participation_rate", safe_div(F.col("trade_count"), n)).withColumn(
        "mean_opportunity_net_r", safe_div(F.col("total_net_r"), n)
    )


def max_drawdown(
    trades: DataFrame,
    *,
    keys: Sequence[str] = ("model_id",),
    order: Sequence[str] = ("exit_at", "trade_id"),
    value: str = "net_r",
) -> DataFrame:
    """Largest fall of the running sum from its running peak (origin 0), scanned in time blocks."""
    block = time_block(order[0])
    slim = trades.select(*keys, *order, F.col(value).alias("_v"))
    run = running_total(slim, keys, order, block, "_v", "_equity")
    run = running_peak(run, keys, order, block, "_equity", "_peak")
    return run.groupBy(*keys).agg(
        F.max(F.col("_peak") - F.col("_equity")).alias("maximum_drawdown_r")
    )


def calendar_counts(
    events: DataFrame,
    *,
    keys: Sequence[str],
    ts: str = "event_at",
    years: Sequence[int] | None = None,
    unit: str = "year",
) -> DataFrame:
    """Events per key and year (or month), with zero rows for calendar cells without events.

    The cells are those of ``years``, or of all years from the first to the last event. Events of other years keep
    their own cells: no event is left out.
    """
    fmt = "yyyy" if unit == "year" else "yyyy-MM"
    dated = events.where(F.col(ts).isNotNull())
    counted = dated.groupBy(*keys, F.date_format(ts, fmt).alias(unit)).agg(F.count(F.lit(1)).alias("_n"))
    if years is None:
        first, last = dated.agg(F.min(F.year(ts)), F.max(F.year(ts))).first()
        years = range(first, last + 1) if first is not None else ()
    cells = [str(y) if unit == "year" else f"{y}-{m:02d}" for y in years for m in ([0] if unit == "year" else range(1, 13))]
    grid = events.select(*keys).distinct().withColumn(
        unit, F.explode(F.array(*[F.lit(c) for c in cells]).cast("array<string>"))
    )
    return (
        grid.join(counted, [*keys, unit], "full")
        .withColumn("event_count", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def monthly_summary(trades: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    return trades.groupBy(*keys, F.substring("session_date", 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.avg(F.col("win").cast("double")).alias("win_rate"),
        F.sum("net_r").alias("total_net_r"),
        F.avg("net_r").alias("mean_trade_net_r"),
    )


def best_month_share(monthly: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Best positive month over the sum of positive months; NULL without a positive month."""
    gain = F.when(F.col("total_net_r") > 0, F.col("total_net_r"))
    return monthly.groupBy(*keys).agg(
        safe_div(F.max(gain), F.sum(gain)).alias("best_month_share")
    )


def exit_summary(trades: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("net_r").alias("total_net_r"),
        F.avg("net_r").alias("mean_trade_net_r"),
    )


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long table of count, median, p05 and p95 per column, ignoring NULL."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    long = df.withColumn("_c", F.explode(cells)).select(
        *keys, F.col("_c.measure").alias("measure"), F.col("_c.v").alias("_x")
    )
    group = [*keys, "measure"]
    counts = long.groupBy(*group).agg(F.count("_x").alias("count"))
    q = group_quantiles(long, group, "_x", {"median": 0.5, "p05": 0.05, "p95": 0.95})
    return counts.join(q, group, "left")


def stop_distance_summary(mappings: DataFrame) -> DataFrame:
    scoped = by_scope(mappings, {"session": "session", "event_type": "event_type"})
    core = scoped.groupBy("scope", "value").agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.max("structural_stop_atr").alias("stop_atr_max"),
        F.min("theoretical_lots_at_fixed_risk").alias("theoretical_lots_minimum"),
    )
    distance = {"stop_atr_q25": 0.25, "stop_atr_median": 0.5, "stop_atr_q75": 0.75, "stop_atr_q90": 0.9}
    return with_quantiles(
        core, scoped, ["scope", "value"],
        {
            "structural_stop_atr": distance,
            "theoretical_lots_at_fixed_risk": {"theoretical_lots_median": 0.5},
        },
    )


def excursion_summary(
    excursions: DataFrame,
    *,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9),
    stops: Sequence[float] = (1.0, 1.25, 1.5, 2.0),
    targets: Sequence[float] = (1.0, 2.0, 3.0),
    keys: Sequence[str] = ("period",),
) -> DataFrame:
    mae, mfe = "max_adverse_excursion_atr", "max_favorable_excursion_atr"
    scoped = by_scope(excursions, {"session": "session", "direction": "direction"})
    aggs = [F.count(F.lit(1)).alias("signal_count")]
    rate = lambda c, k: F.avg((F.col(c) >= k).cast("double"))
    aggs += [rate(mae, k).alias(f"mae_ge_{str(k).replace('.', '_')}_atr_rate") for k in stops]
    aggs += [rate(mfe, k).alias(f"mfe_ge_{str(k).replace('.', '_')}_atr_rate") for k in targets]
    group = [*keys, "scope", "value"]
    named = lambda tag: {f"{tag}_atr_q{round(p * 100):02d}": p for p in quantiles}
    return with_quantiles(
        scoped.groupBy(*group).agg(*aggs), scoped, group, {mae: named("mae"), mfe: named("mfe")}
    )


def sequence_summary(paths: DataFrame, keys: Sequence[str] = ("period",)) -> DataFrame:
    scoped = by_scope(paths, {"session": "session", "direction": "direction"})
    hit = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    s = F.col("sequence")
    aggs = [
        F.count(F.lit(1)).alias("signal_count"),
        hit(s.isin(*STOP_FIRST_LABELS)).alias("stop_first_count"),
        hit(s == "stop_then_target_later").alias("strict_premature_stop_count"),
        hit(F.col("saved_original_premature")).alias("saved_original_premature_count"),
    ]
    for label in SEQUENCE_LABELS:
        aggs += [hit(s == label).alias(f"{label}_count"), F.avg((s == label).cast("double")).alias(f"{label}_rate")]
    out = scoped.groupBy(*keys, "scope", "value", "stop_atr", "target_mode", "target_atr").agg(*aggs)
    return out.withColumn(
        "strict_premature_stop_rate",
        safe_div(F.col("strict_premature_stop_count"), F.col("stop_first_count")),
    )


def _samples(df: DataFrame) -> DataFrame:
    """Each row once per sample it belongs to: all events, and the primary ones."""
    names = F.array_compact(F.array(F.lit("all_events"), F.when(F.col("is_primary"), "primary")))
    return df.withColumn("sample", F.explode(names))


def outcome_summary(
    outcomes: DataFrame, event_key: Sequence[str] = ("symbol", "event_id")
) -> DataFrame:
    """Coverage, signed returns and excursions per sample, scope, primitive, rule and horizon."""
    scopes = {
        "session": "session", "direction": "event_direction", "event_type": "primitive",
        "context_alignment": "context_alignment", "displacement_strength": "displacement_strength",
    }
    scoped = by_scope(_samples(outcomes), scopes)
    emitted = F.col("emitted_prediction") & F.col("signed_forward_return_atr").isNotNull()
    r = F.when(emitted, F.col("signed_forward_return_atr"))
    group = ["sample", "scope", "value", "primitive", "rule", "horizon_minutes"]
    core = scoped.groupBy(*group).agg(
        F.count_distinct(*event_key).alias("event_count"),
        F.sum(F.when(emitted, 1).otherwise(0)).alias("prediction_count"),
        F.avg(emitted.cast("double")).alias("prediction_coverage"),
        F.avg(r).alias("mean_signed_return_atr"),
        F.avg(F.when(emitted, (r > 0).cast("double"))).alias("positive_return_rate"),
        F.avg(F.when(emitted, F.col("mfe_atr"))).alias("mean_mfe_atr"),
        F.avg(F.when(emitted, F.col("mae_atr"))).alias("mean_mae_atr"),
    )
    middle = {"signed_forward_return_atr": {"median_signed_return_atr": 0.5}}
    return with_quantiles(core, scoped.where(emitted), group, middle)


def barrier_summary(barriers: DataFrame) -> DataFrame:
    n = lambda label: F.sum(F.when(F.col("barrier_sequence") == label, 1).otherwise(0))
    out = _samples(barriers).groupBy("sample", "primitive", "rule").agg(
        F.count(F.lit(1)).alias("event_count"),
        n("favorable_first").alias("favorable_first_count"),
        n("adverse_first").alias("adverse_first_count"),
        n("same_bar_ambiguous").alias("same_bar_ambiguous_count"),
        n("neither").alias("neither_count"),
    )
    resolved = F.col("favorable_first_count") + F.col("adverse_first_count")
    return out.withColumn("resolved_count", resolved).withColumn(
        "favorable_first_rate_resolved", safe_div(F.col("favorable_first_count"), resolved)
    )


def paired_difference(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "net_r"
) -> DataFrame:
    """Full outer pairing with membership and difference b - a. Keys must be unique per side."""
    left = a.select(*keys, F.col(value).alias(f"{value}_baseline"), F.lit(True).alias("_l"))
    right = b.select(*keys, F.col(value).alias(f"{value}_candidate"), F.lit(True).alias("_r"))
    side = (
        F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "baseline_only").otherwise("candidate_only")
    )
    return (
        left.join(right, list(keys), "full_outer")
        .withColumn("membership", side)
        .withColumn(f"{value}_difference", F.col(f"{value}_candidate") - F.col(f"{value}_baseline"))
        .drop("_l", "_r")
    )


def paired_baselines(
    outcomes: DataFrame,
    *,
    horizon: int = 60,
    baselines: Sequence[str] = ("session_momentum", "session_mean_reversion", "four_bar_close_breakout"),
    event_key: Sequence[str] = ("symbol", "event_id"),
) -> DataFrame:
    """Mean increment of the event direction over each baseline on events where both predict."""
    primary = outcomes.where(F.col("is_primary") & (F.col("horizon_minutes") == horizon))
    at = lambda rule: F.max(F.when(F.col("rule") == rule, F.col("signed_forward_return_atr")))
    wide = primary.groupBy("primitive", *event_key).agg(
        at("event_direction").alias("_event"), *[at(b).alias(b) for b in baselines]
    )
    long = wide.select(
        "primitive", "_event",
        F.explode(F.array(*[F.struct(F.lit(b).alias("baseline"), F.col(b).alias("v")) for b in baselines])).alias("_b"),
    ).where("_event is not null and _b.v is not null")
    return long.groupBy("primitive", F.col("_b.baseline").alias("baseline")).agg(
        F.count(F.lit(1)).alias("paired_count"),
        F.avg("_event").alias("event_mean_atr"),
        F.avg("_b.v").alias("baseline_mean_atr"),
        F.avg(F.col("_event") - F.col("_b.v")).alias("mean_paired_increment_atr"),
    )


def _numbered(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with position ``_i`` and group size ``_k``, numbered in hash-range blocks of ``order``."""
    src = df.withColumn("_tok", id_token(order))
    block = F.shiftright("_tok", 50)
    out = with_row_index(src, keys, ["_tok", order], block, "_i")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    return out.join(sizes, list(keys)).drop("_tok")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cluster_bootstrap(
    df: DataFrame,
    *,
    cluster: str,
    value: str,
    keys: Sequence[str] = ("model_id",),
    resamples: int = 10_000,
    level: float = 0.95,
    seed: int = 20260901,
    block: int = 65_536,
    cut: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Percentile interval of the mean, resampling clusters with replacement.

    Clusters are pre-aggregated to (sum, count) and numbered by the hash of their label. Draw ``slot`` of resample ``rep``
    is a pure function of (seed, rep, slot), so a re-run or a lost task yields the same intervals. Blocks of at most
    ``block`` clusters are arrays; each meets ranges of resamples, whose draws are made, looked up and summed inside the
    task. Shuffled are the arrays, once a range, and one row a block and resample, never a cluster of a resample.
    """
    keys = list(keys)
    daily = cut(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, cluster)
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_cnt"))
    )
    numbered = cut(_numbered(daily, keys, cluster).select(*keys, "_i", "_k", "_sum", "_cnt"))
    tasks = _tasks(df)
    per = -(-resamples // tasks)
    packed = numbered.groupBy(*keys, "_k", F.floor(F.col("_i") / block).cast("long").alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_i", "_sum", "_cnt"))).alias("_items")
    )
    asked = packed.withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // per) - 1)))).repartition(
        tasks, *keys, "_block", "_range"
    )
    first = (F.col("_range") * per).cast("long")
    offset = F.col("_block") * block

    def drawn(rep: Column) -> Column:
        slots = F.sequence(F.lit(0).cast("long"), F.col("_k").cast("long") - 1)
        places = F.transform(slots, lambda slot: draw(seed, rep, slot) % F.col("_k") - offset)
        return F.filter(places, lambda i: (i >= 0) & (i < block))

    def folded(rep: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, i: F.struct(
            (acc["s"] + F.get("_items", i.cast("int"))["_sum"]).alias("s"),
            (acc["n"] + F.get("_items", i.cast("int"))["_cnt"]).alias("n"),
        )
        return F.struct(rep.alias("rep"), F.aggregate(drawn(rep), zero, add).alias("t"))

    reps = F.sequence(first, F.least(first + per, F.lit(resamples).cast("long")) - 1)
    sums = asked.select(*keys, F.inline(F.transform(reps, folded)))
    est = sums.groupBy(*keys, "rep").agg((F.sum("t.s") / F.sum("t.n")).alias("_est"))
    alpha = 1 - level
    ci = est.groupBy(*keys).agg(
        F.percentile("_est", alpha / 2).alias("ci_lower"),
        F.percentile("_est", 1 - alpha / 2).alias("ci_upper"),
    )
    point = numbered.groupBy(*keys).agg(
        (F.sum("_sum") / F.sum("_cnt")).alias("estimate"),
        F.sum("_cnt").alias("row_count"),
        F.count(F.lit(1)).alias("cluster_count"),
    )
    return point.join(ci, keys).withColumn("resamples", F.lit(resamples))


def random_sign_null(
    df: DataFrame,
    *,
    value: str,
    row_id: str | Column,
    keys: Sequence[str] = ("primitive",),
    resamples: int = 10_000,
    seed: int = 20260901,
) -> DataFrame:
    """Distribution of the mean under random signs: its mean, 2.5 % and 97.5 % points.

    One digest of a row holds the signs of ``COINS`` resamples, so a row is met once for that many of them; each task adds
    vectors of sums, and only these are shuffled. Rows are dealt evenly over the tasks first, whatever their keys.
    """
    keys = list(keys)
    clean = df.where(F.col(value).isNotNull()).select(
        *keys, id_token(row_id).alias("_tok"), F.col(value).cast("double").alias("_v")
    )
    groups = -(-resamples // COINS)
    bits = (
        clean.repartition(_tasks(df))
        .withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        .withColumn("_bits", coins(seed, F.col("_g"), F.col("_tok")))
    )
    heads = [
        F.sum(F.when(F.call_function("getbit", F.col("_bits"), F.lit(k)) == 1, F.col("_v")).otherwise(0.0)) for k in range(COINS)
    ]
    sums = bits.groupBy(*keys, "_g").agg(
        F.sum("_v").alias("_all"), F.count(F.lit(1)).alias("_n"), F.array(*heads).alias("_heads")
    )
    each = sums.select(*keys, "_g", "_all", "_n", F.posexplode("_heads").alias("_k", "_head"))
    est = each.where(F.col("_g") * COINS + F.col("_k") < resamples).withColumn(
        "_est", (2 * F.col("_head") - F.col("_all")) / F.col("_n")
    )
    out = est.groupBy(*keys).agg(
        F.avg("_est").alias("null_mean"),
        F.percentile("_est", 0.025).alias("null_p025"),
        F.percentile("_est", 0.975).alias("null_p975"),
    )
    sizes = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))
    return sizes.join(out, keys).withColumn("resamples", F.lit(resamples))


def set_fingerprint(df: DataFrame, column: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Order-free identity of a set of ids: count and sum of 60-bit md5 tokens (mod 2^61-1)."""
    modulus = (1 << 61) - 1
    token = id_token(col(column))
    # decimal sums: no overflow at any number of rows
    total = lambda part: (F.sum(part.cast("decimal(20,0)")).cast("decimal(38,0)") % F.lit(modulus)).cast("long")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("member_count"),
        total(F.shiftright(token, 30)).alias("token_high"),
        total(F.pmod(token, F.lit(1 << 30))).alias("token_low"),
    )

