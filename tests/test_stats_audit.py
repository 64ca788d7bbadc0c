import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitbars.functions.columns import coin, draw, hash_direction, id_token
from pitbars.operators import audit, signals, stats
from pitbars.operators.quantiles import group_quantiles, narrow

from .helpers import quote_bars, rows, shuffled, ts


def test_quantiles_are_exact_with_ties_and_one_dominant_value(spark):
    rng = random.Random(1)
    values = [("a", rng.gauss(0, 1)) for _ in range(500)] + [("a", 0.25)] * 400 + [("b", 3.0)] + [("c", None)]
    df = spark.createDataFrame(values, "k string, v double")
    probs = {"q0": 0.0, "q05": 0.05, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r.k: r for r in group_quantiles(shuffled(df), ["k"], "v", probs, ranges=8).collect()}
    a = np.array([v for k, v in values if k == "a"])
    for name, p in probs.items():
        assert got["a"][name] == pytest.approx(np.quantile(a, p), abs=1e-12)
        assert got["b"][name] == 3.0
    assert "c" not in got


def test_quantiles_sort_no_more_than_the_bound_in_one_task(spark):
    rng = random.Random(2)
    values = [("a", rng.gauss(0, 1)) for _ in range(6000)] + [("a", 0.5)] * 3000 + [("b", float(k)) for k in range(300)]
    df = spark.createDataFrame(values, "k string, v double").repartition(4)
    probs = {"q0": 0.0, "q05": 0.05, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    seen = []

    def cut(d):
        seen.append(d)
        return d

    got = {r.k: r for r in group_quantiles(df, ["k"], "v", probs, ranges=8, most=40, cut=cut).collect()}
    for key in "ab":
        x = np.array([v for k, v in values if k == key])
        assert all(got[key][n] == pytest.approx(np.quantile(x, p), abs=1e-12) for n, p in probs.items())
    v = df.groupBy("k", F.col("v").alias("_v")).agg(F.count("*").alias("_c"))
    parts = narrow(v, ["k"], list(probs.values()), ranges=8, most=40).groupBy("k", "_part").count().collect()
    assert max(r["count"] for r in parts) <= 40 and len(seen) > 2  # the values, and several rounds


def trades(spark, values):
    data = [("m", "p", "london", "long", f"o{i}", f"2024-01-{i + 1:02d}", ts(f"2024-01-{i + 1:02d}T10:00"), f"t{i}", float(v), v > 0) for i, v in enumerate(values)]
    return spark.createDataFrame(
        data,
        "model_id string, period string, session string, direction string, opportunity_id string, session_date string,"
        "exit_at timestamp, trade_id string, net_r double, win boolean",
    )


def test_drawdown_starts_from_zero_and_crosses_blocks(spark):
    assert stats.max_drawdown(trades(spark, [-1, -1, 3, -2, 1])).first().maximum_drawdown_r == 2.0
    values = [random.Random(i).uniform(-1, 1) for i in range(28)]
    eq = np.concatenate([[0], np.cumsum(values)])
    want = (np.maximum.accumulate(eq) - eq).max()
    assert stats.max_drawdown(trades(spark, values)).first().maximum_drawdown_r == pytest.approx(want)


def test_metrics_score_all_opportunities(spark):
    t = trades(spark, [2, -1, -1])
    opp = spark.createDataFrame(
        [(f"o{i}", "p", "london" if i < 4 else "new_york") for i in range(6)], "opportunity_id string, period string, session string"
    )
    got = {(r.scope, r.value): r for r in stats.metrics(t, opp).collect()}
    assert got["overall", "all"].opportunity_count == 6 and got["session", "london"].opportunity_count == 4
    assert got["direction", "long"].opportunity_count == 6
    assert got["overall", "all"].profit_factor == 1.0 and got["overall", "all"].median_trade_net_r == -1.0
    panel = stats.opportunity_panel(opp, ["m", "idle"], t)
    assert panel.count() == 12 and panel.where("model_id = 'idle' and net_r = 0 and not traded").count() == 6


def test_profit_factor_without_a_loss_is_null(spark):
    opp = spark.createDataFrame([("o0", "p", "london")], "opportunity_id string, period string, session string")
    assert stats.metrics(trades(spark, [1]), opp).where("scope = 'overall'").first().profit_factor is None


def test_bootstrap_of_a_constant_collapses_and_repeats(spark):
    r = stats.cluster_bootstrap(trades(spark, [0.5] * 9), cluster="session_date", value="net_r", resamples=150).first()
    assert r.ci_lower == r.ci_upper == r.estimate == 0.5 and r.cluster_count == 9
    noisy = trades(spark, [1, -1, 2, 0, 3, -2])
    one = rows(stats.cluster_bootstrap(noisy, cluster="session_date", value="net_r", resamples=120), "ci_lower", "ci_upper")
    two = rows(stats.cluster_bootstrap(shuffled(noisy), cluster="session_date", value="net_r", resamples=120), "ci_lower", "ci_upper")
    assert one == two and one[0][0] < 0.5 < one[0][1]


def test_sign_null_is_centred(spark):
    df = spark.createDataFrame([("p", f"e{i}", 1.0) for i in range(40)], "primitive string, event_id string, v double")
    r = stats.random_sign_null(df, value="v", row_id="event_id", resamples=400).first()
    assert abs(r.null_mean) < 0.05 and r.null_p025 < 0 < r.null_p975


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(f"id{i}",) for i in range(50)], "id string")
    a = stats.set_fingerprint(df, "id").first()
    assert a == stats.set_fingerprint(shuffled(df), "id").first()
    assert a != stats.set_fingerprint(df.where("id <> 'id7'"), "id").first()


def test_hash_coin_is_the_low_bit_of_the_first_digest_byte(spark):
    import hashlib

    ids = [f"event:{i}" for i in range(30)]
    got = dict(rows(spark.createDataFrame([(i,) for i in ids], "id string").select("id", hash_direction("id", 5).alias("d")), "id", "d"))
    assert got == {i: "long" if hashlib.sha256(f"5:{i}".encode()).digest()[0] & 1 else "short" for i in ids}


def test_unknown_filter_rule_is_an_error(spark):
    with pytest.raises(ValueError, match="Unknown filter rule"):
        signals.rule_filter(spark.range(1), ["nope"])


def test_first_per_group_uses_the_whole_order(spark):
    df = spark.createDataFrame([("g", 2, "a", 1), ("g", 1, "b", 2), ("g", 1, "a", 3)], "g string, t int, id string, x int")
    assert rows(signals.first_per_group(shuffled(df), ["g"], ["t", "id"]), "x") == [(3,)]


def test_fit_direction_ties_go_long(spark):
    df = spark.createDataFrame([("s", "long", 1.0), ("s", "short", 1.0)], "session string, direction string, net_r double")
    assert signals.fit_direction(df, fit_period=None).where("selected").first().direction == "long"


def test_fit_knows_nothing_of_other_periods(spark):
    data = [("s", "long", 1.0, "construction"), ("s", "short", 0.5, "construction"), ("s", "long", -9.0, "replication"), ("s", "short", 9.0, None)]
    df = spark.createDataFrame(data, "session string, direction string, net_r double, period string")
    fitted = signals.fit_direction(df)
    assert fitted.where("selected").first().direction == "long"
    made = signals.fitted_signals(df, fitted)
    assert sorted(rows(made, "direction", "period", "model_id")) == [("long", "construction", "fitted"), ("long", "replication", "fitted")]


def test_draws_of_resamples_are_unrelated(spark):
    n = 200_000
    slots = spark.range(n).select(*[(draw(20260901, F.lit(r), F.col("id")) % n).alias(f"r{r}") for r in (0, 1, 4295)]).toPandas()
    picks = [np.bincount(slots[c], minlength=n) for c in slots]
    assert np.abs(np.corrcoef(picks) - np.eye(3)).max() < 0.01
    assert abs(picks[0].var() - 1) < 0.02


def test_coins_are_fair_and_unrelated(spark):
    reps = (0, 1, 59, 60, 4295)
    coins = spark.range(100_000).select(*[coin(7, F.lit(r), F.col("id")).alias(f"r{r}") for r in reps]).toPandas()
    assert (np.abs(coins.mean() - 0.5) < 0.01).all()
    assert np.abs(np.corrcoef(coins.T) - np.eye(len(reps))).max() < 0.02


def test_calendar_counts_keep_every_year(spark):
    df = spark.createDataFrame([("a", ts("2023-05-01")), ("a", ts("2026-01-05")), ("b", ts("2026-01-06"))], "k string, event_at timestamp")
    want = [("a", "2023", 1), ("a", "2024", 0), ("a", "2025", 0), ("a", "2026", 1)] + [("b", y, 0) for y in ("2023", "2024", "2025")] + [("b", "2026", 1)]
    assert sorted(rows(stats.calendar_counts(df, keys=["k"]), "k", "year", "event_count")) == want
    some = stats.calendar_counts(df, keys=["k"], years=[2026])
    assert sorted(rows(some, "k", "year", "event_count")) == [("a", "2023", 1), ("a", "2026", 1), ("b", "2026", 1)]
    assert stats.calendar_counts(df.limit(0), keys=["k"]).count() == 0


def with_counts(df):
    return df.withColumn("tick_count", F.lit(1))


def test_reconcile_counts_differences_and_unmatched_bars(spark):
    fine = with_counts(quote_bars(spark, [(1, 2, 0.5, 1.5)] * 10, minutes=1))
    coarse = with_counts(quote_bars(spark, [(1, 2, 0.5, 1.5)] * 2)).withColumn("tick_count", F.lit(5))
    assert audit.reconcile(fine, coarse).first().valid
    moved = coarse.withColumn("mid_high", F.col("mid_high") + 0.1)
    r = audit.reconcile(fine, moved.where("bar_idx = 0")).first()
    assert (r.membership_failure_count, r.mid_high_mismatch_count, r.mid_low_mismatch_count) == (1, 2, 1)


def test_check_bars_flags_order_and_duplicates(spark):
    bars = quote_bars(spark, [(1, 2, 0.5, 1.5), (1, 0.9, 0.5, 1.5)])
    r = audit.check_bars(bars.unionByName(bars.where("bar_idx = 0"))).first()
    assert (r.bid_violation_count, r.duplicate_timestamp_count, r.valid) == (1, 1, False)


def test_jaccard_of_empty_sets_is_one_and_iou_clips(spark):
    empty = spark.createDataFrame([], "id string")
    assert audit.jaccard(empty, empty, ["id"]).first().jaccard_agreement == 1.0
    box = lambda lo, hi: spark.createDataFrame([("z", lo, hi)], "event_id string, lower_bound double, upper_bound double")
    assert audit.interval_iou(box(0.0, 2.0), box(1.0, 4.0)).first().iou == 0.25
    assert audit.interval_iou(box(0.0, 1.0), box(2.0, 4.0)).first().iou == 0.0


def test_audit_keeps_passing_rules_and_finds_forbidden_columns(spark):
    df = spark.createDataFrame([(1, 2), (3, 1)], "a int, net_r int")
    got = dict(
        rows(
            audit.constraint_audit(
                audit.row_rules(df, [("a_below", F.col("a") >= F.col("net_r")), ("positive", F.col("a") <= 0)]),
                audit.schema_rule(df, "no_outcomes", ["net_r"]),
                audit.unique_rule(df, "unique_a", ["a"]),
            ),
            "invariant", "failure_count",
        )
    )
    assert got == {"a_below": 1, "positive": 0, "no_outcomes": 1, "unique_a": 0}


def test_gate_never_passes_on_null(spark):
    df = spark.createDataFrame([("m", None, 5)], "model_id string, pf double, n int")
    g = audit.gate_table(df, {"pf": (">", 1.0), "n": (">=", 5)}, ["model_id"])
    assert dict(rows(g, "gate", "passed")) == {"pf": False, "n": True}
    assert audit.gate_verdict(g, ["model_id"]).first().failed_count == 1


def test_bootstrap_blocks_and_shuffled_rows(spark):
    rng = random.Random(5)
    data = [(m, f"d{k % n}", rng.gauss(0, 1)) for m, n in (("a", 50), ("b", 7)) for k in range(3 * n)]
    df = spark.createDataFrame(data, "model_id string, day string, r double")
    run = lambda **k: {
        r.model_id: r for r in stats.cluster_bootstrap(df, cluster="day", value="r", resamples=300, **k).collect()
    }
    whole, cut = run(), run(block=4)
    for m in "ab":
        assert whole[m].cluster_count == cut[m].cluster_count == {"a": 50, "b": 7}[m]
        assert whole[m].ci_lower == pytest.approx(cut[m].ci_lower) and whole[m].ci_upper == pytest.approx(cut[m].ci_upper)
        assert whole[m].ci_lower < whole[m].estimate < whole[m].ci_upper
    plan = stats.cluster_bootstrap(df, cluster="day", value="r", resamples=300)._jdf.queryExecution().optimizedPlan().toString()
    # resamples meet no join: the only one brings point and interval together
    assert plan.count("Join") == 1


def test_sign_null_shuffles_vectors_only(spark):
    rng = random.Random(6)
    data = [("p", f"e{k}", rng.gauss(0.1, 1)) for k in range(150)] + [("q", "one", 2.0), ("q", "none", None)]
    df = spark.createDataFrame(data, "primitive string, event_id string, v double")
    got = {r.primitive: r for r in stats.random_sign_null(df, value="v", row_id="event_id", resamples=130).collect()}
    tokens = df.where("v is not null").select(
        "primitive", "v", *[coin(20260901, F.lit(r), id_token("event_id")).alias(f"c{r}") for r in range(130)]
    ).toPandas()
    for p, n in (("p", 150), ("q", 1)):
        t = tokens[tokens.primitive == p]
        means = [float(np.where(t[f"c{r}"] == 1, t.v, -t.v).mean()) for r in range(130)]
        assert got[p].event_count == n and got[p].null_mean == pytest.approx(np.mean(means))
        assert got[p].null_p025 == pytest.approx(np.quantile(means, 0.025)) and got[p].null_p975 == pytest.approx(np.quantile(means, 0.975))
