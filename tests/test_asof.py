import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitbars.operators.asof import asof, asof_pair, first_bar_after, range_join

from .helpers import bars_frame, quote_bars, rows, ts


def tables(spark, seed):
    rng = random.Random(seed)
    left = [(rng.choice("AB"), rng.randint(0, 400), i) for i in range(120)]
    right = [(rng.choice("AB"), rng.randint(50, 300), i, f"v{i}") for i in range(60)]
    return (
        spark.createDataFrame(left, "symbol string, t long, id long"),
        spark.createDataFrame(right, "symbol string, r long, k long, v string"),
    )


def brute(left, right, direction, equal):
    out = []
    for x in left.collect():
        cand = [y for y in right.collect() if y.symbol == x.symbol]
        if direction == "backward":
            cand = [y for y in cand if y.r < x.t or (equal and y.r == x.t)]
            best = max(cand, key=lambda y: (y.r, y.k), default=None)
        else:
            cand = [y for y in cand if y.r > x.t or (equal and y.r == x.t)]
            best = min(cand, key=lambda y: (y.r, y.k), default=None)
        out.append((x.id, best.v if best else "none"))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_asof_matches_brute_force_for_any_block(spark, direction, equal, block):
    left, right = tables(spark, 5)
    got = asof(
        left, right, left_on="t", right_on="r", by=["symbol"], cols=["v"], ties=("k",),
        direction=direction, allow_equal=equal, block=block,
    )
    assert rows(got.fillna("none"), "id", "v") == brute(left, right, direction, equal)


def test_asof_is_inclusive_at_the_decision_time(spark):
    left = spark.createDataFrame([("X", ts("2024-01-02T10:00"))], "symbol string, t timestamp")
    right = spark.createDataFrame(
        [("X", ts("2024-01-02T10:00"), "now"), ("X", ts("2024-01-02T10:01"), "later")],
        "symbol string, available_at timestamp, v string",
    )
    assert asof(left, right, left_on="t", right_on="available_at", by=["symbol"], cols=["v"]).first().v == "now"


def test_range_join_emits_each_match_once(spark):
    left = spark.createDataFrame(
        [("X", i, ts("2024-01-01T20:00"), ts(f"2024-01-0{2 + i}T04:00")) for i in range(3)],
        "symbol string, id long, s timestamp, e timestamp",
    )
    bars = quote_bars(spark, [(1, 1, 1, 1)] * 72, minutes=60, start="2024-01-01T00:00")
    got = range_join(left, bars.select("symbol", "timestamp"), by=["symbol"], start="s", end="e")
    counts = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    assert counts == {0: 8, 1: 32, 2: 52}
    assert got.count() == got.distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_bar_after_respects_the_cutoff(spark):
    bars = quote_bars(spark, [(1, 1, 1, 1), None, (2, 2, 2, 2)])
    left = spark.createDataFrame(
        [("X", "a", ts("2024-01-02T08:01"), ts("2024-01-02T08:30")), ("X", "b", ts("2024-01-02T08:01"), ts("2024-01-02T08:10"))],
        "symbol string, id string, t timestamp, cut timestamp",
    )
    out = {r.id: r.px for r in first_bar_after(left, bars, on="t", before="cut", cols={"bid_open": "px"}).collect()}
    assert out == {"a": 2.0, "b": None}


def test_pair_direction_compares_the_last_two_completed_bars(spark):
    bars = bars_frame(spark, [(1, 1, 1, 1), (1, 2, 1, 2), (2, 2, 1, 1)])
    left = spark.createDataFrame(
        [("X", ts(f"2024-01-02T0{h}:00")) for h in range(5)], "symbol string, t timestamp"
    )
    got = [r.pair_direction for r in asof_pair(left, bars, on="t").orderBy("t").collect()]
    assert got == [None, None, "long", "short", "short"]


def test_pandas_merge_asof_agrees(spark):
    left, right = tables(spark, 11)
    got = asof(left, right, left_on="t", right_on="r", by=["symbol"], cols=["v"], ties=("k",), block=7)
    a = left.toPandas().sort_values("t")
    b = right.toPandas().sort_values(["r", "k"])
    want = pd.merge_asof(a, b, left_on="t", right_on="r", by="symbol")[["id", "v"]].fillna("none")
    assert rows(got.fillna("none").withColumn("id", F.col("id")), "id", "v") == sorted(map(tuple, want.values.tolist()))
