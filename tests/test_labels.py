import random

import pytest
from pyspark.sql import functions as F

from pitbars.operators import labels as L
from pitbars.operators import order_blocks as ob
from pitbars.operators.levels import cluster_levels
from pitbars.session import materialize

from .helpers import bars_frame, random_bars, rows


def test_swing_confirms_after_its_right_bars_and_rightmost_plateau_wins(spark):
    b = bars_frame(spark, [(1, 1, 1, 1), (1, 2, 1, 1), (1, 5, 1, 1), (1, 5, 1, 1), (1, 2, 1, 1), (1, 1, 1, 1)])
    got = L.label_swings(b, pip_size=1.0).where("event_type = 'swing_high'").collect()
    assert [(r.pivot_index, r.confirmation_index, r.plateau_size, r.resolved_plateau) for r in got] == [(3, 5, 2, True)]
    assert got[0].available_at == b.where("bar_idx = 5").first().available_at
    assert got[0].extreme_margin_pips == 0.0 and got[0].structural_relationship == "H0"


def test_swing_needs_every_bar_of_its_window_eligible(spark):
    b = bars_frame(spark, [(1, 1, 1, 1), (1, 2, 1, 1, False), (1, 5, 1, 1), (1, 2, 1, 1), (1, 1, 1, 1)])
    assert L.label_swings(b, pip_size=1.0).count() == 0


def test_equal_highs_within_tolerance(spark):
    peak = lambda p: [(1, 1, 1, 1), (1, 1, 1, 1), (1, p, 1, 1), (1, 1, 1, 1), (1, 1, 1, 1)]
    b = bars_frame(spark, [*peak(5), *peak(5.5), *peak(9), *peak(4)])
    got = L.label_swings(b, pip_size=1.0, tolerance_pips=1.0).where("event_type = 'swing_high' and price > 1")
    assert [r.structural_relationship for r in got.orderBy("pivot_index").collect()] == ["H0", "EQH", "HH", "LH"]


def test_gap_life_partial_then_full_and_ineligible_bars_only_age(spark):
    b = bars_frame(
        spark,
        [(1, 2, 1, 2), (2, 5, 2, 5), (5, 6, 4, 6), (6, 6, 4, 6), (6, 6, 1, 5, False), (6, 6, 3, 5), (5, 5, 2, 3)],
    )
    r = L.label_gaps(b).where("direction = 'up' and bar_idx = 2").first()
    at = {x.bar_idx: x.available_at for x in b.collect()}
    assert (r.lower_bound, r.upper_bound) == (2.0, 4.0)
    assert (r.partial_fill_at, r.full_fill_at, r.fill_delay_bars, r.status) == (at[5], at[6], 4, "filled")
    short = L.label_gaps(b, max_age=3).where("direction = 'up' and bar_idx = 2").first()
    assert (short.partial_fill_at, short.full_fill_at, short.status) == (at[5], None, "expired")


def test_gap_needs_contiguous_bars(spark):
    b = bars_frame(spark, [(1, 2, 1, 2), (2, 5, 2, 5), (5, 6, 4, 6)])
    moved = b.withColumn(
        "timestamp", F.when(F.col("bar_idx") == 2, F.col("timestamp") + F.expr("interval 1 hour")).otherwise(F.col("timestamp"))
    )
    assert L.label_gaps(b).count() == 1 and L.label_gaps(moved).count() == 0


def sweep_swing(spark, rows_):
    return spark.createDataFrame(
        rows_, "symbol string, timeframe string, event_id string, event_type string, price double, available_at timestamp, pivot_index long"
    )


def test_sweep_consumes_on_first_excursion_and_drops_two_sided_bars(spark):
    b = bars_frame(spark, [(9, 11, 8, 11), (9, 11, 8, 9), (9, 9.5, 8, 9)])
    t0 = b.first().timestamp
    high = sweep_swing(spark, [("X", "1H", "h", "swing_high", 10.0, t0, 0)])
    assert L.label_sweeps(b, high).count() == 0  # the first excursion closed outside
    b2 = bars_frame(spark, [(9, 9.5, 8, 9), (9, 11, 8, 9.5)])
    assert [r.direction for r in L.label_sweeps(b2, high).collect()] == ["short"]
    both = sweep_swing(
        spark, [("X", "1H", "h", "swing_high", 10.0, t0, 0), ("X", "1H", "l", "swing_low", 8.5, t0, 0)]
    )
    wide = bars_frame(spark, [(9, 11, 8, 9)])
    assert L.label_sweeps(wide, both).count() == 0
    stats = L.sweep_stats(wide, both).first()
    assert (stats.high_excursions, stats.low_excursions, stats.ambiguous_bars) == (1, 1, 1)


def test_displacement_needs_a_directional_body(spark):
    b = bars_frame(spark, [(1, 2, 1, 2), (1, 3, 1, 1), (2, 2, 1, 1.1)])
    assert [(r.bar_idx, r.direction) for r in L.label_displacement(b).orderBy("bar_idx").collect()] == [(0, "long"), (2, "short")]


def zone_walk(swings, ratio=0.2, max_age=500):
    """Plain restatement of the greedy clustering."""
    out = []
    for s in sorted({x.symbol for x in swings}):
        for kind in ("swing_high", "swing_low"):
            pool = []
            for x in sorted((y for y in swings if y.symbol == s and y.event_type == kind), key=lambda y: y.confirmation_index):
                tol = x.atr * ratio
                near = [
                    z for z in pool
                    if x.confirmation_index - z["last"] <= max_age and abs(x.price - z["mid"]) <= max(tol, z["half"])
                ]
                if near:
                    z = min(near, key=lambda q: (abs(x.price - q["mid"]), q["born"]))
                    z["mid"] = (z["mid"] * z["n"] + x.price) / (z["n"] + 1)
                    z["lo"], z["hi"] = min(z["lo"], x.price - tol), max(z["hi"], x.price + tol)
                    z["half"] = max(z["mid"] - z["lo"], z["hi"] - z["mid"])
                    z["n"] += 1
                else:
                    z = {"mid": x.price, "lo": x.price - tol, "hi": x.price + tol, "half": tol, "n": 1, "born": x.confirmation_index}
                    pool.append(z)
                z["last"] = x.confirmation_index
                out.append((s, kind, x.confirmation_index, z["born"], z["n"], z["mid"]))
    return sorted(out)


@pytest.mark.parametrize("epoch, age", [(100_000, 500), (40, 30)])
def test_level_zones_match_a_plain_walk_in_any_epoch_length(spark, epoch, age):
    bars = materialize(random_bars(spark, 220, seed=4))
    swings = materialize(L.label_swings(bars, pip_size=1.0))
    _, snaps = cluster_levels(swings, bars, epoch_bars=epoch, max_age=age)
    got = rows(
        snaps.withColumn("kind", F.when(F.col("role") == "resistance", "swing_high").otherwise("swing_low")),
        "symbol", "kind", "confirmation_index", "created_index", "touch_count", "center",
    )
    assert got == zone_walk(swings.collect(), max_age=age)


def test_zone_activates_on_its_second_touch(spark):
    peak = lambda p: [(1, 1, 1, 1), (1, 1, 1, 1), (1, p, 1, 1), (1, 1, 1, 1), (1, 1, 1, 1)]
    bars = materialize(bars_frame(spark, [*peak(5), *peak(5.1)]))
    zones, snaps = cluster_levels(materialize(L.label_swings(bars, pip_size=1.0)), bars)
    high = zones.where("role = 'resistance' and touch_count = 2").first()
    assert high.center == pytest.approx(5.05) and high.active_at is not None
    assert [r.active for r in snaps.where(f"zone_id = '{high.zone_id}'").orderBy("touch_count").collect()] == [False, True]


def anchor(spark, bars, idx, direction="up"):
    r = bars.where(f"bar_idx = {idx}").first()
    return spark.createDataFrame(
        [("X", "1H", "brk", "bos", r.timestamp, r.available_at, direction, True, idx, r.bar_id, 0)],
        "symbol string, timeframe string, event_id string, event_type string, event_at timestamp, available_at timestamp,"
        "direction string, displacement_qualified boolean, bar_idx long, bar_id string, event_seq int",
    )


def no_gaps(spark):
    return spark.createDataFrame([], "symbol string, timeframe string, event_id string, event_at timestamp, direction string")


def test_order_block_takes_the_last_opposing_candle_and_invalidation_beats_mitigation(spark):
    bars = bars_frame(
        spark,
        [(5, 6, 4, 4.5), (4.5, 5, 3, 4), (4, 4, 4, 4), (4, 9, 4, 9), (9, 9, 4.5, 8), (8, 8, 2, 2.5), (2, 3, 1, 2)],
    )
    zones, audit = ob.label_order_blocks(bars, anchor(spark, bars, 3), no_gaps(spark), pip_size=1.0)
    z = zones.first()
    at = {x.bar_idx: x.available_at for x in bars.collect()}
    assert z.candidate_index == 1 and (z.lower_bound, z.upper_bound) == (3.0, 5.0)
    assert z.first_touch_at == at[4] and z.midpoint_touch_at == at[5]
    assert (z.full_mitigation_at, z.invalidation_at, z.status) == (at[5], at[5], "invalidated")
    assert z.terminal_delay_bars == 2 and audit.first().status == "created"
    body, _ = ob.label_order_blocks(bars, anchor(spark, bars, 3), no_gaps(spark), pip_size=1.0, geometry="body_range")
    assert (body.first().lower_bound, body.first().upper_bound) == (4.0, 4.5)


def test_order_block_without_opposing_candle_is_only_audited(spark):
    bars = bars_frame(spark, [(1, 2, 1, 2), (2, 3, 2, 3), (3, 5, 3, 5)])
    zones, audit = ob.label_order_blocks(bars, anchor(spark, bars, 2), no_gaps(spark))
    assert zones.count() == 0 and audit.first().status == "no_opposing_candle"


ZONES = "symbol string, _ord long, lower_bound double, upper_bound double"


@pytest.mark.parametrize("block", [5, 8192])
def test_prior_overlaps_count_without_pairs(spark, block):
    rng = random.Random(3)
    data = []
    for symbol, n, tick in (("X", 90, 0.1), ("Y", 70, 4), ("Z", 1, 1)):
        for i in range(n):
            lo = float(round(rng.uniform(0, 40) / tick) * tick)  # many equal bounds and equal zones, some without width
            data.append((symbol, i, lo, float(lo + round(rng.uniform(0, 15) / tick) * tick)))
    zones = spark.createDataFrame(data, ZONES).repartition(5)
    got = {
        (r.symbol, r._ord): (r.overlap_with_prior_zone_count, r.nested_with_prior_zone_count)
        for r in ob._prior_overlaps(zones, ["symbol"], block=block).collect()
    }
    for s, i, lo, hi in data:
        prior = [(a, b) for t, j, a, b in data if t == s and j < i and a <= hi and b >= lo]
        nested = [1 for a, b in prior if (a <= lo and b >= hi) or (lo <= a and hi >= b)]
        assert got.get((s, i), (0, 0)) == (len(prior), len(nested))


def test_overlap_rows_grow_with_the_logarithm(spark):
    rng = random.Random(4)
    for n in (200, 800, 3200):
        data = [("X", i, x, x + rng.uniform(0.5, 15)) for i, x in enumerate(rng.uniform(0, 50) for _ in range(n))]
        zones = spark.createDataFrame(data, ZONES)
        rows = ob._rank_rows(ob._places(zones, ["symbol"], lambda d: d), ["symbol"]).count()
        bits = (2 * n).bit_length()
        assert rows <= n * (bits + 6) * -(-bits // ob.DIGIT_BITS)
        assert rows < n * n or n == 200


def test_no_window_holds_a_series_of_zones(spark):
    zones = spark.createDataFrame([("X", 0, 1.0, 2.0)], ZONES)
    plan = ob._prior_overlaps(zones, ["symbol"], cut=lambda d: d)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

