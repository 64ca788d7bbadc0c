import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitbars.functions.columns import anchored_bucket
from pitbars.operators import bars as B
from pitbars.operators import blocks
from pitbars.operators.labels import true_range_atr

from .helpers import bars_frame, rows, shuffled, ts

TICK = "symbol string, ts timestamp, seq long, bid double, ask double, mid double, spread_pips double, activity int"


def ticks(spark, data):
    out = []
    for i, (at, bid, ask) in enumerate(data):
        out.append(("X", ts(at), i, bid, ask, (bid + ask) / 2, (ask - bid) * 1e4, 1))
    return spark.createDataFrame(out, TICK)


def test_ticks_to_bars_closes_left_and_breaks_ties_by_sequence(spark):
    t = ticks(
        spark,
        [
            ("2024-01-02T00:00:00", 1.0, 1.1), ("2024-01-02T00:00:00", 1.2, 1.3),
            ("2024-01-02T00:00:59", 0.9, 1.0), ("2024-01-02T00:01:00", 2.0, 2.1),
            ("2024-01-02T00:05:00", 3.0, 3.1),
        ],
    )
    got = rows(B.ticks_to_bars(shuffled(t)), "timestamp", "bid_open", "bid_high", "bid_low", "bid_close", "tick_count")
    naive = [r[0].strftime("%H:%M") for r in got]
    assert naive == ["00:00", "00:01", "00:05"]  # no empty bars
    assert got[0][1:] == (1.0, 1.2, 0.9, 0.9, 3)


def test_spread_percentile_interpolates(spark):
    t = ticks(spark, [(f"2024-01-02T00:00:{i:02d}", 1.0, 1.0 + 0.0001 * (i + 1)) for i in range(3)])
    r = B.ticks_to_bars(t).first()
    assert r.spread_median_pips == pytest.approx(2.0)
    assert r.spread_p95_pips == pytest.approx(2.9)


def test_dedupe_ticks_keeps_one_of_each(spark):
    t = ticks(spark, [("2024-01-02T00:00:00", 1.0, 1.1)] * 3 + [("2024-01-02T00:00:00", 1.0, 1.2)])
    assert rows(B.dedupe_ticks(t), "seq") == [(0,), (3,)]


@pytest.mark.parametrize(
    "at, minutes, start, end",
    [
        # winter and summer four-hour buckets begin at 17:00 New York
        ("2024-01-02T23:10", 240, "2024-01-02T22:00", "2024-01-03T02:00"),
        ("2024-07-02T23:10", 240, "2024-07-02T21:00", "2024-07-03T01:00"),
        # days on either side of the US clock changes
        ("2024-03-08T22:30", 1440, "2024-03-08T22:00", "2024-03-09T22:00"),
        ("2024-03-10T12:00", 1440, "2024-03-09T22:00", "2024-03-10T21:00"),
        ("2024-11-03T12:00", 1440, "2024-11-02T21:00", "2024-11-03T22:00"),
    ],
)
def test_anchored_bucket_follows_the_local_day(spark, at, minutes, start, end):
    df = spark.createDataFrame([(ts(at),)], "t timestamp")
    s, e = anchored_bucket("t", minutes)
    r = df.select(F.unix_timestamp(s).alias("s"), F.unix_timestamp(e).alias("e")).first()
    assert (r.s, r.e) == (int(ts(start).timestamp()), int(ts(end).timestamp()))


def test_trading_week_keeps_sunday_evening_and_drops_friday_evening(spark):
    data = ["2024-01-05T21:59", "2024-01-05T22:00", "2024-01-07T21:59", "2024-01-07T22:00"]
    df = spark.createDataFrame([(ts(x),) for x in data], "timestamp timestamp")
    kept = [r[0].strftime("%dT%H:%M") for r in B.trading_week_filter(df).orderBy("timestamp").collect()]
    assert kept == ["05T21:59", "07T22:00"]


def base_bars(spark, n, skip=()):
    data = []
    for i in range(n):
        if i in skip:
            continue
        at = ts("2024-01-02T00:00") + dt.timedelta(minutes=5 * i)
        p = [float(i), i + 2.0, i - 2.0, i + 1.0]
        data.append(("X", at, *p, *p, *p, 10, 10, 1.0, float(i), 2.0, 3.0))
    price = ", ".join(f"{s}_{f} double" for s in ("bid", "ask", "mid") for f in ("open", "high", "low", "close"))
    return spark.createDataFrame(
        data,
        f"symbol string, timestamp timestamp, {price}, tick_count long, activity_count long,"
        "spread_open_pips double, spread_median_pips double, spread_p95_pips double, spread_max_pips double",
    )


def test_rollup_reports_coverage_and_does_not_fill(spark):
    out = B.rollup_bars(shuffled(base_bars(spark, 6, skip=(4,))), {"15min": 15}).orderBy("timestamp").collect()
    assert [(r.source_count, r.expected_count) for r in out] == [(3, 3), (2, 3)]
    assert out[0].mid_open == 0.0 and out[0].mid_close == 3.0 and out[0].spread_median_pips == 1.0
    assert out[1].coverage_ratio == pytest.approx(2 / 3)
    assert out[0].bar_id == "15min:2024-01-02T00:00:00+00:00"


def test_rollup_of_nothing_keeps_the_schema(spark):
    out = B.rollup_bars(base_bars(spark, 3).limit(0), {"15min": 15})
    assert out.count() == 0 and "coverage_ratio" in out.columns


def test_positions_do_not_depend_on_block_length(spark):
    b = base_bars(spark, 60, skip=(7, 8, 30)).withColumn("timeframe", F.lit("5min"))
    one = rows(blocks.with_bar_index(b, ["symbol"]), "timestamp", "bar_idx")
    many = rows(blocks.with_bar_index(shuffled(b), ["symbol"], seconds=1200), "timestamp", "bar_idx")
    assert one == many and [r[1] for r in one] == list(range(57))


def test_atr_needs_a_full_window_and_ignores_the_future(spark):
    data = [(10, 11 + i % 3, 9, 10) for i in range(12)]
    b = bars_frame(spark, data).drop("atr", "body_atr")
    got = {r.bar_idx: r.atr for r in true_range_atr(b, 3).collect()}
    assert got[0] is None and got[1] is None
    assert got[2] == pytest.approx((2 + 3 + 4) / 3)
    cut = {r.bar_idx: r.atr for r in true_range_atr(b.where("bar_idx < 8"), 3).collect()}
    assert all(cut[i] == got[i] for i in cut)


def test_atr_is_the_same_for_any_halo_block(spark):
    from pitbars.operators.blocks import drop_halo, halo_window, with_halo

    data = [(10, 10 + (i * 7) % 5, 9 - (i * 3) % 4, 10) for i in range(40)]
    b = bars_frame(spark, data)

    def rolling(size):
        w = halo_window(["symbol"]).rowsBetween(-3, 2)
        return rows(
            drop_halo(with_halo(b, ["symbol"], 3, 2, size).withColumn("m", F.max("mid_high").over(w))),
            "bar_idx", "m",
        )

    assert rolling(8192) == rolling(5) == rolling(1)


def test_keep_last_bar_per_timestamp(spark):
    b = base_bars(spark, 2).withColumn("seq", F.lit(1))
    later = b.withColumn("seq", F.lit(2)).withColumn("mid_close", F.lit(9.0))
    out = B.dedupe_bars_keep_last(b.unionByName(later), year=2024)
    assert [r.mid_close for r in out.collect()] == [9.0, 9.0]
