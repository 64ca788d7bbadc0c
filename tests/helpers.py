"""Small literal frames and brute-force restatements used by several tests."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

UTC = dt.timezone.utc


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def bars_frame(spark, rows, *, minutes=60, start="2024-01-02T00:00", symbol="X", timeframe="1H", atr=1.0):
    """rows: (open, high, low, close[, eligible]) one per step."""
    t0 = ts(start)
    data = []
    for i, r in enumerate(rows):
        at = t0 + dt.timedelta(minutes=minutes * i)
        o, h, l, c = (float(x) for x in r[:4])
        ok = r[4] if len(r) > 4 else True
        data.append(
            (symbol, timeframe, i, f"{timeframe}:{at.isoformat()}", at, at + dt.timedelta(minutes=minutes),
             o, h, l, c, float(atr), abs(c - o) / atr, ok, 1.0)
        )
    return spark.createDataFrame(
        data,
        "symbol string, timeframe string, bar_idx long, bar_id string, timestamp timestamp, available_at timestamp,"
        "mid_open double, mid_high double, mid_low double, mid_close double, atr double, body_atr double,"
        "structure_eligible boolean, coverage_ratio double",
    )


def quote_bars(spark, rows, *, minutes=5, start="2024-01-02T08:00", spread=0.0002, symbol="X"):
    """rows: bid (open, high, low, close); ask = bid + spread; None leaves a hole."""
    t0 = ts(start)
    data, k = [], 0
    for i, r in enumerate(rows):
        if r is None:
            continue
        at = t0 + dt.timedelta(minutes=minutes * i)
        bid = [float(x) for x in r]
        ask = [x + spread for x in bid]
        mid = [x + spread / 2 for x in bid]
        data.append((symbol, at, k, at + dt.timedelta(minutes=minutes), *bid, *ask, *mid))
        k += 1
    cols = ", ".join(f"{s}_{f} double" for s in ("bid", "ask", "mid") for f in ("open", "high", "low", "close"))
    return spark.createDataFrame(data, f"symbol string, timestamp timestamp, bar_idx long, available_at timestamp, {cols}")


def signal(spark, *, direction="long", decision="2024-01-02T08:00", cutoff="2024-01-02T09:00", atr=0.001, sid="s1", **more):
    row = {
        "symbol": "X", "signal_id": sid, "opportunity_id": "o1", "session": "london", "session_date": "2024-01-02",
        "year": 2024, "period": "construction", "event_type": "bos", "model_id": "m", "direction": direction,
        "decision_at": ts(decision), "cutoff_at": ts(cutoff), "atr": atr, **more,
    }
    kinds = {str: "string", float: "double", int: "long", dt.datetime: "timestamp", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


def random_bars(spark, n=300, symbols=("A", "B"), seed=7, step=1.0, hole=0.05):
    """Integer-valued random walk bars: many equal extremes, some ineligible bars."""
    rng = random.Random(seed)
    out = []
    for s in symbols:
        price = 100.0
        t0 = ts("2024-01-01T00:00")
        for i in range(n):
            o = price
            c = o + rng.randint(-4, 4) * step
            h = max(o, c) + rng.randint(0, 2) * step
            l = min(o, c) - rng.randint(0, 2) * step
            at = t0 + dt.timedelta(hours=i)
            atr = 3.0 if i >= 5 else None
            ok = atr is not None and rng.random() > hole
            out.append((s, "1H", i, f"1H:{at.isoformat()}", at, at + dt.timedelta(hours=1), o, h, l, c, atr,
                        None if atr is None else abs(c - o) / atr, ok, 1.0))
            price = c
    return spark.createDataFrame(
        out,
        "symbol string, timeframe string, bar_idx long, bar_id string, timestamp timestamp, available_at timestamp,"
        "mid_open double, mid_high double, mid_low double, mid_close double, atr double, body_atr double,"
        "structure_eligible boolean, coverage_ratio double",
    )


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def shuffled(df, parts=7):
    return df.repartition(parts, F.rand(3))
