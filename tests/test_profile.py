import datetime as dt

import numpy as np
import pytest

from pitbars.operators import profile

AT = dt.datetime(2024, 1, 2)


def test_counts_shares_and_quantiles_of_every_set(spark):
    gap = "symbol string, timeframe string, direction string, status string, fill_delay_bars long, size_atr double, lower_bound double, upper_bound double"
    rows = [
        ("X", "1H", "up", "full", 3, 0.2, 1.0, 1.5), ("X", "1H", "up", "open", None, 0.4, 1.0, 2.0), ("X", "1H", "down", None, 5, 0.1, 0.0, 0.5),
        ("Y", "1H", "up", "full", 9, 0.9, 1.0, 1.5), ("X", "4H", "down", "full", 1, 0.3, 2.0, 2.5), (None, "1H", "up", "full", 2, 0.5, 1.0, 1.1),
    ]
    gaps = spark.createDataFrame(rows, gap).repartition(3)
    swing = "symbol string, timeframe string, event_type string, direction string, structural_relationship string, confirmation_delay_bars long"
    swings = spark.createDataFrame([("X", "1H", "swing_high", "up", "HH", 2), ("X", "1H", "swing_low", "down", None, 2)], swing)
    got = {tuple(r[k] for k in profile.KEYS): r for r in profile.label_profile({"gap": gaps, "swing": swings}, 0.1).collect()}
    for key, r in got.items():
        symbol, timeframe, concept, attribute, value = key
        if concept != "gap":
            continue
        col = {"direction": 2, "status": 3}.get(attribute)
        whole = [x for x in rows if x[1] == timeframe and symbol in ("all", x[0] or "none")]
        own = [x for x in whole if col is None or (x[col] or "none") == value]
        assert r.event_count == len(own) and r.share == pytest.approx(len(own) / len(whole))
        for m, values in (("delay", [x[4] for x in own]), ("size", [x[5] for x in own]), ("width", [(x[7] - x[6]) / 0.1 for x in own])):
            values = [v for v in values if v is not None]
            assert r[f"{m}_count"] == len(values)
            for p, q in profile.POINTS.items():
                assert r[f"{m}_{p}"] == (pytest.approx(np.quantile(values, q)) if values else None)
    assert got["all", "1H", "gap", "all", "all"].event_count == 5 and got["none", "1H", "gap", "status", "full"].event_count == 1
    assert got["X", "1H", "gap", "status", "none"].delay_median == 5 and ("X", "1H", "gap", "relationship", "none") in got
    assert got["X", "1H", "swing", "relationship", "HH"].delay_mean == 2 and got["X", "1H", "swing", "all", "all"].size_count == 0


def test_every_concept_names_known_columns():
    for own in profile.CONCEPTS.values():
        assert set(own) <= {*profile.ATTRIBUTES, *profile.MEASURES}
