"""Entry funnel: one literal case per terminal status."""

import pytest

from pitbars.operators.funnel import COARSE, IMMEDIATE, NESTED, entry_funnel
from pitbars.session import materialize

from .helpers import quote_bars, signal, ts

GAP = "symbol string, direction string, fvg_id string, first_bar_at timestamp, available_at timestamp, lower_bound double, upper_bound double"
HIGH = (1.2508, 1.2509, 1.2507, 1.2508)
DIP = (1.2508, 1.2509, 1.2501, 1.2505)
STOP = (1.2508, 1.2509, 1.2470, 1.2500)
TARGET = (1.2508, 1.2530, 1.2507, 1.2520)
JUMP = (1.2540, 1.2541, 1.2539, 1.2540)


def mapping(spark, status="valid", cutoff="2024-01-02T08:30"):
    # long, stop 1.2480, target 1.2500 + 2 * 0.0010 = 1.2520
    return signal(
        spark, cutoff=cutoff, mapping_status=status, structural_stop_price=1.2480, entry_reference_price=1.2500,
        entry_at=ts("2024-01-02T08:00"),
    )


def gap(spark, at="2024-01-02T08:05", name="g1", low=1.2500, high=1.2504, first="2024-01-02T07:50"):
    return spark.createDataFrame([("X", "long", name, ts(first), ts(at), low, high)], GAP)


def nothing(spark):
    return spark.createDataFrame([], GAP)


def status(spark, model, *, m=None, coarse=(), fine=(), cg=None, fg=None):
    coarse_bars = quote_bars(spark, [HIGH, *coarse])
    fine_bars = quote_bars(spark, [HIGH] * 5 + list(fine), minutes=1)
    out = entry_funnel(
        materialize(m or mapping(spark)), coarse_bars, fine_bars, cg or gap(spark), fg or nothing(spark)
    )
    return out.where(f"model_id = '{model}'").first()


def test_immediate_follows_the_mapping(spark):
    assert status(spark, IMMEDIATE).coverage_status == "entry"
    assert status(spark, IMMEDIATE, m=mapping(spark, "missing_entry_bar")).coverage_status == "invalid_parent_mapping"


@pytest.mark.parametrize(
    "coarse, want",
    [
        ([DIP, HIGH], "entry"),
        ([STOP, HIGH], "stop_before_entry"),
        ([TARGET, HIGH], "target_before_entry"),
        ([HIGH, HIGH], "no_m5_mitigation_before_cutoff"),
        ([DIP], "no_m5_entry_before_cutoff"),
        ([DIP, JUMP], "entry_outside_stop_target"),
    ],
)
def test_coarse_statuses(spark, coarse, want):
    r = status(spark, COARSE, coarse=coarse)
    assert r.coverage_status == want
    if want == "entry":
        assert (r.entry_decision_at.strftime("%H:%M"), r.entry_at.strftime("%H:%M")) == ("08:10", "08:10")


def test_without_a_gap_before_the_cutoff(spark):
    assert status(spark, COARSE, cg=gap(spark, at="2024-01-02T08:30")).coverage_status == "no_directional_m5_fvg"


NEST = {"at": "2024-01-02T08:09", "name": "f1", "first": "2024-01-02T08:06", "low": 1.2503, "high": 1.2506}


@pytest.mark.parametrize(
    "fine, fg, want",
    [
        ([HIGH] * 5, None, "no_m1_mitigation_before_cutoff"),
        ([DIP, HIGH, HIGH, HIGH, HIGH], None, "no_nested_m1_fvg_before_cutoff"),
        ([DIP, HIGH, HIGH, HIGH, HIGH], {**NEST, "low": 1.2504}, "no_nested_m1_fvg_before_cutoff"),  # touches, no overlap
        ([DIP, HIGH, HIGH, HIGH, HIGH], {**NEST, "first": "2024-01-02T08:05"}, "no_nested_m1_fvg_before_cutoff"),
        ([DIP, HIGH, STOP, HIGH, HIGH], NEST, "stop_before_entry"),
        ([DIP, HIGH, HIGH, HIGH], NEST, "no_m1_entry_before_cutoff"),
        ([DIP, HIGH, HIGH, HIGH, TARGET], NEST, "target_before_entry"),
        ([DIP, HIGH, HIGH, HIGH, HIGH], NEST, "entry"),
    ],
)
def test_nested_statuses(spark, fine, fg, want):
    r = status(spark, NESTED, fine=fine, fg=gap(spark, **fg) if fg else None)
    assert r.coverage_status == want
    if want == "entry":
        assert r.fine_gap_id == "f1" and r.entry_at.strftime("%H:%M") == "08:09"
