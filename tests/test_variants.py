import dataclasses

import pytest
from pyspark.sql import functions as F

from pitbars.operators import labels as L
from pitbars.operators import levels, order_blocks, regime, variants
from pitbars.params import VARIANTS, LabelParams
from pitbars.session import materialize

from .helpers import random_bars, rows

P = LabelParams(pip_size=1.0, displacement_body_atr=0.3, ob_max_age=6)
KEYS = ["symbol", "timeframe"]


@pytest.fixture(scope="module")
def market(spark):
    walk = random_bars(spark, n=200, seed=11).withColumn("atr", 4 * F.col("atr"))
    bars = materialize(walk)
    swings = materialize(L.label_swings(bars, pip_size=1.0))
    seg = regime.structure_segments(bars, swings, buffer_atr=0.05)
    return bars, swings, materialize(regime.breaks_from_segments(seg, bars, displacement_body_atr=0.3))


def blocks_of(market, **setting):
    bars, _, breaks = market
    plan = {"lookback": P.ob_lookback, "max_age": P.ob_max_age, **setting}
    return order_blocks.label_order_blocks(bars, breaks, L.label_gaps(bars), pip_size=1.0, timeframes=("1H",), **plan)[0]


def labelled_alone(market, concept, value):
    """Keys of one variant by a whole run of its labeler."""
    bars, swings, _ = market
    if concept == "swing":
        return rows(L.label_swings(bars, right=value, pip_size=1.0), *KEYS, "event_at", "direction")
    if concept == "swing_relationship":
        told = L.label_swings(bars, pip_size=1.0, tolerance_pips=value)
        return rows(told, *KEYS, "event_at", "direction", "structural_relationship")
    if concept == "structure_break":
        seg = regime.structure_segments(bars, swings, buffer_atr=value)
        return rows(regime.breaks_from_segments(seg, bars), *KEYS, "event_at", "direction", "event_type")
    if concept == "fair_value_gap":
        return rows(L.label_gaps(bars, min_size_atr=value), *KEYS, "event_at", "direction")
    if concept == "support_resistance":
        return rows(levels.cluster_levels(swings, bars, tolerance_atr=value)[1].where("active"), *KEYS, "swing_id")
    if concept == "order_block_candidate":
        return rows(blocks_of(market, lookback=value), *KEYS, "anchor_break_id", "candidate_bar_id")
    return rows(blocks_of(market, max_age=value), *KEYS, "event_id", "status")


def test_every_variant_equals_a_run_of_its_labeler(market):
    bars, swings, breaks = market
    got = {
        (r.concept, r.symbol, r.comparison_value): r
        for r in variants.label_sensitivity(bars, swings, breaks, P, timeframes=("1H",)).collect()
    }
    for concept in VARIANTS:
        first, *others = variants.variant_values(P, concept)
        primary = labelled_alone(market, concept, first)
        assert primary
        differ = 0
        for value in others:
            other = labelled_alone(market, concept, value)
            differ += other != primary
            for symbol in ("A", "B"):
                a = {k for k in primary if k[0] == symbol}
                b = {k for k in other if k[0] == symbol}
                r = got.pop((concept, symbol, str(value)))
                assert (r.primary_count, r.comparison_count, r.intersection_count) == (len(a), len(b), len(a & b)), concept
                assert r.jaccard_agreement == pytest.approx(len(a & b) / len(a | b))
                assert (r.parameter, r.primary_value) == (VARIANTS[concept][0], str(first))
        assert differ, concept  # else the fixture would not notice a variant that is ignored
    assert {k[0] for k in got} == {"order_block_geometry"}


def test_geometry_is_the_median_overlap(market):
    bars, _, breaks = market
    zones = variants.widest_order_blocks(bars, breaks, P, ("1H",))
    got = {r.symbol: r for r in variants.geometry_agreement(zones, P).collect()}
    for symbol in ("A", "B"):
        wick = {r.event_id: r for r in blocks_of(market).where(F.col("symbol") == symbol).collect()}
        body = blocks_of(market, geometry="body_range").where(F.col("symbol") == symbol).collect()
        shares = sorted(
            (r.upper_bound - r.lower_bound) / (wick[r.event_id].upper_bound - wick[r.event_id].lower_bound) for r in body
        )
        n = len(shares)
        assert got[symbol].primary_count == n == len(wick)
        assert got[symbol].jaccard_agreement == pytest.approx((shares[(n - 1) // 2] + shares[n // 2]) / 2)


def test_a_series_without_labels_has_no_rows(market):
    bars, swings, breaks = market
    none = lambda df: df.where("false")
    assert variants.label_sensitivity(none(bars), none(swings), none(breaks), P).count() == 0


def test_the_primary_setting_comes_from_the_parameters():
    moved = dataclasses.replace(P, swing_right=3)
    assert variants.variant_values(moved, "swing")[0] == 3
