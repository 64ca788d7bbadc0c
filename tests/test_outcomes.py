import pytest
from pyspark.sql import functions as F

from pitbars.operators import outcomes as out
from pitbars.params import Costs

from .helpers import quote_bars, signal, ts

FLAT = (1.2500, 1.2501, 1.2499, 1.2500)


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


def test_long_target_uses_ask_entry_bid_exit_and_costs(spark):
    # entry ask 1.2502, stop 10 pips away, target 20 pips: bid reaches 1.2522 on the second bar
    bars = quote_bars(spark, [FLAT, (1.2500, 1.2525, 1.2499, 1.2520)])
    r = one(out.bracket_outcome(signal(spark), bars))
    assert r.exit_reason == "target" and r.entry_reference_price == pytest.approx(1.2502)
    # 20 pips - 0.2 slippage - 0.7 commission over 10 pips of risk
    assert r.net_r == pytest.approx(1.91) and r.exit_at.strftime("%H:%M") == "08:10"


def test_a_bar_touching_both_counts_as_stop(spark):
    bars = quote_bars(spark, [FLAT, (1.2500, 1.2530, 1.2480, 1.2500)])
    r = one(out.bracket_outcome(signal(spark), bars))
    assert r.exit_reason == "stop" and r.net_r == pytest.approx(-1.09) and not r.win


def test_gap_through_stop_fills_at_open_and_gap_through_target_at_target(spark):
    down = one(out.bracket_outcome(signal(spark), quote_bars(spark, [FLAT, (1.2470, 1.2471, 1.2469, 1.2470)])))
    assert (down.exit_reason, down.raw_exit_price) == ("stop_gap", pytest.approx(1.2470))
    up = one(out.bracket_outcome(signal(spark), quote_bars(spark, [FLAT, (1.2550, 1.2551, 1.2549, 1.2550)])))
    assert (up.exit_reason, up.raw_exit_price) == ("target_gap", pytest.approx(1.2522))


def test_short_mirrors_and_time_exit_takes_the_last_bar_before_cutoff(spark):
    bars = quote_bars(spark, [FLAT] * 20)
    r = one(out.bracket_outcome(signal(spark, direction="short", cutoff="2024-01-02T08:12"), bars))
    assert r.exit_reason == "time" and r.entry_reference_price == pytest.approx(1.2500)
    assert r.exit_at.strftime("%H:%M") == "08:12"  # capped at the cutoff
    assert r.raw_exit_price == pytest.approx(1.2502)


def test_no_bar_before_cutoff_or_bad_atr_yields_no_row(spark):
    bars = quote_bars(spark, [None, None, FLAT])
    assert out.bracket_outcome(signal(spark, cutoff="2024-01-02T08:10"), bars).count() == 0
    assert out.bracket_outcome(signal(spark, atr=float("nan")), bars).count() == 0


def mapping(spark, **kw):
    base = {"mapping_status": "valid", "structural_stop_price": 1.2482, "entry_reference_price": 1.2502}
    return signal(spark, **{**base, **kw})


def test_structural_variants_share_the_stop(spark):
    bars = quote_bars(spark, [FLAT] * 3)
    got = {r.variant_id: r for r in out.structural_variants(mapping(spark), bars).collect()}
    assert got["structural_fixed_2atr"].target_price == pytest.approx(1.2522)
    assert got["structural_2r"].target_price == pytest.approx(1.2542)
    assert got["structural_2r"].risk_pips == pytest.approx(20)
    assert got["structural_2r"].theoretical_lots == pytest.approx(30 / (20 * 10))


@pytest.mark.parametrize(
    "path, reason, triggered, activated",
    [
        # trigger on bar 2 (bid high >= 1.2512), falls back to entry on bar 3
        ([FLAT, (1.2505, 1.2515, 1.2504, 1.2510), (1.2505, 1.2506, 1.2495, 1.2500)], "protected_stop", True, True),
        # opens below entry on the next bar
        ([FLAT, (1.2505, 1.2515, 1.2504, 1.2510), (1.2495, 1.2496, 1.2494, 1.2495)], "protected_stop_gap", True, True),
        # the trigger bar itself dips below entry: protection is not active yet
        ([FLAT, (1.2505, 1.2515, 1.2490, 1.2510), (1.2510, 1.2511, 1.2509, 1.2510)], "time", True, True),
        # trigger on the last bar: triggered, never activated
        ([FLAT, (1.2505, 1.2515, 1.2504, 1.2510)], "time", True, False),
        # hard stop on the trigger bar wins
        ([FLAT, (1.2505, 1.2515, 1.2480, 1.2490), FLAT], "hard_stop", False, False),
    ],
)
def test_break_even_acts_from_the_next_bar(spark, path, reason, triggered, activated):
    got = out.protected_bracket(mapping(spark), quote_bars(spark, path)).collect()
    moved = next(r for r in got if r.variant_id == "break_even_after_trigger")
    assert (moved.exit_reason, moved.protection_triggered, moved.protection_activated) == (reason, triggered, activated)
    static = next(r for r in got if r.variant_id == "static_bracket")
    assert static.trigger_observed_at is None and static.entry_at == moved.entry_at


def test_delayed_entry_keeps_the_parents_target(spark):
    m = mapping(spark, structural_stop_price=1.2492)  # target 1.2522 from the parent entry
    bars = quote_bars(spark, [FLAT, (1.2500, 1.2501, 1.2499, 1.2500), (1.2500, 1.2530, 1.2499, 1.2525)])
    entry = spark.createDataFrame(
        [("X", "e1", "s1", "5min", 5, ts("2024-01-02T08:05"))],
        "symbol string, model_id string, signal_id string, timeframe string, bar_minutes int, entry_at timestamp",
    )
    r = one(out.delayed_entry_outcome(entry, m, bars.withColumn("timeframe", F.lit("5min"))))
    assert r.target_price == pytest.approx(1.2522) and r.exit_reason == "target"
    assert r.net_r == pytest.approx((20 - 0.2 - 0.7) / 10)


def test_cost_scenarios_change_fills_only(spark):
    raw = out.structural_variants(mapping(spark), quote_bars(spark, [FLAT] * 3)).select(
        "signal_id", "variant_id", "direction", "entry_reference_price", "raw_exit_price", "risk_price"
    )
    got = out.apply_cost_scenarios(raw, Costs()).where("variant_id = 'structural_2r'")
    pips = {r.cost_case: r.net_pips for r in got.collect()}
    assert pips["primary"] - pips["stress"] == pytest.approx(0.2)


def test_excursions_are_floored_at_zero(spark):
    bars = quote_bars(spark, [(1.2502, 1.2503, 1.2502, 1.2503), (1.2510, 1.2522, 1.2509, 1.2520)])
    r = one(out.excursions(signal(spark), bars))
    assert r.max_adverse_excursion_atr == pytest.approx(0.2)  # ask entry 1.2504 against bid low 1.2502
    assert r.max_favorable_excursion_atr == pytest.approx(1.8)


@pytest.mark.parametrize(
    "path, label",
    [
        ([FLAT, (1.2500, 1.2525, 1.2490, 1.2500)], "same_bar_ambiguous_stop_first"),
        ([FLAT, (1.2500, 1.2501, 1.2490, 1.2495), (1.25, 1.2530, 1.25, 1.25)], "stop_then_target_later"),
        ([FLAT, (1.2500, 1.2530, 1.2499, 1.2500)], "target_before_stop"),
        ([FLAT, (1.2500, 1.2501, 1.2480, 1.2490)], "stop_without_later_target"),
        ([FLAT], "neither_touched"),
    ],
)
def test_threshold_order_is_never_guessed(spark, path, label):
    got = out.threshold_sequence(signal(spark), quote_bars(spark, path), stops=(1.0,))
    assert got.where("target_mode = 'fixed_2atr'").first().sequence == label


def event(spark, **kw):
    return signal(
        spark, event_id="e1", primitive="bos", event_at=ts("2024-01-02T07:45"), available_at=ts("2024-01-02T08:00"),
        event_direction="long", up="long", down="short", **kw,
    ).withColumn("none", F.lit(None).cast("string"))


def test_forward_returns_need_an_exact_unbroken_horizon(spark):
    path = [(1.25 + i * 1e-4,) * 4 for i in range(5)]
    rules = ("up", "down", "none")
    got = out.forward_returns(event(spark), quote_bars(spark, path, spread=0.0), horizons=(15, 20), rules=rules)
    by = {(r.rule, r.horizon_minutes): r for r in got.collect()}
    assert by["up", 15].signed_forward_return_atr == pytest.approx(0.3)
    assert by["down", 15].signed_forward_return_atr == pytest.approx(-0.3)
    assert by["none", 15].signed_forward_return_atr is None and not by["none", 15].emitted_prediction
    assert by["up", 20].mfe_atr == pytest.approx(0.3) and by["up", 20].mae_atr == 0.0
    holed = quote_bars(spark, [path[0], None, *path[2:]], spread=0.0)
    assert out.forward_returns(event(spark), holed, horizons=(15,), rules=rules).count() == 0


def test_horizon_starts_at_the_actual_entry_bar(spark):
    path = [None, None, *[(1.25 + i * 1e-4,) * 4 for i in range(4)]]
    r = out.forward_returns(event(spark), quote_bars(spark, path, spread=0.0), horizons=(15,), rules=("up",)).first()
    assert r.entry_at.strftime("%H:%M") == "08:10" and r.exit_at.strftime("%H:%M") == "08:25"


def test_barriers_report_same_bar_touches_as_ambiguous(spark):
    path = [(1.25, 1.25, 1.25, 1.25), (1.25, 1.2515, 1.2485, 1.25), (1.25,) * 4, (1.25,) * 4]
    bars = quote_bars(spark, path, spread=0.0)
    fwd = out.forward_returns(event(spark), bars, horizons=(15,), rules=("up",))
    assert out.barrier_first(fwd, bars, horizon=15).first().barrier_sequence == "same_bar_ambiguous"
