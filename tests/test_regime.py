"""The regime labeller against a bar-by-bar walk, and its hand-made scenarios."""

import pytest

from pitbars.operators.labels import label_swings, transition_counts
from pitbars.operators.regime import label_regime

from pitbars.session import materialize

from .helpers import bars_frame, random_bars, rows, shuffled, ts

BUFFER = 0.05


def walk(bars, swings):
    """Bar-by-bar restatement of the rule: returns (breaks, contexts) as tuples."""
    breaks, contexts = [], []
    for s in sorted({b.symbol for b in bars}):
        mine = sorted((b for b in bars if b.symbol == s), key=lambda b: b.bar_idx)
        at = {}
        for w in swings:
            if w.symbol == s:
                at.setdefault(w.confirmation_index, {})[w.event_type] = w
        if not at:
            continue
        last, intact = {}, {"swing_high": False, "swing_low": False}
        guard, regime, hold, begun = None, "undetermined", -1, False
        for b in mine:
            opened, new = regime, at.get(b.bar_idx, {})
            for kind, w in new.items():
                last[kind], intact[kind] = w, True
            hi, lo = last.get("swing_high"), last.get("swing_low")
            if new:
                if not (hi and lo):
                    regime = "undetermined"
                elif min(hi.confirmation_index, lo.confirmation_index) <= hold:
                    regime = "transition"
                else:
                    pair = (hi.structural_relationship, lo.structural_relationship)
                    named = {("HH", "HL"): "bullish", ("LH", "LL"): "bearish", ("EQH", "EQL"): "balance"}
                    regime = named.get(pair) or ("undetermined" if "H0" in pair or "L0" in pair else "transition")
                guard = {"bullish": "swing_low", "bearish": "swing_high"}.get(regime)
            if not b.structure_eligible or b.atr is None:
                continue
            over = hi and b.mid_close > hi.price + BUFFER * b.atr
            under = lo and b.mid_close < lo.price - BUFFER * b.atr
            todo = []
            if over and (guard == "swing_high" or (regime != "bearish" and intact["swing_high"])):
                todo.append(("up", "swing_high"))
            if under and (guard == "swing_low" or (regime != "bullish" and intact["swing_low"])):
                todo.append(("down", "swing_low"))
            if regime == "bearish":
                todo.reverse()
            start, changed = regime, False
            for direction, kind in todo:
                if guard == kind:
                    label, changed = "choch", True
                elif (start, direction) in (("bullish", "up"), ("bearish", "down")):
                    label = "bos"
                else:
                    label = "unclassified_break"
                breaks.append((s, b.bar_idx, direction, label, start, last[kind].event_id))
                intact[kind] = False
            if changed:
                regime, hold, guard = "transition", b.bar_idx, None
            if not begun or regime != opened:
                cause = "initialization" if not begun else "choch" if changed else "swing_confirmation"
                contexts.append((s, b.bar_idx, None if not begun else opened, regime, cause))
                begun = True
    return sorted(breaks), sorted(contexts, key=str)


@pytest.mark.parametrize("seed, block", [(1, 8), (2, 32), (3, 8192)])
def test_matches_the_bar_by_bar_walk(spark, seed, block):
    bars = random_bars(spark, 260, seed=seed)
    bars = materialize(shuffled(bars))
    swings = materialize(label_swings(bars, tolerance_pips=0.5, pip_size=1.0))
    breaks, contexts = label_regime(bars, swings, buffer_atr=BUFFER, block_rows=block)
    want_b, want_c = walk(bars.collect(), swings.collect())
    got_b = rows(breaks, "symbol", "bar_idx", "direction", "event_type", "regime_before", "broken_swing_id")
    assert got_b == want_b and len({b[3] for b in want_b}) == 3
    got_c = sorted(
        (tuple(r) for r in contexts.select("symbol", "bar_idx", "previous_state", "state", "cause").collect()), key=str
    )
    assert got_c == want_c


def swing(kind, price, conf, rel):
    return (
        "X", "1H", f"{kind}{conf}", f"swing_{kind}", float(price), conf - 1, conf, False, rel, f"bar{conf}",
        ts("2024-01-02T00:00"), ts("2024-01-02T00:00"),
    )


SWING = (
    "symbol string, timeframe string, event_id string, event_type string, price double, pivot_index long,"
    "confirmation_index long, ambiguous_equal boolean, structural_relationship string, bar_id string,"
    "event_at timestamp, available_at timestamp"
)


def flat(price, n):
    return [(price, price, price, price)] * n


def test_break_with_the_trend_is_bos_and_against_protected_level_is_choch(spark):
    swings = spark.createDataFrame(
        [swing("high", 10, 0, "HH"), swing("low", 5, 1, "HL")], SWING
    )
    bars = bars_frame(spark, [*flat(8, 2), (8, 11, 8, 11), (8, 8, 4, 4), (4, 12, 4, 12)])
    breaks, contexts = label_regime(bars, swings)
    assert rows(breaks, "bar_idx", "event_type", "broken_level_role") == [
        (2, "bos", "continuation_high"), (3, "choch", "protected_low"),
    ]
    assert rows(contexts, "bar_idx", "state", "cause") == [
        (0, "undetermined", "initialization"), (1, "bullish", "swing_confirmation"), (3, "transition", "choch"),
    ]


def test_after_a_change_both_swings_must_confirm_again(spark):
    swings = spark.createDataFrame(
        [
            swing("high", 10, 0, "HH"), swing("low", 5, 1, "HL"), swing("high", 9, 3, "LH"), swing("low", 3, 4, "LL"),
        ],
        SWING,
    )
    bars = bars_frame(spark, [*flat(8, 2), (8, 8, 4, 4), *flat(4, 3)])
    _, contexts = label_regime(bars, swings)
    states = rows(contexts, "bar_idx", "state")
    assert states == [(0, "undetermined"), (1, "bullish"), (2, "transition"), (4, "bearish")]


def test_daily_breaks_never_trigger_entries(spark):
    swings = spark.createDataFrame([swing("high", 10, 0, "H0")], SWING).selectExpr(
        "symbol", "'1D' as timeframe", "* except (symbol, timeframe)"
    )
    bars = bars_frame(spark, [*flat(8, 1), (8, 11, 8, 11)], timeframe="1D", minutes=1440)
    breaks, _ = label_regime(bars, swings)
    assert [r.entry_trigger_eligible for r in breaks.collect()] == [False]


def test_series_without_swings_has_no_rows(spark):
    bars = bars_frame(spark, flat(8, 30))
    swings = materialize(label_swings(bars, pip_size=1.0).where("1 = 0"))
    breaks, contexts = label_regime(bars, swings)
    assert breaks.count() == 0 and contexts.count() == 0 and "regime_after" in breaks.columns


def test_labels_known_by_then_do_not_change_with_more_data(spark):
    bars = random_bars(spark, 160, symbols=("A",), seed=9)
    cols = ("bar_idx", "event_type", "direction")

    def labels(n):
        part = bars.where(f"bar_idx < {n}")
        return rows(label_regime(part, materialize(label_swings(part, pip_size=1.0)))[0], *cols)

    assert labels(110) == [r for r in labels(160) if r[0] < 110]


def test_transition_counts_follow_event_order(spark):
    bars = random_bars(spark, 200, symbols=("A",), seed=2)
    breaks, _ = label_regime(bars, materialize(label_swings(bars, pip_size=1.0)))
    seq = [
        f"{r.event_type}:{r.direction}"
        for r in breaks.where("event_type in ('bos', 'choch')").orderBy("bar_idx", "event_seq").collect()
    ]
    want = {}
    for a, b in zip(seq, seq[1:]):
        want[f"{a} -> {b}"] = want.get(f"{a} -> {b}", 0) + 1
    assert dict(rows(transition_counts(breaks), "transition", "transition_count")) == want
