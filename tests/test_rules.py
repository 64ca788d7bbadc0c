"""Every rule of every set counts nothing on sound rows and something on the broken ones."""

import datetime as dt

import pytest

from pitbars.operators import rules

T = dt.datetime(2024, 3, 4, 8)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def frame(spark, types, rows):
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in types.split(", ")) for r in rows], types)


def broken(sound, *changes):
    """The sound row, and one changed copy for each of ``changes``."""
    return [sound, *({**sound, **c} for c in changes)]


def counts(tables, own):
    got = {r.invariant: r.failure_count for r in rules.check_rules(tables, own).collect()}
    assert set(got) == set(rules.names(own))
    return got


def check(spark, types, sound, bad, own, skip=()):
    """``sound`` and ``bad``: rows by table. All rules hold on the first and none on the second."""
    make = lambda rows: {t: frame(spark, types[t], rows[t]) for t in types}
    schema = {r.name for r in own if isinstance(r, rules.Schema)}
    assert {n: v for n, v in counts(make(sound), own).items() if v and n not in skip} == {}
    got = counts(make(bad), own)
    assert [n for n, v in got.items() if v == 0 and n not in schema] == []
    return got


EVENT = "symbol string, timeframe string, event_id string, event_at timestamp, available_at timestamp"


def test_label_rules(spark):
    types = {
        "bars": "symbol string, bar_id string, timestamp timestamp, available_at timestamp, mid_open double, mid_high double, mid_low double, mid_close double",
        "swings": EVENT + ", pivot_index long, confirmation_index long, confirmation_delay_bars long",
        "gaps": EVENT + ", partial_fill_at timestamp, full_fill_at timestamp",
        "order_blocks": EVENT + ", candidate_at timestamp, candidate_available_at timestamp, first_touch_at timestamp,"
        " midpoint_touch_at timestamp, full_mitigation_at timestamp, invalidation_at timestamp",
    }
    types = {k: v.replace(",", ", ").replace("  ", " ") for k, v in types.items()}
    bar = dict(symbol="X", bar_id="b", timestamp=at(0), available_at=at(60), mid_open=1.0, mid_high=2.0, mid_low=0.5, mid_close=1.5)
    event = dict(symbol="X", timeframe="1H", event_id="e", event_at=at(0), available_at=at(60))
    swing = event | dict(pivot_index=3, confirmation_index=5, confirmation_delay_bars=2)
    gap = event | dict(partial_fill_at=at(90), full_fill_at=None)
    clocks = ("first_touch_at", "midpoint_touch_at", "full_mitigation_at", "invalidation_at")
    block = event | dict(candidate_at=at(-60), candidate_available_at=at(0)) | dict.fromkeys(clocks, at(61))
    early = {"available_at": at(0)}
    check(
        spark, types, {"bars": [bar], "swings": [swing], "gaps": [gap], "order_blocks": [block]},
        {
            "bars": broken(bar, {"mid_high": 1.2}, early),
            "swings": broken(swing, {"confirmation_delay_bars": 3}, early),
            "gaps": broken(gap, {"partial_fill_at": at(60)}, {"full_fill_at": at(1)}, early),
            "order_blocks": broken(block, {"candidate_at": at(0)}, early, *({c: at(60)} for c in clocks)),
        },
        rules.label_rules(),
    )


def test_signal_rules(spark):
    signal = "signal_id string, opportunity_id string, direction string, feature_available_at timestamp, decision_at timestamp, session_open_at timestamp, observation_end_at timestamp"
    trade = "signal_id string, model_id string, opportunity_id string, decision_at timestamp, entry_at timestamp, exit_at timestamp, cutoff_at timestamp, risk_pips double"
    key = "opportunity_id string, direction string"
    types = {"signals": signal, "trades": trade, "structure": key, "aligned": key, "confluent": key}
    s = dict(signal_id="s", opportunity_id="o", direction="long", feature_available_at=at(5), decision_at=at(5), session_open_at=at(0), observation_end_at=at(90))
    t = dict(signal_id="s", model_id="m", opportunity_id="o", decision_at=at(5), entry_at=at(5), exit_at=at(60), cutoff_at=at(60), risk_pips=1.0)
    k, other = dict(opportunity_id="o", direction="long"), dict(opportunity_id="o", direction="short")
    sound = {"signals": [s], "trades": [t], "structure": [k, other], "aligned": [k], "confluent": [k]}
    bad = {
        "signals": broken(s, {"feature_available_at": at(6)}, {"decision_at": at(-1)}, {"decision_at": at(91)}),
        "trades": broken(t, {"entry_at": at(4)}, {"entry_at": at(60)}, {"exit_at": at(61)}, {"risk_pips": 0.0}, {"signal_id": "lost"}),
        "structure": [], "aligned": [k], "confluent": [k, other],
    }
    own = rules.signal_rules()
    got = check(spark, types, sound, bad, own)
    assert got["one_trade_per_model_session"] == 6 and got["trades_subset_of_signals"] == 1
    wide = {t: frame(spark, types[t], sound[t]) for t in types}
    wide["signals"] = wide["signals"].selectExpr("*", "1 as near_order_block", "2 as H1_SR")
    assert counts(wide, own)["forbidden_feature_columns"] == 2


def test_filter_rules(spark):
    types = {
        "selected": "filter_id string, opportunity_id string, source_event_id string, year long, feature_available_at timestamp, decision_at timestamp",
        "candidates": "opportunity_id string, source_event_id string",
    }
    row = dict(filter_id="f", opportunity_id="o", source_event_id="e", year=2024, feature_available_at=at(0), decision_at=at(0))
    parent = dict(opportunity_id="o", source_event_id="e")
    bad = broken(row, {"year": None}, {"feature_available_at": at(1)}, {"source_event_id": "lost"})
    check(spark, types, {"selected": [row], "candidates": [parent]}, {"selected": bad, "candidates": [parent]}, rules.filter_rules(2024))


def test_sequence_rules(spark):
    own = "signal_id string, entry_at timestamp, entry_reference_price double"
    types = {
        "excursions": own + ", atr double, max_adverse_excursion_atr double, max_favorable_excursion_atr double, decision_at timestamp, last_observed_bar_at timestamp, cutoff_at timestamp",
        "paths": "signal_id string, sequence string", "original": "signal_id string, sequence string",
        "parents": own + ", exit_reason string",
    }
    e = dict(signal_id="s", entry_at=at(1), entry_reference_price=1.0, atr=0.1, max_adverse_excursion_atr=0.0, max_favorable_excursion_atr=2.0, decision_at=at(0), last_observed_bar_at=at(9), cutoff_at=at(10))
    p = dict(signal_id="s", sequence="target_before_stop")
    t = dict(signal_id="s", entry_at=at(1), entry_reference_price=1.0, exit_reason="target_gap")
    sound = {"excursions": [e], "paths": [p], "original": [p], "parents": [t]}
    bad = {
        "excursions": broken(e, {"atr": float("nan")}, {"max_adverse_excursion_atr": -0.1}, {"entry_at": at(-1)}, {"last_observed_bar_at": at(10)}, {"entry_reference_price": 1.1}),
        "paths": broken(p, {"sequence": "other"}), "original": [p],
        "parents": [t | {"exit_reason": "stop"}, t | {"signal_id": "lost"}],
    }
    bad["excursions"] = [x | {"entry_at": at(3)} if k == 2 else x for k, x in enumerate(bad["excursions"])]
    check(spark, types, sound, bad, rules.sequence_rules(1))


def test_structural_rules(spark):
    trade = "signal_id string, opportunity_id string, entry_at timestamp, entry_reference_price double, period string"
    types = {
        "mappings": "signal_id string, source_event_match boolean, mapping_status string, structural_swing_available_at timestamp, structural_swing_event_at timestamp, decision_at timestamp, period string",
        "parents": trade, "v1": trade, "v2": trade,
    }
    m = dict(signal_id="s", source_event_match=True, mapping_status="valid", structural_swing_available_at=at(0), structural_swing_event_at=at(-9), decision_at=at(0), period="p")
    t = dict(signal_id="s", opportunity_id="o", entry_at=at(1), entry_reference_price=1.0, period="p")
    bad = {
        "mappings": broken(m, {"source_event_match": None}, {"mapping_status": None}, {"structural_swing_available_at": at(1)}, {"structural_swing_event_at": at(0)}, {"period": "q"}),
        "parents": [t], "v1": [t | {"entry_at": at(2)}, t | {"signal_id": "lost", "period": "q"}],
        "v2": [t, t | {"period": None}],
    }
    check(spark, types, {"mappings": [m], "parents": [t], "v1": [t], "v2": [t]}, bad, rules.structural_rules("p", ["v1", "v2"]))


def test_coverage_rules(spark):
    types = {"coverage": "model_id string, opportunity_id string, coverage_status string, period string, entry_at timestamp, entry_decision_at timestamp, cutoff_at timestamp, mitigation_bar_at timestamp, coarse_gap_available_at timestamp, fine_gap_available_at timestamp"}
    c = dict(model_id="m", opportunity_id="o", coverage_status="entry", period="p", entry_at=at(5), entry_decision_at=at(5), cutoff_at=at(9), mitigation_bar_at=at(2), coarse_gap_available_at=at(1), fine_gap_available_at=at(3))
    bad = broken(c, {"entry_at": at(4)}, {"entry_at": at(9)}, {"period": "q"}, {"mitigation_bar_at": at(0)}, {"fine_gap_available_at": at(2)})
    check(spark, types, {"coverage": [c]}, {"coverage": bad}, rules.coverage_rules("p"))
    waits = [c | {"coverage_status": "no_gap", "entry_at": at(0)}]
    assert counts({"coverage": frame(spark, types["coverage"], waits)}, rules.coverage_rules("p"))["entry_before_decision"] == 0


def test_primitive_rules(spark):
    event = "symbol string, event_id string, primitive string, opportunity_id string, event_at timestamp, available_at timestamp, atr double, source_swing_available_at timestamp, baseline_feature_available_at timestamp"
    types = {"events": event, "primary": event, "outcomes": "event_year long, entry_at timestamp, available_at timestamp, exit_at timestamp, horizon_minutes long, atr double"}
    e = dict(symbol="X", event_id="e", primitive="liquidity_sweep", opportunity_id="o", event_at=at(0), available_at=at(60), atr=1.0, source_swing_available_at=at(0), baseline_feature_available_at=at(60))
    o = dict(event_year=2024, entry_at=at(60), available_at=at(60), exit_at=at(120), horizon_minutes=60, atr=1.0)
    bad = {
        "events": broken(e, {"event_at": dt.datetime(2023, 1, 1)}, {"atr": 0.0}, {"available_at": at(0)}, {"source_swing_available_at": at(1)}, {"baseline_feature_available_at": at(61)}),
        "primary": [e, e | {"event_id": "lost"}],
        "outcomes": broken(o, {"event_year": None}, {"entry_at": at(59)}, {"exit_at": at(121)}, {"atr": -1.0}),
    }
    check(spark, types, {"events": [e], "primary": [e], "outcomes": [o]}, bad, rules.primitive_rules(2024))


def test_protection_rules(spark):
    trade = "signal_id string, variant_id string, year long, entry_at timestamp, exit_at timestamp, cutoff_at timestamp, entry_reference_price double, stop_price double, target_price double, raw_exit_price double, exit_reason string, protection_activated boolean, protection_active_from timestamp, trigger_observed_at timestamp"
    names = ("primary", "stress", "primary_static", "primary_protected", "stress_static", "stress_protected")
    types = {"mappings": "year long", "valid": "year long"} | dict.fromkeys(names, trade)
    s = dict(signal_id="s", variant_id="static", year=2024, entry_at=at(0), exit_at=at(9), cutoff_at=at(9), entry_reference_price=1.0, stop_price=0.5, target_price=2.0, raw_exit_price=1.0, exit_reason="time", protection_activated=False)
    p = s | dict(variant_id="protected", exit_reason="protected_stop", protection_activated=True, trigger_observed_at=at(3), protection_active_from=at(4))
    y = {"year": 2024}
    sound = {"mappings": [y], "valid": [y], "primary": [s, p], "stress": [s, p], "primary_static": [s], "stress_static": [s], "primary_protected": [p], "stress_protected": [p]}
    late = {"year": 2025, "exit_at": at(10)}
    bad = {
        "mappings": [{"year": None}], "valid": [y],
        "primary": [s | late, p], "stress": [s | late | {"raw_exit_price": 1.1, "exit_reason": "stop", "exit_at": at(11)}],
        "primary_static": [s, s], "stress_static": [s, s], "stress_protected": [p, p],
        "primary_protected": [p | {"entry_at": at(1), "entry_reference_price": 1.2, "stop_price": 0.4, "target_price": 2.1, "protection_active_from": at(2)}, p | {"signal_id": "lost"}, p | {"protection_active_from": None}],
    }
    check(spark, types, sound, bad, rules.protection_rules(2024))


def test_set_needs_its_tables_and_names(spark):
    with pytest.raises(ValueError, match="need tables"):
        rules.check_rules({"selected": spark.range(1)}, rules.filter_rules(2024))
    twice = [rules.Row("a", "n", "true"), rules.Row("a", "n", "false")]
    with pytest.raises(ValueError, match="differ"):
        rules.check_rules({"a": spark.range(1)}, twice)


def test_rules_of_a_table_share_a_pass_and_of_a_key_a_shuffle(spark):
    a, b = spark.range(5), spark.range(3, 9)
    own = [
        rules.Row("a", "r1", "id = 2"), rules.Row("a", "r2", "id > 2"), rules.Count("a", "b", "c"), rules.Unique("a", "u", ("id",)),
        rules.Subset("a", "b", "s", ("id",)), rules.Same("a", "b", "m", ("id",), {"v": ("id", "id")}),
    ]
    out = rules.check_rules({"a": a, "b": b}, own)
    assert {r.invariant: r.failure_count for r in out.collect()} == {
        "r1": 1, "r2": 2, "c": 1, "u": 0, "s": 3, "m_membership": 7, "v": 7
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Range") == 4
