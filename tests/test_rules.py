from __future__ import annotations

from datetime import datetime, timedelta

import machine
import pytest
from event_data import START, collected, frame, make, registry

from stakelens.plans import rules

SINCE = {"hot": START + timedelta(hours=4), "p1": START + timedelta(hours=1)}
SETTINGS = {
    "card_testing": {"window_seconds": 1800, "min_bins": 3},
    "bonus_ring": {"gap_seconds": 1800},
    "account_takeover": {"pending_seconds": 7200},
    "bot_betting": {"min_gaps": 3, "max_sd": 200.0, "ttl_seconds": 1800},
    "structuring": {"window_seconds": 3600},
}
MACHINE = dict(window=1800, bins=3, ring=1800, pending=7200, gaps=3, sd=200.0, ttl=1800, span=3600)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("width", [None, 900])
def test_rules_agree_with_event_at_a_time(spark, seed, width):
    """The same flags must come out of slices of a quarter of an hour."""
    events = make(seed)
    settings = {name: {**s, **({"width": width} if width else {})} for name, s in SETTINGS.items()}
    got = collected(rules.run_rules(frame(spark, events), registry(spark, SINCE), settings))
    want = machine.run(events, SINCE, **MACHINE)
    assert got == want
    assert len({w[0] for w in want}) == 6, "every rule should fire on this data"


@pytest.mark.parametrize("bins", [1, 2, 4])
def test_card_testing_any_number_of_bins(spark, bins):
    events = make(3, n=300)
    got = collected(rules.card_testing(frame(spark, events), 1800, bins))
    assert got == [f for f in machine.run(events, {}, window=1800, bins=bins) if f[0] == "card_testing"]


def test_structuring_three_deposits(spark):
    events = make(4, n=300)
    got = collected(rules.structuring(frame(spark, events), window_seconds=7200, min_deposits=3))
    assert got == [f for f in machine.run(events, {}, span=7200, deposits=3) if f[0] == "structuring"]


def test_known_devices_are_forgotten(spark):
    """A history longer than the memory of known devices: the list starts anew after a quiet spell."""
    events = make(5, n=1500, minutes=60 * 24 * 40)
    got = collected(rules.account_takeover(frame(spark, events), pending_seconds=86400 * 9, known_ttl_days=6))
    want = [f for f in machine.run(events, {}, pending=86400 * 9, known_days=6) if f[0] == "account_takeover"]
    without = [f for f in machine.run(events, {}, pending=86400 * 9) if f[0] == "account_takeover"]
    assert got == want != without


def _event(kind, i, seconds, **fields):
    base = dict.fromkeys(frame_columns())
    seq = {"login": 0, "payment": 1, "bonus_claim": 2, "game_round": 3}[kind]
    ts = datetime(2024, 1, 1) + timedelta(seconds=seconds)
    return {**base, "event_type": kind, "entity_id": f"e{i}", "player_id": "p", "seq": seq, "ts": ts, **fields}


def frame_columns():
    from stakelens.schemas import EVENT

    return EVENT.fieldNames()


def test_window_ends_are_inclusive(spark):
    deposit = dict(payment_type="deposit", amount_gbp=10, device_id="d")
    def bins(last):
        return [
            _event("payment", 0, 0, card_bin="a", **deposit), _event("payment", 1, 5, card_bin="b", **deposit),
            _event("payment", 2, last, card_bin="c", **deposit),
        ]
    for last, flags in ((600, 1), (601, 0)):
        events = [{**e, "amount_gbp": None} for e in bins(last)]
        assert rules.card_testing(frame(spark, events)).count() == flags


def test_bot_needs_a_hundred_gaps(spark):
    def session(rounds):
        return [_event("game_round", i, 5 * i, session_id="s") for i in range(rounds)]
    assert rules.bot_betting(frame(spark, session(100))).count() == 0
    assert rules.bot_betting(frame(spark, session(101))).count() == 1


def test_ring_memory_is_exclusive_after_six_hours(spark):
    def claims(gap):
        return [
            _event("bonus_claim", 0, 0, device_id="d", bonus_type="welcome", player_id="a"),
            _event("bonus_claim", 1, gap, device_id="d", bonus_type="welcome", player_id="b"),
        ]
    assert rules.bonus_ring(frame(spark, claims(6 * 3600))).count() == 1
    assert rules.bonus_ring(frame(spark, claims(6 * 3600 + 1))).count() == 0


def test_no_geography_means_every_login_is_new(spark):
    base = dict(player_id="p")
    events = [
        _event("login", 0, 0, device_id="d1", country_from_ip=None, **base),
        _event("login", 1, 60, device_id="d2", country_from_ip=None, **base),
        _event("payment", 2, 120, device_id="d2", payment_type="withdrawal", **base),
        _event("payment", 3, 180, device_id="d2", payment_type="withdrawal", **base),
    ]
    flags = collected(rules.account_takeover(frame(spark, events)))
    assert [f[2] for f in flags] == ["e1", "e2"], "the login and the first withdrawal only"


def test_detection_stamp_is_repeatable(spark):
    flags = rules.run_rules(frame(spark, make(1)), registry(spark, SINCE), SETTINGS)
    first, second = (sorted(map(tuple, rules.stamp_detection(flags).collect()), key=str) for _ in range(2))
    assert first == second
    late = rules.stamp_detection(flags).selectExpr("unix_micros(detected_ts) - unix_micros(triggering_event_ts) as d")
    assert late.filter("d < 200000").count() == 0


def test_own_rules_join_the_others(spark):
    def every_bonus(events, minimum=1):
        return rules._flags(events.filter("event_type = 'bonus_claim'"), "every_bonus", "bonus_claim")

    events = make(1, n=80)
    flags = rules.run_rules(frame(spark, events), registry(spark, SINCE), rules=[every_bonus])
    kinds = {r.scenario_type: r["count"] for r in flags.groupBy("scenario_type").count().collect()}
    assert kinds["every_bonus"] == sum(e["event_type"] == "bonus_claim" for e in events)
