"""The stateful jobs over several micro-batches must raise what the batch rules raise."""

from __future__ import annotations

import json
import os
import random
from collections import Counter
from datetime import timedelta

import pytest
from event_data import START, collected, frame, make, registry
from pyspark.sql import functions as F
from test_rules import SETTINGS, SINCE

from stakelens.plans import rules
from stakelens.sources import event_stream, fx_rates
from stakelens.sources.events import from_messages, message_stream
from stakelens.sources.replay import replay_stream, write_slices
from stakelens.streaming import detector
from stakelens.streaming.processors import SECOND, InOrder, PlayerRules
from stakelens.streaming.rule import Rule

PLAYER = PlayerRules(card_window_seconds=1800, pending_seconds=7200, structuring_window_seconds=3600)


def publish(folder, events, name, order):
    """One file of JSON messages; files are read in the order of their modification times."""
    fields = [c for c in events[0] if c not in ("seq", "amount_gbp")]
    path = folder / f"{name}.json"
    with open(path, "w") as out:
        for e in events:
            body = {c: e[c] for c in fields if e[c] is not None}
            body["ts"] = e["ts"].isoformat()  # no offset: UTC
            if "amount" in body:
                body["amount"] = float(body["amount"])
            out.write(json.dumps(body) + "\n")
    os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))


def in_pieces(folder, events, pieces):
    """Split by time without cutting through one instant."""
    instants = sorted({e["ts"] for e in events})
    size = -(-len(instants) // pieces)
    for n in range(pieces):
        chosen = set(instants[n * size:(n + 1) * size])
        publish(folder, [e for e in events if e["ts"] in chosen], f"part{n}", n)


def tick(folder, at, order, delay=timedelta(minutes=10)):
    """A last message that lets the watermark pass ``at``."""
    path = folder / f"tick{order}.json"
    path.write_text(json.dumps({"event_type": "tick", "ts": (at + delay + timedelta(milliseconds=2)).isoformat()}))
    os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))


@pytest.fixture
def topic(tmp_path):
    folder = tmp_path / "topic"
    folder.mkdir()
    return folder


def detect(spark, topic, tmp_path, name="out"):
    events = event_stream(spark, str(topic), fx_rates(spark), maxFilesPerTrigger="1")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # few keys
    jobs = detector.run_detector(
        events, registry(spark, SINCE), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", once=True,
        player=PLAYER, ring=SETTINGS["bonus_ring"], session=SETTINGS["bot_betting"],
    )
    spark.conf.set("spark.sql.shuffle.partitions", before)  # running streams keep theirs
    for job in jobs:
        job.awaitTermination()
    return detector.read_flags(spark, f"{tmp_path}/{name}")


def test_stream_equals_batch_over_micro_batches(spark, topic, tmp_path):
    events = make(2)
    in_pieces(topic, events, 4)
    tick(topic, max(e["ts"] for e in events), 4)
    flags = detect(spark, topic, tmp_path)
    want = collected(rules.run_rules(frame(spark, events), registry(spark, SINCE), SETTINGS))
    assert collected(flags) == want and len({w[0] for w in want}) == 6
    assert flags.select("job", "batch_id").distinct().count() > 4
    # Copies of one event raise copies of one flag, so they share an id.
    assert flags.select("flag_id").distinct().count() == len(set(want))


@pytest.mark.parametrize("seed", [30, 32])
def test_order_of_arrival_does_not_matter_within_the_watermark(spark, topic, tmp_path, seed):
    """Each event arrives up to nine minutes late, so batches overlap and cut through instants."""
    rng = random.Random(seed)
    events = make(seed, n=400, minutes=300)
    arrived = sorted(events, key=lambda e: e["ts"] + timedelta(seconds=rng.uniform(0, 540)))
    assert [e["ts"] for e in arrived] != sorted(e["ts"] for e in arrived)
    for n in range(8):
        publish(topic, arrived[n * len(arrived) // 8:(n + 1) * len(arrived) // 8], f"part{n}", n)
    tick(topic, max(e["ts"] for e in events), 8)
    want = collected(rules.run_rules(frame(spark, events), registry(spark, SINCE), SETTINGS))
    assert collected(detect(spark, topic, tmp_path)) == want and len({w[0] for w in want}) == 6


def test_replay_is_bounded_and_in_order(spark, tmp_path):
    events = frame(spark, make(33, n=300))
    write_slices(events, f"{tmp_path}/slices", rows=20)
    seen = []
    replay_stream(spark, f"{tmp_path}/slices").writeStream.foreachBatch(
        lambda batch, _: seen.append([(r.ts, r.event_type) for r in batch.collect()])).option(
        "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) > 15 and max(map(len, seen)) <= 20
    assert all(max(a)[0] <= min(b)[0] for a, b in zip(seen, seen[1:], strict=False))
    assert sum(map(len, seen)) == events.count() + 1 and seen[-1][0][1] == "tick"
    write_slices(events.limit(0), f"{tmp_path}/none")


def test_restart_goes_on_where_it_stopped(spark, topic, tmp_path):
    events = sorted(make(22, n=200), key=lambda e: e["ts"])
    middle = events[100]["ts"]
    publish(topic, [e for e in events if e["ts"] < middle], "first", 0)
    detect(spark, topic, tmp_path)
    publish(topic, [e for e in events if e["ts"] >= middle], "second", 1)
    tick(topic, events[-1]["ts"], 2)
    flags = detect(spark, topic, tmp_path)
    assert collected(flags) == collected(rules.run_rules(frame(spark, events), registry(spark, SINCE), SETTINGS))


def test_events_behind_the_watermark_are_dropped(spark, topic, tmp_path):
    """A deposit an hour late would complete three BINs in a window that has already been given up."""
    def deposit(i, minute, card_bin):
        e = next(e for e in make(1) if e["payment_type"] == "deposit")
        return {**e, "entity_id": f"late{i}", "player_id": "p", "card_bin": card_bin,
                "ts": START + timedelta(minutes=minute)}
    publish(topic, [deposit(0, 0, "a"), deposit(1, 1, "b"), deposit(2, 300, "c")], "first", 0)
    publish(topic, [deposit(3, 301, "c")], "second", 1)
    publish(topic, [deposit(4, 2, "z")], "third", 2)
    events = event_stream(spark, str(topic), fx_rates(spark), maxFilesPerTrigger="1")
    tick(topic, START + timedelta(minutes=301), 3)
    flags = detector.player_flags(events, PLAYER)
    detector.write_flags(flags, f"{tmp_path}/o", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    found = [r.entity_id for r in spark.read.parquet(f"{tmp_path}/o").filter("scenario_type = 'card_testing'").collect()]
    assert found == []


def test_archive_is_partitioned_and_compressed(spark, topic, tmp_path):
    events = make(23, n=60)
    in_pieces(topic, events, 2)
    stream = event_stream(spark, str(topic), fx_rates(spark), maxFilesPerTrigger="1")
    detector.archive_events(stream, f"{tmp_path}/a", f"{tmp_path}/s").trigger(
        availableNow=True).start().awaitTermination()
    files = list((tmp_path / "a").glob("year=2024/month=03/day=*/*.json.gz"))
    assert files and spark.read.json(f"{tmp_path}/a").count() == len(events)


def test_retries_are_dropped_on_request(spark, topic, tmp_path):
    events = make(24, n=120)
    in_pieces(topic, events, 3)
    stream = event_stream(spark, str(topic), fx_rates(spark), maxFilesPerTrigger="1")
    once = detector.without_retries(stream, "1 day")
    once.writeStream.format("parquet").option("path", f"{tmp_path}/o").option(
        "checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/o")
    assert got.count() == 120 < len(events)
    assert got.filter(F.col("event_type") == "login").select("entity_id").distinct().count() == \
        got.filter(F.col("event_type") == "login").count()


def test_messages_that_are_no_events_are_set_aside(spark):
    from stakelens.sources.events import from_messages, rejected_messages
    from stakelens.sources.raw import fx_rates

    good = '{"event_type": "login", "ts": "2024-01-01T00:00:00Z"}'
    bad = ["{", '{"event_type": "login", "ts": "yesterday"}', '{"event_type": "walk", "ts": "2024-01-01T00:00:00Z"}', "null", None]
    messages = spark.createDataFrame([(m,) for m in [good, *bad]], "value string")
    assert from_messages(messages, fx_rates(spark)).count() == 1
    got = {r.message: r.reason for r in rejected_messages(messages).collect()}
    assert got == {"{": "no event", bad[1]: "no time", bad[2]: "unknown event type", "null": "no event", None: "no event"}


def test_the_detector_keeps_messages_that_are_no_events(spark, topic, tmp_path):
    publish(topic, make(3, n=7)[:7], "good", 0)
    (topic / "bad.json").write_text('{\n{"event_type": "walk", "ts": "2024-01-01T00:00:00Z"}\n{"event_type": "login"}\n')
    messages = message_stream(spark, str(topic), maxFilesPerTrigger="1")
    for job in detector.run_detector(
            from_messages(messages, fx_rates(spark)), registry(spark, SINCE), f"{tmp_path}/o", f"{tmp_path}/s", once=True,
            messages=messages):
        job.awaitTermination()
    assert sorted(r.reason for r in detector.read_rejects(spark, f"{tmp_path}/o").collect()) == [
        "no event", "no time", "unknown event type"]


def test_windows_are_upserted_and_forgotten(spark, topic, tmp_path):
    events = make(35, n=300)
    in_pieces(topic, events, 3)
    stream = event_stream(spark, str(topic), fx_rates(spark), maxFilesPerTrigger="1")
    windows = detector.rolling_large_deposits(stream, window="1 hour", slide="1 hour", at_least=1)
    query = detector.write_windows(windows, f"{tmp_path}/w", f"{tmp_path}/s").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.player_id, r.window_start): r.deposits for r in detector.read_windows(spark, f"{tmp_path}/w").collect()}
    want = Counter((e["player_id"], e["ts"].replace(minute=0)) for e in events
                   if e["payment_type"] == "deposit" and e["amount_gbp"] >= 9000)
    assert got == want
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert held[-1] < len(want), "windows behind the watermark stay in state"


def test_keys_share_the_state_of_a_bucket(spark, topic, tmp_path):
    """Rows in state, and so round trips to it, go by the number of buckets, not by that of keys."""
    events = make(37, n=300)
    events += [{**e, "session_id": None} for e in events if e["event_type"] == "game_round"][::3]
    in_pieces(topic, events, 3)
    tick(topic, max(e["ts"] for e in events), 3)
    stream = event_stream(spark, str(topic), fx_rates(spark), maxFilesPerTrigger="1")
    flags = detector.session_flags(stream, **SETTINGS["bot_betting"], buckets=1)
    query = detector.write_flags(flags, f"{tmp_path}/o/job=session", f"{tmp_path}/s").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len({e["session_id"] for e in events}) > 3
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 20
    want = rules.run_rules(frame(spark, events), registry(spark, SINCE), SETTINGS).filter("scenario_type = 'bot_betting'")
    assert collected(detector.read_flags(spark, f"{tmp_path}/o")) == collected(want)


def test_a_bucket_forgets_quiet_keys(spark, topic, tmp_path):
    """Each session's rounds lie hours after those of the one before, so a bucket of them all remembers few."""
    rounds = [e for e in make(38, n=300) if e["event_type"] == "game_round"][:12]
    events = [{**e, "session_id": f"s{i}", "ts": START + timedelta(hours=9 * i)} for i, e in enumerate(rounds)]
    in_pieces(topic, events, len(events))
    tick(topic, events[-1]["ts"], len(events))
    tick(topic, events[-1]["ts"] + timedelta(hours=9), len(events) + 1)
    stream = event_stream(spark, str(topic), fx_rates(spark), maxFilesPerTrigger="1")
    flags = detector.session_flags(stream, buckets=1)
    query = detector.write_flags(flags, f"{tmp_path}/o", f"{tmp_path}/s").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1] == 0


def hasty_rule():
    # A class in a function travels to the workers by value.
    class Hasty(InOrder):
        """Every third withdrawal of a player without an hour between two of them."""

        columns = ("player_id", "payment_type")
        quiet_us = 3600 * SECOND

        def begin(self):
            return [0]

        def step(self, memory, e):
            if e.payment_type == "withdrawal":
                memory[0] += 1
                if memory[0] % 3 == 0:
                    yield "hasty", "payment", e.entity_id, e.player_id, e.us, e.us, e.entity_id

    return Rule("hasty", ("payment",), ("player_id",), Hasty())


def test_a_further_rule_runs_on_tables_and_streams(spark, topic, tmp_path):
    rng = random.Random(9)
    events = make(36, n=500)
    rule = hasty_rule()
    want, seen = [], {}
    for e in sorted(events, key=lambda e: (e["ts"], e["seq"], e["entity_id"])):
        if e["event_type"] == "payment":
            last, n = seen.get(e["player_id"], (e["ts"], 0))
            n = (0 if e["ts"] - last > timedelta(hours=1) else n) + (e["payment_type"] == "withdrawal")
            seen[e["player_id"]] = (e["ts"], n)
            if e["payment_type"] == "withdrawal" and n % 3 == 0:
                want.append(("hasty", "payment", e["entity_id"], e["player_id"], e["ts"], e["ts"], e["entity_id"]))
    got = rules.run_rules(frame(spark, events), registry(spark, SINCE), SETTINGS, (*rules.KEYED_RULES, rule.batch))
    assert collected(got.filter("scenario_type = 'hasty'")) == sorted(want, key=str) and len(want) > 5
    arrived = sorted(events, key=lambda e: e["ts"] + timedelta(seconds=rng.uniform(0, 540)))
    for n in range(3):
        publish(topic, arrived[n * len(arrived) // 3:(n + 1) * len(arrived) // 3], f"part{n}", n)
    tick(topic, max(e["ts"] for e in events), 3)
    stream = event_stream(spark, str(topic), fx_rates(spark), maxFilesPerTrigger="1")
    for job in detector.run_detector(stream, registry(spark, SINCE), f"{tmp_path}/o", f"{tmp_path}/s", once=True, further=[rule]):
        job.awaitTermination()
    found = detector.read_flags(spark, f"{tmp_path}/o").filter("scenario_type = 'hasty'")
    assert collected(found) == sorted(want, key=str)
