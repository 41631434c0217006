"""Edge rows of the staging models and marts."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stakelens import functions as fn
from stakelens.plans import bi, churn, distortion, marts, quality, staging
from stakelens.schemas import RAW
from stakelens.sources import fx_rates, read_raw
from stakelens.sources.sinks import export_reports, published, replace_table, sync_flags, write_metrics, write_parquet

T0 = datetime(2024, 1, 1)


def table(spark, name, rows):
    fields = RAW[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], RAW[name])


def test_leap_day_age(spark):
    players = table(spark, "players", [
        {"player_id": "a", "signup_ts": datetime(2025, 2, 28), "country": "gb", "date_of_birth": date(2000, 2, 29)},
        {"player_id": "b", "signup_ts": datetime(2025, 3, 1), "country": "ie", "date_of_birth": date(2000, 2, 29)},
        {"player_id": "b", "signup_ts": datetime(2026, 3, 1), "country": "ie", "date_of_birth": date(2000, 2, 29)},
    ])
    got = {r.player_id: (r.age_at_signup, r.country) for r in staging.stg_players(players).collect()}
    assert got == {"a": (24, "GB"), "b": (25, "IE")}


def test_unmapped_currency_counts_at_par(spark):
    payments = table(spark, "payments", [
        {"payment_id": "1", "amount": Decimal("10.00"), "currency": "usd", "ts": T0},
        {"payment_id": "2", "amount": Decimal("10.00"), "currency": "eur", "ts": T0},
        {"payment_id": "2", "amount": Decimal("10.00"), "currency": "eur", "ts": T0},
    ])
    got = {r.payment_id: r.amount_gbp for r in staging.stg_payments(payments, fx_rates(spark)).collect()}
    assert got == {"1": Decimal("10"), "2": Decimal("8.5")}


def test_device_flag_defaults_to_false(spark):
    devices = table(spark, "devices", [{"device_id": d, "is_shared_fraud_ring": v}
                                       for d, v in (("a", None), ("b", True))])
    got = {r.device_id: r.is_shared_fraud_ring for r in staging.stg_devices(devices).collect()}
    assert got == {"a": False, "b": True}


def _rounds(spark, sessions):
    rows = [
        {"round_id": f"{s}{i}", "session_id": s, "player_id": "p", "stake_amount": Decimal(2),
         "payout_amount": Decimal(1), "ts": T0 + timedelta(seconds=at)}
        for s, times in sessions.items() for i, at in enumerate(times)
    ]
    return table(spark, "game_rounds", rows)


def test_sessions_without_rounds_and_bots(spark):
    even, uneven = [5 * i for i in range(101)], [i * i for i in range(101)]
    rounds = _rounds(spark, {"bot": even, "human": uneven, "short": even[:100]})
    sessions = table(spark, "sessions", [
        {"session_id": s, "player_id": "p", "start_ts": T0, "end_ts": T0} for s in ("bot", "human", "short", "empty")
    ])
    stats = marts.session_stats(rounds)
    assert [r.session_id for r in marts.bot_sessions(stats).collect()] == ["bot"]
    activity = marts.session_activity(staging.stg_sessions(sessions), stats)
    got = {r.session_id: (r.round_count, r.net_gaming_revenue) for r in activity.collect()}
    assert got["empty"] == (0, 0) and got["human"] == (101, 101)
    payments = staging.stg_payments(table(spark, "payments", []), fx_rates(spark))
    day = marts.player_daily_activity(activity, payments).collect()
    assert len(day) == 1 and day[0].session_count == 3 and day[0].deposits_gbp == 0


def test_sliced_session_stats(spark):
    rounds = _rounds(spark, {"bot": [5 * i for i in range(101)], "human": [i * i for i in range(101)]})
    plain = marts.session_stats(rounds).collect()
    cut = marts.session_stats(rounds, width=60).collect()
    key = lambda r: (r.session_id, r.rounds, r.stake, round(r.stddev_gap_seconds, 6), r.is_bot)
    assert sorted(map(key, plain)) == sorted(map(key, cut))


@pytest.fixture
def small_world(spark):
    players = staging.stg_players(table(spark, "players", [
        {"player_id": p, "signup_ts": T0 - timedelta(days=9), "country": "GB", "currency": "GBP"} for p in "abcd"
    ]))
    history = staging.stg_player_attribute_history(table(spark, "player_attribute_history", [
        {"player_id": "a", "effective_ts": T0, "self_exclusion_status": "none", "risk_segment": "low"},
        {"player_id": "a", "effective_ts": T0 + timedelta(days=2), "self_exclusion_status": "self_excluded",
         "risk_segment": "high"},
        {"player_id": "b", "effective_ts": T0 + timedelta(days=9), "self_exclusion_status": "none"},
    ]))
    daily = spark.createDataFrame(
        [(p, T0 + timedelta(days=d), 1, Decimal(1), Decimal(1), Decimal(0), Decimal(0))
         for p, d in (("a", 0), ("b", 1), ("b", 30), ("c", 2))],
        "player_id string, activity_date timestamp, session_count long, total_stake decimal(18,2),"
        " net_gaming_revenue decimal(18,2), deposits_gbp decimal(18,2), withdrawals_gbp decimal(18,2)",
    )
    return players, marts.dim_players_scd2(history, players), daily


def test_churn_is_three_valued_about_exclusion(small_world):
    players, dim, daily = small_world
    got = {r.player_id: r for r in marts.churn_labels(daily, dim, players).collect()}
    assert set(got) == {"a", "b", "c"}, "a player without activity has no label"
    assert got["a"].observation_date == T0 + timedelta(days=2)
    assert got["a"].is_self_excluded_as_of is True, "effective exactly at the observation date"
    assert got["b"].is_self_excluded_as_of is None and got["b"].self_exclusion_status_as_of == "none"
    assert (got["a"].is_churned, got["b"].is_churned, got["c"].is_churned) == (True, False, True)
    kinds = {r.population: r.players for r in bi.churn_composition(marts.churn_labels(daily, dim, players)).collect()}
    assert kinds == {"Self-excluded": 1}


def test_ltv_keeps_players_without_activity(small_world):
    players, _, daily = small_world
    got = {r.player_id: r for r in marts.player_ltv(players, daily).collect()}
    assert got["d"].ltv_gbp is None and got["d"].lifetime_days is None
    assert got["b"].lifetime_days == 30


def test_dim_has_one_current_row_per_player(small_world):
    _, dim, _ = small_world
    rows = dim.groupBy("player_id").agg(F.count_if("is_current").alias("n")).collect()
    assert {r.n for r in rows} == {1}
    assert dim.select("player_dimension_key").distinct().count() == 3
    assert quality.overlapping_periods(dim, "player_id").count() == 0


def test_overlaps_are_found(spark):
    day = lambda n: T0 + timedelta(days=n)
    periods = spark.createDataFrame(
        [("a", day(0), day(9)), ("a", day(1), day(2)), ("a", day(5), day(6)), ("a", day(9), None), ("b", day(0), None),
         ("b", day(3), day(4))],
        "player_id string, valid_from timestamp, valid_to timestamp",
    )
    found = sorted((r.player_id, r.valid_from) for r in quality.overlapping_periods(periods, "player_id").collect())
    assert found == [("a", day(1)), ("a", day(5)), ("b", day(3))]
    cut = sorted((r.player_id, r.valid_from)
                 for r in quality.overlapping_periods(periods, "player_id", width=86_400).collect())
    assert cut == found


def test_the_history_is_exchanged_once_for_the_dimension(spark, tmp_path):
    """Its rows and their summaries per slice are read from one exchange."""
    rows = [{"player_id": p, "effective_ts": T0 + timedelta(days=400 * n), "vip_tier": f"t{n}"}
            for p in ("a", "b", None) for n in range(4)]
    table(spark, "player_attribute_history", rows).write.parquet(f"{tmp_path}/h")
    table(spark, "players", [{"player_id": p, "signup_ts": T0} for p in ("a", "b")]).write.parquet(f"{tmp_path}/p")
    history = staging.stg_player_attribute_history(spark.read.parquet(f"{tmp_path}/h"))
    dim = marts.dim_players_scd2(history, staging.stg_players(spark.read.parquet(f"{tmp_path}/p")))
    got = sorted((r.player_id, r.vip_tier, r.valid_to) for r in dim.collect())
    ends = [*[T0 + timedelta(days=400 * n) for n in (1, 2, 3)], None]
    assert got == [(p, f"t{n}", ends[n]) for p in ("a", "b") for n in range(4)]
    plan = dim._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_fraud_summary_joins_once(spark):
    """Labels and flags of no scenario, flags of unlabelled types and of players: as counted by hand, from one join."""
    truth = table(spark, "fraud_ground_truth", [
        {"entity_type": t, "entity_id": e, "scenario_type": s} for t, e, s in (
            ("payment", "1", "x"), ("payment", "2", "x"), ("login", "3", "x"), ("payment", "4", None), ("player", "p", "x"),
            ("payment", None, "y"))])
    flags = table(spark, "streaming_fraud_flags", [
        {"flag_id": str(n), "entity_type": t, "entity_id": e, "scenario_type": s, "triggering_event_ts": T0,
         "detected_ts": T0 + timedelta(seconds=n)} for n, (t, e, s) in enumerate((
             ("payment", "1", "x"), ("payment", "1", "x"), ("payment", "9", "x"), ("player", "p", "x"), ("payment", "4", None),
             ("payment", None, "y"), ("session", "7", "z")))])
    found = marts.fraud_summary(truth, staging.stg_streaming_fraud_flags(flags))
    got = {(r.scenario_type, r.entity_type): (*tuple(r)[2:5], r.avg_detection_latency_seconds) for r in found.collect()}
    assert got == {
        ("x", "payment"): (2, 2, 2, 0.5), ("x", "login"): (1, 0, 2, None),
        (None, "payment"): (1, 0, 0, None), ("y", "payment"): (0, 0, 1, None),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_fraud_summary_counts(spark):
    truth = staging.stg_fraud_ground_truth(table(spark, "fraud_ground_truth", [
        {"entity_type": "payment", "entity_id": "1", "scenario_type": "card_testing", "injected_ts": T0},
        {"entity_type": "payment", "entity_id": "1", "scenario_type": "card_testing", "injected_ts": T0},
        {"entity_type": "payment", "entity_id": "2", "scenario_type": "card_testing", "injected_ts": T0},
        {"entity_type": "login", "entity_id": "3", "scenario_type": "account_takeover", "injected_ts": T0},
        {"entity_type": "player", "entity_id": "p", "scenario_type": "card_testing", "injected_ts": T0},
    ]))
    flag = {"scenario_type": "card_testing", "entity_type": "payment", "triggering_event_ts": T0}
    flags = staging.stg_streaming_fraud_flags(table(spark, "streaming_fraud_flags", [
        {**flag, "flag_id": "x", "entity_id": "1", "detected_ts": T0 + timedelta(seconds=1)},
        {**flag, "flag_id": "y", "entity_id": "1", "detected_ts": T0 + timedelta(seconds=2)},
        {**flag, "flag_id": "z", "entity_id": "9", "detected_ts": T0 + timedelta(seconds=3)},
    ]))
    got = {r.scenario_type: r for r in marts.fraud_summary(truth, flags).collect()}
    card, login = got["card_testing"], got["account_takeover"]
    assert (card.ground_truth_count, card.true_positive_count, card.false_positive_count) == (2, 2, 1)
    assert card.recall == 1.0 and card.avg_detection_latency_seconds == 1.5
    assert login.recall == 0.0 and login.avg_detection_latency_seconds is None and login.false_positive_count == 0


def test_expectations_ignore_nulls_and_count_whole_groups(spark):
    from stakelens.operators.expect import at_least, expect, in_set, not_null, unique

    df = spark.createDataFrame([("a", "x", 1), ("a", "y", -1), ("b", None, None), (None, "z", 0), (None, "x", 0)],
                               "id string, kind string, n int")
    report = {r.expectation: r for r in expect(df, "t", [
        not_null("id"), unique("id"), in_set("kind", ["x", "y"]), at_least("n", 0), at_least("n", 0, strict=True),
    ]).collect()}
    bad = {k: r.unexpected_count for k, r in report.items()}
    assert bad == {"not_null(id)": 2, "unique(id)": 2, "in_set(kind)": 1, "at_least(n, 0)": 1, "above(n, 0)": 3}
    assert report["unique(id)"].unexpected_percent == 40.0 and report["in_set(kind)"].sample_min == "z"
    with pytest.raises(quality.QualityGateError, match="in_set"):
        quality.enforce(expect(df, "t", [in_set("kind", ["x", "y"])]))
    empty = expect(df.limit(0), "t", [not_null("id"), unique("id")])
    assert all(r.success and r.unexpected_percent == 0.0 for r in empty.collect())


def test_split_is_exact_and_metrics_match_brute_force(spark):
    rows = [(i, int(i % 7 == 0), round((i * 37 % 100) / 100, 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label int, score double")
    for widths in ({}, {"width": 1e-3}):
        split = churn.stratified_split(df, "label", "id", **({"width": 2.0**58} if widths else {}))
        sizes = {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
        assert sizes == {(0, True): 86, (0, False): 256, (1, True): 15, (1, False): 43}
        got = churn.score_metrics(df, **widths).first()
        pos = [s for _, y, s in rows if y]
        neg = [s for _, y, s in rows if not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        steps, seen = 0.0, 0
        for t in sorted({s for _, _, s in rows}, reverse=True):
            above = [y for _, y, s in rows if s >= t]
            steps += (sum(above) - seen) / len(pos) * sum(above) / len(above)
            seen = sum(above)
        assert got.auc == pytest.approx(auc) and got.average_precision == pytest.approx(steps)
        chosen = [y for _, y, s in rows if s >= 0.5]
        assert got.precision == pytest.approx(sum(chosen) / len(chosen))
        assert got.recall == pytest.approx(sum(chosen) / len(pos))


def test_money_does_not_drift(spark):
    payments = table(spark, "payments", [{"payment_id": str(i), "amount": Decimal("0.10")} for i in range(1000)])
    row = distortion.money_sum(payments).first()
    assert row.exact_total == Decimal("100.00")
    assert distortion.bonus_average(spark.createDataFrame([(Decimal(3),), (None,)], "bonus_amount decimal(18,2)")
                                    ).first().avg_bonus == 1.5


def test_day_of_wall_clock_time_in_a_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 0, 30), "Europe/Stockholm")], "ts timestamp, zone string")
    row = df.select(fn.day_in_utc("ts").alias("utc"), fn.day_in_utc("ts", F.col("zone")).alias("local")).first()
    assert (row.utc, row.local) == (date(2024, 7, 1), date(2024, 6, 30))


def test_raw_reader_casts_and_skips(spark, tmp_path):
    first, second = tmp_path / "a", tmp_path / "b"
    spark.sql("select 'd1' as device_id, timestamp_ntz '2024-01-01 10:00:00' as first_seen_ts, 'iOS' as os"
              ).write.parquet(f"{second}/devices.parquet")
    first.mkdir()
    got = read_raw(spark, [str(first), str(second)], "devices")
    assert got.schema == RAW["devices"]
    row = got.first()
    assert row.first_seen_ts == datetime(2024, 1, 1, 10) and row.player_id is None
    assert read_raw(spark, [str(first)], "players") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    replace_table(df, "replaced")
    replace_table(df.withColumn("more", F.lit(True)), "replaced")
    assert spark.table("replaced").columns == ["n", "s", "more"]
    write_metrics(df, f"{tmp_path}/metrics")
    assert len(list((tmp_path / "metrics").glob("part-*.json"))) == 1
    export_reports(spark, {"one": df, "two": df}, f"{tmp_path}/reports")
    assert sorted(r.report for r in published(spark, f"{tmp_path}/reports").collect()) == ["one", "two"]
    flags = table(spark, "streaming_fraud_flags", [{"flag_id": "x"}])
    assert sync_flags(flags, f"{tmp_path}/flags") and not sync_flags(flags.limit(0), f"{tmp_path}/flags")
    assert spark.read.parquet(f"{tmp_path}/flags").count() == 1, "an empty store leaves the copy alone"
    write_parquet(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1
