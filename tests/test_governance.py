from __future__ import annotations

import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from test_models import T0, table

from stakelens.plans import governance as gov
from stakelens.plans.warehouse import RawTables
from stakelens.sources.versions import ConcurrentCommitError, TableSet

SALT = "pepper"


@pytest.fixture
def store(spark, tmp_path):
    frames = {
        "players": table(spark, "players", [
            {"player_id": p, "signup_ts": T0, "date_of_birth": date(1990, 1, 1)} for p in "abc"]),
        "sessions": table(spark, "sessions", [
            {"session_id": str(i), "player_id": p, "ip_address": ip}
            for i, (p, ip) in enumerate([("a", "1.1.1.1"), ("a", "1.1.1.1"), ("a", "2.2.2.2"), ("b", "1.1.1.1"),
                                         ("a", None)])]),
        "login_events": table(spark, "login_events", [
            {"login_id": "1", "player_id": "a", "ip_address": "1.1.1.1", "ts": T0}]),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _ask(spark, *players):
    return spark.createDataFrame([(p,) for p in players], "player_id string")


def digest(value):
    return "erased:" + hashlib.sha256(f"{SALT}:{value}".encode()).hexdigest()[:32]


def seen(spark, store):
    """What a reader of the set sees: sessions, logins, births, and how many audit records."""
    raw = RawTables(spark, store)
    log = gov.audit_log(spark, store).count() if TableSet(spark, store).version()[0] else 0
    return (
        sorted(((r.session_id, r.player_id, r.ip_address) for r in raw.sessions.collect()), key=str),
        [r.ip_address for r in raw.login_events.collect()],
        {r.player_id: r.date_of_birth for r in raw.players.collect()}, log)


one, two, BORN = digest("1.1.1.1"), digest("2.2.2.2"), date(1990, 1, 1)
BEFORE = ([("0", "a", "1.1.1.1"), ("1", "a", "1.1.1.1"), ("2", "a", "2.2.2.2"), ("3", "b", "1.1.1.1"), ("4", "a", None)],
          ["1.1.1.1"], {"a": BORN, "b": BORN, "c": BORN}, 0)
AFTER = ([("0", "a", one), ("1", "a", one), ("2", "a", two), ("3", "b", "1.1.1.1"), ("4", "a", None)],
         [one], {"a": None, "b": BORN, "c": BORN}, 1)


def test_erasure_is_complete_and_idempotent(spark, store, tmp_path):
    assert seen(spark, store) == BEFORE
    gov.run_erasure(spark, store, _ask(spark, "a", "a"), SALT, "2024-02-29 10:00:00")
    assert seen(spark, store) == AFTER
    gov.run_erasure(spark, store, _ask(spark, "a"), SALT, "2024-03-01 10:00:00")
    assert seen(spark, store) == (*AFTER[:3], 2)
    log = gov.audit_log(spark, store).orderBy("processed_at").collect()
    assert log[0].player_id_pseudonym == digest("a")
    assert log[0].retention_expires_at == date(2029, 2, 28), "five years from a leap day"
    assert json.loads(log[0].pseudonymised_fields)["players"] == ["date_of_birth"]
    assert set(json.loads(log[0].retained_tables)) == set(gov.RETAINED_TABLES)
    assert spark.read.parquet(f"{store}/sessions.parquet").count() == 5, "no copy of the identifiers stays behind"
    assert len(list((tmp_path / "_versions").glob("*.json"))) == 1 and not list(tmp_path.glob("_staged*"))


def test_only_files_of_requested_players_are_rewritten(spark, store, tmp_path):
    spark.read.parquet(f"{store}/players.parquet").repartitionByRange(3, "player_id").write.parquet(f"{tmp_path}/cut/players.parquet")
    for name in ("sessions", "login_events"):
        spark.read.parquet(f"{store}/{name}.parquet").write.parquet(f"{tmp_path}/cut/{name}.parquet")
    def files():
        return {p.name for p in (tmp_path / "cut/players.parquet").glob("*.parquet")}
    before = files()
    assert len(before) == 3
    gov.run_erasure(spark, f"{tmp_path}/cut", _ask(spark, "b"), SALT)
    assert len(before & files()) == 2 and RawTables(spark, f"{tmp_path}/cut").players.count() == 3


STEPS = ["clean", "files_with", "add", "commit", "_point"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("call", [1, 2, 4])
def test_a_crash_leaves_all_or_nothing(spark, store, monkeypatch, step, call):
    """Die at the n-th call of a step, look, and run again."""
    real, calls = getattr(TableSet, step), []

    def dying(self, *args):
        calls.append(1)
        if len(calls) == call:
            raise KeyboardInterrupt
        return real(self, *args)

    monkeypatch.setattr(TableSet, step, dying)
    try:
        gov.run_erasure(spark, store, _ask(spark, "a"), SALT)
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    state = seen(spark, store)
    assert state in (BEFORE, AFTER)
    gov.run_erasure(spark, store, _ask(spark, "a"), SALT)
    assert seen(spark, store) == (*AFTER[:3], state[3] + 1)
    assert spark.read.parquet(f"{store}/sessions.parquet").count() == 5


def test_an_unfinished_pointer_is_none_and_two_writers_collide(spark, store, tmp_path):
    gov.run_erasure(spark, store, _ask(spark, "a"), SALT)
    (tmp_path / "_versions/2.json").write_text('{"fil')
    assert seen(spark, store) == AFTER
    tables = TableSet(spark, store)
    assert tables.version()[0] == 1 and tables.commit(1, {}, {}) == 3
    with pytest.raises(ConcurrentCommitError):
        tables.commit(2, {}, {})
    tables.clean()
    assert seen(spark, store) == AFTER and tables.version()[0] == 3


def test_later_loads_are_read_and_erased(spark, store):
    gov.run_erasure(spark, store, _ask(spark, "a"), SALT)
    more = table(spark, "sessions", [{"session_id": "9", "player_id": "a", "ip_address": "2.2.2.2"}])
    more.write.mode("append").parquet(f"{store}/sessions.parquet")
    assert seen(spark, store)[0] == [*AFTER[0], ("9", "a", "2.2.2.2")]
    gov.run_erasure(spark, store, _ask(spark, "a"), SALT)
    assert seen(spark, store) == ([*AFTER[0], ("9", "a", two)], *AFTER[1:3], 2)


def test_unknown_player_stops_the_batch(spark, store, tmp_path):
    with pytest.raises(gov.UnknownPlayerError):
        gov.run_erasure(spark, store, _ask(spark, "a", "nobody"), SALT)
    assert spark.read.parquet(f"{store}/sessions.parquet").filter("ip_address like 'erased:%'").count() == 0


def test_distinct_addresses_stay_countable(spark, store):
    tables = {n: spark.read.parquet(f"{store}/{n}.parquet") for n in ("players", "sessions", "login_events")}
    after = gov.erase(tables, _ask(spark, "a", "b"), SALT)
    count = lambda df: df.agg(F.countDistinct("ip_address")).first()[0]
    assert count(after["sessions"]) == count(tables["sessions"])
    dry = {(r.player_id, r.field): r.rows_affected for r in gov.erase_dry_run(tables, _ask(spark, "a", "c")).collect()}
    assert dry[("a", "sessions.ip_address")] == 3 and dry[("c", "sessions.ip_address")] == 0


def test_metadata_travels_with_the_columns(spark, tmp_path):
    df = spark.createDataFrame([("p", "verified", 1)], "player_id string, kyc_status string, other int")
    marked = gov.classified(df, "dim_players_scd2")
    marked.write.parquet(f"{tmp_path}/d")
    back = spark.read.parquet(f"{tmp_path}/d")
    assert back.schema["kyc_status"].metadata["classification"] == "restricted"
    listed = gov.catalogue(spark, {"dim_players_scd2": back}).collect()
    assert sorted(r.column_name for r in listed) == ["kyc_status", "player_id"]
    assert gov.general_view(df, "dim_players_scd2").columns == ["player_id"], "an unclassified column leaks"
    assert len([c for m in gov.classification().values() for c in m]) == 57


def test_the_general_view_hides_restricted_columns_and_no_others(spark):
    kinds = ("player_dimension_key string, player_id string, country string, currency string, acquisition_channel string,"
             " activity_segment string, signup_ts timestamp, valid_from timestamp, valid_to timestamp, is_current boolean,"
             " vip_tier string, kyc_status string, self_exclusion_status string, risk_segment string, born date")
    df = spark.createDataFrame([], kinds)
    hidden = {"kyc_status", "self_exclusion_status", "risk_segment", "born"}
    assert gov.general_view(df, "dim_players_scd2").columns == [c for c in df.columns if c not in hidden]


def test_a_column_is_as_restricted_as_what_it_is_made_of(spark, monkeypatch):
    df = spark.createDataFrame([], "player_id string, age int, odd int")
    made = {"age": ["stg_players.signup_ts", "stg_players.date_of_birth"], "odd": ["stg_players.country", "stg_players.none"]}
    monkeypatch.setitem(gov.LINEAGE, "dim_players_scd2", made)
    assert gov.general_view(df, "dim_players_scd2").columns == ["player_id"]


def test_retention(spark):
    df = spark.createDataFrame([("p", datetime(2024, 2, 29))], "player_id string, closed timestamp")
    assert gov.retention_due(df, "financial_aml", "closed").first().retention_due == date(2029, 2, 28)
    assert gov.retention_due(df, "responsible_gambling", "closed").first().retention_due == date(2030, 2, 28)
