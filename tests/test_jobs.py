"""The daily job from end to end, on raw tables written from the lens."""

from __future__ import annotations

import pytest
from conftest import TESTDATA

from stakelens.plans import batch, quality
from stakelens.plans.warehouse import RawTables
from stakelens.registry import LENS_THRESHOLDS
from stakelens.schemas import RAW
from stakelens.sources.lens import Lens
from stakelens.sources.sinks import export_reports, published
from stakelens.sources.versions import TableSet

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def raw_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    lens = Lens(spark, FOLDER)
    for name in RAW:
        if name != "streaming_fraud_flags":
            getattr(lens, name).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_daily_job(spark, raw_dir, tmp_path):
    out = str(tmp_path)
    w = batch.run(spark, [raw_dir], out, LENS_THRESHOLDS, gated=False)
    assert spark.read.parquet(f"{out}/derived/streaming_fraud_flags.parquet").count() > 0, "no detector, so a backtest"
    ltv = spark.read.parquet(f"{out}/models/player_ltv")
    assert ltv.count() == w.stg_players.count() == spark.read.parquet(f"{TESTDATA}/sf0.001/customer.parquet").count()
    assert spark.read.parquet(f"{out}/quality/scd2_overlaps").count() == 0
    tests = {(r.table_name, r.expectation): r.success
             for r in spark.read.parquet(f"{out}/quality/model_tests").collect()}
    assert tests[("player_ltv", "unique(player_id)")] and tests[("stg_game_rounds", "unique(round_id)")]
    manifest = {r.report: r.rows for r in published(spark, f"{out}/reports").collect()}
    assert set(manifest) == set(batch.reports(w)) and manifest["player_ltv"] == ltv.count()
    results = spark.read.json(f"{out}/comparison").first()
    assert results.join_fanout_demo.players == ltv.count() and len(results.as_of_date) == 10
    aucs = results.naive.auc, results.engineered.auc  # none where only one class was seen
    assert results.auc_delta == (None if None in aucs else pytest.approx(aucs[1] - aucs[0]))


def test_gate_stops_the_job(spark, raw_dir, tmp_path):
    with pytest.raises(quality.QualityGateError, match="in_set"):
        batch.gate(RawTables(spark, raw_dir), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/quality/raw_gate").count() == 39


def test_flags_follow_the_data(spark, raw_dir, tmp_path):
    """A second run with the same output folder, on raw tables without bonus claims, must not keep yesterday's flags."""
    import shutil

    changed, out = str(tmp_path / "raw"), str(tmp_path / "out")
    shutil.copytree(raw_dir, changed)
    flags = f"{out}/derived/streaming_fraud_flags.parquet"
    batch.run(spark, [changed], out, LENS_THRESHOLDS, gated=False)
    first = spark.read.parquet(flags).filter("scenario_type = 'card_testing'").count()
    payments = spark.read.parquet(f"{raw_dir}/payments.parquet").filter("payment_type != 'deposit'")
    payments.write.mode("overwrite").parquet(f"{changed}/payments.parquet")
    spark.catalog.clearCache()
    batch.run(spark, [changed], out, LENS_THRESHOLDS, gated=False)
    assert first > 0 and spark.read.parquet(flags).filter("scenario_type = 'card_testing'").count() == 0


def test_failed_model_test_leaves_no_reports(spark, raw_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(batch, "gate", lambda raw, out: None)
    bad = spark.sql("select 'player_ltv' table_name, 'unique(player_id)' expectation, false success, 1L unexpected_count,"
                    " 1.0D unexpected_percent, 'a' sample_min, 'a' sample_max")
    monkeypatch.setattr(quality, "model_tests", lambda w: bad)
    with pytest.raises(quality.QualityGateError, match="player_ltv"):
        batch.run(spark, [raw_dir], str(tmp_path), LENS_THRESHOLDS)
    assert not (tmp_path / "reports").exists() and (tmp_path / "quality").exists()


def test_every_failed_check_is_named(spark):
    report = spark.range(7).selectExpr("'t' table_name", "concat('check', id) expectation", "false success",
                                       "1.0D unexpected_percent", "'a' sample_min", "'b' sample_max")
    with pytest.raises(quality.QualityGateError) as error:
        quality.enforce(report)
    assert all(f"check{i}" in str(error.value) for i in range(7))


def test_absent_tables_are_rows_of_the_report(spark, raw_dir, tmp_path):
    import shutil

    shutil.copytree(f"{raw_dir}/sessions.parquet", f"{tmp_path}/sessions.parquet")
    report = quality.raw_gate(RawTables(spark, str(tmp_path)))
    absent = {r.table_name for r in report.filter("expectation = 'table_found'").collect()}
    assert len(absent) == 7 and "sessions" not in absent and report.count() == 7 + 4
    assert quality.enforce(report).filter("success is null").count() == 7
    nothing = quality.raw_gate(RawTables(spark, f"{tmp_path}/nowhere"))
    assert nothing.count() == 8 and {r.table_passed for r in quality.report_by_table(nothing).collect()} == {None}


@pytest.mark.parametrize("step", ["add", "commit", "clean"])
def test_an_export_that_dies_leaves_an_edition_whole(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/r"
    export_reports(spark, {"a": spark.range(3), "b": spark.range(4)}, path)
    first = sorted(map(tuple, published(spark, path).collect()))
    assert [r[:2] for r in first] == [("a", 3), ("b", 4)]
    real, calls = getattr(TableSet, step), []

    def dying(self, *args):
        calls.append(1)
        if len(calls) == 2 or step == "commit":
            raise KeyboardInterrupt
        return real(self, *args)

    monkeypatch.setattr(TableSet, step, dying)
    with pytest.raises(KeyboardInterrupt):
        export_reports(spark, {"a": spark.range(30), "b": spark.range(40)}, path)
    monkeypatch.undo()
    sizes = [published(spark, path, r).count() for r in "ab"]
    assert sizes == ([30, 40] if step == "clean" else [3, 4])
    export_reports(spark, {"a": spark.range(3), "b": spark.range(4)}, path)
    assert sorted(map(tuple, published(spark, path).collect())) == first, "equal rows, equal checksums"
