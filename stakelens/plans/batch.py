"""The daily job: gate the raw tables, build the marts, test them, export the reports.

    spark-submit -m stakelens.plans.batch --raw <folder> [--raw <folder>] --out <folder>
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clear_scratch
from ..session import build_session
from ..sources.sinks import export_reports, write_metrics, write_parquet
from . import bi, churn, distortion, quality, rules
from .warehouse import RawTables, Thresholds, Warehouse

# In order of dependency. Each is written once and read back by those after it.
MODELS = [
    "stg_players", "stg_player_attribute_history", "stg_sessions", "stg_game_rounds", "stg_payments",
    "stg_fraud_ground_truth", "stg_streaming_fraud_flags",
    "session_stats", "session_activity", "player_daily_activity", "dim_players_scd2", "player_ltv", "churn_labels",
    "fraud_summary", "self_exclusion_registry",
]


def build_models(w: Warehouse, out: str) -> Warehouse:
    """Materialise the models under ``out``; the warehouse then reads the written tables."""
    for name in MODELS:
        df = getattr(w, name)
        write_parquet(df, f"{out}/models/{name}")
        setattr(w, name, w.spark.read.schema(df.schema).parquet(f"{out}/models/{name}"))
    w.written = True
    return w


def gate(raw, out: str) -> None:
    """Write the report on the raw tables and stop the job if a check failed."""
    write_parquet(quality.raw_gate(raw), f"{out}/quality/raw_gate")
    write_parquet(quality.raw_duplicate_rates(raw), f"{out}/quality/duplicate_rates")
    quality.enforce(raw.spark.read.parquet(f"{out}/quality/raw_gate"))


def check_models(w: Warehouse, out: str, strict: bool = True) -> None:
    """Write the results of the model tests and the overlapping periods, and stop a strict job if anything is wrong."""
    write_parquet(quality.model_tests(w), f"{out}/quality/model_tests")
    write_parquet(quality.overlapping_periods(w.dim_players_scd2, "player_id"), f"{out}/quality/scd2_overlaps")
    if not strict:
        return
    quality.enforce(w.spark.read.parquet(f"{out}/quality/model_tests"))
    overlaps = w.spark.read.parquet(f"{out}/quality/scd2_overlaps").count()
    if overlaps:
        raise quality.QualityGateError(f"dim_players_scd2: {overlaps} periods overlap an earlier one")


def backtest(raw: RawTables, w: Warehouse, folder: str) -> None:
    """Run the rules over the history and write the flags where the raw reader looks for them, afresh in every run."""
    write_parquet(rules.stamp_detection(w.flags), f"{folder}/streaming_fraud_flags.parquet")


def reports(w: Warehouse) -> dict:
    return {
        "fraud_summary": w.fraud_summary,
        "recent_flags": bi.recent_flags(w.stg_streaming_fraud_flags),
        "player_ltv": w.player_ltv,
        "churn_labels": w.churn_labels,
        "scd_summary": bi.scd_summary(w.dim_players_scd2),
        "scd_timeline": bi.scd_timeline(w.dim_players_scd2),
        "scenario_exposure": bi.value_at_risk(w),
    }


def results_document(w: Warehouse) -> DataFrame:
    """The naive-against-engineered results as one row: the date, both models, the difference of their AUC, each topic."""
    models = churn.compare_models(w)
    of = {name: models.filter(F.col("dataset") == name).drop("dataset") for name in ("naive", "engineered")}
    topics = {
        **of,
        "portfolio_value_distortion": distortion.deposit_distortion(w),
        "self_exclusion_contamination": distortion.self_exclusion_contamination(w),
        "bot_session_contamination": distortion.bot_contamination(w),
        "scd_point_in_time_lookup": distortion.point_in_time_mismatches(w),
        "join_fanout_demo": distortion.join_fanout(w),
    }
    one = w.churn_labels.agg(F.max("observation_date").cast("date").alias("as_of_date")).select(
        "as_of_date", *[df.select(F.struct("*")).scalar().alias(name) for name, df in topics.items()])
    return one.withColumn("auc_delta", F.col("engineered.auc") - F.col("naive.auc"))


def comparison(w: Warehouse, out: str) -> None:
    """One JSON document."""
    write_metrics(results_document(w), f"{out}/comparison")


def run(
    spark: SparkSession, raw_dirs: list[str], out: str, thresholds: Thresholds = Thresholds(), gated: bool = True
) -> Warehouse:
    """The whole job. Flags are computed here if no detector has delivered any, anew in every run.

    Nothing is published before every test of the models has passed; without ``gated`` failures are only reported.
    """
    derived = f"{out}/derived"
    delivered = RawTables(spark, *raw_dirs)
    if gated:
        gate(delivered, out)
    if not delivered.has("streaming_fraud_flags"):
        backtest(delivered, Warehouse(delivered, thresholds), derived)
    w = Warehouse(RawTables(spark, *raw_dirs, derived), thresholds)
    build_models(w, out)
    check_models(w, out, gated)
    export_reports(spark, reports(w), f"{out}/reports")
    comparison(w, out)
    return w


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--raw", action="append", required=True)
    parser.add_argument("--out", required=True)
    args = parser.parse_args()
    spark = build_session("stakelens-batch")
    try:
        run(spark, args.raw, args.out)
    finally:
        clear_scratch(spark)


if __name__ == "__main__":
    main()
