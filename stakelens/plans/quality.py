"""The gate on raw tables and the tests on models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as s
from ..operators import ordered, running_max_before
from ..operators.ordered import YEAR
from ..operators.expect import (
    at_least,
    duplicate_rate,
    expect,
    in_set,
    never,
    not_before,
    not_found,
    not_null,
    unique,
)
from .warehouse import Warehouse


class QualityGateError(RuntimeError):
    pass


def _raw_checks() -> dict[str, list]:
    ring_only = F.col("player_id").isNull() & ~F.coalesce("is_shared_fraud_ring", F.lit(False))
    return {
        "players": [
            not_null("player_id"), unique("player_id"), not_null("signup_ts"),
            in_set("country", s.COUNTRIES), in_set("currency", s.CURRENCIES),
            in_set("acquisition_channel", s.ACQUISITION_CHANNELS), in_set("activity_segment", s.ACTIVITY_SEGMENTS),
        ],
        "devices": [
            not_null("device_id"), unique("device_id"), not_null("first_seen_ts"),
            never("null_player_id_only_on_shared_fraud_ring_devices", ring_only),
        ],
        "player_attribute_history": [
            not_null("player_id"), not_null("effective_ts"), in_set("vip_tier", s.VIP_TIERS),
            in_set("kyc_status", s.KYC_STATUSES), in_set("self_exclusion_status", s.SELF_EXCLUSION_STATUSES),
            in_set("risk_segment", s.RISK_SEGMENTS),
        ],
        "sessions": [
            not_null("session_id"), unique("session_id"), not_null("player_id"), not_before("end_ts", "start_ts"),
        ],
        "login_events": [not_null("login_id"), unique("login_id"), not_null("player_id"), not_null("ts")],
        "game_rounds": [
            not_null("round_id"), at_least("stake_amount", 0), at_least("payout_amount", 0),
            in_set("game_type", s.GAME_TYPES),
        ],
        "payments": [
            not_null("payment_id"), at_least("amount", 0, strict=True), in_set("currency", s.CURRENCIES),
            in_set("payment_type", s.PAYMENT_TYPES), in_set("method", s.PAYMENT_METHODS),
            in_set("status", s.PAYMENT_STATUSES),
        ],
        "bonuses": [
            not_null("bonus_id"), unique("bonus_id"), at_least("bonus_amount", 0, strict=True),
            in_set("bonus_type", s.BONUS_TYPES),
        ],
    }


def raw_gate(raw) -> DataFrame:
    """All checks on all raw tables, as one report. An absent table is a row that neither passed nor failed."""
    reports = []
    for table, checks in _raw_checks().items():
        try:
            frame = getattr(raw, table)
        except FileNotFoundError:
            reports.append(not_found(raw.spark, table))
            continue
        reports.append(expect(frame, table, checks))
    return reduce(DataFrame.unionByName, reports)


def raw_duplicate_rates(raw) -> DataFrame:
    return duplicate_rate(raw.game_rounds, "game_rounds", "round_id").unionByName(
        duplicate_rate(raw.payments, "payments", "payment_id")
    )


def model_tests(w: Warehouse) -> DataFrame:
    """Column tests on the models."""
    tests = {
        "stg_players": [not_null("player_id"), unique("player_id"), in_set("country", s.COUNTRIES)],
        "stg_devices": [not_null("device_id"), unique("device_id")],
        "stg_player_attribute_history": [
            in_set("kyc_status", s.KYC_STATUSES), in_set("self_exclusion_status", s.SELF_EXCLUSION_STATUSES),
        ],
        "stg_sessions": [not_null("session_id"), unique("session_id")],
        "stg_game_rounds": [not_null("round_id"), unique("round_id"), at_least("stake_amount", 0)],
        "stg_payments": [
            not_null("payment_id"), unique("payment_id"), in_set("payment_type", s.PAYMENT_TYPES),
            at_least("amount_gbp", 0),
        ],
        "stg_fraud_ground_truth": [in_set("scenario_type", s.SCENARIOS)],
        "dim_players_scd2": [not_null("player_dimension_key"), unique("player_dimension_key"), not_null("player_id")],
        "player_ltv": [not_null("player_id"), unique("player_id")],
        "churn_labels": [not_null("player_id"), unique("player_id")],
        "fraud_summary": [not_null("scenario_type")],
    }
    return reduce(DataFrame.unionByName, [expect(getattr(w, model), model, checks) for model, checks in tests.items()])


def report_by_table(report: DataFrame) -> DataFrame:
    """Passed and total checks per table; a table passes when all its checks do."""
    return report.groupBy("table_name").agg(
        F.count_if("success").alias("passed"),
        F.count("*").alias("checks"),
        F.every("success").alias("table_passed"),
    )


def enforce(report: DataFrame) -> DataFrame:
    """Abort the job if a check failed, naming all that did. A report has a few dozen rows, one per check."""
    failed = report.filter("not success").orderBy("table_name", "expectation").collect()
    if failed:
        raise QualityGateError("; ".join(
            f"{r.table_name}: {r.expectation} unexpected={r.unexpected_percent:.2f}%"
            f" sample={r.sample_min}..{r.sample_max}" for r in failed
        ))
    return report


def overlapping_periods(periods: DataFrame, key: str, width: float = YEAR) -> DataFrame:
    """Periods of a key that start inside a period that began strictly earlier.

    Compares each start with the furthest end seen so far, instead of pairing every two periods of a key.
    """
    forever = F.lit("9999-12-31").cast("timestamp")
    starts = periods.groupBy(key, "valid_from").agg(F.max(F.coalesce("valid_to", forever)).alias("valid_to"))
    rows = ordered(starts, [key], ["valid_from"], width)
    found = rows.add(covered_until=running_max_before(F.col("valid_to"))).result()
    return found.filter("covered_until > valid_from").select(key, "valid_from", "covered_until")
