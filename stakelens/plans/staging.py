"""Staging models: one row per business key, cleaned columns, money in GBP."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import age_in_years, seconds_between
from ..operators import keep_first
from ..sources.events import normalise


def stg_players(players: DataFrame) -> DataFrame:
    return keep_first(players, ["player_id"], ["signup_ts"]).select(
        "player_id",
        "signup_ts",
        F.upper("country").alias("country"),
        F.upper("currency").alias("currency"),
        "acquisition_channel",
        "activity_segment",
        "date_of_birth",
        age_in_years("signup_ts", "date_of_birth").alias("age_at_signup"),
    )


def stg_devices(devices: DataFrame) -> DataFrame:
    return keep_first(devices, ["device_id"], ["first_seen_ts"]).select(
        "device_id",
        F.col("player_id").alias("first_seen_player_id"),
        "first_seen_ts",
        "os",
        F.coalesce("is_shared_fraud_ring", F.lit(False)).alias("is_shared_fraud_ring"),
    )


def stg_player_attribute_history(history: DataFrame) -> DataFrame:
    return keep_first(history, ["player_id", "effective_ts"], []).select(
        "player_id", "effective_ts", "vip_tier", "kyc_status", "self_exclusion_status", "risk_segment"
    )


def stg_sessions(sessions: DataFrame) -> DataFrame:
    return keep_first(sessions, ["session_id"], ["start_ts"]).select(
        "session_id",
        "player_id",
        "device_id",
        "ip_address",
        "country_from_ip",
        "start_ts",
        "end_ts",
        (seconds_between("end_ts", "start_ts") / 60).alias("duration_minutes"),
    )


def stg_login_events(logins: DataFrame) -> DataFrame:
    return keep_first(logins, ["login_id"], ["ts"]).select(
        "login_id",
        "player_id",
        "device_id",
        "ip_address",
        "country_from_ip",
        "ts",
        F.coalesce("success_flag", F.lit(True)).alias("success_flag"),
    )


def stg_game_rounds(rounds: DataFrame) -> DataFrame:
    return keep_first(rounds, ["round_id"], ["ts"]).select(
        "round_id", "session_id", "player_id", "game_type", "stake_amount", "payout_amount", "ts"
    )


def stg_payments(payments: DataFrame, fx: DataFrame) -> DataFrame:
    return normalise(keep_first(payments, ["payment_id"], ["ts"]), fx).select(
        "payment_id", "player_id", "payment_type", "amount", "currency", "amount_gbp",
        "method", "card_bin", "device_id", "ts", "status",
    )


def stg_bonuses(bonuses: DataFrame) -> DataFrame:
    return keep_first(bonuses, ["bonus_id"], ["claim_ts"]).select(
        "bonus_id", "player_id", "bonus_type", "claim_ts",
        "wagering_requirement_multiple", "bonus_amount", "device_id",
    )


def stg_fraud_ground_truth(truth: DataFrame) -> DataFrame:
    if "ring_id" not in truth.columns:
        truth = truth.withColumn("ring_id", F.lit(None).cast("string"))
    return keep_first(truth, ["entity_type", "entity_id", "scenario_type"], ["injected_ts"]).select(
        "entity_type", "entity_id", "scenario_type", "injected_ts", "ring_id"
    )


def stg_streaming_fraud_flags(flags: DataFrame) -> DataFrame:
    return keep_first(flags, ["flag_id"], ["detected_ts"]).select(
        "flag_id",
        "scenario_type",
        "entity_type",
        "entity_id",
        "player_id",
        "triggering_event_ts",
        "detected_ts",
        seconds_between("detected_ts", "triggering_event_ts").alias("detection_latency_seconds"),
        "severity",
    )
