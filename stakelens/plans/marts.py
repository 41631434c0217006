"""Intermediate models and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seconds_between, surrogate_key
from ..operators import lag, ordered, scd_periods
from ..operators.ordered import DAY, YEAR


def session_stats(
    rounds: DataFrame, min_gaps: int = 100, max_sd: float = 0.3, width: float = DAY
) -> DataFrame:
    """Totals and gap statistics per (session, player), with the bot verdict. ``gaps`` is rounds less one.

    Rounds are by far the largest table. They are exchanged once, by session and day; totals are summed there before they
    move on, as a row per session and day.
    """
    timed = ordered(rounds, ["session_id"], ["ts"], width).add(_prev=lag("ts")).result()
    gap = seconds_between("ts", "_prev")
    stats = timed.withColumn("_gap", gap).groupBy("session_id", "player_id").agg(
        F.count("*").alias("rounds"),
        F.sum("stake_amount").alias("stake"),
        F.sum("payout_amount").alias("payout"),
        F.count("_gap").alias("gaps"),
        F.avg("_gap").alias("avg_gap_seconds"),
        F.stddev_samp("_gap").alias("stddev_gap_seconds"),
    )
    even = (F.col("gaps") >= min_gaps) & (F.col("stddev_gap_seconds") < max_sd)
    return stats.withColumn("is_bot", F.coalesce(even, F.lit(False)))


def bot_sessions(stats: DataFrame) -> DataFrame:
    """Sessions with many rounds at suspiciously even gaps. ``round_count`` counts the gaps."""
    return stats.filter("is_bot").select(
        "session_id", "player_id", F.col("gaps").alias("round_count"), "avg_gap_seconds", "stddev_gap_seconds"
    )


def session_activity(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """Totals per session, zero without rounds, and whether the session looks like a bot's."""
    totals = stats.groupBy("session_id").agg(
        F.sum("rounds").alias("round_count"),
        F.sum("stake").alias("total_stake"),
        F.sum("payout").alias("total_payout"),
        F.bool_or("is_bot").alias("is_bot"),
    )
    filled = sessions.join(totals, "session_id", "left").select(
        "session_id", "player_id", "device_id", "start_ts", "end_ts", "duration_minutes",
        F.coalesce("round_count", F.lit(0)).alias("round_count"),
        F.coalesce("total_stake", F.lit(0)).alias("total_stake"),
        F.coalesce("total_payout", F.lit(0)).alias("total_payout"),
        F.coalesce("is_bot", F.lit(False)).alias("is_bot"),
    )
    return filled.withColumn("net_gaming_revenue", F.col("total_stake") - F.col("total_payout"))


def player_daily_activity(activity: DataFrame, payments: DataFrame) -> DataFrame:
    """Sessions (bots removed) and completed payments per player and day, zero-filled on either side."""
    sessions = (
        activity.filter("not is_bot")
        .groupBy("player_id", F.date_trunc("day", "start_ts").alias("activity_date"))
        .agg(
            F.count("*").alias("session_count"),
            F.sum("total_stake").alias("total_stake"),
            F.sum("net_gaming_revenue").alias("net_gaming_revenue"),
        )
    )
    gbp = lambda kind: F.sum(F.when(F.col("payment_type") == kind, F.col("amount_gbp")).otherwise(0))
    money = (
        payments.filter("status = 'completed'")
        .groupBy("player_id", F.date_trunc("day", "ts").alias("activity_date"))
        .agg(gbp("deposit").alias("deposits_gbp"), gbp("withdrawal").alias("withdrawals_gbp"))
    )
    measures = ["session_count", "total_stake", "net_gaming_revenue", "deposits_gbp", "withdrawals_gbp"]
    return sessions.join(money, ["player_id", "activity_date"], "full_outer").select(
        "player_id", "activity_date", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures]
    )


def dim_players_scd2(history: DataFrame, players: DataFrame, width: float = YEAR) -> DataFrame:
    """Type 2 dimension: attribute periods joined to the player's static attributes."""
    # The join drops the others. Said here, it holds for both readings of the history, which can then share an exchange.
    known = history.filter("player_id is not null")
    periods = scd_periods(known, "player_id", "effective_ts", width)
    return periods.join(players, "player_id").select(
        surrogate_key("player_id", F.unix_micros("valid_from")).alias("player_dimension_key"),
        "player_id", "country", "currency", "acquisition_channel", "activity_segment", "signup_ts",
        "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"),
        "vip_tier", "kyc_status", "self_exclusion_status", "risk_segment",
    )


def player_ltv(players: DataFrame, daily: DataFrame) -> DataFrame:
    """Lifetime totals per player. Players who never played keep nulls, not zeros."""
    totals = daily.groupBy("player_id").agg(
        F.min("activity_date").alias("first_active_date"),
        F.max("activity_date").alias("last_active_date"),
        F.sum("session_count").alias("total_sessions"),
        F.sum("total_stake").alias("total_stake"),
        F.sum("net_gaming_revenue").alias("ltv_gbp"),
        F.sum("deposits_gbp").alias("total_deposits_gbp"),
        F.sum("withdrawals_gbp").alias("total_withdrawals_gbp"),
    )
    return players.join(totals, "player_id", "left").select(
        "player_id", "country", "currency", "acquisition_channel", "signup_ts",
        "first_active_date", "last_active_date",
        (F.datediff("last_active_date", "first_active_date") + 1).alias("lifetime_days"),
        "total_sessions", "total_stake", "ltv_gbp", "total_deposits_gbp", "total_withdrawals_gbp",
    )


def observation_date(daily: DataFrame, window_days: int = 28) -> DataFrame:
    """One row: the day from which a full churn window is still inside the data."""
    return daily.agg((F.max("activity_date") - F.expr(f"interval {int(window_days)} days")).alias("as_of_date"))


def churn_labels(daily: DataFrame, dim: DataFrame, players: DataFrame, window_days: int = 28) -> DataFrame:
    """Churn per player active by the observation date, with the self-exclusion status of that date.

    ``is_self_excluded_as_of`` is three-valued: null for a player without attributes on the date.
    """
    as_of = observation_date(daily, window_days).scalar()
    horizon = F.expr(f"interval {int(window_days)} days")
    day = F.col("activity_date")
    # Both halves of the window in one pass over the activity.
    activity = daily.groupBy("player_id").agg(
        F.max(F.when(day <= as_of, day)).alias("last_active_before_asof"),
        F.max(F.when((day > as_of) & (day <= as_of + horizon), day)).alias("_next_active"),
    )
    status = dim.filter(
        (F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    ).select("player_id", "self_exclusion_status")
    return (
        players.filter(F.col("signup_ts") <= as_of)
        .select("player_id")
        .join(activity.filter("last_active_before_asof is not null"), "player_id")
        .join(status, "player_id", "left")
        .select(
            "player_id",
            as_of.alias("observation_date"),
            "last_active_before_asof",
            F.coalesce("self_exclusion_status", F.lit("none")).alias("self_exclusion_status_as_of"),
            (F.col("self_exclusion_status") == "self_excluded").alias("is_self_excluded_as_of"),
            F.col("_next_active").isNull().alias("is_churned"),
        )
    )


_ENTITY = ["scenario_type", "entity_type", "entity_id"]


def flags_per_entity(flags: DataFrame) -> DataFrame:
    """Flags of each (scenario, entity): how many, and their latencies. An entity may be flagged any number of times,
    so they are counted before anything is joined."""
    return flags.groupBy(*_ENTITY).agg(
        F.countDistinct("flag_id").alias("flags"),
        F.sum("detection_latency_seconds").alias("latency"),
        F.count("detection_latency_seconds").alias("timed"),
    )


def fraud_summary(truth: DataFrame, flags: DataFrame) -> DataFrame:
    """Detector score per (scenario, entity type). False positives are counted per scenario."""
    labels = truth.filter("entity_type <> 'player'").select(*_ENTITY, F.lit(True).alias("_label"))
    label, missed = F.col("_label").isNotNull(), F.col("_label").isNull()
    # One join and one aggregation give both; what is left has a row per scenario and entity type.
    counted = labels.join(flags_per_entity(flags), _ENTITY, "full_outer").groupBy("scenario_type", "entity_type").agg(
        F.count_if(label).alias("_labels"),
        F.countDistinct(F.when(label, F.col("entity_id"))).alias("ground_truth_count"),
        F.coalesce(F.sum(F.when(label, F.col("flags"))), F.lit(0)).alias("true_positive_count"),
        F.try_divide(F.sum(F.when(label, F.col("latency"))), F.sum(F.when(label, F.col("timed")))).alias("_latency"),
        F.sum(F.when(missed, F.col("flags"))).alias("_false"),
    )
    false = F.sum("_false").over(Window.partitionBy("scenario_type"))
    caught = counted.withColumn(
        "false_positive_count", F.when(F.col("scenario_type").isNotNull(), false)
    ).filter("_labels > 0")
    share = F.try_divide(F.col("true_positive_count"), F.col("ground_truth_count"))
    return caught.select(
        "scenario_type",
        "entity_type",
        "ground_truth_count",
        "true_positive_count",
        F.coalesce("false_positive_count", F.lit(0)).alias("false_positive_count"),
        F.least(F.round(share, 3), F.lit(1.0)).alias("recall"),
        F.round("_latency", 1).alias("avg_detection_latency_seconds"),
    )


def self_exclusion_registry(history: DataFrame) -> DataFrame:
    """Earliest self-exclusion per player."""
    return (
        history.filter("self_exclusion_status = 'self_excluded'")
        .groupBy("player_id")
        .agg(F.min("effective_ts").alias("excluded_since"))
    )
