"""The queries behind the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .warehouse import Warehouse

ATTRIBUTES = ["vip_tier", "kyc_status", "self_exclusion_status", "risk_segment"]

# Hypothetical checking intervals in hours; zero is the deployed detector.
CHECK_INTERVALS = {
    "Real-time (streaming, as deployed)": 0.0,
    "Every 1 minute": 1 / 60,
    "Every 15 minutes": 15 / 60,
    "Every hour": 1.0,
    "Every 6 hours": 6.0,
    "Once a day (daily batch)": 24.0,
}


def kpis(w: Warehouse) -> DataFrame:
    """Headline numbers. Players known to be self-excluded stay out of the churn rate."""
    w.share("player_daily_activity")
    churned = F.when(F.coalesce("is_self_excluded_as_of", F.lit(False)), None).otherwise(F.col("is_churned").cast("int"))
    rate = w.churn_labels.agg(F.try_divide(F.sum(churned), F.count(churned)))
    return w.player_ltv.agg(
        F.count("*").alias("players"),
        F.sum("ltv_gbp").alias("total_ltv_gbp"),
        F.coalesce(F.sum("total_sessions"), F.lit(0)).alias("total_sessions"),
    ).withColumn("churn_rate", rate.scalar())


def scd_summary(dim: DataFrame) -> DataFrame:
    return dim.groupBy(*ATTRIBUTES, "is_current").agg(F.count("*").alias("n"))


def current_split(dim: DataFrame) -> DataFrame:
    """Current players by tier and by exclusion status, in long form. One pass over the dimension."""
    return (
        dim.filter("is_current")
        .groupBy("vip_tier", "self_exclusion_status").agg(F.count("*").alias("n"))
        .unpivot(["n"], ["vip_tier", "self_exclusion_status"], "attribute", "value")
        .groupBy("attribute", "value").agg(F.sum("n").alias("n"))
    )


def scd_timeline(dim: DataFrame, players: int = 15) -> DataFrame:
    """Every period of the players with the most changes; ties go to the smaller id."""
    busiest = (
        dim.groupBy("player_id").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "player_id").limit(players).select("player_id")
    )
    # A top-k result: its size is the limit.
    return dim.join(F.broadcast(busiest), "player_id", "left_semi").select(
        "player_id", "country", "valid_from", "valid_to", "is_current", *ATTRIBUTES
    )


def displayed_end(periods: DataFrame, days: int = 14) -> DataFrame:
    """Close open periods a little after the last change, for drawing."""
    latest = periods.agg(
        (F.greatest(F.max("valid_to"), F.max("valid_from")) + F.expr(f"interval {days} days")).alias("t")
    ).scalar()
    return periods.withColumn("valid_to_display", F.coalesce("valid_to", latest))


def attribute_timeline(periods: DataFrame) -> DataFrame:
    """One row per player, attribute and period."""
    return displayed_end(periods).unpivot(
        ["player_id", "valid_from", "valid_to_display"], ATTRIBUTES, "attribute", "value"
    )


def point_in_time_vs_current(dim: DataFrame, day: str) -> DataFrame:
    """Per player, the attributes that covered a calendar day (both ends inclusive) and those of today."""
    on = F.lit(day).cast("date")
    covers = (F.to_date("valid_from") <= on) & (F.to_date("valid_to_display") >= on)
    found = displayed_end(dim).groupBy("player_id").agg(
        F.min_by(F.struct("risk_segment", "kyc_status"), F.when(covers, F.col("valid_from"))).alias("then"),
        F.max_by(F.struct("risk_segment", "kyc_status"), F.when(F.col("is_current"), F.col("valid_from"))).alias("now"),
    )
    return found.select(
        "player_id",
        F.col("then.risk_segment").alias("risk_segment_then"), F.col("then.kyc_status").alias("kyc_status_then"),
        F.col("now.risk_segment").alias("risk_segment_now"), F.col("now.kyc_status").alias("kyc_status_now"),
        F.coalesce(F.col("then") != F.col("now"), F.lit(False)).alias("mismatch"),
    )


def recent_flags(flags: DataFrame, limit: int = 200) -> DataFrame:
    """Newest flags first. A top-k: each task keeps its own newest before they meet."""
    return flags.orderBy(F.desc("detected_ts"), "flag_id").limit(limit).select(
        "scenario_type", "entity_type", "entity_id", "player_id", "triggering_event_ts", "detected_ts",
        "detection_latency_seconds", "severity",
    )


def value_at_risk(w: Warehouse) -> DataFrame:
    """Average value of what each scenario touches: payments in GBP, raw bonuses, raw stake of sessions."""
    labels = w.stg_fraud_ground_truth.select("scenario_type", "entity_type", "entity_id")
    stakes = w.raw.game_rounds.groupBy("session_id").agg(F.sum("stake_amount").alias("stake"))
    priced = {
        "payment": w.stg_payments.select(F.col("payment_id").alias("entity_id"), F.col("amount_gbp").alias("value")),
        "bonus_claim": w.raw.bonuses.select(F.col("bonus_id").alias("entity_id"), F.col("bonus_amount").alias("value")),
        "session": stakes.select(F.col("session_id").alias("entity_id"), F.col("stake").alias("value")),
    }
    parts = None
    for kind, values in priced.items():
        hit = labels.filter(F.col("entity_type") == kind).join(values, "entity_id").select(
            "scenario_type", "entity_type", F.col("value").cast("decimal(29,8)").alias("value")
        )
        parts = hit if parts is None else parts.unionByName(hit)
    return parts.groupBy("scenario_type", "entity_type").agg(
        F.count("*").alias("n_events"),
        F.round(F.try_divide(F.sum("value").cast("double"), F.count("value")), 2).alias("avg_amount_gbp"),
    )


def exposure(w: Warehouse, days: int = 150) -> DataFrame:
    """What each scenario would cost undetected at each checking interval; events where nothing has a price."""
    intervals = F.array(*[
        F.struct(F.lit(label).alias("check_interval"), F.lit(hours).alias("hours"))
        for label, hours in CHECK_INTERVALS.items()
    ])
    joined = w.fraud_summary.join(value_at_risk(w), ["scenario_type", "entity_type"], "left")
    wait = F.when(F.col("hours") == 0.0, F.col("avg_detection_latency_seconds") / 3600).otherwise(F.col("hours") / 2)
    return (
        joined.select("*", F.inline(intervals))
        .withColumn("expected_wait_hours", wait)
        .withColumn("events_per_day", F.col("ground_truth_count") / F.lit(days))
        .withColumn("extra_events", F.greatest(F.col("events_per_day") * F.col("expected_wait_hours") / 24, F.lit(0.0)))
        .select(
            "scenario_type", "entity_type", "check_interval", "events_per_day", "expected_wait_hours", "extra_events",
            (F.col("extra_events") * F.coalesce("avg_amount_gbp", F.lit(1.0))).alias("exposure"),
            F.col("avg_amount_gbp").isNotNull().alias("in_gbp"),
        )
    )


def ltv_histogram(ltv: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, those without players included."""
    known = ltv.filter("ltv_gbp is not null").select(F.col("ltv_gbp").cast("double").alias("v"))
    edges = known.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    place = F.floor(F.try_divide((F.col("v") - edges["low"]) * bins, edges["high"] - edges["low"]))
    filled = (
        known.groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("players"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    )
    every = known.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(filled, "bin", "left").withColumn("players", F.coalesce("players", F.lit(0)))


def ltv_by_country(ltv: DataFrame) -> DataFrame:
    """Players with activity and their average value per market, most valuable first."""
    return (
        ltv.filter("ltv_gbp is not null").groupBy("country")
        .agg(F.count("*").alias("players"), (F.sum("ltv_gbp").cast("double") / F.count("*")).alias("avg_ltv_gbp"))
        .orderBy(F.desc("avg_ltv_gbp"), "country")
    )


def churn_composition(churn: DataFrame) -> DataFrame:
    """Self-excluded and churned players apart; players of unknown status belong to neither."""
    population = F.when(F.col("is_self_excluded_as_of"), "Self-excluded").when(
        ~F.col("is_self_excluded_as_of") & F.col("is_churned"), "Churned"
    )
    return (
        churn.select(population.alias("population")).filter("population is not null")
        .groupBy("population").agg(F.count("*").alias("players"))
    )
