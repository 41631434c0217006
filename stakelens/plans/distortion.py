"""How far naive reads of the raw tables are from the modelled answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_in_utc, whole_days_between
from ..operators import asof_lookup, current_lookup, keep_first
from .marts import observation_date
from .warehouse import Warehouse


def one_row(w: Warehouse, **values: DataFrame) -> DataFrame:
    """A single row of scalar subqueries. Each frame must have one row and one column."""
    return w.spark.range(1).select(*[df.scalar().alias(name) for name, df in values.items()])


def naive_features(w: Warehouse) -> DataFrame:
    """Features and label straight off the raw tables: retries, mixed currencies and bots included."""
    zero = F.lit(0).cast("decimal(18,2)")
    paid = lambda kind: F.when(F.col("payment_type") == kind, F.col("amount")).otherwise(zero)
    activity = w.raw.game_rounds.select(
        "player_id", F.col("ts").alias("event_ts"), F.col("stake_amount").alias("stake"),
        zero.alias("deposit"), zero.alias("withdrawal"),
    ).unionByName(w.raw.payments.select(
        "player_id", F.col("ts").alias("event_ts"), zero.alias("stake"),
        paid("deposit").alias("deposit"), paid("withdrawal").alias("withdrawal"),
    ))
    per_player = activity.groupBy("player_id").agg(
        F.count_if(F.col("stake") > 0).alias("total_rounds_naive"),
        F.sum("stake").alias("total_stake_naive"),
        F.sum("deposit").alias("total_deposits_naive"),
        F.sum("withdrawal").alias("total_withdrawals_naive"),
        F.min("event_ts").alias("first_activity"),
        F.max("event_ts").alias("last_activity"),
    )
    w.share("player_daily_activity")
    as_of = observation_date(w.player_daily_activity, w.at.churn_window_days).scalar()
    return (
        per_player.join(w.raw.players.select("player_id", "signup_ts"), "player_id")
        .filter(F.col("first_activity") <= as_of)
        .withColumn("tenure_days", whole_days_between("last_activity", "signup_ts"))
        .withColumn("is_churned_naive", F.col("last_activity") <= as_of)
    )


def engineered_features(w: Warehouse) -> DataFrame:
    """Features and label from the marts."""
    w.share("player_daily_activity")
    return (
        w.player_ltv.join(w.churn_labels.select("player_id", "is_churned", "is_self_excluded_as_of"), "player_id")
        .select(
            "player_id", "total_sessions", F.col("total_stake").alias("total_stake_engineered"),
            "total_deposits_gbp", "total_withdrawals_gbp", "ltv_gbp", "signup_ts", "last_active_date",
            "is_churned", "is_self_excluded_as_of",
            whole_days_between("last_active_date", "signup_ts").alias("tenure_days"),
        )
    )


def _percent_over(naive: Column, right: Column) -> Column:
    return F.try_divide((naive - right).cast("double"), right.cast("double")) * 100


def dedup_distortion(w: Warehouse) -> DataFrame:
    """Effect of retried deliveries alone: deposits with a known currency, in GBP, before and after dedup.

    One pass over the payments: all copies of a payment are summed where the first copy is found.
    """
    rates = w.fx.withColumnRenamed("currency", "_fx")
    raw = w.raw.payments
    place = F.struct("ts", *[c for c in raw.columns if c not in ("payment_id", "ts")])  # the order of staging
    priced = raw.join(rates, F.upper("currency") == F.col("_fx"), "left").select(
        "payment_id", place.alias("place"),
        F.when(F.col("payment_type") == "deposit", F.col("amount") * F.col("rate_to_gbp")).alias("gbp")
    )
    # Boxed, because the first copy decides what a payment is, also if it is no deposit.
    first = F.min_by(F.struct("gbp"), F.col("place"))
    payments = priced.groupBy("payment_id").agg(F.sum("gbp").alias("every"), first.alias("one"))
    both = payments.agg(F.sum("every").alias("raw_with_dupes_gbp"), F.sum("one.gbp").alias("deduped_gbp"))
    share = _percent_over(F.col("raw_with_dupes_gbp"), F.col("deduped_gbp"))
    return both.withColumn("dedup_only_distortion_pct", share)


def declined_distortion(w: Warehouse) -> DataFrame:
    """Effect of counting declined deposits alone."""
    totals = w.stg_payments.filter("payment_type = 'deposit'").agg(
        F.sum("amount_gbp").alias("with_declined_gbp"),
        F.sum(F.when(F.col("status") == "completed", F.col("amount_gbp"))).alias("completed_only_gbp"),
    )
    share = _percent_over(F.col("with_declined_gbp"), F.col("completed_only_gbp"))
    return totals.withColumn("declined_payments_distortion_pct", share)


def deposit_distortion(w: Warehouse) -> DataFrame:
    """All deposit effects; currency mixing is what the other two leave unexplained."""
    values = one_row(
        w,
        naive_total_deposits=naive_features(w).agg(F.sum("total_deposits_naive")),
        engineered_total_deposits=engineered_features(w).agg(F.sum("total_deposits_gbp")),
        dedup_only_distortion_pct=dedup_distortion(w).select("dedup_only_distortion_pct"),
        declined_payments_distortion_pct=declined_distortion(w).select("declined_payments_distortion_pct"),
    )
    combined = _percent_over(F.col("naive_total_deposits"), F.col("engineered_total_deposits"))
    return values.withColumn("combined_distortion_pct", combined).withColumn(
        "currency_mixing_distortion_pct",
        F.col("combined_distortion_pct")
        - F.col("dedup_only_distortion_pct")
        - F.col("declined_payments_distortion_pct"),
    )


def deposit_scenarios(distortion: DataFrame) -> DataFrame:
    """Reported deposit total under each of the eight subsets of fixes."""
    fixes = {"dedup": 1, "currency": 2, "declined": 4}
    effects = {
        "dedup": "dedup_only_distortion_pct",
        "currency": "currency_mixing_distortion_pct",
        "declined": "declined_payments_distortion_pct",
    }
    combined = F.col("combined_distortion_pct")
    share = {n: F.coalesce(F.try_divide(F.col(c), combined), F.lit(0.0)) for n, c in effects.items()}
    fixed = {n: F.col("_subset").bitwiseAND(bit) > 0 for n, bit in fixes.items()}
    remaining = sum((F.when(fixed[n], 0.0).otherwise(share[n]) for n in fixes), F.lit(0.0))
    naive, right = F.col("naive_total_deposits").cast("double"), F.col("engineered_total_deposits").cast("double")
    return (
        distortion.withColumn("_subset", F.explode(F.sequence(F.lit(0), F.lit(7))))
        .select(
            *[fixed[n].alias(f"{n}_fixed") for n in fixes],
            (right + (naive - right) * remaining).alias("reported_total"),
            (combined * remaining).alias("distortion_pct"),
        )
    )


def self_exclusion_contamination(w: Warehouse) -> DataFrame:
    """Self-excluded players a naive label would call churned."""
    excluded = F.coalesce("is_self_excluded_as_of", F.lit(False))
    return engineered_features(w).agg(
        F.count_if(excluded & F.col("is_churned")).alias("mislabelled_as_churn"),
        F.count_if(excluded).alias("total_self_excluded"),
    )


def bot_contamination(w: Warehouse) -> DataFrame:
    """Stake with and without the sessions that ground truth, not the detector, calls bots."""
    bots = w.stg_fraud_ground_truth.filter("entity_type = 'session' and scenario_type = 'bot_betting'").select(
        F.col("entity_id").alias("session_id"), F.lit(True).alias("_bot")
    )
    # Stake per session first: the join then moves one row per session instead of every round.
    stakes = w.raw.game_rounds.groupBy("session_id").agg(F.sum("stake_amount").alias("stake"))
    marked = stakes.join(bots, "session_id", "left")
    return marked.agg(
        F.sum("stake").alias("naive_total_stake_incl_bots"),
        F.sum(F.when(F.col("_bot").isNull(), F.col("stake"))).alias("engineered_total_stake_excl_bots"),
        F.count_if("_bot").alias("bot_session_count"),
    )


def point_in_time_mismatches(w: Warehouse) -> DataFrame:
    """Player-level incidents whose current risk segment differs from the one at the time."""
    incidents = (
        w.stg_fraud_ground_truth.filter("entity_type = 'player'")
        .groupBy(F.col("entity_id").alias("player_id"), F.col("injected_ts").alias("event_ts"))
        .agg(F.count("*").alias("n"))
    )
    periods = w.dim_players_scd2.select("player_id", "valid_from", "valid_to", "is_current", "risk_segment")
    then = asof_lookup(incidents, periods, "player_id", "event_ts", ["risk_segment"])
    now = periods.withColumnRenamed("risk_segment", "risk_segment_now")
    both = current_lookup(then, now, "player_id", ["risk_segment_now"])
    # Incidents of one player at one instant match each other on both sides, hence the square.
    pairs = F.col("n") * F.col("n")
    return both.agg(
        F.coalesce(F.sum(pairs), F.lit(0)).alias("total_lookups"),
        F.coalesce(
            F.sum(F.when(F.col("risk_segment") != F.col("risk_segment_now"), pairs)), F.lit(0)
        ).alias("mismatches"),
    )


def join_fanout(w: Warehouse) -> DataFrame:
    """Rows a payments-to-rounds join per player would produce, without producing them. Each table is read once."""
    count = lambda df, name: df.groupBy("player_id").agg(F.count("*").alias(name))
    per_player = count(w.raw.payments, "p").join(count(w.raw.game_rounds, "g"), "player_id", "full_outer")
    product = (F.col("p") * F.col("g").cast("decimal(20,0)")).cast("decimal(38,0)")
    totals = per_player.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("payments"), F.coalesce(F.sum("g"), F.lit(0)).alias("game_rounds"),
        F.sum(product).alias("naive_join_rows"),
    )
    return totals.select(
        w.raw.players.agg(F.count("*")).scalar().alias("players"), "payments", "game_rounds", "naive_join_rows")


def totals_before_join(w: Warehouse) -> DataFrame:
    """The fix for fan-out: each fact aggregated to one row per player before joining."""
    deposits = w.raw.payments.groupBy("player_id").agg(F.sum("amount").alias("deposits"))
    stakes = w.raw.game_rounds.groupBy("player_id").agg(F.sum("stake_amount").alias("stake"))
    return (
        w.raw.players.select("player_id").join(deposits, "player_id", "left").join(stakes, "player_id", "left")
    )


def bonus_average(bonuses: DataFrame) -> DataFrame:
    """Average that counts a missing amount as zero, and how many are missing."""
    filled = F.coalesce("bonus_amount", F.lit(0))
    return bonuses.agg(
        (F.sum(filled).cast("double") / F.count("*")).alias("avg_bonus"),
        F.count_if(F.col("bonus_amount").isNull()).alias("missing_bonus_amounts"),
    )


def sessions_per_utc_day(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(day_in_utc("start_ts").alias("day_utc")).agg(F.count("*").alias("sessions"))


def money_sum(payments: DataFrame) -> DataFrame:
    """Exact total, and the total binary floating point arrives at."""
    return payments.agg(
        F.sum("amount").alias("exact_total"), F.sum(F.col("amount").cast("double")).alias("float_total")
    )
