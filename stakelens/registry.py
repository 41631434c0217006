"""Named queries over the star-schema test tables. Every one reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import asof_lookup, current_lookup, keep_first, scratch_dir
from .plans import bi, churn, distortion, governance, quality, rules
from .plans.warehouse import RawTables, Thresholds, Warehouse
from .schemas import RAW
from .session import prepare
from .sources.events import event_stream, replay_slice, to_messages
from .sources import replay
from .sources.lens import Lens
from .sources.replay import replay_stream, write_slices
from .sources.sinks import append_audit, export_reports, published, replace_table, sync_flags, write_metrics, write_parquet
from .streaming import detector
from .streaming.processors import PlayerRules

Query = Callable[[SparkSession, str], DataFrame]

# The test tables hold about 66 sparse events per player in 30 days, so the thresholds are scaled to them.
LENS_THRESHOLDS = Thresholds(
    bot_min_gaps=2,
    bot_max_sd=3600.0,
    churn_window_days=1,
    rules={
        "card_testing": {"window_seconds": 72 * 3600, "min_bins": 3},
        "bonus_ring": {"gap_seconds": 6 * 3600},
        "account_takeover": {"pending_seconds": 72 * 3600},
        "bot_betting": {"min_gaps": 2, "max_sd": 3600.0},
        "structuring": {"threshold_gbp": 50.0, "window_seconds": 72 * 3600},
    },
)

REPLAY_SLICES = 20  # micro-batches of a replay at least
REPLAY_ROWS_A_TASK = 20_000
BUCKETS_A_TASK = 8

PERIOD = ["country", "valid_from", "valid_to", "is_current", *bi.ATTRIBUTES]  # what reports show of a player's period

THREE_VALUED = {"is_self_excluded_as_of", "success_flag"}

QUERIES: dict[str, Query] = {}


def warehouse(spark: SparkSession, folder: str, **kwargs) -> Warehouse:
    return Warehouse(Lens(spark, folder, **kwargs), LENS_THRESHOLDS)


def tidy(df: DataFrame) -> DataFrame:
    """Types that compare exactly across engines: exact money as double, rates to six places, dates as text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(f.dataType, (T.DateType, T.ArrayType, T.MapType, T.StructType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif f.name in THREE_VALUED:
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(function: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    """Register a query under its function name."""
    QUERIES[function.__name__] = lambda spark, folder: tidy(function(warehouse(spark, folder)))
    return function


def _models(*names: str) -> None:
    for name in names:
        QUERIES[name] = lambda spark, folder, name=name: tidy(getattr(warehouse(spark, folder), name))


_models(
    "stg_players", "stg_devices", "stg_player_attribute_history", "stg_sessions", "stg_login_events",
    "stg_game_rounds", "stg_payments", "stg_bonuses", "stg_fraud_ground_truth", "stg_streaming_fraud_flags",
    "bot_sessions", "player_daily_activity", "dim_players_scd2", "player_ltv",
    "fraud_summary", "self_exclusion_registry",
)
QUERIES["unified_events"] = lambda spark, folder: tidy(warehouse(spark, folder).events)
QUERIES["fx_rates"] = lambda spark, folder: tidy(
    warehouse(spark, folder).raw.payments.select(F.upper("currency").alias("currency")).distinct()
    .join(F.broadcast(warehouse(spark, folder).fx), "currency", "left")
)


def _rule(name: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        w = warehouse(spark, folder)
        return tidy(getattr(rules, name)(w.events, **w.at.rules[name]))

    QUERIES[f"flags_{name}"] = run


for _name in LENS_THRESHOLDS.rules:
    _rule(_name)


@query
def session_activity(w: Warehouse) -> DataFrame:
    return w.session_activity.drop("is_bot")


@query
def churn_labels(w: Warehouse) -> DataFrame:
    return w.share("player_daily_activity").churn_labels


@query
def flags_self_exclusion_breach(w: Warehouse) -> DataFrame:
    return rules.self_exclusion_breach(w.events, w.self_exclusion_registry)


@query
def flags_all_rules(w: Warehouse) -> DataFrame:
    return w.flags


@query
def flags_stamped(w: Warehouse) -> DataFrame:
    return rules.stamp_detection(w.flags)


@query
def replayed_events(w: Warehouse) -> DataFrame:
    return replay_slice(w.events, 6, "2024-06-01 00:00:00")


@query
def keep_first_lineitem(w: Warehouse) -> DataFrame:
    return keep_first(w.raw.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query
def payments_with_status_then(w: Warehouse) -> DataFrame:
    columns = ["vip_tier", "risk_segment"]
    return asof_lookup(
        w.stg_payments.select("payment_id", "player_id", "ts"), w.dim_players_scd2, "player_id", "ts", columns
    )


@query
def payments_with_status_now(w: Warehouse) -> DataFrame:
    columns = ["vip_tier", "risk_segment"]
    return current_lookup(
        w.stg_payments.select("payment_id", "player_id", "ts"), w.dim_players_scd2, "player_id", columns
    )


# Quality ----------------------------------------------------------------------------------------------------------


@query
def raw_gate(w: Warehouse) -> DataFrame:
    return quality.raw_gate(w.raw)


@query
def raw_gate_by_table(w: Warehouse) -> DataFrame:
    return quality.report_by_table(quality.raw_gate(w.raw))


@query
def raw_duplicate_rates(w: Warehouse) -> DataFrame:
    return quality.raw_duplicate_rates(w.raw)


@query
def model_tests(w: Warehouse) -> DataFrame:
    return quality.model_tests(w.share("player_daily_activity"))


@query
def scd2_overlaps(w: Warehouse) -> DataFrame:
    return quality.overlapping_periods(w.dim_players_scd2, "player_id")


@query
def overlapping_quarters(w: Warehouse) -> DataFrame:
    """The overlap test on periods that do overlap: ninety days from every attribute change."""
    quarters = w.raw.player_attribute_history.select(
        "player_id", F.col("effective_ts").alias("valid_from"),
        F.expr("effective_ts + interval 90 days").alias("valid_to"),
    )
    return quality.overlapping_periods(quarters, "player_id")


# Governance -------------------------------------------------------------------------------------------------------

SALT = "bench-salt"
GOVERNED = (*governance.HASHED_COLUMNS, *governance.NULLED_COLUMNS, *governance.RETAINED_TABLES)


def _tables(w: Warehouse) -> dict[str, DataFrame]:
    return {n: getattr(w.raw, n) for n in GOVERNED}


def _requests(w: Warehouse) -> DataFrame:
    """Everybody who ever self-excluded asks to be erased."""
    return w.self_exclusion_registry.select("player_id")


@query
def erased_sessions(w: Warehouse) -> DataFrame:
    return governance.erase(_tables(w), _requests(w), SALT)["sessions"]


@query
def erased_login_events(w: Warehouse) -> DataFrame:
    return governance.erase(_tables(w), _requests(w), SALT)["login_events"]


@query
def erased_players(w: Warehouse) -> DataFrame:
    return governance.erase(_tables(w), _requests(w), SALT)["players"]


@query
def erasure_dry_run(w: Warehouse) -> DataFrame:
    return governance.erase_dry_run(_tables(w), _requests(w))


@query
def erasure_audit(w: Warehouse) -> DataFrame:
    return governance.audit_rows(_requests(w), SALT, "2024-02-29 12:00:00")


@query
def erasure_committed(w: Warehouse) -> DataFrame:
    """Erasure end to end: raw tables written, erased in one commit, and read as any job reads them, with the audit log."""
    folder = scratch_dir(w.spark, "governed")
    for name in (*governance.HASHED_COLUMNS, *governance.NULLED_COLUMNS):
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW[name].fields]
        getattr(w.raw, name).select(*typed).repartitionByRange("player_id").write.parquet(f"{folder}/{name}.parquet")
    requests = _requests(w).select(F.col("player_id").cast("string").alias("player_id"))
    governance.run_erasure(w.spark, folder, requests, SALT, "2024-02-29 12:00:00")
    raw, log = RawTables(w.spark, folder), governance.audit_log(w.spark, folder)
    parts = [
        raw.sessions.select(F.lit("sessions").alias("table_name"), F.col("session_id").alias("row_id"), "player_id",
                            F.col("ip_address").alias("value")),
        raw.login_events.select(F.lit("login_events"), "login_id", "player_id", "ip_address"),
        raw.players.select(F.lit("players"), "player_id", "player_id", F.col("date_of_birth").cast("string")),
        log.select(F.lit(governance.AUDIT_LOG), "erasure_id", "player_id_pseudonym", F.col("retention_expires_at").cast("string")),
    ]
    return reduce(DataFrame.union, parts)


@query
def erasure_refused(w: Warehouse) -> DataFrame:
    """Requested players that do not exist, for whose sake a batch is refused: every other id is made up."""
    asked = w.raw.players.select((F.col("player_id") * (1 - 2 * (F.col("player_id") % 2))).alias("player_id"))
    return governance.unknown_players(asked, w.raw.players)


@query
def retained_row_counts(w: Warehouse) -> DataFrame:
    return governance.retained_row_counts(_tables(w), w.raw.players)


@query
def erasure_sample(w: Warehouse) -> DataFrame:
    return governance.erasure_sample(w.dim_players_scd2, _tables(w))


@query
def classified_columns(w: Warehouse) -> DataFrame:
    return governance.classified_columns(w.spark, w.share("player_daily_activity").governed_models())


@query
def classification_rollup(w: Warehouse) -> DataFrame:
    return governance.classification_rollup(classified_columns(w))


@query
def retention_schedule(w: Warehouse) -> DataFrame:
    return governance.retention_schedule(w.spark, classified_columns(w))


@query
def retention_due(w: Warehouse) -> DataFrame:
    """Exclusion history may go six years after the player's last activity."""
    closed = w.player_ltv.filter("last_active_date is not null").select("player_id", "last_active_date")
    return governance.retention_due(closed, "responsible_gambling", "last_active_date")


@query
def expired_archive_days(w: Warehouse) -> DataFrame:
    return governance.expired_days(w.events, "2024-04-15")


@query
def general_view_dim_players(w: Warehouse) -> DataFrame:
    return governance.general_view(w.dim_players_scd2, "dim_players_scd2")


# Distortion and model ---------------------------------------------------------------------------------------------

for _plan in (
    distortion.naive_features, distortion.engineered_features, distortion.dedup_distortion,
    distortion.declined_distortion, distortion.deposit_distortion, distortion.self_exclusion_contamination,
    distortion.bot_contamination, distortion.point_in_time_mismatches, distortion.join_fanout,
    distortion.totals_before_join,
):
    query(_plan)


@query
def deposit_scenarios(w: Warehouse) -> DataFrame:
    return distortion.deposit_scenarios(distortion.deposit_distortion(w))


@query
def bonus_average(w: Warehouse) -> DataFrame:
    return distortion.bonus_average(w.raw.bonuses)


@query
def sessions_per_utc_day(w: Warehouse) -> DataFrame:
    return distortion.sessions_per_utc_day(w.raw.sessions)


@query
def money_sum(w: Warehouse) -> DataFrame:
    totals = distortion.money_sum(w.raw.payments)
    return totals.withColumn("float_total", F.round("float_total", 2))


@query
def churn_score_metrics(w: Warehouse) -> DataFrame:
    """The ranking metrics for a simple score: fewer sessions, more likely to have gone."""
    scored = distortion.engineered_features(w).select(
        F.col("is_churned").alias("label"), (1 / (1 + F.col("total_sessions"))).alias("score")
    )
    return churn.score_metrics(scored)


@query
def churn_model_comparison(w: Warehouse) -> DataFrame:
    return churn.compare_models(w)


# Reports ----------------------------------------------------------------------------------------------------------


@query
def bi_kpis(w: Warehouse) -> DataFrame:
    return bi.kpis(w)


@query
def bi_scd_summary(w: Warehouse) -> DataFrame:
    return bi.scd_summary(w.dim_players_scd2)


@query
def bi_current_split(w: Warehouse) -> DataFrame:
    return bi.current_split(w.dim_players_scd2)


@query
def bi_scd_timeline(w: Warehouse) -> DataFrame:
    return bi.scd_timeline(w.dim_players_scd2)


@query
def bi_attribute_timeline(w: Warehouse) -> DataFrame:
    return bi.attribute_timeline(bi.scd_timeline(w.dim_players_scd2))


@query
def bi_point_in_time_vs_current(w: Warehouse) -> DataFrame:
    return bi.point_in_time_vs_current(w.dim_players_scd2, "2022-06-15")


@query
def bi_recent_flags(w: Warehouse) -> DataFrame:
    return bi.recent_flags(w.stg_streaming_fraud_flags)


@query
def bi_value_at_risk(w: Warehouse) -> DataFrame:
    return bi.value_at_risk(w)


@query
def bi_exposure(w: Warehouse) -> DataFrame:
    return bi.exposure(w, days=30)


@query
def bi_ltv_histogram(w: Warehouse) -> DataFrame:
    return bi.ltv_histogram(w.share("player_ltv").player_ltv)


@query
def bi_ltv_by_country(w: Warehouse) -> DataFrame:
    return bi.ltv_by_country(w.player_ltv)


@query
def bi_churn_composition(w: Warehouse) -> DataFrame:
    return bi.churn_composition(w.share("player_daily_activity").churn_labels)


# Sinks and streams. Each writes to a fresh folder in shared storage and returns what it reads back. --------------


@query
def synced_flags(w: Warehouse) -> DataFrame:
    target = scratch_dir(w.spark, "flags")
    sync_flags(w.raw.streaming_fraud_flags, target)
    return w.spark.read.parquet(target)


@query
def replaced_table(w: Warehouse) -> DataFrame:
    """Load a table, then load it again with other columns."""
    path = scratch_dir(w.spark, "registry")
    replace_table(w.self_exclusion_registry.select("player_id"), "stakelens_self_exclusion", path)
    replace_table(w.self_exclusion_registry, "stakelens_self_exclusion", path)
    return w.spark.table("stakelens_self_exclusion")


@query
def appended_audit(w: Warehouse) -> DataFrame:
    path = scratch_dir(w.spark, "audit")
    append_audit(governance.audit_rows(_requests(w), SALT, "2024-02-29 12:00:00"), path)
    append_audit(governance.audit_rows(w.raw.players, SALT, "2024-03-01 12:00:00"), path)
    return w.spark.read.parquet(path)


@query
def metrics_document(w: Warehouse) -> DataFrame:
    path = scratch_dir(w.spark, "metrics")
    metrics = distortion.join_fanout(w)
    write_metrics(metrics, path)
    return w.spark.read.schema(metrics.schema).json(path)


@query
def exported_reports(w: Warehouse) -> DataFrame:
    """Rows of each exported report."""
    # Several reports read these, so they are made once, with no columns but those that a report needs.
    w.dim_players_scd2 = w.dim_players_scd2.select("player_id", *PERIOD)
    w.stg_payments = w.stg_payments.select("payment_id", "player_id", "payment_type", "amount_gbp", "ts", "status")
    w.stg_fraud_ground_truth = w.stg_fraud_ground_truth.select("scenario_type", "entity_type", "entity_id")
    w.share("stg_payments", "player_daily_activity", "dim_players_scd2", "stg_fraud_ground_truth", "stg_streaming_fraud_flags")
    target = scratch_dir(w.spark, "reports")
    reports = {
        "fraud_summary": w.fraud_summary,
        "recent_flags": bi.recent_flags(w.stg_streaming_fraud_flags),
        "player_ltv": w.player_ltv,
        "churn_labels": w.churn_labels,
        "scd_summary": bi.scd_summary(w.dim_players_scd2),
        "scd_timeline": bi.scd_timeline(w.dim_players_scd2),
        "scenario_exposure": bi.value_at_risk(w),
    }
    export_reports(w.spark, reports, target)
    return published(w.spark, target).drop("checksum")


@query
def exported_timeline(w: Warehouse) -> DataFrame:
    """The contents of an exported report: of two editions, readers see the second."""
    target = scratch_dir(w.spark, "editions")
    w.dim_players_scd2 = w.dim_players_scd2.select("player_id", *PERIOD)
    timeline = bi.scd_timeline(w.share("dim_players_scd2").dim_players_scd2)  # which reads it twice
    export_reports(w.spark, {"scd_timeline": timeline.limit(0)}, target)
    export_reports(w.spark, {"scd_timeline": timeline}, target)
    return published(w.spark, target, "scd_timeline")


def _streamed(function: Callable[[Warehouse, str], DataFrame]) -> None:
    """Register a query over the events table read as a stream, worked off until nothing is left."""
    QUERIES[function.__name__] = lambda spark, folder: tidy(
        function(warehouse(spark, folder, stream=True), scratch_dir(spark, function.__name__))
    )


def _finish(writer, **trigger) -> None:
    writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


@_streamed
def stream_archive(w: Warehouse, target: str) -> DataFrame:
    """Events per archived day, read back by partition."""
    _finish(detector.archive_events(w.events, target, f"{target}-state"))
    days = w.spark.read.schema("event_type string, year string, month string, day string").json(target)
    return days.groupBy("year", "month", "day", "event_type").agg(F.count("*").alias("events"))


@_streamed
def stream_without_retries(w: Warehouse, target: str) -> DataFrame:
    kept = detector.without_retries(w.events).select("event_type", "entity_id", "ts")
    _finish(kept.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-state"))
    return w.spark.read.schema("event_type string, entity_id bigint, ts timestamp").parquet(target)


@_streamed
def stream_rolling_large_deposits(w: Warehouse, target: str) -> DataFrame:
    windows = detector.rolling_large_deposits(w.events, floor_gbp=45.0, window="72 hours", slide="24 hours")
    _finish(detector.write_windows(windows, target, f"{target}-state"))
    return detector.read_windows(w.spark, target)


@_streamed
def stream_messages(w: Warehouse, target: str) -> DataFrame:
    """Events encoded as keyed JSON messages, written, and decoded from the stream of files."""
    to_messages(warehouse(w.spark, w.raw.folder).events).select("value").write.text(f"{target}-topic")
    decoded = event_stream(w.spark, f"{target}-topic", w.fx)
    _finish(decoded.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-state"))
    ids = {c: F.col(c).cast("bigint") for c in ("entity_id", "player_id", "device_id", "session_id")}
    return w.spark.read.schema(decoded.schema).parquet(target).withColumns(ids)


@_streamed
def stream_flags(w: Warehouse, target: str) -> DataFrame:
    """All six rules as stateful jobs over a bounded replay. They must raise what the batch rules raise."""
    at = w.at.rules
    events = warehouse(w.spark, w.raw.folder).events
    total = events.count()
    rows = min(replay.ROWS, -(-total // REPLAY_SLICES) or 1)
    # A micro-batch of a long replay takes several slices, or the number of batches, each of which reads and writes the
    # state of nearly all keys, would grow along with the state.
    files = max(1, total // rows // REPLAY_SLICES)
    write_slices(events, f"{target}-slices", rows)
    write_parquet(w.self_exclusion_registry, f"{target}-registry")
    # State is dealt out for good when a stream starts, so its session has as many partitions as a micro-batch can fill.
    own = prepare(w.spark.newSession())
    tasks = max(1, min(rows * files // REPLAY_ROWS_A_TASK, int(w.spark.conf.get("spark.sql.shuffle.partitions"))))
    own.conf.set("spark.sql.shuffle.partitions", tasks)
    player = PlayerRules(
        card_window_seconds=at["card_testing"]["window_seconds"],
        min_bins=at["card_testing"]["min_bins"],
        pending_seconds=at["account_takeover"]["pending_seconds"],
        near_threshold_gbp=at["structuring"]["threshold_gbp"] * 0.9,
        structuring_window_seconds=at["structuring"]["window_seconds"],
    )
    jobs = detector.run_detector(
        replay_stream(own, f"{target}-slices", events.schema, files), own.read.parquet(f"{target}-registry"), target,
        f"{target}-state", once=True, player=player, ring=at["bonus_ring"], session=at["bot_betting"],
        buckets=tasks * BUCKETS_A_TASK,
    )
    for job in jobs:
        job.awaitTermination()
    ids = {c: F.col(c).cast("bigint") for c in ("entity_id", "player_id", "raised_by")}
    return detector.read_flags(w.spark, target).withColumns(ids).drop("flag_id", "detected_ts", "job", "batch_id")
