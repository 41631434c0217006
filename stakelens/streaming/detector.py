"""The detector as Structured Streaming jobs: rules per key, flag sink, archive."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..session import STATE_PROVIDER
from ..sources.events import TICK, rejected_messages
from ..sources.raw import exists
from .processors import FLAG_OUT, InOrder, PlayerProcessor, PlayerRules, RingProcessor, SessionProcessor

if TYPE_CHECKING:
    from .rule import Rule

WATERMARK = "10 minutes"
# Keys share the state of a bucket, which is read and written whole: a few keys with events in each, per micro-batch, are
# enough. State is bound to its bucket, so a checkpoint keeps the number it started with.
BUCKETS = 512


def with_watermark(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Late events beyond the delay are dropped; within it, order does not matter."""
    return events.withWatermark("ts", delay)


def of_kinds(events: DataFrame, kinds: tuple[str, ...], delay: str) -> DataFrame:
    """The events of these kinds. Ticks move the watermark on with them and go only behind it.

    The second condition reads ``ts``, so the optimizer does not apply it before the watermark.
    """
    marked = with_watermark(events.filter(F.col("event_type").isin(*kinds, TICK)), delay)
    return marked.filter(F.when(F.col("ts").isNotNull(), F.col("event_type") != TICK))


def without_retries(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Drop redelivered events while the watermark still remembers them. A caller's option: the rules do not ask it."""
    return with_watermark(events, delay).dropDuplicatesWithinWatermark(["event_type", "entity_id"])


def slim_events(events: DataFrame, keys: list[str], processor: InOrder) -> DataFrame:
    """Only the columns a rule reads: ids travel as text (the event's own as it is ordered), time as microseconds."""
    processor.keys = tuple(keys)
    processor.id_type = "bigint" if isinstance(events.schema["entity_id"].dataType, T.IntegralType) else "string"
    kinds = {"seq": "int", "amount_gbp": "double", "entity_id": processor.id_type}
    wanted = dict.fromkeys([*keys, "seq", "entity_id", *processor.columns])
    return events.select("ts", F.unix_micros("ts").alias("us"), *[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in wanted])


def as_flags(found: DataFrame) -> DataFrame:
    return found.select(
        "scenario_type", "entity_type", "entity_id", "player_id",
        F.timestamp_micros("triggering_us").alias("triggering_event_ts"), F.lit("high").alias("severity"),
        F.timestamp_micros("raised_us").alias("raised_ts"), "raised_by",
    )


def keyed_flags(events: DataFrame, keys: list[str], processor: InOrder, buckets: int = BUCKETS) -> DataFrame:
    """The flags that a processor raises on a stream with a watermark. Events without one of the keys belong together."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    dealt = slim_events(events, keys, processor).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return as_flags(dealt.groupBy("_bucket").transformWithState(
        statefulProcessor=processor, outputStructType=FLAG_OUT, outputMode="append", timeMode="EventTime"
    ))


def player_flags(
    events: DataFrame, rules: PlayerRules = PlayerRules(), delay: str = WATERMARK, buckets: int = BUCKETS
) -> DataFrame:
    wanted = of_kinds(events, ("login", "payment"), delay)
    return keyed_flags(wanted, ["player_id"], PlayerProcessor(rules), buckets)


def ring_flags(
    events: DataFrame, gap_seconds: float = 6 * 3600, delay: str = WATERMARK, buckets: int = BUCKETS
) -> DataFrame:
    wanted = of_kinds(events, ("bonus_claim",), delay)
    return keyed_flags(wanted, ["device_id", "bonus_type"], RingProcessor(gap_seconds), buckets)


def session_flags(
    events: DataFrame, min_gaps: int = 100, max_sd: float = 0.3, ttl_seconds: float = 6 * 3600, delay: str = WATERMARK,
    buckets: int = BUCKETS,
) -> DataFrame:
    wanted = of_kinds(events, ("game_round",), delay)
    return keyed_flags(wanted, ["session_id"], SessionProcessor(min_gaps, max_sd, ttl_seconds), buckets)


def breach_flags(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Stream-static join, so the registry is read afresh in every micro-batch. Needs no state."""
    logins = events.filter("event_type = 'login'")
    late = logins.join(registry, "player_id").filter(F.col("ts") > F.col("excluded_since"))
    text = lambda c: F.col(c).cast("string")
    return late.select(
        F.lit("self_exclusion_breach").alias("scenario_type"), F.lit("login").alias("entity_type"),
        text("entity_id").alias("entity_id"), text("player_id").alias("player_id"),
        F.col("ts").alias("triggering_event_ts"), F.lit("high").alias("severity"),
        F.col("ts").alias("raised_ts"), text("entity_id").alias("raised_by"),
    )


def rolling_large_deposits(
    events: DataFrame, floor_gbp: float = 9_000, window: str = "24 hours", slide: str = "1 hour", at_least: int = 2
) -> DataFrame:
    """Structuring as a plain windowed count, without state code. Coarser: windows start on the slide."""
    large = with_watermark(events).filter(
        (F.col("event_type") == "payment") & (F.col("payment_type") == "deposit") & (F.col("amount_gbp") >= floor_gbp)
    )
    return (
        large.groupBy(F.window("ts", window, slide), "player_id").agg(F.count("*").alias("deposits"))
        .filter(F.col("deposits") >= at_least)
        .select("player_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "deposits")
    )


def flag_id(*extra: Column) -> Column:
    """A function of the flag, so that a replayed micro-batch writes the same ids."""
    parts = [F.col(c).cast("string") for c in ("scenario_type", "entity_type", "entity_id", "raised_by")]
    return F.sha2(F.concat_ws("|", *parts, F.unix_micros("triggering_event_ts").cast("string"), *extra), 256)


def write_flags(flags: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Stamp and append flags. Each micro-batch owns a folder and overwrites it, so a retry does not duplicate.

    A batch without flags, as most are, leaves no folder.
    """

    def stamped(batch: DataFrame) -> DataFrame:
        return batch.select(
            flag_id().alias("flag_id"), "scenario_type", "entity_type", "entity_id", "player_id",
            "triggering_event_ts", F.current_timestamp().alias("detected_ts"), "severity", "raised_ts", "raised_by",
        )

    return _per_batch(flags, path, checkpoint, stamped)


def _per_batch(
    stream: DataFrame, path: str, checkpoint: str, shown: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> DataStreamWriter:
    """Each micro-batch with rows owns a folder and overwrites it, so a retry does not duplicate."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # or the state would be worked through once to see whether there are rows and once to write them
        try:
            if batch.count():  # all of its tasks at once; isEmpty would run one of them first, then a few
                shown(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def write_rejects(rejects: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Messages that are no events, with the reason, by micro-batch."""
    return _per_batch(rejects, path, checkpoint)


def read_rejects(spark, path: str) -> DataFrame:
    """The rejected messages of :func:`run_detector` under its ``path``; none if there were none."""
    schema = "message string, reason string, batch_id int"
    return spark.read.schema(schema).parquet(f"{path}-rejects") if exists(spark, f"{path}-rejects") else spark.createDataFrame([], schema)


def write_windows(windows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The windows that a micro-batch changed, as they are after it. State behind the watermark is dropped."""
    return _per_batch(windows, path, checkpoint).outputMode("update")


def read_windows(spark, path: str) -> DataFrame:
    """Every window as the last micro-batch left it that changed it."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in ("player_id", "window_start", "batch_id")]
    last = F.max_by(F.struct(*values), F.col("batch_id"))
    return changes.groupBy("player_id", "window_start").agg(last.alias("last")).select("player_id", "window_start", "last.*")


def archive_events(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Every event as gzipped JSON lines under year/month/day of its time, in files of five minutes' arrivals."""
    return (
        events.filter(F.col("event_type") != TICK).withColumns({
            "year": F.date_format("ts", "yyyy"), "month": F.date_format("ts", "MM"), "day": F.date_format("ts", "dd"),
        })
        .writeStream.format("json").partitionBy("year", "month", "day").option("compression", "gzip")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="5 minutes")
    )


def run_detector(
    events: DataFrame, registry: DataFrame, path: str, checkpoint: str, once: bool = False,
    player: PlayerRules = PlayerRules(), ring: dict | None = None, session: dict | None = None,
    messages: DataFrame | None = None, further: Sequence[Rule] = (), buckets: int = BUCKETS,
) -> list:
    """Start one query per partitioning key. ``once`` works off what is there and stops, for a backtest.

    With ``messages``, the stream that the events were decoded from, one more query keeps those that are no events,
    with the reason, so that none vanishes. Each rule in ``further`` is a query of its own.
    """
    jobs = {
        "player": player_flags(events, player, buckets=buckets),
        "ring": ring_flags(events, **(ring or {}), buckets=buckets),
        "session": session_flags(events, **(session or {}), buckets=buckets),
        "breach": breach_flags(events, registry),
        **{rule.name: rule.stream(events, buckets=buckets) for rule in further},
    }
    trigger = {"availableNow": True} if once else {"processingTime": "1 second"}
    writers = [write_flags(flags, f"{path}/job={name}", f"{checkpoint}/{name}") for name, flags in jobs.items()]
    if messages is not None:
        writers.append(write_rejects(rejected_messages(messages), f"{path}-rejects", f"{checkpoint}/rejects"))
    return [w.trigger(**trigger).start() for w in writers]


FLAG_FILE = (
    "flag_id string, scenario_type string, entity_type string, entity_id string, player_id string,"
    " triggering_event_ts timestamp, detected_ts timestamp, severity string, raised_ts timestamp, raised_by string,"
    " job string, batch_id int"
)


def read_flags(spark, path: str) -> DataFrame:
    """Flags of all jobs written by :func:`run_detector`; none if no batch has found any."""
    if not exists(spark, path):
        return spark.createDataFrame([], FLAG_FILE)
    return spark.read.parquet(path)
