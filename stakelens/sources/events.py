"""One event frame for the detector, from tables, from messages, or replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import to_gbp
from ..schemas import EVENT

# Events of equal timestamp are handled in this order.
SEQ = {"login": 0, "payment": 1, "bonus_claim": 2, "game_round": 3}
# A message that says only that time has come so far: nothing earlier will follow. It moves a stream's watermark on.
TICK = "tick"


def normalise(payments: DataFrame, fx: DataFrame) -> DataFrame:
    """Attach ``amount_gbp``. Rates may come from a caller's file, so the planner decides by their size."""
    rates = fx.select(F.col("currency").alias("_fx"), "rate_to_gbp")
    return (
        payments.join(rates, F.upper("currency") == F.col("_fx"), "left")
        .withColumn("amount_gbp", to_gbp("amount", "rate_to_gbp"))
        .drop("_fx", "rate_to_gbp")
    )


def _typed(df: DataFrame, kind: str, **renamed: str) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in renamed.items()}).withColumns(
        {"event_type": F.lit(kind), "seq": F.lit(SEQ[kind])}
    )


def login_events(logins: DataFrame, use_geo: bool = True) -> DataFrame:
    cols = ["event_type", "entity_id", "player_id", "device_id", "ts", "seq"]
    return _typed(logins, "login", entity_id="login_id").select(*cols, *(["country_from_ip"] if use_geo else []))


def payment_events(payments: DataFrame, fx: DataFrame) -> DataFrame:
    return _typed(normalise(payments, fx), "payment", entity_id="payment_id").select(
        "event_type", "entity_id", "player_id", "device_id", "ts", "seq",
        "payment_type", "amount", "currency", "amount_gbp", "card_bin",
    )


def bonus_events(bonuses: DataFrame) -> DataFrame:
    return _typed(bonuses, "bonus_claim", entity_id="bonus_id", ts="claim_ts").select(
        "event_type", "entity_id", "player_id", "device_id", "ts", "seq", "bonus_type"
    )


def round_events(rounds: DataFrame) -> DataFrame:
    return _typed(rounds, "game_round", entity_id="round_id").select(
        "event_type", "entity_id", "player_id", "session_id", "ts", "seq"
    )


def unified_events(
    logins: DataFrame,
    payments: DataFrame,
    bonuses: DataFrame,
    rounds: DataFrame,
    fx: DataFrame,
    use_geo: bool = True,
) -> DataFrame:
    """The four event tables as one frame in EVENT's column order.

    Rows are taken as given, retries included. ``use_geo=False`` leaves the login country out, which makes every
    login "new geography" to the takeover rule.
    """
    parts = [
        login_events(logins, use_geo),
        payment_events(payments, fx),
        bonus_events(bonuses),
        round_events(rounds),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT.fields if f.name not in out.columns]
    return out.select("*", *missing).select(*EVENT.fieldNames())


def replay_slice(events: DataFrame, hours: int, now: str | None = None) -> DataFrame:
    """The last ``hours`` before the newest round, every ts shifted so that the cutoff lands on ``now``."""
    newest = events.filter("event_type = 'game_round'")
    cutoff = newest.agg(F.max("ts") - F.expr(f"interval {int(hours)} hours")).scalar()
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    shifted = F.timestamp_micros(F.unix_micros("ts") - F.unix_micros(cutoff) + F.unix_micros(at))
    return events.filter(F.col("ts") >= cutoff).withColumn("ts", shifted)


def to_messages(events: DataFrame) -> DataFrame:
    """Key and JSON value of each event, ready for a topic keyed by player."""
    body = F.struct(
        *[c for c in events.columns if c not in {"ts", "seq", "amount_gbp"}],
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
    )
    return events.select(F.col("player_id").cast("string").alias("key"), F.to_json(body).alias("value"))


def _decoded(messages: DataFrame) -> DataFrame:
    """The messages with ``e``, their fields, ``at``, their time, and ``wrong``, why they are no events (else null)."""
    wire = T.StructType([T.StructField(f.name, T.StringType() if f.name == "ts" else f.dataType)
                         for f in EVENT.fields if f.name not in {"seq", "amount_gbp"}])
    body = F.col("value").cast("string")
    decoded = messages.select(body.alias("message"), F.from_json(body, wire).alias("e")).withColumn(
        "at", F.try_to_timestamp("e.ts"))
    wrong = (
        F.when(F.col("message").isNull() | F.col("e.event_type").isNull(), F.lit("no event"))
        .when(~F.col("e.event_type").isin([*SEQ, TICK]), F.lit("unknown event type"))
        .when(F.col("at").isNull(), F.lit("no time"))
    )
    return decoded.withColumn("wrong", wrong)


def rejected_messages(messages: DataFrame) -> DataFrame:
    """Messages that are no events, with the reason: to be written next to the events, so that none vanishes."""
    return _decoded(messages).filter("wrong is not null").select("message", F.col("wrong").alias("reason"))


def from_messages(messages: DataFrame, fx: DataFrame) -> DataFrame:
    """Decode JSON messages into EVENT rows, but for those that :func:`rejected_messages` returns.

    A ts without an offset is UTC, as the session zone is.
    """
    events = _decoded(messages).filter("wrong is null").select("e.*", "at")
    rank = F.coalesce(*[F.when(F.col("event_type") == kind, F.lit(n)) for kind, n in SEQ.items()])
    events = events.withColumns({"ts": F.col("at"), "seq": rank}).drop("at")
    return normalise(events, fx).select(*EVENT.fieldNames())


def message_stream(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Messages from a topic (``source="kafka"`` plus its options) or a folder of JSON messages.

    Admission is bounded per micro-batch: ``maxOffsetsPerTrigger`` or ``maxFilesPerTrigger``.
    """
    if source == "kafka":
        bounded = {"maxOffsetsPerTrigger": "100000", **options}
        return spark.readStream.format("kafka").options(**bounded).load()
    bounded = {"maxFilesPerTrigger": "100", **options}
    return spark.readStream.options(**bounded).text(source)


def event_stream(spark: SparkSession, source: str, fx: DataFrame, **options: str) -> DataFrame:
    """Streaming EVENT rows from the messages of :func:`message_stream` that are events."""
    return from_messages(message_stream(spark, source, **options), fx)
