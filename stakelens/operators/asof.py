"""Validity periods and lookups against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import DAY, YEAR, last_value, lead, ordered


def scd_periods(history: DataFrame, key: str, effective: str, width: float = YEAR) -> DataFrame:
    """Turn a change log into half-open periods [valid_from, valid_to); the open end is null."""
    log = ordered(history.withColumnRenamed(effective, "valid_from"), [key], ["valid_from"], width)
    return log.add(valid_to=lead("valid_from")).result()


def asof_lookup(
    events: DataFrame,
    periods: DataFrame,
    key: str,
    at: str,
    columns: list[str],
    width: float = 30 * DAY,
) -> DataFrame:
    """Inner point-in-time lookup: each event with the period of its key that covers ``at``.

    Union and carry forward rather than an equi join with a range residual: the join would form every
    (event, period) pair of a key before discarding all but one, while this stays linear in both inputs.
    Periods of one key must not overlap.
    """
    side = F.lit(0).alias("_side")  # a period that starts exactly at the event's instant covers it
    period = F.struct("valid_from", "valid_to", *columns).alias("_period")
    starts = periods.select(F.col(key), F.col("valid_from").alias(at), side, period)
    rows = events.select("*", F.lit(1).alias("_side"))
    both = ordered(starts.unionByName(rows, allowMissingColumns=True), [key], [at, "_side"], width)
    found = both.add(_period=last_value(F.col("_period"))).result()
    covers = F.col("_period.valid_to").isNull() | (F.col(at) < F.col("_period.valid_to"))
    return (
        found.filter((F.col("_side") == 1) & F.col("_period").isNotNull() & covers)
        .select(*events.columns, *[F.col(f"_period.{c}").alias(c) for c in columns])
    )


def current_lookup(events: DataFrame, periods: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The naive counterpart: whatever the open row says today, whenever the event happened."""
    return events.join(periods.filter("is_current").select(key, *columns), key)
