"""Data-quality expectations, all of a table's checks in one aggregation plus one per uniqueness check."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """``bad`` marks unexpected rows; uniqueness has none, because it is a property of groups."""

    name: str
    column: str | None
    bad: Column | None


def not_null(column: str) -> Expectation:
    return Expectation(f"not_null({column})", column, F.col(column).isNull())


def unique(column: str) -> Expectation:
    return Expectation(f"unique({column})", column, None)


def in_set(column: str, values: Sequence[str]) -> Expectation:
    return Expectation(f"in_set({column})", column, ~F.col(column).isin(list(values)))


def at_least(column: str, low: float, strict: bool = False) -> Expectation:
    c = F.col(column)
    return Expectation(f"{'above' if strict else 'at_least'}({column}, {low})", column, c <= low if strict else c < low)


def not_before(later: str, earlier: str) -> Expectation:
    return Expectation(f"not_before({later}, {earlier})", later, F.col(later) < F.col(earlier))


def never(name: str, bad: Column) -> Expectation:
    return Expectation(name, None, bad)


def _result(table: str, name: str, rows: Column, bad: Column, low: Column, high: Column) -> Column:
    percent = F.when(rows > 0, bad * 100.0 / rows).otherwise(0.0)
    return F.struct(
        F.lit(table).alias("table_name"),
        F.lit(name).alias("expectation"),
        (bad == 0).alias("success"),
        bad.alias("unexpected_count"),
        percent.alias("unexpected_percent"),
        low.alias("sample_min"),
        high.alias("sample_max"),
    )


def _row_totals(checks: Sequence[Expectation]) -> list[Column]:
    totals = [F.count("*").alias("rows")]
    for i, c in enumerate(checks):
        text = F.col(c.column).cast("string") if c.column else F.lit(None).cast("string")
        totals += [
            F.count_if(c.bad).alias(f"bad{i}"),
            F.min(F.when(c.bad, text)).alias(f"low{i}"),
            F.max(F.when(c.bad, text)).alias(f"high{i}"),
        ]
    return totals


def _repeats(df: DataFrame, column: str) -> DataFrame:
    """Rows in all, and those whose value is not alone. Counts per value hash and combine before the exchange."""
    repeated = (F.col("n") > 1) & F.col(column).isNotNull()
    text = F.when(repeated, F.col(column).cast("string"))
    return df.groupBy(column).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("bad"),
        F.min(text).alias("low"),
        F.max(text).alias("high"),
    )


def expect(df: DataFrame, table: str, checks: Sequence[Expectation]) -> DataFrame:
    """One row per check. Nulls count only against ``not_null``; the sample is the range of unexpected values.

    All row checks of a table are sums over one pass, without an exchange of rows. Each uniqueness check is a count
    per value that reads and exchanges only its column.
    """
    rowwise = [c for c in checks if c.bad is not None]
    reports = []
    if rowwise:
        results = [
            _result(table, c.name, F.col("rows"), F.col(f"bad{i}"), F.col(f"low{i}"), F.col(f"high{i}"))
            for i, c in enumerate(rowwise)
        ]
        reports.append(df.agg(*_row_totals(rowwise)).select(F.inline(F.array(*results))))
    for c in checks:
        if c.bad is None:
            one = _result(table, c.name, F.col("rows"), F.col("bad"), F.col("low"), F.col("high"))
            reports.append(_repeats(df, c.column).select(F.inline(F.array(one))))
    return reduce(DataFrame.unionByName, reports)


def not_found(spark: SparkSession, table: str) -> DataFrame:
    """The report's row for a table that is not there: nothing was checked, so its success is null."""
    return spark.range(1).select(
        F.lit(table).alias("table_name"), F.lit("table_found").alias("expectation"), F.lit(None).cast("boolean").alias("success"),
        F.lit(0).cast("long").alias("unexpected_count"), F.lit(0.0).alias("unexpected_percent"),
        F.lit(None).cast("string").alias("sample_min"), F.lit(None).cast("string").alias("sample_max"))


def duplicate_rate(df: DataFrame, table: str, column: str) -> DataFrame:
    """Share of rows beyond the first per id; zero for an empty table. Reported, never gated."""
    rate = F.when(F.count("*") > 0, 1 - F.countDistinct(column) / F.count("*")).otherwise(0.0)
    return df.agg(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), rate.alias("duplicate_rate")
    )
