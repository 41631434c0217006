"""Gapless positions in a total order, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import fresh


def ranked(df: DataFrame, order: list[Column], to: str, durable: Callable[..., DataFrame]) -> DataFrame:
    """The frame with a long column ``to``: 0, 1, 2, ... along ``order``. Ties are ranked in some fixed way.

    Rows are dealt out in ranges of the order and written; positions start at the rows of all earlier ranges. What is
    gathered is one count per range.
    """
    part, place, first = fresh(df, "_part", "_place", "_first")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits of this id number the rows of a partition, the bits above name the partition.
    at = F.monotonically_increasing_id()
    written = durable(dealt.withColumns({
        part: F.shiftright(at, 33), place: at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = written.groupBy(part).count().select(
        F.col(part).alias(first), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(to))
    return (
        written.join(F.broadcast(firsts), F.col(part) == F.col(first))  # a row per partition
        .withColumn(to, (F.col(to) + F.col(place)).cast("long")).drop(part, place, first)
    )
