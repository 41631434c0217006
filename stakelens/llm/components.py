"""Connected components of a link table, without ever holding it in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _towards_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Link each node's neighbours to the least node of its neighbourhood (Kiveris et al., two kinds of stars).

    With ``larger_only`` only the larger neighbours move; otherwise only the smaller ones and the node itself.
    The least is combined before the exchange, and the join may be split, so a node with many links is no hot spot.
    """
    both = links.select("a", "b")
    if larger_only:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("low")
    )
    moved = both.join(least, F.col("a") == F.col("node"))
    if larger_only:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("low").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, durable: Callable[..., DataFrame]) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a and b); the component is its least node.

    Rounds until nothing changes, logarithmically many in the size of the largest component. Each round is written.
    Two numbers per round come to the driver. No links give no rows; links of a node to itself are dropped.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = durable(links.filter(F.col("a") != F.col("b")).select(high, low).distinct(), "links")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        stars = _towards_least(now, larger_only=True)
        # Links point from the larger to the smaller node, as the second kind of star takes them.
        now = durable(_towards_least(stars, larger_only=False), "links")
    least = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least)
