"""Shards of nearly equal bytes out of indivisible groups, by Karmarkar-Karp differencing.

A partial partition has one sum per shard. The two partial partitions of largest spread are combined again and again,
the largest sum of one with the smallest of the other, until one is left; unrolling the combinations gives the shard
of each group. The groups are dealt into cells of bounded size by their digest. Cells are differenced in parallel,
each down to one partial partition, and these are differenced in turn, in as many levels as it takes for the last to
fit one task. A level multiplies what is left of the spread by a small fraction, as the method does.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked

CELL = 8192  # groups, or partial partitions, that one task combines; about, since cells are dealt by hash


def difference(partitions: list[list[int]], shards: int) -> list[list[int]]:
    """For each partial partition (sums, at most ``shards`` of them), the shard of each of its sums."""
    nodes: list[tuple] = []
    heap: list[tuple[int, int, tuple[int, ...]]] = []
    for i, sums in enumerate(partitions):
        padded = [*sums, *[0] * (shards - len(sums))]
        order = sorted(range(shards), key=lambda s: (-padded[s], s))
        nodes.append((order,))
        ranked_sums = tuple(padded[s] for s in order)
        heap.append((ranked_sums[-1] - ranked_sums[0], i, ranked_sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, large = heapq.heappop(heap)
        _, b, small = heapq.heappop(heap)
        sums = [x + y for x, y in zip(large, reversed(small), strict=True)]
        order = sorted(range(shards), key=lambda s: (-sums[s], s))
        nodes.append((order, a, b))
        ranked_sums = tuple(sums[s] for s in order)
        heapq.heappush(heap, (ranked_sums[-1] - ranked_sums[0], len(nodes) - 1, ranked_sums))
    out: list[list[int]] = [[] for _ in partitions]
    label: dict[int, list[int]] = {len(nodes) - 1: list(range(shards))} if nodes else {}
    for i in range(len(nodes) - 1, -1, -1):
        order, own = nodes[i][0], label.pop(i)
        placed = [0] * shards
        for position, s in enumerate(order):
            placed[s] = own[position]
        if len(nodes[i]) == 1:
            out[i] = placed[:len(partitions[i])]
        else:
            label[nodes[i][1]], label[nodes[i][2]] = placed, placed[::-1]
    return out


def _cells(count: int) -> int:
    return -(-count // CELL)


def balance(groups: DataFrame, shards: int, durable: Callable[..., DataFrame]) -> DataFrame:
    """(digest, shard) for ``groups`` (digest, weight: one row each). The same groups always get the same shards."""
    cells = max(1, _cells(groups.count()))

    def of_groups(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("digest", ignore_index=True)
        placed = difference([[int(w)] for w in rows["weight"]], shards)
        return rows.assign(part=[p[0] for p in placed])[["node", "digest", "weight", "part"]]

    def of_partitions(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        return rows.assign(places=difference([list(map(int, s)) for s in rows["sums"]], shards))[
            ["node", "parent", "sums", "places"]]

    dealt = groups.withColumn("node", F.pmod(F.xxhash64("digest"), F.lit(cells)))
    placed = durable(dealt.groupBy("node").applyInPandas(
        of_groups, "node long, digest binary, weight long, part int"), "cells")
    by_part = placed.groupBy("node", "part").agg(F.sum("weight").alias("sum"))
    # Sums of a node, one for each of the shards.
    table = by_part.groupBy("node").agg(*[
        F.coalesce(F.max(F.when(F.col("part") == p, F.col("sum"))), F.lit(0)).alias(f"s{p}") for p in range(shards)
    ]).select("node", F.array(*[f"s{p}" for p in range(shards)]).alias("sums"))
    chain = []
    while cells:
        cells = _cells(cells) if cells > 1 else 0
        level = durable(table.withColumn("parent", F.pmod(F.col("node"), F.lit(max(1, cells)))).groupBy("parent").applyInPandas(
            of_partitions, "node long, parent long, sums array<long>, places array<int>"), "level")
        chain.append(level)
        if cells <= 1:
            break
        moved = level.select("parent", F.posexplode(F.arrays_zip("sums", "places")).alias("at", "v"))
        by_part = moved.groupBy("parent", F.col("v.places").alias("part")).agg(F.sum("v.sums").alias("sum"))
        table = by_part.groupBy(F.col("parent").alias("node")).agg(*[
            F.coalesce(F.max(F.when(F.col("part") == p, F.col("sum"))), F.lit(0)).alias(f"s{p}") for p in range(shards)
        ]).select("node", F.array(*[f"s{p}" for p in range(shards)]).alias("sums"))
    for level in chain:
        step = level.select(F.col("node").alias("from"), "parent", "places")
        placed = placed.join(step, F.col("node") == F.col("from")).select(
            "digest", F.col("parent").alias("node"), F.get("places", F.col("part")).alias("part"))
    return placed.select("digest", F.col("part").alias("shard"))


def shard(docs: DataFrame, durable: Callable[..., DataFrame], shards: int = 8, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The size is the bytes of the text and one more; equal texts share a shard, and null counts as empty. Slots number
    a shard's rows without gaps, by key. Nothing is promised for another number of shards, so ``grown_shard`` is
    null. Repeated rows get slots of their own; null keys come first. Empty tables give no rows. Other columns are
    not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = durable(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"), F.unhex(F.sha2(body, 256)).alias("digest")), "sizes")
    groups = durable(rows.groupBy("digest").agg((F.first("size") * F.count("*")).alias("weight")), "groups")
    home = balance(groups, shards, durable)
    placed = ranked(rows.join(home, "digest"), [F.col("shard").asc(), F.col("key").asc(), F.col("digest").asc()],
                    "place", durable)
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("shard").alias("of")).count().select(
        "of", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), F.col("shard") == F.col("of")).select(  # a row per shard
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), (F.col("place") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
