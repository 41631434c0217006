"""Approximate nearest neighbours by inner product: a hierarchical small-world graph per shard, results merged.

Rows are dealt to shards of about ``SHARD_ROWS`` by their id. A shard's graph has its distinct vectors as nodes (copies
share a node, so a vector that a third of the rows hold is one node per shard), a level for every node, and on each
level a flat array with a fixed number of neighbours per node: the most similar ones that are not more similar to a
neighbour already taken, and the nodes that chose this one. For vectors of unequal length neighbours are chosen
with one more dimension that makes all lengths equal, in which largest inner product means least distance.

A graph is built once and written as one row. Queries come in blocks; a block walks a shard's graph together, one
array operation per step for all its queries: greedily down the levels, then with a beam on the lowest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
QUERY_BLOCK = 256
LINKS = 16  # chosen neighbours of a node, and half of those that it can have
CONSIDERED = 64  # most similar nodes among which neighbours are chosen
BEAM = 128
TOP = 20


def _similar(x: np.ndarray, rows: slice, count: int) -> tuple[np.ndarray, np.ndarray]:
    sims = x[rows] @ x.T
    sims[np.arange(sims.shape[0]), np.arange(rows.start, rows.start + sims.shape[0])] = -np.inf
    near = np.argpartition(-sims, min(count, sims.shape[1] - 1) - 1, axis=1)[:, :count]
    value = np.take_along_axis(sims, near, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)


def neighbours(x: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Flat neighbour array (nodes by twice ``links``, -1 for none) of vectors of equal length."""
    n = len(x)
    out = np.full((n, 2 * links), -1, np.int32)
    if n < 2:
        return out
    count = min(CONSIDERED, n - 1)
    froms, tos = [], []
    for start in range(0, n, 256):
        rows = slice(start, min(n, start + 256))
        near, value = _similar(x, rows, count)
        among = np.einsum("bcd,bed->bce", x[near], x[near])
        taken = np.zeros(near.shape, bool)
        for c in range(count):
            # A candidate stays if no neighbour already taken is more similar to it than the node itself.
            closer = (np.where(taken, among[:, c, :], -np.inf) > value[:, c, None]).any(axis=1)
            taken[:, c] = ~closer & (taken.sum(axis=1) < links)
        # What is free goes to the most similar of the rest, which keeps dense groups connected.
        taken |= ~taken & (np.cumsum(~taken, axis=1) <= links - taken.sum(axis=1, keepdims=True))
        row, col = np.nonzero(taken)
        froms.append(row + start)
        tos.append(near[row, col])
    a, b = np.concatenate(froms), np.concatenate(tos)
    pairs = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])], axis=1), axis=0)
    a, b = pairs.T
    v = np.einsum("nd,nd->n", x[a], x[b])
    order = np.lexsort((b, -v, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < 2 * links
    out[a[keep], place[keep]] = b[keep]
    return out


def _levels(ids: np.ndarray) -> np.ndarray:
    """The level of each node, geometric with ratio LINKS, from its smallest id."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(8, np.floor(-np.log(u) / np.log(LINKS))).astype(int)


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, bytes]:
    """The graph of one shard as flat arrays. Of rows with one id, the one with the smallest vector stays."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order] + 0.0  # no negative zeros
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    ids, vectors = ids[first], vectors[first]
    nodes, node_of = np.unique(vectors, axis=0, return_inverse=True)
    members = np.lexsort((ids, node_of.ravel()))
    starts = np.searchsorted(node_of.ravel()[members], np.arange(len(nodes) + 1))
    lengths = np.einsum("nd,nd->n", nodes, nodes)
    raised = np.concatenate([nodes, np.sqrt(np.maximum(0, lengths.max() - lengths))[:, None]], axis=1)
    raised = (raised / np.sqrt(lengths.max())).astype(np.float32)
    level = _levels(ids[members][starts[:-1]])
    tables, counts = [], []
    for at in range(level.max() + 1):
        own = np.flatnonzero(level >= at).astype(np.int32)
        near = neighbours(raised[own])
        table = np.where(near >= 0, own[np.maximum(near, 0)], -1).astype(np.int32)
        tables.append(own.tobytes() + table.tobytes())
        counts.append(len(own))
    return {
        "ids": ids[members].astype("<i8").tobytes(), "starts": starts.astype("<i8").tobytes(),
        "vectors": nodes.astype("<f8").tobytes(), "levels": np.array(counts, "<i8").tobytes(), "links": b"".join(tables)}


class Graph:
    def __init__(self, row: dict[str, bytes]):
        self.ids, self.starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(self.starts) - 1, -1)
        self.tables, flat = [], np.frombuffer(row["links"], np.int32)
        for n in np.frombuffer(row["levels"], "<i8").tolist():
            own, flat = flat[:n], flat[n:]
            table, flat = flat[:n * 2 * LINKS].reshape(n, -1), flat[n * 2 * LINKS:]
            self.tables.append((own, table))

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """A good node of the level above the lowest for each query."""
        top = self.tables[-1][0]
        at = top[(q @ self.vectors[top].T).argmax(axis=1)]
        for own, table in reversed(self.tables[1:]):
            score = np.einsum("qd,qd->q", q, self.vectors[at])
            moving = np.arange(len(q))
            while len(moving):
                near = table[np.searchsorted(own, at[moving])]
                value = np.einsum("qd,qmd->qm", q[moving], self.vectors[np.maximum(near, 0)])
                value[near < 0] = -np.inf
                best = value.argmax(axis=1)
                gain = value[np.arange(len(moving)), best] > score[moving]
                moving, near, value, best = moving[gain], near[gain], value[gain], best[gain]
                at[moving], score[moving] = near[np.arange(len(moving)), best], value[np.arange(len(moving)), best]
        return at

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes found for each query (-1 for none) and their inner products, best first."""
        n, rows = len(self.vectors), np.arange(len(q))[:, None]
        table = self.tables[0][1]
        seen = np.zeros((len(q), n + 1), bool)  # the last column stands for "no neighbour"
        seen[:, n] = True
        if n <= beam:
            node = np.broadcast_to(np.arange(n), (len(q), n)).copy()
        else:
            # The walk starts where the descent ends and, so that a dense group does not hold it, on the upper levels.
            upper = self.tables[min(2, len(self.tables) - 1)][0][:beam // 2]
            start = self._descend(q)[:, None]
            upper = np.broadcast_to(upper, (len(q), len(upper)))
            node = np.concatenate([start, np.where(upper == start, -1, upper)], axis=1)
        score = np.einsum("qd,qmd->qm", q, self.vectors[node])
        score[node < 0] = -np.inf
        seen[rows, node] = True  # -1 is the last column
        pad = beam - node.shape[1]
        node = np.pad(node, ((0, 0), (0, pad)), constant_values=-1)
        score = np.pad(score, ((0, 0), (0, pad)), constant_values=-np.inf)
        fresh = node >= 0
        while True:
            live = np.flatnonzero(fresh.any(axis=1))
            if not len(live):
                break
            at = np.where(fresh[live], score[live], -np.inf).argmax(axis=1)
            fresh[live, at] = False
            near = table[node[live, at]]
            near = np.where(near < 0, n, near)
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            value = np.einsum("qd,qmd->qm", q[live], self.vectors[np.minimum(near, n - 1)])
            value[~new] = -np.inf
            every = np.concatenate([score[live], value], axis=1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            score[live] = np.take_along_axis(every, best, axis=1)
            node[live] = np.take_along_axis(np.concatenate([node[live], near], axis=1), best, axis=1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], new], axis=1), best, axis=1)
            node[live] = np.where(np.isneginf(score[live]), -1, node[live])
            fresh[live] &= node[live] >= 0
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(node, order, axis=1), np.take_along_axis(score, order, axis=1)

    def nearest(self, own: np.ndarray, q: np.ndarray, top: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query id, id, score) of each query's ``top`` best rows but its own, ties to smaller ids."""
        nodes, scores = self.search(q, max(beam, top + 1))
        for query, node, score in zip(own.tolist(), nodes, scores, strict=True):
            found: list[tuple[float, int]] = []
            for a, s in zip(node.tolist(), score.tolist(), strict=True):
                if a < 0 or (len(found) > top and -s > sorted(found)[top][0]):
                    break
                found.extend((-s, i) for i in self.ids[self.starts[a]:self.starts[a + 1]][:top + 1].tolist())
            for s, i in sorted(x for x in found if x[1] != query)[:top]:
                yield query, i, -s


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and one that is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, durable: Callable[..., DataFrame], key: str = "vec_id",
            vector: str = "embedding", top: int = TOP, beam: int = BEAM) -> DataFrame:
    """``query_id``, ``rank`` (from 1), id and ``score`` of the ``top`` nearest found for each row that ``queries`` marks.

    Candidates are all rows but those with the query's id. Rows take no part if their id is null or their vector is
    null, empty, zero, not finite throughout, or of another length than most. Rows with one id count once, with
    their smallest vector. Ties go to the smaller id. Empty tables give no rows. Other columns are not read.
    """
    usable_rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    rows = durable(usable_rows.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks")), "vectors")
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    wide, count = (sizes["size"], sizes["count"]) if sizes else (0, 0)
    rows = rows.filter(F.size("v") == wide)
    shards = max(1, -(-count // SHARD_ROWS))
    blocks = max(1, -(-rows.filter("asks").count() // QUERY_BLOCK))

    def graph(part: pd.DataFrame) -> pd.DataFrame:
        made = build(part["id"].to_numpy(), np.stack(part["v"].to_numpy()))
        return pd.DataFrame([{"shard": int(part["shard"].iloc[0]), **made}])

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(t=part["v"].map(tuple)).sort_values(["id", "t"]).drop_duplicates("id")
        return pd.DataFrame([{
            "block": int(part["block"].iloc[0]), "own": part["id"].to_numpy("<i8").tobytes(),
            "q": np.stack(part["v"].to_numpy()).astype("<f8").tobytes()}])

    dealt = F.xxhash64("id")
    graphs = durable(rows.withColumn("shard", F.pmod(dealt, F.lit(shards))).select("shard", "id", "v").groupBy("shard")
                     .applyInPandas(graph, "shard long, ids binary, starts binary, vectors binary, levels binary, links binary"),
                     "graphs")
    asked = durable(rows.filter("asks").withColumn("block", F.pmod(dealt, F.lit(blocks))).select("block", "id", "v")
                    .groupBy("block").applyInPandas(packed, "block long, own binary, q binary"), "queries")
    # The stated queries, in blocks, go to every shard.
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    pairs = everywhere.join(graphs, "shard").drop("block")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                own = np.frombuffer(values["own"], "<i8")
                q = np.frombuffer(values["q"], "<f8").reshape(len(own), -1)
                found = list(Graph(values).nearest(own, q, top, beam))
                ids, others, scores = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(ids, pa.int64()), "id": pa.array(others, pa.int64()),
                    "score": pa.array(scores, pa.float64())})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = pairs.mapInArrow(walk, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
