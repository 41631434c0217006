"""Near-duplicates by SimHash: an exact join of all fingerprints within a radius of bits, tile against tile.

Equal fingerprints are merged first. The rest are sorted into cells by population counts and cut into tiles of one
cell. Two fingerprints within the radius have counts that differ by the radius at most, so a tile meets only the
tiles of its own and of neighbouring cells; all other tile pairs are skipped. For a small radius, cells are the
counts of the four 16-bit quarters, which skips about 19 of 20 pairs of random fingerprints; for a wide one they are
bands of the whole count. Tiles that meet are compared in full, by exclusive-or and bit counts. Links between two
tiles are thinned to stars as they are found, which keeps every connection while a large group of near copies makes no
more links in a tile pair than it has members there.

Where texts count as near by the shingles they share, bit links are candidates only. What they connect is a group, and
inside a group a link is what has the exact Jaccard similarity of the sets of hashed shingles. Groups are confirmed in
rounds. First a group is shuffled and cut into blocks, and what is linked inside a block becomes one component; that is
done twice, in different orders, and moves each set once a time. Then all candidates between different components are
decided. Nobody leaves before, so no link is lost, and of a large group of near copies hardly any pair is left by then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import blake2b
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .text import fresh

SEED = 42
QUARTERS = 4
TILE = 4096
CELLS = 1 << 18  # of one comparison matrix
SHINGLES_AT_ONCE = 1 << 14
NARROW = 4  # widest radius for which quarter counts are worth their many neighbours
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)
STRIPES = 16  # tasks over which the tiles of one band are spread
BLOCK, BLOCK_SHINGLES = 512, 1 << 19  # most texts, and about the most shingles, of one side of a block
SET_BYTES, SIZE_BYTES = 16, 4  # of an entry, after its fingerprint
SHUFFLES = 2  # rounds inside blocks before all pairs of components are decided


@dataclass(frozen=True)
class Likeness:
    """What counts as near. ``lanes`` is the number of 64-bit words of a fingerprint; links differ in ``radius`` bits
    or fewer in all and in ``first`` bits or fewer in the first word."""

    shingle: int = 3
    lanes: int = 1
    radius: int = 3
    first: int = 3


# Near is a Jaccard similarity of ALIKE or more between the sets of five-word shingles.
ALIKE = (4, 5)
# Candidates for it. Of sets at 0.8, a bit of 256 differs with probability 0.151 if they are large and equal in size, and
# 0.1875 at most (4 of 5 shingles). So such a pair is missed (over 68 bits, or over 24 in the first word) with less than
# one in 1,000 at any size, and one in 100,000 for large sets. Unrelated texts differ in 128, with a deviation of 8.
FIVE_WORDS = Likeness(shingle=5, lanes=4, radius=68, first=24)


def fingerprint(text: str | None, shingle: int = 3, lanes: int = 1) -> np.ndarray:
    """SimHash words of a whole text over word shingles, repeats included; zeros for a text without words.

    The first word has the majority bits of the shingles' XXH64; further words those of its mixed values.
    """
    w = _words(text)
    last = max(1, len(w) - shingle + 1)
    blocks = (_hashes(w, shingle, range(i, min(last, i + SHINGLES_AT_ONCE))) for i in range(0, last, SHINGLES_AT_ONCE))
    return _majority(blocks, last, lanes) if w else np.zeros(lanes, np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of the distinct word shingles of a whole text, in order; none for a text without words."""
    w = _words(text)
    return np.unique(_hashes(w, shingle, range(max(1, len(w) - shingle + 1)))) if w else np.zeros(0, np.uint64)


def entry(text: str | None, like: Likeness) -> tuple[bytes, np.ndarray]:
    """What stands for all texts with the same set of shingles: fingerprint of the set, its digest and its size.

    The fingerprint's words come along; in it each distinct shingle counts once.
    """
    h = shingle_set(text, like.shingle)
    blocks = (h[i:i + SHINGLES_AT_ONCE] for i in range(0, len(h), SHINGLES_AT_ONCE))
    fp = _majority(blocks, len(h), like.lanes)
    digest = blake2b(h.astype("<u8").tobytes(), digest_size=SET_BYTES).digest()
    return fp.astype(">u8").tobytes() + digest + len(h).to_bytes(SIZE_BYTES, "big"), fp


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at the six ASCII spaces only


def _hashes(w: list[bytes], shingle: int, places: range) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(b" ".join(w[i:i + shingle]), SEED) for i in places), np.uint64, len(places))


def _majority(blocks: Iterable[np.ndarray], n: int, lanes: int) -> np.ndarray:
    ones = np.zeros((lanes, 64), np.int64)
    for h in blocks:
        for lane in range(lanes):
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[lane] += bits.sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _cell(fp: np.ndarray, like: Likeness) -> int:
    if like.radius > NARROW:
        return int(np.bitwise_count(fp).sum(dtype=int)) // (like.radius + 1)
    cell = 0
    for count in np.bitwise_count(fp[:1].astype("<u8").view("<u2")).tolist():
        cell = cell * 32 + count
    return cell


def _steps(like: Likeness) -> list[int]:
    """Differences between the cell numbers of tiles that may hold links, one of each pair of opposites."""
    if like.radius > NARROW:
        return [0, 1]
    steps = []
    for move in product(range(-like.radius, like.radius + 1), repeat=QUARTERS):
        if sum(map(abs, move)) <= like.radius and move >= (0,) * QUARTERS:
            step = 0
            for m in move:
                step = step * 32 + m
            steps.append(step)
    return steps


def fingerprints(docs: DataFrame, text: str = "text", like: Likeness = Likeness(), to: str = "mark") -> DataFrame:
    """The frame with a column ``to``: struct of ``fp`` (binary, big-endian words) and ``cell``."""

    @F.pandas_udf("fp binary, cell int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = [fingerprint(x, like.shingle, like.lanes) for x in batch]
            yield pd.DataFrame({
                "fp": pd.Series([m.astype(">u8").tobytes() for m in marks], dtype=object),
                "cell": np.array([_cell(m, like) for m in marks], np.int32),
            })

    return docs.withColumn(to, of(F.col(text)))


def entries(docs: DataFrame, text: str, like: Likeness, to: str) -> DataFrame:
    """The frame with a column ``to``: struct of ``fp`` (the whole :func:`entry`) and ``cell``."""

    @F.pandas_udf("fp binary, cell int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [entry(x, like) for x in batch]
            yield pd.DataFrame({
                "fp": pd.Series([e for e, _ in made], dtype=object),
                "cell": np.array([_cell(fp, like) for _, fp in made], np.int32),
            })

    return docs.withColumn(to, of(F.col(text)))


def _tiles(distinct: DataFrame, *order: Column) -> DataFrame:
    """Tiles of at most TILE fingerprints of one cell, in the order given: cell, tile, packed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, fps = batch.column("cell").to_numpy(), batch.column("fp").to_pylist()
            edges = np.flatnonzero(cells[1:] != cells[:-1]) + 1
            starts = [s for a, b in zip([0, *edges], [*edges, len(cells)], strict=True) for s in range(a, b, TILE)]
            ends = [*starts[1:], len(cells)]
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array(cells[starts], pa.int64()),
                "tile": pa.array([fps[s] for s in starts], pa.binary()),  # the first member names the tile
                "packed": pa.array([b"".join(fps[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
            })

    # Ranges over (cell, fp): a crowded cell spreads over many tasks.
    keys = ["cell", *[f"_{k}" for k in range(len(order))], "fp"]
    dealt = distinct.select(F.col("cell").cast("long").alias("cell"), "fp", *[c.alias(f"_{k}") for k, c in enumerate(order)])
    return dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select("cell", "fp").mapInArrow(
        cut, "cell long, tile binary, packed binary")


def _merged(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` numbers the least that it is connected with."""
    root = np.arange(n)
    for i, j in links:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(shorter := root[root], root):
                root = shorter
    return root


def tile_links(a: np.ndarray, b: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links between two tiles connect, at most one per fingerprint.

    ``a`` and ``b`` have a row of unsigned words for each fingerprint; the result is two such arrays. Links are
    merged into classes as the rows of ``a`` are worked off, so no more than one comparison matrix is held.
    """
    every = np.concatenate([a, b])
    rows = max(1, CELLS // max(1, len(b)))

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(a), rows):
            i, j = np.nonzero(np.bitwise_count(a[start:start + rows, 0, None] ^ b[None, :, 0]) <= like.first)
            i += start
            if like.lanes > 1 and len(i):
                close = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=int) <= like.radius
                i, j = i[close], j[close]
            yield i, j + len(a)

    root = _merged(len(every), near())
    moved = np.flatnonzero(root != np.arange(len(every)))
    left, right = every[moved], every[root[moved]]
    differ = (left != right).any(axis=1)
    return left[differ], right[differ]


def fingerprint_links(distinct: DataFrame, like: Likeness, durable: Callable[..., DataFrame]) -> DataFrame:
    """Links (a, b) that connect what all links connect. ``distinct`` has one row per ``fp``, with its ``cell``."""
    pairs, lanes = _meetings(durable(_tiles(distinct), "tiles"), like, _steps(like)), like.lanes

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64).reshape(-1, lanes) for z in (x, y))  # any order of bytes
                left, right = tile_links(p, q, like)
                if len(left):
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array([r.tobytes() for r in left], pa.binary()),
                        "b": pa.array([r.tobytes() for r in right], pa.binary())})

    return pairs.mapInArrow(compare, "a binary, b binary")


def _meetings(tiles: DataFrame, like: Likeness, steps: list[int]) -> DataFrame:
    """The pairs (a, b) of packed tiles in cells so many steps apart, each once and each tile with itself."""
    stripes = STRIPES if like.radius > NARROW else 1
    stripe = F.pmod(F.xxhash64("tile"), F.lit(stripes)).cast("int")
    meets = F.array(*[F.struct((F.col("cell") + s).alias("cell_b"), F.lit(k).alias("stripe"))
                      for s in steps for k in range(stripes)])
    left = tiles.select(
        F.col("tile").alias("tile_a"), F.col("packed").alias("a"), F.col("cell").alias("cell_a"),
        F.inline(meets),
    )
    right = tiles.select(
        F.col("tile").alias("tile_b"), F.col("packed").alias("b"), F.col("cell").alias("cell_b"),
        stripe.alias("stripe"),
    )
    once = (F.col("cell_a") != F.col("cell_b")) | (F.col("tile_a") <= F.col("tile_b"))
    return left.join(right, ["cell_b", "stripe"]).filter(once).select("a", "b")


def _unpacked(entries: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint words and set sizes of rows of bytes."""
    words = np.ascontiguousarray(entries[:, :8 * like.lanes]).view(np.uint64)  # any order of bytes
    end = _width(like)
    return words, np.ascontiguousarray(entries[:, end - SIZE_BYTES:end]).view(">u4").ravel().astype(np.int64)


def _width(like: Likeness) -> int:
    """Bytes of an entry. In a round, the name of its component follows."""
    return 8 * like.lanes + SET_BYTES + SIZE_BYTES


def _candidates(a: np.ndarray, b: np.ndarray, like: Likeness) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows near enough in bits and in size, in order of the first; a slice of ``a`` at a time.

    Pairs with the same name after the entry are left out.
    """
    (p, m), (q, n), named = _unpacked(a, like), _unpacked(b, like), a.shape[1] > _width(like)
    if named:
        names = np.ascontiguousarray(np.concatenate([a, b])[:, _width(like):])
        name = np.unique(names.view(f"V{names.shape[1]}").ravel(), return_inverse=True)[1]
        of_a, of_b = name[:len(a)], name[len(a):]
    rows = max(1, CELLS // max(1, len(b)))
    for start in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(p[start:start + rows, 0, None] ^ q[None, :, 0]) <= like.first)
        i += start
        near = ALIKE[1] * np.minimum(m[i], n[j]) >= ALIKE[0] * np.maximum(m[i], n[j])
        if named:
            near &= of_a[i] != of_b[j]
        i, j = i[near], j[near]
        near = np.bitwise_count(p[i] ^ q[j]).sum(axis=1, dtype=int) <= like.radius
        yield i[near], j[near]


def _labelled(tiles: DataFrame, like: Likeness) -> DataFrame:
    """The tiles, each entry with the name of the first entry that candidates inside the tile connect it with."""
    width, digest = _width(like), slice(8 * like.lanes, 8 * like.lanes + SET_BYTES)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for x in batch.column("packed"):
                a = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width)
                root = _merged(len(a), _candidates(a, a, like))
                packed.append(np.concatenate([a, a[root][:, digest]], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("tile"), pa.array(packed, pa.binary())],
                                             names=["cell", "tile", "packed"])

    return tiles.mapInArrow(label, "cell long, tile binary, packed binary")


def candidate_links(distinct: DataFrame, like: Likeness, durable: Callable[..., DataFrame]) -> DataFrame:
    """Links (a, b) between entries that connect what all candidates connect.

    Each entry is linked to the first of its class in its own tile. Between two tiles, classes are linked and not their
    members, so a group of n entries in t tiles has n links and t * t at most.
    """
    width, digest = _width(like), slice(8 * like.lanes, 8 * like.lanes + SET_BYTES)
    tiles = durable(_labelled(durable(_tiles(distinct), "tiles"), like), "labelled")

    def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row, and the row that each class is named by."""
        of = np.unique(np.ascontiguousarray(rows[:, width:]).view(f"V{SET_BYTES}").ravel(), return_inverse=True)[1]
        heads = np.flatnonzero((rows[:, digest] == rows[:, width:]).all(axis=1))
        head = np.zeros(of.max(initial=-1) + 1, np.int64)
        head[of[heads]] = heads
        return of, head

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            name: pa.array([r[:width].tobytes() for r in rows], pa.binary()) for name, rows in (("a", a), ("b", b))})

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("packed"):
                a = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width + SET_BYTES)
                of, head = classes(a)
                moved = np.flatnonzero(head[of] != np.arange(len(a)))
                yield links(a[moved], a[head[of[moved]]])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.frombuffer(z.as_buffer(), np.uint8).reshape(-1, width + SET_BYTES) for z in (x, y))
                if np.array_equal(a[0], b[0]):
                    continue
                every = np.concatenate([a, b])
                of, head = classes(every)
                root = _merged(len(head), ((of[i], of[j + len(a)]) for i, j in _candidates(a, b, like)))
                moved = np.flatnonzero(root != np.arange(len(root)))
                yield links(every[head[moved]], every[head[root[moved]]])

    schema = "a binary, b binary"
    return tiles.mapInArrow(inner, schema).unionByName(_meetings(tiles, like, _steps(like)).mapInArrow(outer, schema))


def _chunks(sizes: np.ndarray) -> np.ndarray:
    """Ascending numbers that cut rows into chunks of BLOCK texts and about BLOCK_SHINGLES shingles at most."""
    key = np.arange(len(sizes)) // BLOCK * (1 << 40) + (np.cumsum(sizes) - sizes) // BLOCK_SHINGLES
    return np.unique(key, return_inverse=True)[1]


def blocks(pairs: DataFrame, like: Likeness, inside: bool) -> DataFrame:
    """Pairs of chunks of tiles with candidates: block (its name), side (1 or 2) and fp (a named entry with candidates).

    With ``inside``, a tile meets itself and only chunks with themselves.
    """
    width = _width(like)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.frombuffer(z.as_buffer(), np.uint8).reshape(-1, width + SET_BYTES) for z in (x, y))
                same = np.array_equal(a[0], b[0])
                of_a, of_b = (_chunks(_unpacked(z, like)[1]) for z in (a, b))
                in_a, in_b = np.zeros((len(a), of_b[-1] + 1), bool), np.zeros((len(b), of_a[-1] + 1), bool)
                for k in range(of_a[-1] + 1) if inside else [None]:
                    at = np.flatnonzero(of_a == k) if inside else np.arange(len(a))
                    to = at if inside else np.arange(len(b))
                    for i, j in _candidates(a[at], b[to], like):
                        i, j = at[i], to[j]
                        if same:
                            i, j = i[i < j], j[i < j]
                        in_a[i, of_b[j]] = True
                        in_b[j, of_a[i]] = True
                for k, m in zip(*np.nonzero([in_a[of_a == k].any(axis=0) for k in range(of_a[-1] + 1)]), strict=True):
                    left, right = in_a[:, m] & (of_a == k), in_b[:, k] & (of_b == m)
                    if same and k == m:
                        left, right = left | right, np.zeros(len(b), bool)
                    name = b"".join(z[np.argmax(of == c), 8 * like.lanes:width - SIZE_BYTES].tobytes()
                                    for z, of, c in ((a, of_a, k), (b, of_b, m)))
                    members = [r.tobytes() for r in (*a[left], *b[right])]
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([name] * len(members), pa.binary()),
                        "side": pa.array([1] * int(left.sum()) + [2] * int(right.sum()), pa.int32()),
                        "fp": pa.array(members, pa.binary())})

    return pairs.mapInArrow(find, "block binary, side int, fp binary")


def confirmed_links(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Links among the candidates between two lists of entries that connect what all pairs of them with ALIKE connect.

    ``sets`` has the shingle sets of ``a``, then of ``b``. Each candidate is decided by its whole sets unless the two
    are connected already.
    """
    every = np.concatenate([a, b])
    root = np.arange(len(every))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([len(s) for s in sets])
    own = np.split(ids, ends[:-1])
    size, mark = np.diff(ends, prepend=0), np.zeros(ids.max(initial=-1) + 1, bool)
    for rows, others in _candidates(a, b, like):
        edges = np.flatnonzero(np.diff(rows)) + 1
        for i, js in zip(rows[np.concatenate([[0], edges])] if len(rows) else [], np.split(others, edges), strict=False):
            js = js + len(a)
            js = js[(root[js] != root[i]) & (size[js] > 0)]
            if not len(js):
                continue
            mark[own[i]] = True
            starts = np.cumsum(size[js]) - size[js]
            common = np.add.reduceat(mark[np.concatenate([own[j] for j in js])], starts, dtype=np.int64)
            mark[own[i]] = False
            joined = root[js[sum(ALIKE) * common >= ALIKE[0] * (size[i] + size[js])]]
            if len(joined):
                joined = np.append(joined, root[i])
                root[np.isin(root, joined)] = joined.min()
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every[moved], every[root[moved]]


def _confirmed(candidates: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) among the members of each block. ``sets`` has ``of`` (an entry) and ``shingles`` (packed hashes)."""
    width = _width(like)

    def confirm(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        entry_of, packed = table.column("fp").to_pylist(), table.column("shingles").to_pylist()
        place = [np.flatnonzero(side == k) for k in (1, 2)]
        if not len(place[1]):
            place[1] = place[0]  # a chunk with itself
        a, b = (np.array([np.frombuffer(entry_of[i], np.uint8) for i in p]) for p in place)
        left, right = confirmed_links(a, b, [np.frombuffer(packed[i], "<u8") for p in place for i in p], like)
        linked = [(x[:width].tobytes(), y[:width].tobytes()) for x, y in zip(left, right, strict=True)]
        return pa.table({"a": pa.array([x for x, _ in linked], pa.binary()), "b": pa.array([y for _, y in linked], pa.binary())})

    members = candidates.join(sets, F.substring("fp", 1, width) == F.col("of")).select("block", "side", "fp", "shingles")
    return members.groupBy("block").applyInArrow(confirm, "a binary, b binary")


def shingle_links(distinct: DataFrame, texts: DataFrame, like: Likeness, durable: Callable[..., DataFrame]) -> DataFrame:
    """Links (a, b) that connect what all confirmed candidates connect.

    ``distinct`` has one row per entry ``fp``, with its ``cell`` and the number ``row`` of one of its texts; ``texts``
    has ``row`` and ``text``. Only texts with candidates are shuffled, as hashes.
    """
    groups = components(durable(candidate_links(distinct, like, durable), "candidates"), durable)
    # A group is a cell of its own. If two got the same number, they would only be compared for nothing.
    members = durable(distinct.join(groups, F.col("fp") == F.col("node")).select(
        "fp", F.xxhash64("component").alias("cell"), F.col("row").alias("at")), "members")

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(x, like.shingle).astype("<u8").tobytes() for x in batch], dtype=object)

    sets = durable(texts.join(members, F.col("row") == F.col("at")).select(
        F.col("fp").alias("of"), packed("text").alias("shingles")), "sets")
    links = None
    for k in range(SHUFFLES + 1):
        inside = k < SHUFFLES
        # An entry's digest of its set names it; a component has the name of its least entry.
        least = F.col("fp") if links is None else F.coalesce("component", "fp")
        so_far = members if links is None else members.join(components(links, durable), F.col("fp") == F.col("node"), "left")
        named = so_far.select(
            F.concat("fp", F.substring(least, 8 * like.lanes + 1, SET_BYTES)).alias("fp"), "cell", least.alias("least"))
        tiles = durable(_tiles(named, F.xxhash64("fp", F.lit(k)) if inside else F.col("least")), "tiles")
        pairs = tiles.select(F.col("packed").alias("a"), F.col("packed").alias("b")) if inside else _meetings(tiles, like, [0])
        found = durable(blocks(pairs, like, inside), "blocks")
        more = durable(_confirmed(found, sets, like), "confirmed")
        links = more if links is None else links.unionByName(more)
    return links


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of pairs of tiles, which are wide rows, are kept small while they are compared."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def _linked(distinct: DataFrame, links: Callable[[], DataFrame], durable: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``distinct`` that have links, with their ``component``. Written."""
    with _small_batches(distinct.sparkSession):
        found = durable(links(), "links")
    member = components(found, durable)
    return durable(distinct.join(member, F.col("fp") == F.col("node")).drop("node"), "linked")


def near_duplicates(docs: DataFrame, durable: Callable[..., DataFrame], key: str = "doc_id", text: str = "text",
                    like: Likeness = Likeness()) -> DataFrame:
    """One row per row of ``docs``: the key, ``fingerprint`` (hex digits) and ``component_id``.

    A component is whatever is connected by links; it is named by its smallest key. Null and empty texts have
    fingerprint zero and are linked like any other. Null keys take part but never name a component; one without any
    key has a null name. Repeated rows share a component. Empty tables give no rows. Other columns are not read.
    """
    marked = durable(
        fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", like)
        .select("key", "mark.fp", "mark.cell"), "marked")
    distinct = durable(
        marked.groupBy("fp").agg(F.first("cell").alias("cell"), F.min("key").alias("first")), "distinct")
    linked = _linked(distinct, lambda: fingerprint_links(distinct, like, durable), durable)
    names = linked.groupBy("component").agg(F.min("first").alias("name"))
    renamed = linked.join(names, "component").select(F.col("fp").alias("linked"), "name")
    name = F.when(F.col("linked").isNull(), F.col("first")).otherwise(F.col("name"))
    classes = distinct.join(renamed, F.col("fp") == F.col("linked"), "left").select(
        F.col("fp").alias("class"), name.alias("id"))
    return marked.join(classes, F.col("fp") == F.col("class")).select(
        F.col("key").alias(key), F.lower(F.hex("fp")).alias("fingerprint"), F.col("id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, durable: Callable[..., DataFrame], key: str = "doc_id", text: str = "text",
                         like: Likeness = FIVE_WORDS) -> DataFrame:
    """The documents with one of each component left: the one with the smallest key, nulls last.

    Links are texts whose sets of shingles have a Jaccard similarity of ALIKE or more, equal sets among them. Those are
    always found; of pairs just at ALIKE less than one in 1,000 is no candidate and so missed (see FIVE_WORDS).
    Columns are those of ``docs``, whatever their names. Of repeated rows one stays; a null key is a document of its
    own like any other. All null and empty texts are copies of each other. Empty tables stay empty.
    """
    row, mark, out = fresh(docs, "_row", "_mark", "_gone")
    marked = durable(entries(docs, text, like, mark).withColumn(row, F.monotonically_increasing_id()), "marked")
    # The order in which documents are kept: those with a key, by key, then the row number.
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    rows = marked.select(F.col(f"{mark}.fp").alias("fp"), F.col(f"{mark}.cell").alias("cell"), place.alias("place"))
    distinct = durable(
        rows.groupBy("fp").agg(F.first("cell").alias("cell"), F.min("place").alias("first"), F.count("*").alias("n")),
        "distinct")
    one, texts = distinct.select("fp", "cell", "first.row"), marked.select(F.col(row).alias("row"), F.col(text).alias("text"))
    linked = _linked(distinct, lambda: shingle_links(one, texts, like, durable), durable)
    best = linked.groupBy("component").agg(F.min("first").alias("best"))
    behind = linked.join(best, "component").filter(F.col("first.row") != F.col("best.row")).select("first.row")
    # All rows of a set of shingles but its first go, and the first too if it is behind in its component. Few rows go,
    # so the texts themselves are shuffled only if even those do not fit a broadcast.
    copies = rows.join(distinct.filter("n > 1").select(F.col("fp").alias("same"), F.col("first.row").alias("kept")),
                       F.col("fp") == F.col("same")).filter(F.col("place.row") != F.col("kept")).select("place.row")
    gone = durable(copies.unionByName(behind).select(F.col("row").alias(out)), "gone")
    return marked.join(gone, F.col(row) == F.col(out), "left_anti").select(*[marked[c] for c in docs.columns])
