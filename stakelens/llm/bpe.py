"""Byte-level BPE over padded matrices, and back to bytes.

A text is cut into pieces by a pattern; a piece that is itself in the vocabulary is one token, and any other piece is
merged from its bytes. Pieces that a task has not met before are encoded together: padded to a common width, one
row each, and every row merges its leftmost pair of lowest rank per round, so that a round is a few array operations
for all rows. Ranks of pairs come from an open-addressing hash table over all splits of vocabulary entries.

Ids are stored packed, as little-endian unsigned 32-bit integers, four bytes each.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge
WIDEST_MATRIX = 256  # longer pieces are merged alone
CELLS = 1 << 19  # of one matrix
KEPT_PIECES = 200_000  # a task's memory of pieces; it starts afresh beyond that
PIECES_AT_ONCE = 1 << 16
CHARACTERS_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 256
MOST_VOCABULARY_BYTES = 64 << 20  # broadcast to every task, so its size is checked


class Pairs:
    """Rank of each pair of ids that merges: open addressing with linear probing, looked up for arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = self._key(np.array(left, np.uint64), np.array(right, np.uint64))
        values = np.array(merged, np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == np.uint64(2**64 - 1)
            self.keys[at[free]] = keys[free]  # of several for one slot, the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of equal-shaped arrays of ids; NONE where a pair does not merge or an id is negative."""
        keys = self._key(a.astype(np.uint32).ravel(), b.astype(np.uint32).ravel())
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(a.shape)


class Tokenizer:
    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs = Pairs(self.ranks)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def pack(self, text: str | None) -> bytes:
        """All ids of a text. Null counts as empty."""
        out = []
        found = (m.group() for m in self.pattern.finditer(text or ""))
        while pieces := list(islice(found, PIECES_AT_ONCE)):
            self.learn(pieces)
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return b"".join(out)

    def pack_all(self, texts: list[str | None]) -> list[bytes]:
        """As ``pack`` for each. Short texts share their new pieces, a bounded number of characters at a time."""
        out: list[bytes] = []
        some: list[list[str]] = []
        held = 0

        def flush() -> None:
            self.learn([p for pieces in some for p in pieces])
            out.extend(b"".join(map(self.known.__getitem__, pieces)) for pieces in some)
            some.clear()

        for text in texts:
            text = text or ""
            held += len(text)
            if held > CHARACTERS_AT_ONCE:
                flush()
                held = len(text)
            if held > CHARACTERS_AT_ONCE:
                out.append(self.pack(text))
                held = 0
            else:
                some.append(self.pattern.findall(text))
        flush()
        return out

    def unpack(self, packed: bytes) -> bytes:
        """The bytes that the ids stand for; raises KeyError for an id that is not in the vocabulary."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        new = [p for p in set(pieces) if p not in self.known]
        rest, raw = [], []
        for p in new:
            b = p.encode()
            whole = self.ranks.get(b)
            if whole is None:
                rest.append(p)
                raw.append(b)
            else:
                self.known[p] = whole.to_bytes(4, "little")
        if rest:
            for p, ids in zip(rest, self.encode_pieces(raw), strict=True):
                self.known[p] = ids

    def encode_pieces(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of pieces that are not vocabulary entries."""
        out: list[bytes] = [b""] * len(raw)
        lengths = np.array([len(b) for b in raw])
        widths = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(int))
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            if width > WIDEST_MATRIX:
                for i in rows:
                    out[i] = self._merge_long(self.of_byte[np.frombuffer(raw[i], np.uint8)]).astype("<u4").tobytes()
                continue
            for start in range(0, len(rows), max(1, CELLS // int(width))):
                some = rows[start:start + max(1, CELLS // int(width))]
                padded = b"".join(raw[i].ljust(int(width), b"\0") for i in some)
                ids = self.of_byte[np.frombuffer(padded, np.uint8)].reshape(len(some), int(width))
                ids[np.arange(int(width))[None, :] >= lengths[some][:, None]] = -1
                self._merge_rows(ids, some, out)
        return out

    def _merge_rows(self, ids: np.ndarray, names: np.ndarray, out: list[bytes]) -> None:
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(ids):
            best = ranks.argmin(axis=1)  # the leftmost of equal ranks
            row = np.arange(len(ids))
            rank = ranks[row, best]
            done = rank == NONE
            if done.any():
                lengths = (ids[done] >= 0).sum(axis=1)
                for name, r, n in zip(names[done].tolist(), ids[done].astype("<u4"), lengths.tolist(), strict=True):
                    out[name] = r[:n].tobytes()
                live = ~done
                ids, ranks, names, best, rank = ids[live], ranks[live], names[live], best[live], rank[live]
                row = np.arange(len(ids))
                if not len(ids):
                    return
            ids[row, best] = rank
            width = ids.shape[1]
            ids = ids[np.arange(width)[None, :] != (best + 1)[:, None]].reshape(len(ids), width - 1)
            if width == 2:
                ranks = np.full((len(ids), 1), NONE)
                continue
            ranks = ranks[np.arange(width - 1)[None, :] != best[:, None]].reshape(len(ids), width - 2)
            some = np.flatnonzero(best < width - 2)
            ranks[some, best[some]] = self.pairs.ranks(ids[some, best[some]], ids[some, best[some] + 1])
            some = np.flatnonzero(best > 0)
            ranks[some, best[some] - 1] = self.pairs.ranks(ids[some, best[some] - 1], ids[some, best[some]])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece. All places of the lowest rank merge in one round if one by one would give the same.

        That holds unless a merge makes a pair of a rank as low; then only the leftmost place merges.
        """
        while len(ids) > 1:
            ranks = self.pairs.ranks(ids[:-1], ids[1:])
            rank = ranks.min()
            if rank == NONE:
                break
            at = np.flatnonzero(ranks == rank)
            first = np.concatenate([[True], np.diff(at) > 1])
            start = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            at = at[(at - start) % 2 == 0]  # of overlapping places every other one, from the left
            left = np.where(at > 0, ids[at - 1], -1)
            left[1:] = np.where(np.diff(at) == 2, rank, left[1:])
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), rank, np.int32)
            if min(self.pairs.ranks(left, merged).min(), self.pairs.ranks(merged, right).min()) <= rank:
                at = at[:1]
            ids = ids.copy()
            ids[at] = rank
            ids = np.delete(ids, at + 1)
        return ids


@lru_cache(maxsize=4)
def _tokenizer(vocabulary: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(vocabulary, pattern)


def tokenizer_of(spark: SparkSession, ranks_path: str, pattern: str) -> Callable[[], Tokenizer]:
    """What tasks call for their tokenizer. The rank file is read once, by the driver, and broadcast."""
    if os.path.getsize(ranks_path) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{ranks_path} has more than {MOST_VOCABULARY_BYTES} bytes")
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return lambda: _tokenizer(shared.value, pattern)


def _added(docs: DataFrame, names: list[str], keep: list[str] | None,
           of: Callable[[pa.RecordBatch], list[list[bytes]]]) -> DataFrame:
    """The columns ``keep`` (all, if None) and binary columns ``names``, which replace columns of those names."""
    replaced = {n.lower() for n in names}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in replaced]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, T.BinaryType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(start, ROWS_AT_ONCE)
                new = [pa.array(x, pa.binary()) for x in of(some)]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], *new], [*kept, *names])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "token_ids",
           keep: list[str] | None = None) -> DataFrame:
    """The frame (or its columns ``keep``) with a binary column ``to``: the packed ids of the whole text.

    Null and empty texts have no ids. Rows are treated one by one, so repeated rows and empty tables need nothing
    special; other columns pass through, but one that is called ``to`` is replaced. No special tokens are recognised
    or added.
    """
    tokenizer = tokenizer_of(docs.sparkSession, ranks_path, pattern)
    return _added(docs, [to], keep, lambda rows: [tokenizer().pack_all(rows.column(text).to_pylist())])


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", to: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """The frame with a binary column ``to``: the bytes behind packed ids. Null ids decode to no bytes."""
    tokenizer = tokenizer_of(df.sparkSession, ranks_path, pattern)
    return _added(df, [to], keep, lambda rows: [[tokenizer().unpack(x or b"") for x in rows.column(ids).to_pylist()]])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "token_ids",
               back: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and then ``decode`` of its ids, in one pass of the rows through Python."""
    tokenizer = tokenizer_of(docs.sparkSession, ranks_path, pattern)

    def both(rows: pa.RecordBatch) -> list[list[bytes]]:
        packed = tokenizer().pack_all(rows.column(text).to_pylist())
        return [packed, [tokenizer().unpack(x) for x in packed]]

    return _added(docs, [to, back], keep, both)
