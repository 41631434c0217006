"""Periodic runs of words: all maximal stretches that repeat with their smallest period, and the text without repeats.

Common extensions of two places of a text are found by a difference cover. Of all suffixes only those that start at
places of the cover are sorted: by their first COVER_PERIOD words, then by doubling along the samples. Any two places
reach two samples after the same few words, which are compared one by one; from there the smallest common prefix
between the two samples in sorted order, from a sparse table, gives the rest.

Runs are looked for on a harmonic grid: a run of period p holds two neighbours of the grid 0, p, 2p, ... So for each p
the words of such neighbours are compared, and where they are equal the stretch is extended both ways. The grids of
all periods have n * ln(n) points. Many texts are worked on as one sequence, with a word of its own after each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import fresh

LEAST_WORDS = 12
# Every difference modulo 31 is that of two of these numbers, in one way only.
COVER_PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
WORDS_AT_ONCE = 1 << 19  # about the most words in one sequence, unless one text has more
PAIRS_AT_ONCE = 1 << 20
STEPS_BACK = 8  # words compared one by one before bisection

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def _shifts() -> np.ndarray:
    """For the remainders of two places, how many words it takes until both are in the cover."""
    inside = np.isin(np.arange(COVER_PERIOD), COVER)
    out = np.zeros((COVER_PERIOD, COVER_PERIOD), np.int64)
    for a in range(COVER_PERIOD):
        for b in range(COVER_PERIOD):
            out[a, b] = next(s for s in range(COVER_PERIOD)
                             if inside[(a + s) % COVER_PERIOD] and inside[(b + s) % COVER_PERIOD])
    return out


SHIFTS = _shifts()
PLACE = np.searchsorted(COVER, np.arange(COVER_PERIOD))  # of a remainder in the cover


class CommonExtensions:
    """How far a sequence of numbers goes on alike from any two different places.

    The last number must occur nowhere else, so that two places always come apart.
    """

    def __init__(self, numbers: np.ndarray):
        self.numbers = np.concatenate([numbers, np.zeros(COVER_PERIOD, numbers.dtype)])
        blocks = -(-len(numbers) // COVER_PERIOD)
        places = (np.arange(blocks)[:, None] * COVER_PERIOD + COVER).ravel()
        self.places = places[places < len(numbers)]
        levels = self._ranks()
        self.rank = levels[-1]
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(self.rank))
        self.table = self._least(self._prefixes(order, levels))

    def _ranks(self) -> list[np.ndarray]:
        """Ranks of the samples by their first 1, 2, 4, ... times COVER_PERIOD numbers, until all differ."""
        first = self.numbers.astype(">u4")[self.places[:, None] + np.arange(COVER_PERIOD)]
        rank = np.unique(first.view(f"S{4 * COVER_PERIOD}").ravel(), return_inverse=True)[1].astype(np.int64)
        out, step, n = [rank], len(COVER), len(rank)
        while n and rank.max() + 1 < n:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            out.append(rank)
            step *= 2
        return out

    def _prefixes(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Length of the common prefix of each sample, in sorted order, and the next."""
        a, b = order[:-1], order[1:]
        moved = np.zeros(len(a), np.int64)  # in samples
        for k in range(len(levels) - 2, -1, -1):
            within = np.flatnonzero(np.maximum(a, b) + moved < len(order))
            x, y = (z[within] + moved[within] for z in (a, b))
            moved[within[levels[k][x] == levels[k][y]]] += len(COVER) << k
        common = moved // len(COVER) * COVER_PERIOD
        x, y, live = self.places[a] + common, self.places[b] + common, np.arange(len(a))
        for k in range(COVER_PERIOD):
            live = live[self.numbers[x[live] + k] == self.numbers[y[live] + k]]
            if not len(live):
                break
            common[live] += 1
        return common

    @staticmethod
    def _least(values: np.ndarray) -> np.ndarray:
        """Row k has the least of 2**k values from each place on."""
        rows = [values]
        while 2 << (len(rows) - 1) <= len(values):
            half, last = 1 << (len(rows) - 1), rows[-1]
            row = last.copy()
            row[:-half] = np.minimum(last[:-half], last[half:])
            rows.append(row)
        return np.array(rows)

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from ``i`` on equal those from ``j`` on; the places of a pair differ."""
        shift = SHIFTS[i % COVER_PERIOD, j % COVER_PERIOD]
        common, live, k = np.zeros(len(i), np.int64), np.flatnonzero(shift > 0), 0
        reached = [np.flatnonzero(shift == 0)]
        while len(live):
            live = live[self.numbers[i[live] + k] == self.numbers[j[live] + k]]
            k += 1
            common[live] = k
            done = shift[live] == k
            reached.append(live[done])
            live = live[~done]
        at = np.concatenate(reached)
        x, y = (self.rank[z // COVER_PERIOD * len(COVER) + PLACE[z % COVER_PERIOD]]
                for z in (i[at] + shift[at], j[at] + shift[at]))
        low, high = np.minimum(x, y), np.maximum(x, y)
        row = np.frexp((high - low).astype(float))[1] - 1
        common[at] += np.minimum(self.table[row, low], self.table[row, high - (1 << row)])
        return common

    def before(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers before ``i`` equal those before ``j``, at most ``most``."""
        common, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(1, STEPS_BACK + 1):
            live = live[most[live] >= k]
            live = live[self.numbers[i[live] - k] == self.numbers[j[live] - k]]
            common[live] = k
        low, high = common[live], most[live]
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.after(i[live] - middle, j[live] - middle) >= middle
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        common[live] = low
        return common


def _equal_neighbours(joined: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points i and periods p with equal words at i and i + p of one text, i on the grid of p; about PAIRS_AT_ONCE each."""
    places, periods, held = [], [], 0
    for p in range(1, int(sizes.max(initial=0)) // 2 + 1):
        grid = joined[::p]
        i = np.flatnonzero(grid[1:] == grid[:-1]) * p
        i = i[(text[i] == text[i + p]) & (2 * p <= sizes[text[i]])]
        if not len(i):
            continue
        places.append(i)
        periods.append(np.full(len(i), p))
        held += len(i)
        if held >= PAIRS_AT_ONCE:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[np.ndarray], least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts, given as numbers from 0 on: text, start, length and period, in order of text, start, period.

    A run has at least ``least`` words and twice its period, and no smaller period.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    joined = np.concatenate([x for k, t in enumerate(texts) for x in (t, [top + k])]).astype(np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    extensions, found = None, []
    for i, p in _equal_neighbours(joined, text, sizes):
        extensions = extensions or CommonExtensions(joined)
        need = np.maximum(p, least - p)  # equal pairs in a row
        right = extensions.after(i, i + p)
        some = right + p - 1 >= need
        i, p, right, need = i[some], p[some], right[some], need[some]
        left = extensions.before(i, i + p, np.minimum(p, i))
        some = (left < p) & (left + right >= need)  # if not less than p, an earlier point of the grid has it
        found.append((i[some] - left[some], left[some] + right[some] + p[some], p[some]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, p = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    # A multiple of the smallest period gives the same stretch again.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[new], length[new], p[new]
    order = np.lexsort((p, start))
    start, length, p = start[order], length[order], p[order]
    return text[start], start - first[text[start]], length, p


def _groups(sizes: list[int], least: int) -> Iterator[list[int]]:
    """Numbers of texts that may have runs, in groups of like sizes and at most about WORDS_AT_ONCE words."""
    group, total = [], 0
    for k in sorted((k for k, n in enumerate(sizes) if n >= max(least, 2)), key=lambda k: sizes[k]):
        if group and (total + sizes[k] > WORDS_AT_ONCE or sizes[k] > 2 * sizes[group[0]]):
            yield group
            group, total = [], 0
        group.append(k)
        total += sizes[k]
    if group:
        yield group


def collapse(texts: list[str | None], least: int = LEAST_WORDS) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Of each text: the number of its words, its runs (start, length, period), and its words less repeats, joined."""
    split = [(t or "").encode().split() for t in texts]  # bytes: at the six ASCII spaces only
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for group in _groups([len(w) for w in split], least):
        number: dict[bytes, int] = {}
        ids = [np.array([number.setdefault(x, len(number)) for x in split[k]], np.int64) for k in group]
        for t, *run in zip(*(x.tolist() for x in runs_of(ids, least)), strict=True):
            runs[group[t]].append(tuple(run))
    for w, own in zip(split, runs, strict=True):
        n, kept = len(w), w
        if own:
            change = np.zeros(n + 1, np.int64)
            start, length, period = np.array(own).T
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = [x for x, covered in zip(w, np.cumsum(change[:-1]).tolist(), strict=True) if not covered]
        yield n, own, b" ".join(kept).decode()


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS,
                  names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """The frame without ``text`` but with the number of words, the runs and the collapsed text, under ``names``.

    A run (start, length, period) is a stretch of words that repeats with ``period``, its smallest, as far as it goes
    both ways; it has ``least`` words and twice its period at least. Runs are in order of start, then period, and may
    overlap. The collapsed text has the words that no run holds after its first period, joined by single spaces.

    Whole texts are read; memory is in proportion to one Arrow batch, or to one text if that is longer. Null and empty
    texts have no words, no runs and an empty collapsed text. Repeated rows, and ties of any kind, each have their own
    runs. An empty table gives no rows. Columns with one of the names in ``names`` are replaced, others pass.
    """
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in (text, *names)}]
    whole, = fresh(docs.select(*[docs[c] for c in kept]), "_text")
    read = docs.select(*[docs[c] for c in kept], docs[text].alias(whole))
    out = T.StructType([*[f for f in docs.schema if f.name in kept], T.StructField(names[0], T.LongType()),
                        T.StructField(names[1], RUNS), T.StructField(names[2], T.StringType())])
    struct = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUNS.elementType]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(collapse(batch.column(whole).to_pylist(), least))
            every = np.array([r for _, own, _ in found for r in own], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *(len(own) for _, own, _ in found)])
            fields = [pa.array(every[:, k]) for k in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(struct.value_type)))
            columns = [batch.column(c) for c in kept]
            columns += [pa.array([n for n, _, _ in found], pa.int64()), runs, pa.array([t for _, _, t in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return read.mapInArrow(find, out)
