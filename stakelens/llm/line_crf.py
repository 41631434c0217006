"""Document quality from its lines: a linear-chain conditional random field that labels each line good or bad.

A line's features are a few shares (symbols, capitals, digits, repeated words, ...), those of the lines before and
after it, and whether it copies an earlier line. The chain has a weight per feature and one per pair of labels of
neighbouring lines. Forward and backward sums give the probability that a line is good; a document's score is their
mean, weighted by length. It is fitted on a bounded sample of labelled documents, each line of which takes the label
of its document; scoring covers every line of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
OWN = 11  # features of a line by itself
WIDTH = 3 * OWN + 2
SAMPLE_DOCUMENTS = 3_000  # the most documents that are fitted
SAMPLE_LINES = 400  # documents with more lines than this are not fitted
GOOD_FROM = 0.7
STEPS, RATE, DECAY = 150, 0.1, 1e-4


def _own_features(line: str, copied: bool) -> list[float]:
    raw = line.encode()
    size = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))

    def share(characters: bytes) -> float:
        return (len(raw) - len(raw.translate(None, characters))) / size

    return [
        float(not words), min(1.0, np.log1p(len(words)) / 5), min(2.0, len(line) / n / 10), 4 * share(SYMBOLS),
        2 * share(CAPITALS), 2 * share(DIGITS), 8 * raw.count(b"!") / size, 1 - len(set(words)) / n,
        float(copied and bool(words)), sum(len(w) <= 3 for w in words) / n, float(raw.rstrip().endswith((b".", b"!", b"?"))),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One row of features per line, and the lines' lengths in characters. Null counts as one empty line."""
    seen: set[int] = set()
    own, sizes = [], []
    for line in (text or "").split("\n"):
        mark = hash(line)
        own.append(_own_features(line, mark in seen))
        seen.add(mark)
        sizes.append(len(line))
    x = np.zeros((len(own), WIDTH), np.float64)
    x[:, :OWN] = own
    x[1:, OWN:2 * OWN] = x[:-1, :OWN]
    x[:-1, 2 * OWN:3 * OWN] = x[1:, :OWN]
    x[0, 3 * OWN] = 1.0  # nothing before it
    x[-1, 3 * OWN + 1] = 1.0  # nothing after it
    return x, np.array(sizes, np.float64)


@dataclass(frozen=True)
class Crf:
    """``weights`` and ``bias`` speak for a good line; ``pairs[a, b]`` for label b after label a."""

    weights: np.ndarray
    bias: float
    pairs: np.ndarray

    def good(self, x: np.ndarray) -> np.ndarray:
        """Probability of each line of one document to be good."""
        odds = np.exp(np.clip(x @ self.weights + self.bias, -30, 30)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.pairs).tolist()
        n = len(odds)
        ahead = [0.0] * n  # share of "good" of the forward sums, and of the backward sums
        good = odds[0] / (1 + odds[0])
        ahead[0] = good
        for t in range(1, n):
            g = (good * gg + (1 - good) * bg) * odds[t]
            good = g / (g + good * gb + (1 - good) * bb)
            ahead[t] = good
        out = [0.0] * n
        good = 0.5
        for t in range(n - 1, -1, -1):
            g = ahead[t] * good
            out[t] = g / (g + (1 - ahead[t]) * (1 - good))
            g, b = good * odds[t], 1 - good
            to_good, to_bad = gg * g + gb * b, bg * g + bb * b
            good = to_good / (to_good + to_bad)
        return np.array(out)

    def score(self, text: str | None) -> float:
        x, sizes = features(text)
        p = self.good(x)
        return float(p @ sizes / sizes.sum()) if sizes.sum() else float(p.mean())


def fit(documents: list[tuple[np.ndarray, int]]) -> Crf:
    """By Adam on the mean log-likelihood of the label sequences, every document counting once.

    ``documents`` are (features, label). Without documents of both labels the result scores the share of good ones.
    """
    labels = np.array([y for _, y in documents], np.float64)
    if not len(labels) or labels.min() == labels.max():
        p = (labels.sum() + 0.5) / (len(labels) + 1)
        return Crf(np.zeros(WIDTH), float(np.log(p / (1 - p))), np.zeros((2, 2)))
    documents = sorted(documents, key=lambda d: len(d[0]))
    parameters = np.zeros(WIDTH + 1 + 4)
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    batches = []
    for start in range(0, len(documents), 256):
        part = documents[start:start + 256]
        length = max(len(x) for x, _ in part)
        x = np.zeros((len(part), length, WIDTH + 1))
        mask = np.zeros((len(part), length), bool)
        for i, (rows, _) in enumerate(part):
            x[i, :len(rows), :-1], x[i, :len(rows), -1], mask[i, :len(rows)] = rows, 1.0, True
        batches.append((x, mask, np.array([y for _, y in part])))
    for step in range(1, STEPS + 1):
        slope = np.zeros_like(parameters)
        for x, mask, y in batches:
            slope += _slope(parameters, x, mask, y)
        slope = slope / len(documents) - DECAY * parameters
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        parameters = parameters + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Crf(parameters[:WIDTH], float(parameters[WIDTH]), parameters[WIDTH + 1:].reshape(2, 2))


def _slope(parameters: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the log-likelihood per line of padded documents, by forward and backward sums."""
    n, length, _ = x.shape
    own = np.zeros((n, length, 2))
    own[:, :, 1] = np.where(mask, np.clip(x @ parameters[:WIDTH + 1], -30, 30), 0)
    pairs = parameters[WIDTH + 1:].reshape(2, 2)
    lines = mask.sum(axis=1)
    ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = own[:, 0]
    for t in range(1, length):
        on = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pairs[None], axis=1) + own[:, t]
        ahead[:, t] = np.where(mask[:, t, None], on, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        back = np.logaddexp.reduce(pairs[None] + (own[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(mask[:, t + 1, None], back, 0)
    whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
    weight = (1 / lines)[:, None] * mask
    p = np.exp(ahead + behind - whole[:, None, None])[:, :, 1]
    from_own = np.einsum("nt,ntf->f", weight * (y[:, None] - p), x)
    both = np.exp(ahead[:, :-1, :, None] + pairs + (own[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
    expected = np.einsum("nt,ntab->ab", weight[:, 1:], both)
    observed = np.zeros((2, 2))
    for label in (0, 1):
        observed[label, label] = weight[y == label, 1:].sum()
    return np.concatenate([from_own, (observed - expected).ravel()])


def held_out(key: Column) -> Column:
    """A quarter of the keys: those whose CRC-32, as text, leaves 2 by 4. A null key is not held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          most: int = SAMPLE_DOCUMENTS) -> Crf:
    """Fit on at most ``most`` labelled documents that are not held out, the first in a random order of their keys.

    Null keys, labels and texts are not fitted; of several labels of a key the smallest counts, and of repeated
    documents each row. Documents with more than SAMPLE_LINES lines are not fitted either. Only the features of the
    sample come to the driver.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("known")).agg(F.min(label).alias("label"))
    )
    chosen = known.orderBy(F.md5(F.col("known").cast("string")), "known").limit(most)  # so it is no larger than that
    body = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    sample = body.join(F.broadcast(chosen), F.col("key") == F.col("known")).select("key", "text", "label")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["text"].str.count("\n") < SAMPLE_LINES]
            yield pd.DataFrame({"key": batch["key"].astype(str), "label": batch["label"].astype(int), "x": [
                features(t)[0].astype(np.float32).tobytes() for t in batch["text"]]})

    rows = sample.mapInPandas(measure, "key string, label int, x binary").orderBy("key", "x").limit(most).collect()
    return fit([(np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH).astype(float), r["label"]) for r in rows])


def score(docs: DataFrame, model: Crf, text: str = "text", to: str = "score") -> DataFrame:
    """The frame with a double column ``to`` from 0 to 1, which replaces one of that name; higher is better.

    Null and empty texts are one empty line and get a score like any other. Rows are scored one by one: repeated rows
    alike, an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return docs.withColumn(to, of(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``held_out``, ``score`` and ``predicted``. See :func:`train` and :func:`score`."""
    model = train(docs, labels, key, text)
    scored = score(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model)
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score",
                         (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
