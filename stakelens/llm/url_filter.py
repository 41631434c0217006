"""URL filters: host and path rules in a sorted array of 64-bit digests.

A rule is a host and the start of a path, such as ``example.net/en/``; it fits the host and all its subdomains. The
index is one file: sorted xxHash64 digests of the rules, then their verdicts, places and full strings. Every executor
gets the file from Spark and maps it into memory. A batch of urls makes all pairs of a host suffix and a path start of
a length that some rule has, finds their digests by binary search over the mapped array in one call, and confirms hits
by the stored string, so that equal digests of different strings do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.durable import shared_dir
from .text import fresh

ALLOW, BLOCK = "allow", "block"
MOST_INDEX_BYTES = 2 << 30  # an executor downloads the whole file
HEAD = 4  # words: rules, path lengths, bytes of strings, reserved


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def parts(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://`` up to /, ?, # or end; A-Z lowered) and path (up to ? or #); empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, stop)
    host, path = (rest[:stop], "") if slash < 0 else (rest[:slash], rest[slash:stop])
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


def index_bytes(rules: Iterable[Rule]) -> bytes:
    """The index file. Of equal rules, one that blocks counts. A verdict is ``allow`` or ``block``."""
    verdicts: dict[str, bool] = {}
    lengths, longest = {0}, 0
    for r in rules:
        longest = max(longest, len(r.host))
        name = r.host + r.path
        verdicts[name] = verdicts.get(name, False) or r.verdict == BLOCK
        lengths.add(len(r.path))
    names = sorted(verdicts, key=lambda n: (xxh64_intdigest(n), n))
    raw = [n.encode() for n in names]
    blob = b"".join(raw)
    ends = np.cumsum([0, *map(len, raw)]).astype("<u8")
    steps = np.array(sorted(lengths), "<u8")
    return b"".join([
        np.array([len(names), len(steps), len(blob), longest], "<u8").tobytes(),
        np.array([xxh64_intdigest(n) for n in names], "<u8").tobytes(), ends.tobytes(), steps.tobytes(),
        np.array([verdicts[n] for n in names], "u1").tobytes(), blob])


class Index:
    """The mapped file."""

    def __init__(self, path: str):
        whole = np.memmap(path, "u1", "r")
        n, lengths, size, self.longest = (int(x) for x in whole[:8 * HEAD].view("<u8"))
        cuts = np.cumsum([8 * HEAD, 8 * n, 8 * (n + 1), 8 * lengths, n, size])
        piece = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.keys, self.ends, steps = (p.view("<u8") for p in piece[:3])
        self.blocks, self.blob = piece[3:]
        self.lengths = [int(x) for x in steps]

    def confirmed(self, name: str, digest: int, at: int) -> bool | None:
        """Whether the rule of this name blocks; None if there is none. Runs of equal digests are searched through."""
        raw = name.encode()
        while at < len(self.keys) and int(self.keys[at]) == digest:
            if self.blob[int(self.ends[at]):int(self.ends[at + 1])].tobytes() == raw:
                return bool(self.blocks[at])
            at += 1
        return None

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """Host, path, rule and verdict of each url. The longest rule wins; of equally long ones that of the longer host."""
        found = [parts(u) for u in urls]
        rows, names, order = [], [], []
        for row, (host, path) in enumerate(found):
            # No rule is for a longer host, so of a host of thousands of labels only the last few are looked up.
            spare = len(host) - self.longest
            at = 0 if spare <= 0 else host.find(".", spare - 1) + 1 or -1
            while host and at >= 0:
                for n in self.lengths:
                    if n <= len(path):
                        rows.append(row)
                        names.append(host[at:] + path[:n])
                        order.append(len(host) - at)
                at = host.find(".", at) + 1 or -1
        digests = np.array([xxh64_intdigest(n.encode("utf-8", "surrogatepass")) for n in names], np.uint64)
        places = np.searchsorted(self.keys, digests)
        inside = places < len(self.keys)
        hits = np.flatnonzero(inside & (self.keys[np.where(inside, places, 0)] == digests)) if len(self.keys) else []
        best: dict[int, tuple[int, int, str, bool]] = {}
        for h in hits:
            blocks = self.confirmed(names[h], int(digests[h]), int(places[h]))
            if blocks is not None:
                best[rows[h]] = max(best.get(rows[h], (-1,)), (len(names[h]), order[h], names[h], blocks))
        out = []
        for row, (host, path) in enumerate(found):
            rule = best.get(row)
            out.append((host, path, rule[2] if rule else None, BLOCK if rule and rule[3] else ALLOW))
        return out


@lru_cache(maxsize=4)
def _mapped(name: str) -> Index:
    return Index(SparkFiles.get(name))


def share_index(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Write the index to the shared folder and have Spark give it to every executor. Returns the file's name."""
    data = index_bytes(rules)
    if len(data) > MOST_INDEX_BYTES:
        raise ValueError(f"the rules take {len(data)} bytes; the bound is {MOST_INDEX_BYTES}")
    name = f"urls-{hashlib.sha256(data).hexdigest()[:32]}.index"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        draft = hadoop.Path(f"{path.toString()}.{hashlib.sha256(spark.sparkContext.applicationId.encode()).hexdigest()[:8]}")
        stream = files.create(draft, True)
        stream.write(bytearray(data))
        stream.close()
        files.rename(draft, path)
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


def filter_urls(pages: DataFrame, rules: Iterable[Rule], url: str = "url",
                names: tuple[str, ...] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """The pages with host, path, rule (as ``host/path``, null if none fits) and verdict, under ``names``.

    A url that no rule fits is allowed. Null urls and those without ``://`` have an empty host and path, and no rule
    fits them. Rows are judged one by one: repeated rows alike, an empty table gives no rows. The work for a url is
    bounded by the longest rule host and the number of path lengths of the rules, however long the url is. Of the page's own
    columns, those called like ``names`` are replaced and the others pass.
    """
    name = share_index(pages.sparkSession, rules)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = _mapped(name)
        for batch in batches:
            yield pd.DataFrame(index.judge(batch.tolist()), columns=["host", "path", "rule", "verdict"], dtype=object)

    found, = fresh(pages, "_judged")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in {n.lower() for n in names}]
    fields = ("host", "path", "rule", "verdict")
    return pages.withColumn(found, judged(F.col(url))).select(
        *kept, *[F.col(found)[f].alias(n) for f, n in zip(fields, names, strict=True)])
