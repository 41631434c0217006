"""Token counts per field or section, from one encoding of the whole document.

A document is encoded once. Each token covers the characters that its bytes touch, and these spans are joined with
the sections' spans, both in order. A token that crosses a boundary goes to one section by the rule ``MAJORITY``,
``FIRST`` or ``LAST``: the section with most of its characters (the earlier of equals), the first or the last that
it touches. Tokens that touch no section, such as separators, are counted under a section without a name, so that the
counts of a document add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PIECES_AT_ONCE, Tokenizer, tokenizer_of

ROWS_AT_ONCE = 128
MAJORITY, FIRST, LAST = "majority", "first", "last"
SECTIONS = "array<struct<name:string,start:int,end:int>>"


def token_spans(tokenizer: Tokenizer, text: str, cut: list[str] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First character of each token, and one past the last that it touches; a bounded number of pieces at a time.

    A token may hold only some bytes of a character; it touches that character. ``cut`` are the text's pieces, if known.
    """
    found = iter(cut) if cut is not None else (m.group() for m in tokenizer.pattern.finditer(text))
    done = 0
    while pieces := list(islice(found, PIECES_AT_ONCE)):
        tokenizer.learn(pieces)
        ids = np.frombuffer(b"".join(map(tokenizer.known.__getitem__, pieces)), "<u4")
        sizes = np.fromiter((len(tokenizer.bytes_of[i]) for i in ids.tolist()), np.int64, len(ids))
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(sizes)
        yield character[ends - sizes] + done, character[ends - 1] + 1 + done
        done += int(character[-1]) + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = MAJORITY) -> np.ndarray:
    """The section of each token, by index; -1 for none. ``sections`` are (start, end), in order and apart."""
    owner = np.full(len(starts), -1)
    if not len(sections):
        return owner
    first = np.searchsorted(sections[:, 1], starts, side="right")
    after = np.searchsorted(sections[:, 0], ends, side="left")
    touched = np.flatnonzero(first < after)
    if rule == FIRST:
        owner[touched] = first[touched]
    elif rule == LAST:
        owner[touched] = after[touched] - 1
    else:
        most = np.zeros(len(starts), np.int64)
        at = first.copy()
        while len(touched):
            s = sections[at[touched]]
            shared = np.minimum(ends[touched], s[:, 1]) - np.maximum(starts[touched], s[:, 0])
            more = shared > most[touched]
            owner[touched[more]], most[touched[more]] = at[touched[more]], shared[more]
            at[touched] += 1
            touched = touched[at[touched] < after[touched]]
    return owner


def _apart(sections: list[dict] | None, size: int) -> tuple[list[str | None], np.ndarray]:
    """Names and spans in order, cut to the text; of overlapping sections the later begins where the earlier ends."""
    names, spans, last = [], [], 0
    for s in sorted((s for s in sections or [] if s and s["start"] is not None and s["end"] is not None),
                    key=lambda s: (s["start"], s["end"])):
        start, end = max(s["start"], last, 0), min(s["end"], size)
        if end > start:
            names.append(s["name"])
            spans.append((start, end))
            last = end
    return names, np.array(spans, np.int64).reshape(-1, 2)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text",
                 sections: str = "sections", rule: str = MAJORITY) -> DataFrame:
    """One row per document and section that has characters: key, ``section``, ``n_chars``, ``n_tokens``.

    ``sections`` names an array of (name, start, end), in characters of the text, end exclusive. Tokens of no section
    have a row with a null section. Sections of one name are separate rows. Null and empty texts have no tokens and give
    no rows; null arrays and entries are no sections. Repeated rows give repeated results; an empty table gives no
    rows. Other columns are not read.
    """
    if rule not in (MAJORITY, FIRST, LAST):
        raise ValueError(f"no such rule: {rule}")
    tokenizer = tokenizer_of(docs.sparkSession, ranks_path, pattern)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("section", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                bodies = [x or "" for x in some.column("text").to_pylist()]
                # Short texts learn their new pieces together, in few large matrices.
                cuts = [t.pattern.findall(x) if len(x) <= PIECES_AT_ONCE else None for x in bodies]
                t.learn([p for pieces in cuts if pieces for p in pieces])
                keys, names, sizes, tokens = [], [], [], []
                for row, (body, cut, parts) in enumerate(zip(
                        bodies, cuts, some.column("sections").to_pylist(), strict=True)):
                    own, spans = _apart(parts, len(body))
                    totals = np.zeros(len(own) + 1, np.int64)
                    for starts, ends in token_spans(t, body, cut):
                        totals += np.bincount(attribute(starts, ends, spans, rule) + 1, minlength=len(own) + 1)
                    widths = [len(body) - int((spans[:, 1] - spans[:, 0]).sum()), *(spans[:, 1] - spans[:, 0]).tolist()]
                    for name, width, n in zip([None, *own], widths, totals.tolist(), strict=True):
                        if width or n:
                            keys.append(row)
                            names.append(name)
                            sizes.append(width)
                            tokens.append(n)
                yield pa.RecordBatch.from_arrays(
                    [some.column("key").take(pa.array(keys, pa.int64())), pa.array(names, pa.string()),
                     pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["key", "section", "n_chars", "n_tokens"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(sections).cast(SECTIONS).alias("sections"))
    return out.mapInArrow(count, schema).withColumnRenamed("key", key)


def joined_fields(fields: dict[str, Column], separator: str = "\n") -> tuple[Column, Column]:
    """The text of all fields, one after another, and their sections. Null fields are empty."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in fields.values()]
    start, sections = F.lit(0), []
    for name, body in zip(fields, texts, strict=True):
        end = start + F.length(body)
        sections.append(F.struct(F.lit(name).alias("name"), start.alias("start"), end.alias("end")))
        start = end + len(separator)
    return F.concat_ws(separator, *texts), F.array(*sections)
