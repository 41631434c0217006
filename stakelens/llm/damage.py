"""Known faults, planted into whole tables, so that an operator's work on them can be told from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, words


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The frame with every text whose key hashes to a multiple of ten repeated from some word on.

    h is the CRC-32 of the key in decimal, g = floor(h / 10), n the number of words. Each word i from a = g mod n on
    becomes word a + (i - a) mod p, where p = 1 + floor((n - a) / (3 + g mod 8)). Texts without words and rows
    without a key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        return let(g % n, lambda a: let(
            1 + F.floor((n - a) / (3 + g % 8)),
            lambda p: F.array_join(F.transform(w, lambda _, i: F.get(
                w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")))

    planted = let(words(F.col(text)), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col(text)))
    return docs.withColumn(text, F.when(h % 10 == 0, planted).otherwise(F.col(text)))


def damaged_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """The turns with nulls in ``role`` and ``text`` as one space, and ``copies``: how often the turn is there.

    By the CRC-32 of ``key:turn`` (nulls: one space) mod 20, a turn is dropped (0), emptied (1), robbed of its sentence
    ends (2), repeated at once (3), or said to be the user's (4).
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind, said = F.crc32(name) % 20, F.coalesce(F.col(text), space)
    return turns.select(
        F.col(key), F.col(turn),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))
