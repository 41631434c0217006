"""From raw documents to token ids: five stages, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.llm.bpe import round_trip
from stakelens.llm.mixing import mixture
from stakelens.llm.quality_rules import quality_rules
from stakelens.llm.secret_scan import mask_secrets
from stakelens.llm.simhash import drop_near_duplicates
from stakelens.operators.durable import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs, durable)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, the one with the smallest id stays."""
    return drop_near_duplicates(docs, durable)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are masked."""
    return mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture(docs, durable)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed ids of each document, and whether they decode to its text."""
    coded = round_trip(docs, RANKS, PATTERN)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids",
        (F.col("decoded") == text).alias("decodes"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_each),
    ("secret_scans", hide_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]

ORACLE_SQL = None  # SimHash and BPE are beyond SQL; the tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
