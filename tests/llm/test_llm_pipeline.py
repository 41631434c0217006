"""Registered queries with SQL twins, and the pipeline against its stages done plainly."""

from __future__ import annotations

from functools import partial

import numpy as np
import pytest
from compare import connect, duck_rows, spark_rows
from conftest import TESTDATA
from edge_tables import documents, no_documents

import corpus_pipeline
from stakelens.llm import bpe
from stakelens.llm.queries import ORACLE_SQL, PATTERN, QUERIES, RANKS

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duck_rows(connect(FOLDER), ORACLE_SQL[name])


def test_thirteen_queries_and_five_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_step_by_step(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, frames = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        frames.append(docs.toPandas())
    raw, good, single, masked, mixed = frames
    kept = {r.doc_id for r in QUERIES["op1_quality_rules"](spark, FOLDER).filter("kept").collect()}
    assert set(good.doc_id) == kept and len(good) == len(kept)

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in zip(good.doc_id, good.text, strict=True)}
    alike = {i: [j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    left = set(single.doc_id)
    assert all(any(j in left for j in alike[i]) or len(alike[i]) == 1 for i in left)
    assert all(len([j for j in alike[i] if j in left]) == 1 for i in left), "two near copies stay"
    close = {i: [j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])] for i in sets}
    assert all(close[i] for i in set(sets) - left), "a document without near copies went"

    assert set(masked.doc_id) == left
    assert not masked.text.str.contains(r"[0-9a-f]{16,}").any()
    assert set(zip(mixed.doc_id, mixed.text, strict=True)) <= set(zip(masked.doc_id, masked.text, strict=True))
    size = masked.text.str.split().str.len()
    half = size.groupby(masked.source.fillna("")).max().sum() / 2  # one document a source is rounded
    assert abs(mixed.text.str.split().str.len().sum() - size.sum()) <= half + mixed.source.nunique()
    t = bpe.Tokenizer(open(RANKS, "rb").read(), PATTERN)
    result = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert result.decodes.all() and len(result) == len(mixed)
    want = sorted((i, t.pack(x)) for i, x in zip(mixed.doc_id, mixed.text, strict=True))
    assert sorted((i, bytes(x)) for i, x in zip(result.doc_id, result.token_ids, strict=True)) == want
    assert (result.n_tokens == [len(x) // 4 for x in result.token_ids]).all()
    assert raw.shape[0] >= good.shape[0] >= single.shape[0] and np.all(result.n_tokens > 0)


@pytest.mark.parametrize("table", [documents, no_documents])
def test_stages_on_edges(spark, table):
    docs = table(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        alone = stage(spark, table(spark), "")
        alone.count()
        docs = corpus_pipeline.durable(stage(spark, docs, ""), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert alone.columns == docs.columns == columns
    assert (docs.count() > 0) == (table is documents)


def test_mixing_stage_beyond_two_billion(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, FOLDER).select("doc_id").collect())
    # As many words as make weight times words too large for an int, by larger weights in the same proportion.
    monkeypatch.setattr(corpus_pipeline, "mixture", partial(
        corpus_pipeline.mixture, weights=(500_000_000, 200_000_000, 100_000_000)))
    made = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in made.select("doc_id").collect()) == want and want
