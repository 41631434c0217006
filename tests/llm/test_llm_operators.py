"""Each operator on small tables: edge cases, and brute-force versions on the smallest test tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import TESTDATA
from edge_tables import DOCUMENTS, TEXTS, documents, no_documents
from pyspark.sql import functions as F

from stakelens.llm import (
    bpe, components, hnsw, line_crf, mixing, quality_rules, ranking, secret_scan, sharding, simhash, token_counts, url_filter)
from stakelens.llm.queries import PATTERN, QUERIES, RANKS
from stakelens.operators.durable import durable

FOLDER = f"{TESTDATA}/sf0.001"
COLUMNS = [c.split()[0] for c in DOCUMENTS.split(", ")]


@pytest.fixture(scope="module")
def edges(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return no_documents(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.Tokenizer(open(RANKS, "rb").read(), PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(open(RANKS, "rb").read(), PATTERN)


# 1 ------------------------------------------------------------------------------------------------------------------

def test_quality_rules_keep_columns_and_reject_the_short(edges, nothing):
    kept = quality_rules.quality_rules(edges, durable)
    assert kept.columns == COLUMNS
    texts = Counter(r.text for r in kept.collect())
    assert texts[TEXTS[7]] == 4 and None not in texts and "" not in texts  # two documents, each twice
    assert quality_rules.quality_rules(nothing, durable).count() == 0


def test_quality_report_on_edges(edges, nothing):
    rows = quality_rules.quality_report(edges, durable).collect()
    assert len(rows) == len(TEXTS) + 4
    null = next(r for r in rows if r.doc_id == 0)
    assert (null.n_words, null.word_chars, null.base_failed, null.kept) == (0, 0, True, False)
    same = next(r for r in rows if r.doc_id == 4)
    assert same.n_repeat_words == 0 and same.n_words == 9
    assert quality_rules.quality_report(nothing, durable).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e x a b c d e", "a a a a a a", "a b c d", "a b c d e f a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s")})
    rows = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_report(df, durable).collect()}
    assert rows == {0: 10, 1: 6, 2: 0, 3: 12}


def test_sketches_merge(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("c", quality_rules.counts(F.col("text")))
    whole = quality_rules.quantile_sketches(df, "c")
    halves = [quality_rules.quantile_sketches(df.filter(f"doc_id % 2 = {k}"), "c") for k in (0, 1)]
    assert sorted(map(str, whole.collect())) == sorted(map(str, quality_rules.merge_sketches(*halves).collect()))


# 2 ------------------------------------------------------------------------------------------------------------------

def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    model = line_crf.Crf(rng.normal(size=line_crf.WIDTH), 0.3, rng.normal(size=(2, 2)))
    x = rng.normal(size=(5, line_crf.WIDTH)) / 5
    weights = np.zeros((5, 2))
    for labels in np.ndindex(*[2] * 5):
        e = sum(labels[t] * (x[t] @ model.weights + model.bias) for t in range(5))
        e += sum(model.pairs[labels[t], labels[t + 1]] for t in range(4))
        for t in range(5):
            weights[t, labels[t]] += np.exp(e)
    assert np.allclose(model.good(x), weights[:, 1] / weights.sum(axis=1))


def test_crf_slope_equals_differences():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, 4, line_crf.WIDTH + 1)) / 5
    p = rng.normal(size=line_crf.WIDTH + 5) / 5

    def likelihood(p):
        total, own = 0.0, 0.0
        for labels in np.ndindex(*[2] * 4):
            e = sum(labels[t] * (x[0, t] @ p[:line_crf.WIDTH + 1]) for t in range(4))
            e += sum(p[line_crf.WIDTH + 1:].reshape(2, 2)[labels[t], labels[t + 1]] for t in range(3))
            total += np.exp(e)
            own = e if labels == (1,) * 4 else own
        return (own - np.log(total)) / 4

    slope = line_crf._slope(p, x, np.ones((1, 4), bool), np.array([1]))
    for i in (0, 7, line_crf.WIDTH, *range(line_crf.WIDTH + 1, line_crf.WIDTH + 5)):
        step = np.zeros_like(p)
        step[i] = 1e-5
        assert abs((likelihood(p + step) - likelihood(p - step)) / 2e-5 - slope[i]) < 1e-6


def test_classifier_holds_out_and_survives_edges(spark, edges, nothing):
    folder = f"{TESTDATA}/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op2_line_crf"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert rows and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    some = spark.createDataFrame([(3, 1), (3, 0), (7, None), (None, 1), (11, 0), (4, 1)], "doc_id long, quality int")
    scored = line_crf.classify(edges, some).collect()
    assert len(scored) == len(TEXTS) + 4 and all(0 <= r.score <= 1 for r in scored)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == 0.5 for r in line_crf.classify(edges, none).collect())
    assert line_crf.classify(nothing, some).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?q=/de/", "https://example.net/en", "x://net/", "x://net",
    "http://example.com/de/1#/en/", "http://badexample.com/de/", "http://a.b.org/fr/?x", "http://org?/fr/",
    "http://ÀB.net/é", "a://b://c.net/x", "http://example.net./en/",
]


def test_urls(spark):
    rules = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"),
             url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]
    pages = spark.createDataFrame([(u, "mine", i) for i, u in enumerate(URLS)], "url string, host string, _judged int")
    rows = sorted(url_filter.filter_urls(pages, rules).collect(), key=lambda r: r._judged)
    got = [(r.host, r.path, r.rule, r.verdict) for r in rows]
    for url, (host, path, rule, verdict) in zip(URLS, got, strict=True):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        want = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        assert (host, path) == want
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert (rule, verdict) == ((best.host + best.path, best.verdict) if best else (None, "allow"))
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert all(r.verdict == "allow" for r in url_filter.filter_urls(pages, []).collect())


def test_equal_digests_do_not_match(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "xxh64_intdigest", lambda name: 7)
    path = tmp_path / "index"
    path.write_bytes(url_filter.index_bytes([url_filter.Rule("a.net", "/", "block"), url_filter.Rule("b.net", "/x", "allow")]))
    index = url_filter.Index(str(path))
    assert [x[2:] for x in index.judge(["http://a.net/", "http://b.net/xy", "http://c.net/"])] == [
        ("a.net/", "block"), ("b.net/x", "allow"), (None, "allow")]


# 4 ------------------------------------------------------------------------------------------------------------------

def test_mixing_on_edges(edges, nothing):
    mixed = mixing.mix(edges, durable)
    rows = mixed.collect()
    assert len(rows) == len(TEXTS) + 4
    by_source = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by_source[r.source].append(r)
    for group in by_source.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 0.5
        assert group[0].source_size == sum(r["size"] for r in group)
        assert group[0].target <= 3 * group[0].source_size
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edges, durable).collect()))
    made = mixing.mixture(edges, durable)
    assert made.columns == COLUMNS
    own = Counter((r.doc_id, r.source, r.text) for r in rows)
    times = Counter((r.doc_id, r.source, r.text) for r in made.collect())
    for r in rows:  # whole documents, as often as is nearest
        if r["size"] and own[r.doc_id, r.source, r.text] == 1:
            assert abs(times[r.doc_id, r.source, r.text] * r["size"] - r.taken) * 2 <= r["size"]
    assert set(times) <= set(own)
    assert mixing.mix(nothing, durable).count() == mixing.mixture(nothing, durable).count() == 0


def test_water_filling_shares_what_is_left(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 200), ("d", 0)], "source string, size long")
    rows = {r.source: (r.weight, r.target) for r in mixing.source_targets(sizes, durable).collect()}
    assert [rows[s][0] for s in ("a", "b", "c", "d", None)] == [5, 2, 1, 5, 2]
    assert rows["a"][1] == 30 and rows["c"][1] == 15 and rows["d"][1] == 0
    assert rows["b"][1] == rows[None][1] == (1215 - 45) / 2
    assert abs(sum(t for _, t in rows.values()) - 1215) < 1e-9


def test_mixing_beyond_two_billion(spark, edges):
    sizes = spark.createDataFrame([("a", 900_000_000), ("b", 400_000_000), ("c", 200_000_000)], "source string, size long")
    targets = {r.source: r.target for r in mixing.source_targets(sizes, durable).collect()}
    assert targets == {"a": 937_500_000, "b": 375_000_000, "c": 187_500_000}
    # Weights in the same proportion give the same mix, though weight times words does not fit an int.
    large = mixing.mix(edges, durable, weights=(500_000_000, 200_000_000, 100_000_000))
    assert sorted(map(str, large.collect())) == sorted(map(str, mixing.mix(edges, durable).collect()))


# 5 ------------------------------------------------------------------------------------------------------------------

def test_neighbours_against_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    got = defaultdict(list)
    for r in QUERIES["op5_hnsw"](spark, FOLDER).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        best = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        found = sorted(got[ids[i]])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, s in found)
        hits += len({ids[j] for j in best} & {v for _, v, _ in found})
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.9


def test_neighbours_on_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, []),
            (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]),
            (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = hnsw.nearest(df, F.col("vec_id") == 0, durable).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert hnsw.nearest(df.limit(0), F.col("vec_id") == 0, durable).count() == 0
    assert hnsw.nearest(df, F.col("vec_id") < 0, durable).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------

def test_shards(spark, edges, nothing, docs):
    rows = QUERIES["op6_sharding"](spark, FOLDER).toPandas().merge(docs, on="doc_id")
    assert (rows["size"] == [len(t.encode()) + 1 for t in rows.text]).all()
    assert rows.groupby("text").shard.nunique().max() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    bytes_of = rows.groupby("shard")["size"].sum()
    assert len(bytes_of) == 8 and bytes_of.max() - bytes_of.min() < 0.01 * bytes_of.mean()
    odd = sharding.shard(edges, durable).collect()
    assert len(odd) == len(TEXTS) + 4 and len({(r.shard, r.slot) for r in odd}) == len(odd)
    assert sharding.shard(nothing, durable).count() == 0


def test_differencing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 40)
    groups = spark.range(3000).select(F.md5(F.col("id").cast("string")).cast("binary").alias("digest"),
                                      (F.pmod(F.xxhash64("id"), F.lit(5000)) + 1).alias("weight"))
    shards = sharding.balance(groups, 8, durable).join(groups, "digest").groupBy("shard").agg(F.sum("weight").alias("w"))
    sums = [r.w for r in shards.collect()]
    assert len(sums) == 8 and (max(sums) - min(sums)) / np.mean(sums) < 0.05


def test_differencing_by_hand():
    assert sharding.difference([], 2) == []
    placed = sharding.difference([[8], [7], [6], [5], [4]], 2)
    sums = Counter()
    for w, (s,) in zip((8, 7, 6, 5, 4), placed, strict=True):
        sums[s] += w
    assert sorted(sums.values()) == [14, 16]  # the method's known result


# 7 ------------------------------------------------------------------------------------------------------------------

def _closure(ids, near):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(ids))]


def _links(fps, radius=3):
    return [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= radius]


def test_simhash_against_brute_force(spark, docs, edges, nothing):
    import xxhash

    def plain(text, k=3):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    for ids, texts, rows in (
        (docs.doc_id.tolist(), docs.text.tolist(), QUERIES["op7_simhash"](spark, FOLDER).collect()),
        ([r.doc_id for r in edges.collect()], [r.text for r in edges.collect()], simhash.near_duplicates(edges, durable).collect()),
    ):
        fps = [plain(t) for t in texts]
        want = sorted(map(str, zip(ids, [f"{x:016x}" for x in fps], _closure(ids, _links(fps)), strict=True)))
        assert sorted(str(tuple(r)) for r in rows) == want
    assert simhash.near_duplicates(nothing, durable).count() == 0


def test_planted_fingerprints_within_the_radius_are_linked(spark):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 300).astype(np.uint64)
    near = [f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for f in fps]
    every = sorted({int(x) for x in [*fps, *near]})
    like = simhash.Likeness()
    rows = [(x.to_bytes(8, "big"), simhash._cell(np.array([x], np.uint64), like)) for x in every]
    df = spark.createDataFrame(rows, "fp binary, cell int")
    got = components.components(simhash.fingerprint_links(df, like, durable), durable).collect()
    name = {int.from_bytes(r.node, "big"): int.from_bytes(r.component, "big") for r in got}
    assert [name.get(x, x) for x in every] == _closure(every, _links(every))


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, durable).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components.components(links.limit(0), durable).count() == 0


def test_near_copies_go_and_others_stay(spark, edges, nothing):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{rng.integers(0, 9**5)}" for _ in range(300)) for _ in range(20)]
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        w[100], w[200] = "changed", "too"
        rows += [(3 * i, t), (3 * i + 1, " ".join(w)), (3 * i + 2, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df, durable).collect()) == [3 * i for i in range(20)]
    kept = simhash.drop_near_duplicates(edges, durable)
    assert kept.columns == COLUMNS
    texts = Counter(r.text for r in kept.collect())
    assert texts[TEXTS[7]] == 1 and sum(texts[t] for t in (None, "", TEXTS[2])) == 1 and texts[TEXTS[5]] == 1
    assert simhash.drop_near_duplicates(nothing, durable).count() == 0


def _alike(texts, k=5):
    """Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = [{tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} for w in (t.lower().split() for t in texts)]
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]


def _kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(df, durable).collect())


def _fresh_words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 9**9, n)]


def test_every_dropped_document_has_a_chain_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(8)
    texts = []
    for shared in (250, 260, 270, 280):  # of 304 words a passage in common: similarities of 0.69 to 0.88, and 0.8 nearly
        passage = _fresh_words(rng, shared)
        texts += [" ".join(passage + _fresh_words(rng, 304 - shared)) for _ in range(30)]
    word = _fresh_words(rng, 200)
    for _ in range(30):  # a chain whose ends have nothing in common
        word = word[8:] + _fresh_words(rng, 8)
        texts.append(" ".join(word))
    texts += [" ".join(_fresh_words(rng, 9)[:n]) for n in (1, 4, 5, 8, 9) for _ in range(4)]
    short = _fresh_words(rng, 9)
    texts += [" ".join(short), " ".join(short[:8]), " ".join(short[:7])]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    name = _closure(range(len(texts)), _alike(texts))
    assert _kept(spark, texts) == sorted(set(name)) and len(set(name)) > 60


def test_documents_with_a_long_passage_in_common_stay(spark):
    rng = np.random.default_rng(9)
    passage = _fresh_words(rng, 230)
    texts = [" ".join(passage + _fresh_words(rng, 74)) for _ in range(700)]  # all pairs at 0.6
    assert _kept(spark, texts) == list(range(700))


def test_repeated_shingles_count_once_and_equal_fingerprints_are_confirmed(spark, monkeypatch):
    rng = np.random.default_rng(10)
    texts = [" ".join([*_fresh_words(rng, 475), *["-"] * 60, *_fresh_words(rng, 475)]) for _ in range(40)]
    texts += [t.replace(" - -", " -" * 300, 1) for t in texts[:10]]  # the same sets of shingles
    assert _kept(spark, texts) == list(range(40))
    assert simhash.entry(texts[0], simhash.FIVE_WORDS)[0] == simhash.entry(texts[40], simhash.FIVE_WORDS)[0]
    monkeypatch.setattr(simhash, "_majority", lambda blocks, n, lanes: np.full(lanes, 5, np.uint64))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = df.toPandas()
    made["fp"] = [simhash.entry(t, simhash.FIVE_WORDS)[0] for t in made.text]
    same = spark.createDataFrame(made.drop_duplicates("fp").assign(cell=0, row=lambda d: d.doc_id)[["fp", "cell", "row"]],
                                 "fp binary, cell int, row long")
    links = simhash.shingle_links(same, df.withColumnRenamed("doc_id", "row"), simhash.FIVE_WORDS, durable)
    assert same.count() == 40 and links.filter("a <> b").count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------

def test_bpe_equals_the_library(tokenizer, encoding):
    rng = np.random.default_rng(5)
    bits = ["a", "b", "ab", "the", "é", "ß", "日本", "1", "23", " ", "  ", "\n", "\t", "'s", "!", "...", "\u00a0", "\x1c", "😀", "\u0301", "AAAA"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 60))) for _ in range(500)]
    texts += ["a" * 5000, "ab" * 4000, "=" * 3001, " " * 3000 + "x", "é" * 900, "".join(rng.choice(list("abcdefghij"), 9000)), *filter(None, TEXTS)]
    want = [np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert tokenizer.pack_all(texts) == want
    assert [tokenizer.pack(t) for t in texts] == want
    assert [tokenizer.unpack(p) for p in want] == [t.encode() for t in texts]


def test_bpe_query_and_columns(spark, docs, edges, nothing, encoding):
    rows = {r.doc_id: r for r in QUERIES["op8_byte_bpe"](spark, FOLDER).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = encoding.encode_ordinary(text)
        assert rows[i].n_tokens == len(ids) and rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    coded = bpe.decode(bpe.encode(edges, RANKS, PATTERN, to="Size"), RANKS, PATTERN, ids="Size")
    assert coded.columns == [*[c for c in COLUMNS if c != "size"], "Size", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
    assert bpe.round_trip(nothing, RANKS, PATTERN).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------------

def _base(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


TRICKY = [
    "secret=token:abcdefghijklmnop", "😀 API_KEY : 'abc.def-ghi_jkl' x", "password=short passwd=longenough123", "AKIA" + "A" * 13,
    "AKIA" + "Z9" * 7 + " AKIAAKIA" + "Q" * 12, "x" + "0123456789abcdef" * 3 + "g", "token token=\"\" apikey==aaaaaaaaaaaa",
] + ["".join(f"é{i:016x} " for i in range(700))]


def test_base_spans(spark, docs, edges, nothing):
    every = [*docs.text, *TRICKY]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secret_scan.secret_spans(df, durable).collect()}
    for i, text in enumerate(every):
        assert [tuple(s) for s in rows[i].base] == _base(text)
        assert set(_base(text)) <= {tuple(s) for s in rows[i].spans}
    assert len(secret_scan.report(secret_scan.secret_spans(edges, durable)).collect()) == len(TEXTS) + 4
    assert secret_scan.secret_spans(nothing, durable).count() == 0


def test_random_keys_are_found_and_masked(spark, edges):
    rng = np.random.default_rng(6)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(letters, 40)) for _ in range(60)]
    plain = " from internationalisierung2024version_final to src/main/java/org/example1/foo and release-notes-2024-version12"
    df = spark.createDataFrame([(i, f"word {k}{plain}", 0) for i, k in enumerate(keys)], "doc_id long, text string, n_chars int")
    added = [s for r in secret_scan.secret_spans(df, durable).collect() for s in r.spans]
    assert len(added) >= 55 and all((s["start"], s["end"]) == (5, 45) for s in added)
    masked = secret_scan.mask_secrets(df).collect()
    assert sum(k in r.text for k, r in zip(keys, sorted(masked, key=lambda r: r.doc_id), strict=True)) <= 5
    assert all(plain in r.text and r.n_chars == len(r.text) for r in masked)
    out = secret_scan.mask_secrets(edges)
    assert out.columns == COLUMNS
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[9] == '[secret]" end' and texts[10] == "[secret] and [secret]" and texts[7] == TEXTS[7]


SMALL, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "base32": SMALL.upper() + "234567", "small base32": SMALL + "234567", "small and digits": SMALL + DIGITS,
    "capitals and digits": SMALL.upper() + DIGITS, "capital hex": DIGITS + "ABCDEF", "letters and digits": SMALL + SMALL.upper() + DIGITS,
    "base64": SMALL + SMALL.upper() + DIGITS + "+/",
}
NOUNS = ("internal release version customer verwaltung kunden entwicklung desarrollo aplicacion archivo fichier serveur quelque "
         "response request handler project schema update report session player payment stream window buffer").split()


def _ordinary(rng):
    """A token of words and a number, joined in one of the usual ways."""
    w = [*rng.choice(NOUNS, 3), str(rng.integers(1, 3000))]
    return rng.choice(["-".join(w), "_".join(w).upper(), "".join(w), "".join(w).upper(), "/".join(w),
                       "".join(x.capitalize() for x in w), f"{w[0]}{w[3]}_{w[1]}_{w[2]}"])


def test_keys_of_every_encoding_are_found(spark):
    rng = np.random.default_rng(11)
    for least, ordinary in ((0.8, 0), (0.5, 9)):  # every candidate a key; one in ten, less in the strata that words share
        rows = []
        for name, characters in ENCODINGS.items():
            for n in (20, 32, 40, 64):
                for _ in range(60):
                    key = "".join(rng.choice(list(characters), n))
                    rows.append((f"{name}, {n}", f"x {key} " + " ".join(_ordinary(rng) for _ in range(ordinary)), n))
        df = spark.createDataFrame(rows, "doc_id string, text string, n int")
        found, wrong = Counter(), 0
        for r in secret_scan.secret_spans(df, durable).collect():
            n = int(r.doc_id.split(", ")[1])
            spans = {(s["start"], s["end"]) for s in r.spans}
            found[r.doc_id] += any(a < n + 2 and b > 2 for a, b in spans)
            wrong += sum(a >= n + 2 for a, b in spans)
        print(ordinary, wrong, {k: round(found[k] / 60, 2) for k in sorted(found)})
        assert wrong <= 0.01 * sum(found.values()), wrong
        for k in found:
            assert found[k] / 60 >= (least if k.endswith(" 20") else 0.85 if k.endswith(" 32") else 0.93), (k, found[k])
        assert len(found) == 28


def test_keys_around_a_hex_stretch_are_found_whole(spark):
    rng = np.random.default_rng(12)
    letters = list(SMALL + SMALL.upper() + DIGITS)
    hexes = ["".join(rng.choice(list(DIGITS + "abcdef"), 18)) for _ in range(40)]
    keys = ["".join(rng.choice(letters, 14)) + "Z" + h + "Z" + "".join(rng.choice(letters, 14)) for h in hexes]
    plain = ["AKIA" + "Z9" * 8, "0123456789abcdef" * 2]
    df = spark.createDataFrame([(i, f"word {k} and {' '.join(plain)}") for i, k in enumerate(keys)], "doc_id long, text string")
    found = [{(s["start"], s["rank"], s["end"]) for s in r.spans} for r in secret_scan.secret_spans(df, durable).collect()]
    assert sum((5, 3, 53) in x for x in found) >= 36 and all((20, 2, 38) in x and len(x) <= 4 for x in found)
    left = [r.text for r in secret_scan.mask_secrets(df).collect()]
    assert sum(x == "word [secret] and [secret] [secret]" for x in left) >= 36


# 10 -----------------------------------------------------------------------------------------------------------------

def test_tokens_of_sections(tokenizer, encoding):
    rng = np.random.default_rng(7)
    for text in [t for t in TEXTS if t] + ["日本語 text 😀😀 end"] * 3:
        size = len(text)
        cuts = sorted(set(rng.integers(0, size + 1, 8).tolist()))
        sections = np.array(list(zip(cuts[:-1:2], cuts[1::2], strict=False)), int).reshape(-1, 2)
        touched = []
        at, index = 0, [i for i, c in enumerate(text) for _ in c.encode()]
        for token in encoding.encode_ordinary(text):
            n = len(encoding.decode_single_token_bytes(token))
            touched.append(sorted(set(index[at:at + n])))
            at += n
        starts, ends = (np.concatenate(x) for x in zip(*token_counts.token_spans(tokenizer, text), strict=True))
        assert [(t[0], t[-1] + 1) for t in touched] == list(zip(starts.tolist(), ends.tolist(), strict=True))
        for rule in (token_counts.MAJORITY, token_counts.FIRST, token_counts.LAST):
            want = []
            for t in touched:
                own = [k for c in t for k, (a, b) in enumerate(sections) if a <= c < b]
                pick = {"majority": lambda o: max(sorted(set(o)), key=o.count), "first": min, "last": max}[rule]
                want.append(pick(own) if own else -1)
            assert token_counts.attribute(starts, ends, sections, rule).tolist() == want


def test_token_counts_on_edges(edges, nothing, encoding):
    body, sections = token_counts.joined_fields({"lang": F.col("lang"), "text": F.col("text")})
    ready = edges.withColumns({"whole": body, "parts": sections})
    rows = token_counts.token_counts(ready, RANKS, PATTERN, text="whole", sections="parts").collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    for r in edges.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        again = 2 if r.doc_id in (7, 8) else 1
        assert total[r.doc_id] == again * len(encoding.encode_ordinary(f"{r.lang or ''}\n{r.text or ''}"))
    odd = ready.withColumn("parts", F.lit(None).cast(token_counts.SECTIONS))
    assert {r.section for r in token_counts.token_counts(odd, RANKS, PATTERN, sections="parts").collect()} == {None}
    assert token_counts.token_counts(nothing.withColumn("parts", F.array()), RANKS, PATTERN, sections="parts").count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(ready, RANKS, PATTERN, sections="parts", rule="other")


# Helpers ------------------------------------------------------------------------------------------------------------

def test_ranks_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("_part"))
    rows = ranking.ranked(df, [F.col("v").asc()], "at", durable).collect()
    assert all(r.v == r.at for r in rows) and len(rows) == 1000


def test_the_rank_file_is_a_parameter():
    assert public_tokenizers.path("byte_bpe_50k.tiktoken") == RANKS
