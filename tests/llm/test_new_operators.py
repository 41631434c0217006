"""Periodic runs, decontamination and conversation repair against brute-force versions, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pytest
from conftest import TESTDATA
from edge_tables import TEXTS, documents, no_documents
from pyspark.sql import functions as F

from stakelens.llm import conversation_repair, damage, decontamination, periodic_runs
from stakelens.llm.queries import QUERIES
from stakelens.operators.durable import durable

FOLDER = f"{TESTDATA}/sf0.001"


sys.setrecursionlimit(20_000)  # of the plain repair, one level a turn


@contextmanager
def partitions(spark, n: int):
    """Shuffles of exactly so many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 11 -----------------------------------------------------------------------------------------------------------------

def plain_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Every period, from the smallest, at every place."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(w) // 2 + 1):
        k = 0
        while k < len(w) - p:
            end = k
            while end < len(w) - p and w[end] == w[end + p]:
                end += 1
            if end - k + p >= max(least, 2 * p):
                found.setdefault((k, end - k + p), p)
            k = end + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapse(w: list, runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repeated(doc_id: int, w: list[str]) -> list[str]:
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def test_the_cover_has_every_difference():
    differences = {(int(a) - int(b)) % 31 for a in periodic_runs.COVER for b in periodic_runs.COVER}
    assert differences == set(range(31))


def test_runs_against_every_period_at_every_place():
    r = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 6)):
            letters, n = r.choice([1, 2, 3, 5, 50]), r.choice([0, 1, 5, 12, 30, 100, 200])
            w = [r.randrange(letters) for _ in range(n)]
            if n > 3 and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + r.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        found: list[list] = [[] for _ in texts]
        for t, *run in zip(*(x.tolist() for x in periodic_runs.runs_of([np.array(w, np.int64) for w in texts])), strict=True):
            found[t].append(tuple(run))
        assert found == [plain_runs(w) for w in texts]


def test_runs_do_not_depend_on_batches(monkeypatch):
    texts = [" ".join("ab cd ef".split() * k) for k in range(40)] + ["x " * 500, None, ""]
    want = [(len(words(t)), plain_runs(words(t)), plain_collapse(words(t), plain_runs(words(t)))) for t in texts]
    assert list(periodic_runs.collapse(texts)) == want
    monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 10)
    assert list(periodic_runs.collapse(texts)) == want


def test_common_extensions_before_and_after():
    r = np.random.default_rng(3)
    numbers = np.append(np.tile(r.integers(0, 2, 90), 5), 9)
    common = periodic_runs.CommonExtensions(numbers)
    i, j = r.integers(0, len(numbers), (2, 3000))
    i, j = i[i != j], j[i != j]
    plain = [next(k for k in range(len(numbers)) if max(a, b) + k >= len(numbers) or numbers[a + k] != numbers[b + k])
             for a, b in zip(i, j, strict=True)]
    assert common.after(i, j).tolist() == plain
    back = [next(k for k in range(len(numbers)) if k == min(a, b, 60) or numbers[a - k - 1] != numbers[b - k - 1])
            for a, b in zip(i, j, strict=True)]
    assert common.before(i, j, np.minimum(np.minimum(i, j), 60)).tolist() == back


def test_periodic_runs_on_edges(spark):
    rows = periodic_runs.periodic_runs(documents(spark).withColumn("Runs", F.lit(1))).collect()
    assert len(rows) == documents(spark).count() and set(rows[0].asDict()) == {
        "doc_id", "lang", "source", "n_chars", "size", "_row", "KEPT", "n_words", "runs", "collapsed"}
    for r in rows:
        w = words(TEXTS[r.doc_id]) if r.doc_id is not None else words("a text without any key at all, twice")
        if len(w) < 1000:
            assert r.n_words == len(w) and [tuple(x) for x in r.runs] == plain_runs(w)
            assert r.collapsed == plain_collapse(w, plain_runs(w))
    assert periodic_runs.periodic_runs(no_documents(spark)).count() == 0


def test_op11_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {}
    for d in docs:
        w = repeated(d.doc_id, words(d.text))
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want[d.doc_id] = (len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2],
                          sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(plain_collapse(w, runs)))
    rows = QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 10
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want


# 13 -----------------------------------------------------------------------------------------------------------------

GOOD = re.compile(r"(s?(ua)+)?")


def plain_repair(turns: list[tuple[str, str, int]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cheapest edits of (role, text, fault) by trying all: what is left of the turns and what the last two roles are."""

    @lru_cache(None)
    def rest(k: int, so_far: str, inserted: int) -> tuple | None:
        # so_far: the roles up to here, cut to what the pattern needs: "", "s", "u" or "a"
        best = (0, "", ()) if k == len(turns) and so_far in ("", "a") else None
        steps = []
        if inserted < 2:
            steps += [(2, "I", k, x, (x, "")) for x in ("user", "assistant")]
        if k < len(turns):
            role, text, fault = turns[k]
            steps.append((3, "D", k + 1, None, None))
            if fault not in (1, 2):
                steps += [(fault == 3, "K", k + 1, role, (role, text))]
                steps += [(2 + (fault == 3), "R", k + 1, x, (x, text)) for x in ("user", "assistant")]
        for cost, letter, to, role, out in steps:
            state = so_far if role is None else {
                ("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((so_far, role[:1]))
            after = None if state is None else rest(to, state, inserted + 1 if letter == "I" else 0)
            if after:
                found = (cost + after[0], letter + after[1], ((out,) if out else ()) + after[2])
                best = found if best is None else min(best, found, key=lambda x: x[:2])
        return best

    cost, audit, out = rest(0, "", 0)
    assert GOOD.fullmatch("".join(r[0] for r, _ in out))
    return cost, audit, list(out)


def plain_report(rows: list[tuple]) -> dict:
    """From (key, turn, role, text), all that the query returns."""
    damaged: dict = {}
    for key, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged.setdefault(key, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {key: plain_faults(turns) for key, turns in damaged.items()}


def plain_faults(turns: list[tuple]) -> tuple:
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
    seen, marked = set(), []
    for _, role, text in turns:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 1 if not ends else 2 if (role, text) in seen else 3 if ends[-1] not in ".!?" else 0
        seen.add((role, text))
        marked.append((role, text, fault))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    cost, audit, left = plain_repair(marked)
    faults = [f for _, _, f in marked]
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left)))


def reported(stream) -> dict:
    return {r[0]: tuple(r)[1:] for r in conversation_repair.report(stream).collect()}


def odd_turns(seed: int, conversations: int, most: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for key in [None, *range(conversations)]:
        for turn in range(r.randint(0, most)):
            rows.append((key, None if r.random() < 0.1 else r.choice([turn, turn + 1, 0]),
                         r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         r.choice(["Yes.", "No!", "what", " \n", "", None, f"Answer {r.randrange(9)}.", "é?  "])))
    return rows + rows[:5]


def test_paths_against_all_edits():
    r = random.Random(11)
    for _ in range(400):
        turns = [(r.choice(["user", "assistant", "system", "tool"]), str(k), r.randrange(4)) for k in range(r.randint(0, 9))]
        paths = conversation_repair.Paths((conversation_repair.NOTHING,))
        for role, _, fault in turns:
            paths.add(conversation_repair.BY_INITIAL.get(role[0]), fault)
        assert conversation_repair.cheapest(paths.ends()) == plain_repair(turns)[:2]


def test_parts_decide_what_the_whole_does(monkeypatch):
    r = random.Random(12)
    for chunk in (64, 3, 1):
        monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
        for _ in range(100):
            turns = [(r.choice([None, 1, 2, 3]), r.randrange(4)) for _ in range(r.randint(1, 40))]
            whole = conversation_repair.Paths((0,))
            for t in turns:
                whole.add(*t)
            want, cuts = conversation_repair.cheapest(whole.ends()), sorted(r.choices(range(len(turns)), k=3))
            parts = []
            for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(turns)], strict=True)):
                part = conversation_repair.Paths((0, 1, 2, 3) if k else (0,))
                for t in turns[a:b]:
                    part.add(*t)
                parts.append(part.ends())
            cost, ways = conversation_repair.through_parts([[e[:4] for e in p] for p in parts])
            letters = "".join(next(e[4] for e in p if e[:2] == way) for p, way in zip(parts, ways, strict=True))
            assert (cost, letters + conversation_repair.AT_END[ways[-1][1]]) == want


@pytest.mark.parametrize("n", [1, 2, 23])
def test_repair_of_odd_turns(spark, n):
    rows = odd_turns(4, 40, 12)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies_", F.lit(1))
    with partitions(spark, n):
        found = reported(conversation_repair.repair(damage.damaged_turns(turns), durable, copies="copies"))
    assert found == plain_report(rows)


def test_one_long_conversation_over_many_tasks(spark):
    r = random.Random(8)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), f"{r.randrange(300)}{r.choice(['.', '', '!'])}") for t in range(900)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_faults([x[1:] for x in rows])
    with partitions(spark, 9):
        stream = durable(conversation_repair.repair(turns, durable).withColumn("at", F.monotonically_increasing_id()))
        assert stream.filter("place = 0").count() == 9
        again = stream.repartition(1).sortWithinPartitions("at").drop("at")
        assert reported(again) == {7: want}
    left = conversation_repair.repaired_turns(stream).orderBy("place").collect()
    assert [x.place for x in left] == list(range(1, len(left) + 1)) and GOOD.fullmatch("".join(x.role[0] for x in left))
    assert sha("\n".join(f"{x.role}:{x.text}" for x in left)) == want[-1]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert reported(conversation_repair.repair(damage.damaged_turns(none), durable, copies="copies")) == {}


def test_op13_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, FOLDER).collect()}
    assert found == plain_report(rows) and sum(r[5] > 0 for r in found.values()) > 10


# 12 -----------------------------------------------------------------------------------------------------------------

def terms(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_windows(items: list[tuple], window: int) -> dict[tuple, set]:
    out: dict[tuple, set] = {}
    for item, text in items:
        w = terms(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[k:k + window]), set()).add(item)
    return out


def plain_contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    windows = plain_windows(items, window)
    sizes, out = sorted({len(x) for x in windows}), []
    for key, text in docs:
        w, hit, found = terms(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((key, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten ELEVEN"), (2, "alpha beta, alpha"), (3, None), (4, " .. "),
         (5, "Zoë"), (6, "two three four five six seven eight nine ten eleven"), (10, "zoë"), (11, "ÉTÉ été")]
DOCS = [(1, "x one two three four five six seven eight nine ten eleven twelve"), (2, "Alpha-beta alpha beta alpha"), (3, None),
        (4, ""), (5, "zOë ZOË zoe"), (6, "one two three four five six seven eight nine eleven"), (None, "alpha beta alpha"),
        (None, "alpha beta alpha"), (7, "two " * 50_000 + "alpha beta alpha"), (8, "été été ÉTÉ été"), (9, "beta alpha alpha")]


def test_contamination_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"row": F.lit(1), "Term": F.lit("x")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1))
    for window in (10, 3, 1):
        rows = decontamination.contamination(docs, items, durable, window=window).collect()
        assert sorted(map(str, (tuple(r)[:6] for r in rows))) == sorted(
            map(str, plain_contamination(DOCS, ITEMS, window)))
        assert all(r.n_near_items >= r.n_items for r in rows)
    none = decontamination.contamination(docs, items.limit(0), durable).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated or r.n_items for r in none)
    assert decontamination.contamination(docs.limit(0), items, durable).count() == 0
    assert len(decontamination.contamination(documents(spark), items, durable).collect()) == documents(spark).count()


def test_near_matches_against_brute_force(spark):
    r = random.Random(2)
    docs = [(k, " ".join(r.choice("abcdefghij") for _ in range(r.randrange(60)))) for k in range(60)]
    items = [(k, " ".join(r.choice("abcdefghijk") for _ in range(r.randint(1, 5)))) for k in range(12)]
    index = decontamination.build_index(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
        durable, window=4)
    rarest = {x.window: (x.lists[0].term, x.lists) for x in index.plans.collect()}
    words_of = {x.window: x.words for x in index.windows.collect()}
    names = {x.row: x.key for x in index.documents().collect()}
    want = set()
    for window, (term, lists) in rarest.items():
        word = words_of[window][next(x.offset for x in lists if x.term == term)]
        for key, text in docs:
            w = text.split()
            want |= {(key, at, window) for at, x in enumerate(w) if x == word
                     and set(words_of[window]) <= set(w[max(0, at - 6):at + 7])}
    matches = decontamination.matches(index, durable, 6)
    found = [(names[x.row], x.anchor, x.window) for x in decontamination.near_matches(matches).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 20


def test_places_are_not_broadcast(spark):
    plans = []

    def noted(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df, purpose)

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    decontamination.contamination(docs, items, noted)
    joins = re.findall(r"(\w+Join) \[row#\d+L?, (stretch|anchor)#", "\n".join(plans))
    assert {x for _, x in joins} == {"stretch", "anchor"} and {x for x, _ in joins} == {"SortMergeJoin"}


def test_op12_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = QUERIES["op12_decontamination"](spark, FOLDER).collect()
    assert sorted(tuple(r)[:6] for r in rows) == sorted(plain_contamination(docs, items))
    assert sum(r.contaminated for r in rows) >= 3


# 3 ------------------------------------------------------------------------------------------------------------------

def test_long_urls_take_little(tmp_path):
    import tracemalloc

    from stakelens.llm import url_filter

    rules = [url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("com", "/", "allow"), url_filter.Rule("", "/x", "block")]
    (tmp_path / "i").write_bytes(url_filter.index_bytes(rules))
    index = url_filter.Index(str(tmp_path / "i"))
    host = "a." * 500_000
    urls = [f"http://{host}example.com/de/x", f"http://{host}com/", f"http://{host}bexample.com/de/", f"http://{'x' * 10**6}",
            f"http://{host}", "http://example.com/de/" + "y/" * 500_000, "http://com/de/", "http://.com/de/"]
    tracemalloc.start()
    got = [(rule, verdict) for _, _, rule, verdict in index.judge(urls)]
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert got == [("example.com/de/", "block"), ("com/", "allow"), ("com/", "allow"), (None, "allow"), (None, "allow"),
                   ("example.com/de/", "block"), ("com/", "allow"), ("com/", "allow")]
