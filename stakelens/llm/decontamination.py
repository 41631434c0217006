"""Passages of test items in documents, by a positional inverted index made of plain tables.

The index holds a posting (document, position, term) for every word of the documents that is a word of the items. Its
counts say how rare each term is. A test window is looked up from its rarest term: each posting of it, less the term's
offset, is a place where the window may stand. The list of the second rarest term, less its own offset, is intersected
with these places, and what remains with the lists of all other terms. What is left are the exact matches. Near matches
are found from the same lists: all terms of the window, in any order, close to its rarest one.

Postings stay with their documents, so making the index moves nothing. Lists are intersected by joins on document and
position, keys that hold one posting each, so neither a frequent term nor a long document is a hot key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
REACH = 20
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Runs of digits, letters a to z and characters beyond ASCII, after A to Z are lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower())
    return F.array_remove(F.split(lowered, BETWEEN), "")


@dataclass(frozen=True)
class Index:
    """``windows`` has (window, words, items); ``postings`` (row, position, term), with ``key`` and ``n_words`` filled in
    the first posting of each document only; ``plans`` (window, lists), its terms as (postings, offset, term), rarest
    first, for the windows all of whose terms are in some document."""

    windows: DataFrame
    postings: DataFrame
    plans: DataFrame
    window: int = WINDOW

    def documents(self) -> DataFrame:
        """row, key, n_words of every document."""
        return self.postings.filter("n_words is not null").select("row", "key", "n_words")


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every different window of ``window`` consecutive words of an item: ``words``, and the ``items`` that have it.

    An item of fewer words, but not none, is one window.
    """
    split = items.select(F.col(item).alias("item"), terms(F.col(text)).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1)))
    return (
        split.filter(F.size("all") > 0).select("item", "all", F.explode(starts).alias("start"))
        .groupBy(F.slice("all", F.col("start"), F.lit(window)).alias("words"))
        .agg(F.collect_set("item").alias("items"))
    )


def build_index(docs: DataFrame, items: DataFrame, durable: Callable[..., DataFrame], key: str = "doc_id",
                text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> Index:
    """The index of whole ``docs`` for the windows of ``items``."""
    windows = durable(item_windows(items, item, item_text, window).withColumn("window", F.monotonically_increasing_id()), "windows")
    split = windows.select("window", F.posexplode("words").alias("offset", "word"))
    # Written, so that the planner knows its size and broadcasts it only if it is small.
    vocabulary = durable(split.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    words = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), terms(F.col(text)).alias("all"))
        .select("row", "key", F.size("all").cast("long").alias("n"), F.posexplode_outer("all").alias("position", "found"))
    )
    first = F.coalesce("position", F.lit(0)) == 0
    postings = durable(
        words.join(vocabulary, F.col("found") == F.col("word"), "left").filter(first | F.col("term").isNotNull())
        .select("row", "position", "term", F.when(first, F.col("key")).alias("key"), F.when(first, F.col("n")).alias("n_words")),
        "postings")
    counts = postings.filter("term is not null").groupBy("term").agg(F.count("*").alias("postings"))
    placed = split.join(vocabulary, "word").join(counts, "term", "left")
    lists = F.sort_array(F.collect_list(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "offset", "term")))
    plans = durable(placed.groupBy("window").agg(lists.alias("lists")).filter("lists[0].postings > 0"), "plans")
    return Index(windows, postings, plans, window)


def _narrowed(index: Index, places: DataFrame, wanted: Column, reach: int, durable: Callable[..., DataFrame],
              everywhere: bool) -> DataFrame:
    """The places that have all ``wanted`` terms near, with ``exact`` if those stand where they should.

    Positions meet in stretches of the reach: a place looks into its own and the two beside it.
    """
    span = max(reach, index.window)
    beside = F.array(*[F.floor(F.col("anchor") / span) + k for k in (-1, 0, 1)])
    terms_of = F.array_distinct(F.transform(wanted, lambda x: x["term"]))
    asked = places.select(
        "row", "anchor", "window", "offset", "exact", F.size(wanted).alias("places"), F.size(terms_of).alias("terms"),
        F.explode(wanted).alias("list")
    ).select("row", "anchor", "window", "exact", "places", "terms", F.col("list.term").alias("term"),
             (F.col("anchor") - F.col("offset") + F.col("list.offset")).alias("due"), F.explode(beside).alias("stretch"))
    # Only lists that are asked for are moved; of the later ones, which are long, only what lies in documents with places.
    # Their terms are written, so that the planner knows how few they are and filters where the postings are.
    lists = index.postings.select("row", "position", "term", F.floor(F.col("position") / span).alias("stretch")).join(
        durable(places.select(F.explode(F.transform(wanted, lambda x: x["term"])).alias("term")).distinct(), "terms"),
        "term", "left_semi")
    if not everywhere:
        lists = lists.join(durable(places.select("row").distinct(), "rows"), "row", "left_semi")
    at = F.col("position") == F.col("due")
    # The planner takes the exploded places for as small as they were before, and would broadcast them by that.
    met = asked.join(lists.hint("merge"), ["row", "stretch", "term"]).filter(at | (F.abs(F.col("position") - F.col("anchor")) <= reach))
    # Per term first, so that a term that stands near a place many times is one row.
    of_term = met.groupBy("row", "anchor", "window", "exact", "places", "terms", "term").agg(
        F.count_if(at).alias("hits"), F.max(F.abs(F.col("position") - F.col("anchor")) <= reach).alias("near"))
    return of_term.groupBy("row", "anchor", "window", "exact", "places", "terms").agg(
        F.sum("hits").alias("hits"), F.count_if("near").alias("n")).select(
        "row", "anchor", "window", (F.col("exact") & (F.col("hits") == F.col("places"))).alias("exact"),
        (F.col("n") == F.col("terms")).alias("near")).filter("exact or near")


def matches(index: Index, durable: Callable[..., DataFrame], reach: int = REACH) -> DataFrame:
    """Every place where a window stands or is near: row, ``anchor`` (position of its rarest word), window, ``at`` (where
    its first word is, or would be), ``size`` in words, ``exact`` (all words in their order) and ``near`` (all of them,
    in any order, at most ``reach`` words from the anchor)."""
    plans = index.plans.select("window", "lists", F.col("lists")[0]["term"].alias("rarest"),
                               F.col("lists")[0]["offset"].alias("offset"), F.size("lists").alias("size"))
    sizes = plans.select("window", "lists", "offset", "size")
    places = durable(
        index.postings.filter("term is not null").join(plans, F.col("term") == F.col("rarest"))
        .select("row", F.col("position").alias("anchor"), "window", "lists", "offset", "size",
                (F.col("position") >= F.col("offset")).alias("exact")), "places")
    second = _narrowed(index, places.filter("size > 1"), F.slice("lists", 2, 1), reach, durable, True)
    both = durable(second.join(sizes, "window"), "places")
    # What misses the second term's place is no exact match, and what has it too far away is no near one.
    rest = _narrowed(index, both.filter("size > 2"), F.slice("lists", F.lit(3), F.size("lists")), reach, durable, False)
    # Places grow with the documents, and in memory they are many times as large as their files, by which they are sized.
    rest = rest.join(both.select("row", "anchor", "window", F.col("near").alias("second_near"), "offset", "size").hint("merge"),
                     ["row", "anchor", "window"])
    columns = ["row", "anchor", "window", (F.col("anchor") - F.col("offset")).alias("at"), "size", "exact", "near"]
    found = (
        places.filter("size = 1").withColumn("near", F.lit(True)).select(columns)
        .unionByName(both.filter("size = 2").select(columns))
        .unionByName(rest.withColumn("near", F.col("near") & F.col("second_near")).filter("exact or near").select(columns)))
    return durable(found, "matches")


def exact_matches(found: DataFrame) -> DataFrame:
    """Every occurrence of a window: row, at, window, size."""
    return found.filter("exact").select("row", "at", "window", "size")


def near_matches(found: DataFrame) -> DataFrame:
    """Places near which all words of a window stand, in any order: row, anchor, window."""
    return found.filter("near").select("row", "anchor", "window")


def contamination(docs: DataFrame, items: DataFrame, durable: Callable[..., DataFrame], key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """One row per document: key, ``n_words``, ``n_hit`` (words inside exact matches), ``n_items`` (items with such),
    ``items_sha256`` (of their ids, sorted as text, comma-joined), ``contaminated``, and ``n_near_items``, which counts
    items with near matches.

    Null and empty texts have no words and are not hit; items without words have no windows. Repeated rows and rows
    with equal or null keys are documents of their own. Windows that several items share count for each. Whole texts are
    read, however long. Without items nothing is hit; an empty table gives no rows. Other columns are not read.
    """
    index = build_index(docs, items, durable, key, text, item, item_text, window)
    found = matches(index, durable, reach)
    exact = exact_matches(found)
    stretches = exact.groupBy("row", "at").agg(F.max("size").alias("size"))
    hit = (
        stretches.select("row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("position"))
        .distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    )
    of_items = durable(index.windows.select("window", F.explode("items").alias("item")), "items")

    def per_row(matches: DataFrame) -> DataFrame:
        return matches.select("row", "window").distinct().join(of_items, "window").select("row", "item").distinct()

    # As many ids in a row as there are items at most.
    ids = F.array_join(F.sort_array(F.collect_list(F.col("item").cast("string"))), ",")
    hit_items = per_row(exact).groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    out = index.documents().join(hit, "row", "left").join(hit_items, "row", "left")
    zero = F.lit(0).cast("long")
    columns = [
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")]
    near = per_row(near_matches(found)).groupBy("row").agg(F.count("*").alias("n_near"))
    return out.join(near, "row", "left").select(*columns, F.coalesce("n_near", zero).alias("n_near_items"))
