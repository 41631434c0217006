"""Quality rules whose cutoffs follow the corpus.

Every document gets a few whole-text counts. Their ratios are gathered into one quantile sketch per language, source
and ratio: a histogram over integer buckets that keep the six leading bits of a value (relative error below 1/32).
Bucket counts add, so sketches merge in any order, over any number of tasks and runs, and always to the same result.
The quartiles of a sketch give fences, and documents outside the fences of their language and source are rejected.
Groups with few documents use the merged sketch of their language, or of everything.

Everything runs inside Spark's own expressions. The largest thing that is shuffled is a table of bucket counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import NOT_SPACE, fresh, let, without, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Ratio:
    """A ratio of counts, times ``scale``. ``spread`` is the least distance between quartiles that fences assume;
    the ratio is judged where its divisor is ``least`` or more."""

    name: str
    above: str
    below: str
    scale: int
    spread: int
    least: int
    low: bool


RATIOS = (
    Ratio("word_length", "word_chars", "n_words", 100, 40, 20, low=True),
    Ratio("symbol_share", "n_symbols", "word_chars", 10_000, 50, 1, low=False),
    Ratio("duplicate_line_share", "n_dup_lines", "n_lines", 10_000, 1_500, 1, low=False),
)
FENCE = 3  # quartile distances between a quartile and its fence
LEAST_DOCUMENTS = 200  # a group with fewer is judged by the next wider group
FEWEST_WORDS = 10
MOST_REPEATED_PERCENT = 20


def _repeated_words(w: Column) -> Column:
    """Words inside five-word windows that the text holds twice or more."""
    hashes = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])),
        F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)),
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        starts = let(placed, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))),
            lambda e: e["at"],
        )))
        reach = let(starts, lambda p: F.transform(
            p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))
        ))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    # Most texts repeat nothing; only the others pay for sorting their windows.
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(without(text, SYMBOLS))


def _lines(text: Column) -> Column:
    """How many lines hold a word, and how many of them equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)), lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeated")
    ))


def counts(text: Column, repeats: bool = True) -> Column:
    """Struct of the whole-text counts. Null and empty texts count zero of everything.

    Ratios need no ``n_repeat_words``; without ``repeats`` the costly search for them is left out.
    """
    text = F.coalesce(text, F.lit(""))
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"),
        (_repeated_words(w) if repeats else F.lit(0)).alias("repeated"),
    ))
    return let(F.struct(of_words.alias("w"), _lines(text).alias("x")), lambda s: F.struct(
        s["w"]["n"].cast("long").alias("n_words"),
        s["w"]["chars"].cast("long").alias("word_chars"),
        _symbols(text).cast("long").alias("n_symbols"),
        s["x"]["repeated"].cast("long").alias("n_dup_lines"),
        s["w"]["repeated"].cast("long").alias("n_repeat_words"),
        s["x"]["n"].cast("long").alias("n_lines"),
    ))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < FEWEST_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MOST_REPEATED_PERCENT)


def _ratio(c: Column, r: Ratio) -> Column:
    """Whole number; zero where the divisor is zero."""
    value = F.floor(c[r.above] * r.scale / F.when(c[r.below] > 0, c[r.below]))
    return F.coalesce(value, F.lit(0)).cast("long")


def _bucket(value: Column) -> Column:
    """The value with all but its six leading bits cleared."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return value - value % step


def quantile_sketches(df: DataFrame, measured: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """Sketches of all texts with a word: language, source, ratio, bucket, n. ``measured`` names the counts column."""
    c = F.col(measured)
    values = F.array(*[F.struct(F.lit(r.name).alias("ratio"), _bucket(_ratio(c, r)).alias("bucket")) for r in RATIOS])
    # A filter on the counts would be pushed below them and make them twice; exploding null drops the row as well.
    return (
        df.select(F.col(lang).alias("lang"), F.col(source).alias("source"),
                  F.explode(F.when(c["n_words"] > 0, values)).alias("v"))
        .groupBy("lang", "source", F.col("v.ratio").alias("ratio"), F.col("v.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """One sketch table from several, such as those of earlier runs."""
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, least: int = LEAST_DOCUMENTS, fence: int = FENCE) -> DataFrame:
    """One row per language and source: ``<ratio>_low`` (where the ratio has one) and ``<ratio>_high``."""
    wide = {"all": [], "lang": ["lang"], "own": ["lang", "source"]}
    tables = {}
    for name, keys in wide.items():
        by = Window.partitionBy(*keys, "ratio")
        so_far = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        merged = sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
        ranked = merged.withColumns({"upto": F.sum("n").over(so_far), "total": F.sum("n").over(by)})
        quartile = {q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket"))) for q in (1, 3)}
        per_ratio = ranked.groupBy(*keys, "ratio").agg(
            F.first("total").alias("total"), quartile[1].alias("q1"), quartile[3].alias("q3")
        )
        columns = [F.max("total").alias(f"n_{name}")]
        for r in RATIOS:
            own = F.col("ratio") == r.name
            q1, q3 = F.max(F.when(own, F.col("q1"))), F.max(F.when(own, F.col("q3")))
            reach = F.greatest(q3 - q1, F.lit(r.spread)) * fence
            columns.append(F.struct((q1 - reach).alias("low"), (q3 + reach).alias("high")).alias(f"{r.name}_{name}"))
        tables[name] = per_ratio.groupBy(*keys).agg(*columns)
    lang = tables["lang"].withColumnRenamed("lang", "_lang")
    # "all" is a single row, and languages are joined to sources on a table of group rows, not of documents.
    groups = (
        tables["own"].join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .join(F.broadcast(tables["all"]), F.lit(True), "left")
    )

    def pick(ratio: str, side: str) -> Column:
        return F.when(F.col("n_own") >= least, F.col(f"{ratio}_own.{side}")).when(
            F.col("n_lang") >= least, F.col(f"{ratio}_lang.{side}")).otherwise(F.col(f"{ratio}_all.{side}"))

    out = ["lang", "source"]
    for r in RATIOS:
        out += [pick(r.name, "low").alias(f"{r.name}_low")] if r.low else []
        out.append(pick(r.name, "high").alias(f"{r.name}_high"))
    return groups.select(*out)


def join_verdict(df: DataFrame, measured: str, limits: DataFrame, lang: str, source: str, kept: str) -> DataFrame:
    """The frame with a boolean ``kept``: inside all fences of its language and source."""
    names = dict(zip(limits.columns, fresh(df, *[f"_limit_{c}" for c in limits.columns]), strict=True))
    limits = limits.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = F.col(lang).eqNullSafe(F.col(names["lang"])) & F.col(source).eqNullSafe(F.col(names["source"]))
    c, inside = F.col(measured), F.lit(True)
    for r in RATIOS:
        value = _ratio(c, r)
        fits = value <= F.col(names[f"{r.name}_high"])
        if r.low:
            fits &= value >= F.col(names[f"{r.name}_low"])
        inside &= (c[r.below] < r.least) | fits
    joined = df.join(limits, same, "left")
    return joined.withColumn(kept, F.coalesce(inside, F.lit(True))).drop(*names.values())


def quality_rules(docs: DataFrame, durable: Callable[..., DataFrame], text: str = "text", lang: str = "lang",
                  source: str = "source") -> DataFrame:
    """The documents that pass, with their own columns.

    A document is rejected if it has under ten words, if repeated five-word windows hold over a fifth of its words, or
    if a ratio lies outside the fences of its language and source. Null texts count as empty and are rejected. Null
    languages and sources form groups of their own. Repeated rows are judged alike. Empty tables stay empty. Extra
    columns pass through, whatever their names. ``durable`` writes the sketches, a small table.
    """
    light, full, kept = fresh(docs, "_light", "_counts", "_kept")
    limits = fences(durable(quantile_sketches(
        docs.select(F.col(lang), F.col(source), counts(F.col(text), repeats=False).alias(light)), light, lang, source
    ), "sketches"))
    judged = join_verdict(docs.withColumn(full, counts(F.col(text))), full, limits, lang, source, kept)
    # One condition over both sides of the join: parts of it would be pushed below and the counts made once more there.
    passes = F.when(F.col(kept), ~base_failed(F.col(full))).otherwise(False)
    return judged.filter(passes).select(*[docs[c] for c in docs.columns])


def quality_report(docs: DataFrame, durable: Callable[..., DataFrame], key: str = "doc_id", text: str = "text", lang: str = "lang",
                   source: str = "source") -> DataFrame:
    """One row per document: key, counts, ``base_failed`` and ``kept``. ``durable`` writes the counts, which are read twice.

    Nulls, empty tables and repeated rows are treated as in :func:`quality_rules`; other columns are not read.
    """
    measured = durable(docs.select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        counts(F.col(text)).alias("counts"),
    ))
    limits = fences(quantile_sketches(measured, "counts"))
    judged = join_verdict(measured, "counts", limits, "lang", "source", "inside")
    failed = base_failed(F.col("counts"))
    return judged.select(
        F.col("key").alias(key), "counts.*", failed.alias("base_failed"), (~failed & F.col("inside")).alias("kept")
    )
