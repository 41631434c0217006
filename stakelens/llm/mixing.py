"""Mixing sources to target weights by capped water-filling.

All sources together give as many words as the corpus has, in proportion to their weights, but none more than
``EPOCHS`` times its own. Sources above are clamped there, and what they leave is shared among the others by weight,
again and again until none is above. A source then repeats all its documents a whole number of times and, for the
fraction, takes documents in a seeded random order until its words are used up; the last of them is taken in part.

Between the tables and the driver pass two sums per round. Cutting a source at a word count needs no sort of the
source: words are summed in 4096 slices of the random order, and only the slice with the cut is put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .text import NOT_SPACE, fresh, words

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
SLICE_BITS = 12


def order_number(key: Column, seed: int = SEED) -> Column:
    """32 bits that put rows in a random order fixed by the seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, durable: Callable[..., DataFrame], weights: tuple[int, ...] = WEIGHTS,
                   epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (source, size, one row each) with ``weight`` and ``target``, by water-filling.

    Weights repeat along the sources in code point order, null last.
    """
    placed = ranked(sizes, [F.col("source").isNull().asc(), F.col("source").asc()], "place", durable)
    choice = F.array(*map(F.lit, weights))
    weighed = durable(placed.withColumn(
        "weight", F.get(choice, (F.col("place") % len(weights)).cast("int"))).drop("place"), "sources")
    cap, weight = F.col("size") * epochs, F.col("weight")
    total, free = weighed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, all_words = total, total
    while free:
        above = weight.cast("decimal(38,0)") * F.lit(left) > cap.cast("decimal(38,0)") * F.lit(free)
        clamped, loose = weighed.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0))).first()
        if (all_words - clamped, loose) == (left, free):
            break
        left, free = all_words - clamped, loose
    if not free:  # no words at all
        return weighed.withColumn("target", cap.cast("double"))
    share = (weight.cast("long") * F.lit(left)).cast("double") / F.lit(free)  # a literal under 2**31 is an int
    return weighed.withColumn("target", F.least(cap.cast("double"), share))


def mix(docs: DataFrame, durable: Callable[..., DataFrame], key: str = "doc_id", text: str = "text",
        source: str = "source", seed: int = SEED, names: tuple[str, ...] = ("size", "source_size", "target", "taken"),
        weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The documents with ``size`` in words, ``source_size``, ``target`` (its source's) and ``taken`` (words the mix
    takes of it, repeats counted), under ``names``.

    The words taken of a source are its target, rounded. Null and empty texts have no words and nothing is taken. A
    null source is a source. Rows with equal or null keys share a place in the random order; among them smaller
    ones come first, and rows equal in that too are interchangeable. Empty tables stay empty. Other columns pass.
    """
    n, order, source_size, target, taken = fresh(docs, *(f"_{x}" for x in ("n", "order", "total", "target", "taken")))
    sized = docs.withColumns({
        n: F.when(F.col(text).rlike(NOT_SPACE), F.size(words(F.col(text)))).otherwise(0).cast("long"),
        order: order_number(F.col(key), seed)})
    narrow = durable(sized.select(
        F.col(source).alias("source"), F.shiftright(F.col(order), 32 - SLICE_BITS).alias("slice"),
        F.col(n).alias("size")).groupBy("source", "slice").agg(F.sum("size").alias("size")), "slices")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("size")), durable, weights, epochs)
    whole = F.floor(F.col("target") / F.when(F.col("total") > 0, F.col("total")))
    shares = targets.withColumnRenamed("size", "total").withColumns({
        "whole": F.coalesce(whole, F.lit(0)).cast("long")}).withColumn(
        "rest", F.round(F.col("target") - F.col("whole") * F.col("total")).cast("long"))
    # The slice in which a source's rest runs out, and the words before it.
    so_far = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = narrow.withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0))).withColumnRenamed("source", "of")
    cut = (
        shares.join(begun, F.col("source").eqNullSafe(F.col("of")))
        .filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
        .groupBy("of").agg(F.min("slice").alias("slice"), F.min("before").alias("before"))
    )
    plan = durable(
        shares.join(cut, F.col("source").eqNullSafe(F.col("of")), "left")
        .select("source", "total", "target", "whole", "rest", F.coalesce("slice", F.lit(-1)).alias("slice"),
                F.coalesce("before", F.lit(0)).alias("before")), "mix")
    own = dict(zip(plan.columns, fresh(sized, *[f"_plan_{c}" for c in plan.columns]), strict=True))
    plan = plan.select(*[F.col(c).alias(a) for c, a in own.items()])
    joined = sized.join(plan, F.col(source).eqNullSafe(F.col(own["source"])), "left")
    slice_ = F.shiftright(F.col(order), 32 - SLICE_BITS)
    size, at_cut = F.col(n), slice_ == F.col(own["slice"])
    inside = Window.partitionBy(own["source"]).orderBy(order, key, n).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col(own["before"]) + F.coalesce(F.sum(size).over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(size, F.col(own["rest"]) - earlier))
    rest = F.when((F.col(own["slice"]) >= 0) & (slice_ < F.col(own["slice"])), size).otherwise(0)
    repeats = F.col(own["whole"]) * size
    both = joined.filter(~at_cut).withColumn(taken, repeats + rest).unionByName(
        joined.filter(at_cut).withColumn(taken, repeats + part))
    made = dict(zip(names, (n, own["total"], own["target"], taken), strict=True))
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    return both.select(*[F.col(f"`{c}`") for c in kept], *[F.col(c).alias(a) for a, c in made.items()])


def mixture(docs: DataFrame, durable: Callable[..., DataFrame], key: str = "doc_id", text: str = "text",
            source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole every time, with its own columns.

    Of the one document of a source that :func:`mix` takes in part, that part is taken as a whole document or not at
    all, whichever leaves the source nearer its target. Documents without words are not taken. See :func:`mix` for
    nulls, ties and repeated rows.
    """
    names = tuple(fresh(docs, "_size", "_source_size", "_target", "_taken"))
    size, taken = F.col(names[0]), F.col(names[3])
    mixed = mix(docs, durable, key, text, source, names=names, **options).filter(taken > 0)
    times = F.floor((2 * taken + size) / (2 * size)).cast("int")
    again, = fresh(mixed, "_again")
    rows = mixed.withColumn(again, F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
