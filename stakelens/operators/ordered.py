"""Lag, lead and running values inside key groups, also when one key holds most of the rows.

A window partitioned by key sorts each key in one task, which ends when a key outgrows a task. So groups are always cut
into slices: stretches of fixed width of the leading order column, such as a day. Rows are exchanged by (key, slice), every
step runs inside its slice, and one summary row per (key, slice), taken from the same exchange, carries the state on:
a window over the summaries of a key gives what each slice starts with, joined back on (key, slice).

The plan is the same at every size and for every key. It is lazy: nothing is counted, measured or written to build it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
DAY, YEAR = 86_400, 366 * 86_400


@dataclass(frozen=True)
class Step:
    """One ordered computation, in its plain form and as slice-local value + slice summary + carry + merge."""

    plain: Callable[[WindowSpec], Column]
    inside: Callable[[WindowSpec], Column]
    head: Callable[[Column], Column]
    carried: Callable[[WindowSpec, Column], Column]
    merge: Callable[[Column, Column], Column]


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _neighbour(col: Column, function: Callable, pick: Callable) -> Step:
    # Boxed in a struct so that "the neighbour is null" and "there is no neighbour" stay apart across slices.
    boxed = F.struct(col.alias("v"))
    return Step(
        plain=lambda w: function(col).over(w),
        inside=lambda w: function(boxed).over(w),
        head=lambda at: pick(boxed, at),
        carried=lambda w, head: function(head).over(w),
        merge=lambda own, carried: F.coalesce(own, carried)["v"],
    )


def lag(col: Column | str) -> Step:
    """Value of the previous row."""
    return _neighbour(F.col(col) if isinstance(col, str) else col, F.lag, F.max_by)


def lead(col: Column | str) -> Step:
    """Value of the next row."""
    return _neighbour(F.col(col) if isinstance(col, str) else col, F.lead, F.min_by)


def last_value(col: Column) -> Step:
    """Latest non-null value up to and including the row."""
    plain = lambda w: F.last(col, ignorenulls=True).over(_so_far(w))
    return Step(
        plain=plain,
        inside=plain,
        head=lambda at: F.max_by(col, F.when(col.isNotNull(), at)),
        carried=lambda w, head: F.last(head, ignorenulls=True).over(_before(w)),
        merge=F.coalesce,
    )


def running_sum(col: Column) -> Step:
    """Sum up to and including the row; ``col`` must not be null."""
    plain = lambda w: F.sum(col).over(_so_far(w))
    return Step(
        plain=plain,
        inside=plain,
        head=lambda at: F.sum(col),
        carried=lambda w, head: F.sum(head).over(_before(w)),
        merge=lambda own, carried: own + F.coalesce(carried, F.lit(0)),
    )


def running_max_before(col: Column) -> Step:
    """Maximum over all earlier rows."""
    plain = lambda w: F.max(col).over(_before(w))
    return Step(
        plain=plain,
        inside=plain,
        head=lambda at: F.max(col),
        carried=lambda w, head: F.max(head).over(_before(w)),
        merge=F.greatest,
    )


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: list[str]
    order: list[str]
    sliced: bool

    def add(self, **steps: Step) -> Ordered:
        """Add one column per step. Steps added together share one sort and one carry join.

        Steps that need the result of others are added after them; each addition reads the exchanged rows twice, so
        a chain should be short.
        """
        if not self.sliced:
            w = Window.partitionBy(*self.keys).orderBy(*self.order)
            return replace(self, df=self.df.withColumns({n: s.plain(w) for n, s in steps.items()}))

        place = [*self.keys, SLICE]
        inside = Window.partitionBy(*place).orderBy(*self.order)
        across = Window.partitionBy(*self.keys).orderBy(SLICE)
        at = F.struct(*self.order)
        heads = self.df.groupBy(*place).agg(*[s.head(at).alias(n) for n, s in steps.items()])
        names = {k: f"_k_{k}" for k in place}
        carry = heads.select(
            *[F.col(k).alias(v) for k, v in names.items()],
            *[s.carried(across, F.col(n)).alias(f"_c_{n}") for n, s in steps.items()],
        )
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()])
        out = (
            self.df.withColumns({n: s.inside(inside) for n, s in steps.items()})
            .join(carry, match, "left")
            .withColumns({n: s.merge(F.col(n), F.col(f"_c_{n}")) for n, s in steps.items()})
            .drop(*names.values(), *[f"_c_{n}" for n in steps])
        )
        return replace(self, df=out)

    def with_columns(self, **columns: Column) -> Ordered:
        return replace(self, df=self.df.withColumns(columns))

    def result(self) -> DataFrame:
        return self.df.drop(SLICE)


def slice_number(df: DataFrame, column: str, width: float) -> Column:
    """Which stretch of ``width`` a value falls into; never falls as the value grows, nulls first."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        units = F.unix_micros(value.cast("timestamp")) / F.lit(1e6)
    elif isinstance(kind, T.DateType):
        units = F.unix_date(value) * F.lit(float(DAY))
    elif isinstance(kind, T.NumericType):
        units = value.cast("double")
    else:
        raise TypeError(f"{column} is {kind.simpleString()}; groups are cut along times and numbers")
    return F.coalesce(F.floor(units / F.lit(float(width))).cast("long"), F.lit(-(2**63)))


def ordered(df: DataFrame, keys: list[str], order: list[str], width: float = DAY) -> Ordered:
    """Prepare ``df`` for ordered steps.

    ``width`` is that of a slice along the first order column, in seconds for times and in its own units for numbers.
    It changes the layout only: rows of one key and slice meet in one task, and there is a summary row for each key and
    slice, so it should hold many rows of an ordinary key and few enough of the largest one.
    """
    cut = df.withColumn(SLICE, slice_number(df, order[0], width))
    return Ordered(cut.repartition(*keys, SLICE), keys, order, sliced=True)
