"""Expressions shared by the text operators. Words are runs of anything but space, tab, LF, VT, FF and CR."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the frame does not have, whatever case its own are in."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """All words in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def without(text: Column, characters: str) -> Column:
    """The text less these characters. A chain of replacements costs far less than ``translate``."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
