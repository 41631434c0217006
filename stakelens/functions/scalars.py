"""Scalar expressions with the semantics the warehouse models need. All of them stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PSEUDONYM_PREFIX = "erased:"
MICROS_PER_DAY = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Signed seconds with microsecond resolution."""
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(1e6)


def whole_days_between(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed whole days (floor of the interval, not calendar-day difference), clipped at zero."""
    micros = F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))
    return F.greatest(F.floor(micros / F.lit(MICROS_PER_DAY)).cast("bigint"), F.lit(0).cast("bigint"))


def age_in_years(at: Column | str, born: Column | str) -> Column:
    """Completed years. Compares (month, day) because months_between counts 28 Feb as a full month for 29 Feb births."""
    at, born = _col(at), _col(born)
    before_birthday = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(at) - F.year(born) - before_birthday.cast("int")


def to_gbp(amount: Column | str, rate: Column | str) -> Column:
    """Exact decimal conversion. A currency without a rate counts at par."""
    return _col(amount) * F.coalesce(_col(rate), F.lit(1).cast("decimal(10,6)"))


def pseudonym(value: Column | str, salt: str) -> Column:
    """Salted one-way pseudonym. Null stays null and an already erased value is left alone."""
    value = _col(value).cast("string")
    digest = F.sha2(F.concat_ws(":", F.lit(salt), value), 256)
    erased = F.concat(F.lit(PSEUDONYM_PREFIX), F.substring(digest, 1, 32))
    return F.when(value.isNull() | value.startswith(PSEUDONYM_PREFIX), value).otherwise(erased)


def surrogate_key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("-", *[_col(p).cast("string") for p in parts]))


def day_in_utc(ts: Column | str, zone: Column | str | None = None) -> Column:
    """Calendar day in UTC of an instant, or of a wall-clock time in ``zone``."""
    ts = _col(ts)
    return F.to_date(ts if zone is None else F.to_utc_timestamp(ts, zone))
