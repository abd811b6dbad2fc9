"""Column expressions shared by the operators. All run on the JVM within code generation."""

from __future__ import annotations

import functools
import operator
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_A_DAY = 1440


def all_true(c: Column, nulls_fail: bool = True) -> Column:
    """Aggregate: every value true. Nulls count as false or are passed over; an empty group is true."""
    return F.coalesce(F.bool_and(F.coalesce(c, F.lit(False)) if nulls_fail else c), F.lit(True))


def any_true(c: Column) -> Column:
    """Aggregate: some value true; nulls are passed over and an empty group is false."""
    return F.coalesce(F.bool_or(c), F.lit(False))


def any_null(columns: list[str]) -> Column:
    return functools.reduce(operator.or_, [F.col(c).isNull() for c in columns])


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def half_open(c: Column, start, end) -> Column:
    """start <= c < end; a bound of None is open."""
    parts = [p for p in ((c >= F.lit(start)) if start is not None else None, (c < F.lit(end)) if end is not None else None) if p is not None]
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def not_negative(c: Column) -> Column:
    """Negative values become 0; nulls stay null."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_slot(ts: Column, minutes: int = 5) -> Column:
    """Number of the interval of the day."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")


def week_slot(ts: Column, minutes: int = 5) -> Column:
    """Number of the interval of the week, Monday first."""
    return F.weekday(ts) * (MINUTES_A_DAY // minutes) + day_slot(ts, minutes)


def hash_seed(*parts: Column | str) -> Column:
    """A seed of 32 bits: the first 8 hex digits of the SHA-256 of the parts joined by '|'."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def uniform(*keys: Column | str) -> Column:
    """A repeatable number in (0, 1) from keys, whatever the partitioning."""
    return (F.pmod(F.xxhash64(*keys), F.lit(2**53)) + 0.5) / F.lit(float(2**53))


def normal(*keys: Column | str) -> Column:
    """A repeatable standard normal number from keys (Box and Muller)."""
    keys = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.sqrt(-2 * F.log(uniform(F.lit(1), *keys))) * F.cos(F.lit(2) * F.pi() * uniform(F.lit(2), *keys))


def to_datetime(d: date | datetime | str) -> datetime:
    if isinstance(d, datetime):
        return d
    if isinstance(d, str):
        return datetime.fromisoformat(d)
    return datetime(d.year, d.month, d.day)
