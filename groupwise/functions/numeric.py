"""Numeric helpers shared by all modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double; NULL where the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flag(cond: Column) -> Column:
    return cond.cast("int")


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def null_if_nan(c: Column | str) -> Column:
    """NaN counts as missing; aggregates skip NULL but propagate NaN."""
    return F.when(~F.isnan(col(c)), col(c))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def round_to(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)
