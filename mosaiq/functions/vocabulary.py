"""Expressions to use as operands or on results: comparison, text, arithmetic, casts, arrays and aggregates by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ascii_fold

CASTS = {"text": "string", "integer": "bigint", "boolean": "boolean", "numeric": "double", "decimal": "decimal(38,18)"}


def between(c: Column, low, high) -> Column:
    return c.between(low, high)


def not_between(c: Column, low, high) -> Column:
    return ~c.between(low, high)


def like(c: Column, pattern: str) -> Column:
    return c.like(pattern)


def not_like(c: Column, pattern: str) -> Column:
    return ~c.like(pattern)


def ilike(c: Column, pattern: str) -> Column:
    """LIKE that folds A to Z only."""
    return ascii_fold(c).like(pattern.translate({k: k + 32 for k in range(65, 91)}))


def not_ilike(c: Column, pattern: str) -> Column:
    return ~ilike(c, pattern)


def cast(c: Column, kind: str) -> Column:
    return c.cast(CASTS[kind])


def blob_to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def integer_divide(a: Column, b: Column) -> Column:
    """Toward zero, as set divide does."""
    return F.call_function("div", a, b).cast("bigint")


def array_length(c: Column) -> Column:
    return F.size(c)


def array_get(c: Column, place: int) -> Column:
    """The element at a place from 0; NULL where there is none."""
    return F.get(c, F.lit(place))


def array_push(c: Column, *values) -> Column:
    return F.concat(c, F.array(*map(F.lit, values)))


def array_unshift(c: Column, *values) -> Column:
    return F.concat(F.array(*map(F.lit, values)), c)


def array_set(c: Column, place: int, value) -> Column:
    return F.transform(c, lambda x, i: F.when(i == place, F.lit(value)).otherwise(x))


concat, upper, lower, coalesce, greatest, least = F.concat, F.upper, F.lower, F.coalesce, F.greatest, F.least
count, count_distinct, total, average, smallest, largest = F.count, F.count_distinct, F.sum, F.avg, F.min, F.max
