"""Predicates of the workload as functions of a column; they compose with ``&``, ``|`` and ``~`` and stay with Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def eq(value) -> Predicate:
    return lambda c: c == value


def ne(value) -> Predicate:
    return lambda c: c != value


def lt(value) -> Predicate:
    return lambda c: c < value


def le(value) -> Predicate:
    return lambda c: c <= value


def gt(value) -> Predicate:
    return lambda c: c > value


def ge(value) -> Predicate:
    return lambda c: c >= value


def between(low, high) -> Predicate:
    return lambda c: (c >= low) & (c <= high)


def contains(part: str) -> Predicate:
    return lambda c: c.contains(part)


def prefix(part: str) -> Predicate:
    return lambda c: c.startswith(part)


def like(pattern: str) -> Predicate:
    return lambda c: c.like(pattern)


def not_like(pattern: str) -> Predicate:
    return lambda c: ~c.like(pattern)


def is_null() -> Predicate:
    return lambda c: c.isNull()


def is_not_null() -> Predicate:
    return lambda c: c.isNotNull()


def is_in(values: Sequence) -> Predicate:
    return lambda c: c.isin(*values)


def mark_join(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose column is in a constant list, as a semi-join with the list as a relation; a list from a query's text is small."""
    kind = df.schema[column].dataType
    listed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"`{column}` {kind.simpleString()}")
    return df.join(F.broadcast(listed), column, "left_semi")
