"""COUNT and MIN over a join without making its rows: every input is reduced to one row per key before it meets another.

A row stands for ``_n`` equal combinations and the least value of each wanted column among them.  After every join, variables
that no further input has are dropped, and the rows that then agree are added up.  So what is carried is bounded by the keys
that are still to be joined, not by the combinations behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftjoin.operators import native
from weftjoin.operators.inputs import Input, var

COUNT = "_n"


def _reduced(df: DataFrame, keys: list[str], least: list[str], counted: bool, fresh: bool) -> DataFrame:
    """One row per key; ``fresh`` rows stand for themselves and have no count yet."""
    aggregates = [F.min(f"`{c}`").alias(c) for c in least]
    if counted:
        aggregates.append((F.count(F.lit(1)) if fresh else F.sum(COUNT)).alias(COUNT))
    if not aggregates:
        return df.select(*keys).distinct() if keys else df.limit(1)
    return df.groupBy(*keys).agg(*aggregates)


def aggregate(inputs: list[Input], order: list[int], counted: bool) -> DataFrame:
    """One row: the least value of each payload column, and the number of rows in ``_n`` if ``counted``.

    The inputs are joined in ``order``.  Nothing in common is a product, whose count is that of both sides multiplied.
    """
    waiting, df, bound, least = list(order), None, set(), []
    while waiting:
        i = next((j for j in waiting if df is not None and bound & set(inputs[j].variables)), waiting[0])
        waiting.remove(i)
        own, later = inputs[i], {v for j in waiting for v in inputs[j].variables}
        needed = [v for v in own.variables if v in bound | later]
        part = _reduced(own.df, [var(v) for v in needed], [a.column for a in own.payload], counted, fresh=True)
        least += [a.column for a in own.payload]
        if df is None:
            df, bound = part, set(needed)
            continue
        if counted:
            part = part.withColumnRenamed(COUNT, "_m")
        df = native.join_pair(df, bound, Input(part, tuple(needed), own.payload))
        if counted:
            df = df.withColumn(COUNT, F.col(COUNT) * F.col("_m")).drop("_m")
        bound |= set(needed)
        if not bound <= later and waiting:
            bound &= later
            df = _reduced(df, [var(v) for v in sorted(bound)], least, counted, fresh=False)
    total = [F.min(f"`{c}`").alias(c) for c in least]
    if counted:
        total.append(F.coalesce(F.sum(COUNT), F.lit(0)).cast("long").alias(COUNT))
    return df.agg(*total)
