"""Strategy ``native``: a plan's nodes as inner equality joins in plan order; Catalyst and AQE pick how to run them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftjoin.operators.inputs import Input, merged, var
from weftjoin.plans.fjplan import FJPlan
from weftjoin.sources.catalog import estimated_bytes, estimated_rows

#: Rows of an input for each key, by the estimates, from which on it waits for inputs that multiply rows less.
WIDE = 16

#: Bytes of an input, by the estimates, up to which it is sent whole to every executor: the rows met so far, of which there are
#: more from join to join, then stay where they are.
SMALL_BYTES = 2 << 20


class Widths:
    """How many rows of an input share a key, at least in the mean and as far as Catalyst's estimates tell; no job is started.

    A variable has no more values that join than the smallest input that it is in has rows.
    """

    def __init__(self, inputs: list[Input]):
        self.inputs, self.rows, self.values = inputs, [estimated_rows(i.df) for i in inputs], {}
        for i, n in zip(inputs, self.rows, strict=True):
            for v in i.variables if n is not None else ():
                self.values[v] = min(n, self.values.get(v, n))

    def of(self, i: int, bound: set[int]) -> float:
        """1 if all variables of the input are bound, or if its size isn't known."""
        shared, n = bound & set(self.inputs[i].variables), self.rows[i]
        if n is None or shared == set(self.inputs[i].variables):
            return 1.0
        return max(1.0, n / math.prod(self.values[v] for v in shared))


def probe_order(plan: FJPlan, inputs: list[Input]) -> list[int]:
    """Inputs in the order in which they meet the bound variables.

    Within a node, atoms of inputs all of whose variables are bound come first: they only filter or repeat
    rows, while the others bring in further variables and are left for later.  An input that has ``WIDE`` rows or more for what is bound
    waits as long as any other, of later nodes too, multiplies the rows less.
    """
    order, bound, widths = [0], set(inputs[0].variables), Widths(inputs)
    for node in plan.nodes:
        while waiting := [s for s in dict.fromkeys(a.source for a in node) if s not in order]:
            i = min(waiting, key=lambda s: (not set(inputs[s].variables) <= bound, widths.of(s, bound) >= WIDE, waiting.index(s)))
            if widths.of(i, bound) >= WIDE:
                near = [s for s in range(len(inputs)) if s not in order and bound & set(inputs[s].variables)]
                i = min(near, key=lambda s: (widths.of(s, bound), s), default=i)
            order.append(i)
            bound |= set(inputs[i].variables)
    return order + [i for i in range(len(inputs)) if i not in order]


def join_pair(left: DataFrame, bound: set[int], right: Input) -> DataFrame:
    shared = [v for v in right.variables if v in bound]
    if not shared:
        return left.crossJoin(right.df)  # no variable in common: the query asks for the product
    renamed = right.df.select(*[F.col(f"`{c}`").alias(f"r_{c}" if c in map(var, shared) else c) for c in right.df.columns])
    if estimated_bytes(right.df) <= SMALL_BYTES and not left.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        renamed = F.broadcast(renamed)  # an estimate near Spark's own threshold would have the plan change as the tables grow
    on = [F.col(var(v)) == F.col(f"r_{var(v)}") for v in shared]
    return left.join(renamed, on, "inner").drop(*[f"r_{var(v)}" for v in shared])


def run(plan: FJPlan, inputs: list[Input], reduce: bool = False) -> Input:
    """With ``reduce``, a node's probes filter the rows before any of its joins can multiply them."""
    order = probe_order(plan, inputs)
    df, bound, later = inputs[0].df, set(inputs[0].variables), []
    ahead: dict[int, list[int]] = {}  # by the first input that a node brings in, all that it brings in
    seen = {order[0]}
    for node in plan.nodes:
        if new := [s for s in dict.fromkeys(a.source for a in node) if s not in seen]:
            ahead[min(new, key=order.index)] = new
            seen |= set(new)
    for i in order[1:]:
        if reduce and len(probes := [p for p in ahead.get(i, []) if bound & set(inputs[p].variables)]) > 1:
            df = semi_reduce(df, bound, [inputs[p] for p in probes])
        if bound & set(inputs[i].variables):
            df = join_pair(df, bound, inputs[i])
            bound |= set(inputs[i].variables)
        else:
            later.append(i)
    while later:  # parts of the query that nothing connects; joined among themselves as they come
        i = next((j for j in later if bound & set(inputs[j].variables)), later[0])
        later.remove(i)
        df = join_pair(df, bound, inputs[i])
        bound |= set(inputs[i].variables)
    variables, payload = merged(inputs)
    return Input(df, variables, payload)


def reduced(plan: FJPlan, inputs: list[Input]) -> Input:
    """Strategy ``reduced``: ``native`` with the probes of each node ahead of its joins, for joins that multiply rows most of which a later input drops."""
    return run(plan, inputs, reduce=True)


def semi_reduce(df: DataFrame, bound: set[int], others: list[Input]) -> DataFrame:
    """``df`` without rows that some other input has no match for: a reducer ahead of joins that multiply rows."""
    for o in others:
        shared = [v for v in o.variables if v in bound]
        if shared:
            df = df.join(o.df.select(*map(var, shared)).distinct(), [var(v) for v in shared], "left_semi")
    return df
