"""Strategy ``hypercube``: one shuffle that sends every combination to one cell, then local joins in the cells.

Each variable gets a share, and a row goes to the cells that agree with the hashes of its variables, once
for every value of the shares that it doesn't have.  A result's rows meet in exactly one cell.  It pays
off for cyclic queries whose intermediate results outgrow their output; strategy ``auto`` asks the cover bound for that.
Shares are chosen by the sizes of the inputs, and there are as many cells as keep one near ``CELL_BYTES``; an input
without a shared variable's share is repeated, so a small one costs little and a large one gets the shares.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftjoin.operators import native
from weftjoin.operators.inputs import Input, merged, var
from weftjoin.plans import agm
from weftjoin.plans.fjplan import FJPlan
from weftjoin.sources.catalog import estimated_bytes

#: Bytes of input that a cell should have, by Catalyst's estimates, and the fewest and most cells.  An estimate is a share of the
#: file's compressed bytes; the rows, which a worker holds at once, take about ten times as many.
CELL_BYTES, FEWEST, MOST = 8 << 20, 8, 1 << 20


def cells_for(sizes: list[int]) -> int:
    """A power of two of cells; each input is repeated, so twice its bytes are reckoned."""
    return min(MOST, max(FEWEST, 1 << math.ceil(math.log2(max(1, 2 * sum(sizes) / CELL_BYTES)))))


def shares(variables: list[int], inputs: list[Input], sizes: list[int], cells: int) -> dict[int, int]:
    """Powers of two over the variables that at least two inputs have, ``cells`` in all: each doubling goes where the rows sent out grow least."""
    joint = [v for v in variables if sum(v in i.variables for i in inputs) > 1]
    share = dict.fromkeys(joint, 1)

    def sent(share: dict[int, int]) -> float:
        return sum(n * math.prod(s for v, s in share.items() if v not in i.variables) for n, i in zip(sizes, inputs, strict=True))

    for _ in range(int(math.log2(cells)) if joint else 0):
        best = min(joint, key=lambda v: (sent(share | {v: 2 * share[v]}), share[v], v))
        share[best] *= 2
    return share


def _celled(i: Input, share: dict[int, int]) -> Input:
    cell = F.lit(0)
    df, free = i.df, []
    for v, n in share.items():
        if v in i.variables:
            df = df.filter(F.col(var(v)).isNotNull())
            part = F.pmod(F.xxhash64(F.col(var(v)).cast("string")), F.lit(n)).cast("int")
        else:
            free.append((v, n))
            part = F.col(f"_s{v}")
        cell = cell * n + part
    for v, n in free:
        df = df.withColumn(f"_s{v}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return Input(df.withColumn("_cell", cell).drop(*[f"_s{v}" for v, _ in free]), i.variables, i.payload)


def _slots(inputs: list[Input]) -> list[dict[str, str]]:
    """For each input the columns of the shuffled rows that its own go in: one for the first of a type, another for the second."""
    out = []
    for i in inputs:
        used, names = Counter(), {}
        for f in i.df.schema.fields:
            kind = f.dataType.json()
            names[f.name] = f"{kind}#{used[kind]}"
            used[kind] += 1
        out.append(names)
    number = {slot: f"c{k}" for k, slot in enumerate(dict.fromkeys(slot for names in out for slot in names.values()))}
    return [{c: number[slot] for c, slot in names.items()} for names in out]


def _connected(inputs: list[Input], order: list[int]) -> bool:
    bound = set(inputs[order[0]].variables)
    for i in order[1:]:
        if not bound & set(inputs[i].variables):
            return False
        bound |= set(inputs[i].variables)
    return True


def run(plan: FJPlan, inputs: list[Input], cells: int | None = None) -> Input:
    edges = [frozenset(i.variables) for i in inputs]
    if len(inputs) < 3 or not all(edges) or agm.is_acyclic(edges) or not _connected(inputs, native.probe_order(plan, inputs)):
        return native.run(plan, inputs)
    variables, payload = merged(inputs)
    if any(len({dict(i.df.dtypes)[var(v)] for i in inputs if v in i.variables}) > 1 for v in variables):
        return native.run(plan, inputs)  # keys of different types are compared by Catalyst's rules
    sizes = [max(1, estimated_bytes(i.df)) for i in inputs]
    share = shares(list(variables), inputs, sizes, cells or cells_for(sizes))
    order = native.probe_order(plan, inputs)
    parts = [_celled(i, share) for i in inputs]
    slots, tagged = _slots(inputs), None
    for k, p in enumerate(parts):
        own = p.df.select("_cell", F.lit(k).alias("_k"), *[F.col(f"`{c}`").alias(x) for c, x in slots[k].items()])
        tagged = own if tagged is None else tagged.unionByName(own, allowMissingColumns=True)
    fields = {f.name: f for i in inputs for f in i.df.schema.fields}
    names = [*map(var, variables), *(a.column for a in payload)]
    schema = StructType([StructField(n, fields[n].dataType) for n in names])
    has = [list(map(var, i.variables)) for i in inputs]

    def local(cell: pa.Table) -> pa.Table:
        rows = [cell.select(list(x.values())).filter(pc.equal(cell["_k"], k)).rename_columns(list(x)) for k, x in enumerate(slots)]
        out, bound = rows[order[0]], set(has[order[0]])
        for k in order[1:]:
            out = out.join(rows[k], keys=[v for v in has[k] if v in bound], join_type="inner", use_threads=False)
            bound |= set(has[k])
            rows[k] = None
        pa.default_memory_pool().release_unused()
        return out.select(names)

    return Input(tagged.groupBy("_cell").applyInArrow(local, schema), variables, payload)
