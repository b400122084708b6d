"""Strategy ``auto``: ``native``, unless the cover bound says that its intermediate results may outgrow those of the whole query by far."""

from __future__ import annotations

from weftjoin.operators import hypercube, native
from weftjoin.operators.inputs import Input
from weftjoin.plans import agm
from weftjoin.plans.fjplan import FJPlan
from weftjoin.sources.catalog import estimated_bytes

#: How much larger an intermediate result's bound must be than the whole query's, in rows of at least this many, and bytes reckoned for a row.
FACTOR, LEAST_ROWS, ROW_BYTES = 100, 1e10, 32
#: Catalyst's estimate where it knows nothing is about 2^63; such inputs are left to ``native``.
UNKNOWN = 1 << 60


def choice(plan: FJPlan, inputs: list[Input]) -> str:
    """``hypercube`` for cyclic queries of connected inputs that the bounds speak for, else ``native``; no job is started."""
    edges = [frozenset(i.variables) for i in inputs]
    if len(inputs) < 3 or not all(edges) or agm.is_acyclic(edges):
        return "native"
    sizes = [estimated_bytes(i.df) for i in inputs]
    if max(sizes) >= UNKNOWN:
        return "native"
    rows = [max(1, n // ROW_BYTES) for n in sizes]
    order = native.probe_order(plan, inputs)
    whole = agm.bound(edges, rows)
    worst = max(agm.bound([edges[i] for i in order[:k]], [rows[i] for i in order[:k]]) for k in range(2, len(order)))
    return "hypercube" if worst >= LEAST_ROWS and worst >= FACTOR * whole else "native"


def run(plan: FJPlan, inputs: list[Input]) -> Input:
    return (hypercube if choice(plan, inputs) == "hypercube" else native).run(plan, inputs)
