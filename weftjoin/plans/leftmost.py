"""Which input of an n-ary join is streamed: the order given, the largest, the median, or the smart rule."""

from __future__ import annotations

from collections import Counter

from weftjoin.plans.ir import NaryJoin
from weftjoin.plans.variables import Variables

RULES = ("default", "largest", "median", "smart")


def choose(join: NaryJoin, variables: Variables, sizes: list[int], rule: str = "smart") -> int:
    """Index of the input to lead.  Ties: the lowest variable, then the larger input, then the earlier one."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    if rule == "default":
        return 0
    if rule == "largest":
        return order[0]
    if rule == "median":
        return sorted(range(len(sizes)), key=lambda i: (sizes[i], i))[len(sizes) // 2]
    if rule != "smart":
        raise ValueError(f"no such rule: {rule}; known are {', '.join(RULES)}")
    named = Counter(variables.of[a] for pair in join.equalities for a in pair if a in variables.of)
    if not named:
        return 0
    top = min(named, key=lambda v: (-named[v], v))
    return next(i for i in order if top in variables.among(join.inputs[i].bindings))
