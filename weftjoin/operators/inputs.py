"""What every execution strategy starts from: pruned, renamed inputs of an n-ary join, nested joins included."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftjoin.plans import fjplan, leftmost
from weftjoin.plans.ir import Attr, NaryJoin, Node, Scan
from weftjoin.plans.variables import Variables
from weftjoin.sources.catalog import estimated_bytes


@dataclass(frozen=True)
class Options:
    kind: str = "fully_active"
    leftmost: str = "smart"
    strategy: str = "native"


@dataclass
class Input:
    """Columns ``v<number>`` for the variables it has, and ``binding__name`` for the columns that are wanted above."""

    df: DataFrame
    variables: tuple[int, ...]
    payload: tuple[Attr, ...]


def var(number: int) -> str:
    return f"v{number}"


def scan(df: DataFrame, binding: str, variables: Variables, wanted: set[Attr]) -> Input:
    """Only the columns that are joined or wanted; two columns of one variable are held equal here; null keys never join."""
    joined = variables.attributes([binding])
    payload = tuple(sorted(a for a in wanted if a.binding == binding))
    by_number: dict[int, list[Attr]] = {}
    for a in joined:
        by_number.setdefault(variables.of[a], []).append(a)
    for first, *others in by_number.values():
        for o in others:
            df = df.filter(F.col(f"`{first.name}`") == F.col(f"`{o.name}`"))
    columns = [F.col(f"`{x[0].name}`").alias(var(n)) for n, x in by_number.items()]
    columns += [F.col(f"`{a.name}`").alias(a.column) for a in payload]
    return Input(df.select(*(columns or [F.lit(1).alias(f"{binding}__")])), tuple(by_number), payload)


def prepare(node: Node, tables: Mapping[str, DataFrame], variables: Variables, wanted: set[Attr], options: Options, run) -> Input:
    """The input for a node: a scan, or the result of a nested join, which its parent sees as one relation."""
    if isinstance(node, Scan):
        return scan(tables[node.binding], node.binding, variables, wanted)
    return run_join(node, tables, variables, wanted, options, run)


def run_join(join: NaryJoin, tables: Mapping[str, DataFrame], variables: Variables, wanted: set[Attr], options: Options, run) -> Input:
    inputs = [prepare(i, tables, variables, wanted, options, run) for i in join.inputs]
    sizes = [estimated_bytes(i.df) for i in inputs] if options.leftmost != "default" else [0] * len(inputs)
    lead = leftmost.choose(join, variables, sizes, options.leftmost)
    led = join.led_by(lead)
    inputs[0], inputs[lead] = inputs[lead], inputs[0]
    plan = fjplan.KINDS[options.kind](led, variables)
    return run(plan, inputs)


def merged(inputs: list[Input]) -> tuple[tuple[int, ...], tuple[Attr, ...]]:
    return tuple(dict.fromkeys(v for i in inputs for v in i.variables)), tuple(a for i in inputs for a in i.payload)
