"""Strategy ``trie``: inputs grouped by level, joined on unique keys, expanded as late as possible.

The trie of an input is one row per key of its first level; the deeper levels are arrays, nested once for
each further level, and a leaf is an array of payload rows.  A join with a trie therefore never multiplies
rows.  A node opens one level of the inputs that it concerns: the cover is exploded, and the others are
narrowed to the entry with the same key; of several covers the keys that all have are exploded.  Leaves are exploded last, so repeated combinations come out as
often as in a chain of joins.

A group is one row, so a group of more than ``LARGEST_GROUP`` rows is split into several rows of that size
at most in the mean; a join adds up over them, so nothing else changes.

What a row carries of a trie is its own copy, so a trie with many entries for each key of its first level (``native.WIDE``, by the
estimates) isn't carried when another input can be iterated over its next level: both levels are then one, joined when all of
it is bound.  Planning starts no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftjoin.operators import native
from weftjoin.operators.inputs import Input, merged, var
from weftjoin.plans.fjplan import FJPlan

LARGEST_GROUP = 100_000


def build(df: DataFrame, levels: list[list[str]], payload: list[str], largest: int | None = None) -> DataFrame:
    """Key columns of the first level and ``rest``: an array of structs per level, then of payload structs.

    Rows are dealt out by the first level once; all levels are then grouped where they are, as lists don't shrink before a shuffle.
    With ``largest``, first-level keys of more rows have several rows, counted in the same place.
    """
    df, part = df.repartition(*levels[0]), []
    if largest is not None:
        rows = F.count(F.lit(1)).over(Window.partitionBy(*levels[0]))
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in dict.fromkeys([*(c for level in levels for c in level), *payload])], F.monotonically_increasing_id())
        df, part = df.withColumn("_rows", rows).withColumn("_part", F.pmod(spread, F.ceil(F.col("_rows") / largest))).drop("_rows"), ["_part"]
    leaf = F.struct(*map(F.col, payload)) if payload else F.struct(F.lit(1).alias("one"))
    for depth in range(len(levels) - 1, -1, -1):
        keys = [*part, *(c for level in levels[: depth + 1] for c in level)]
        source = F.collect_list(leaf).alias("rest")
        df = df.groupBy(*keys).agg(source)
        leaf = F.struct(*map(F.col, levels[depth]), F.col("rest"))
    return df.drop(*part)


def _key(names: list[str], column) -> Column:
    return column(names[0]) if len(names) == 1 else F.struct(*[column(n).alias(n) for n in names])


def _as_map(entries: Column, levels: list[list[str]]) -> Column:
    """Nested entries as a map by key, so that an entry is found without a look at the others' contents; null keys join with nothing."""
    names = levels[0]

    def known(x: Column) -> Column:
        test = x[names[0]].isNotNull()
        for n in names[1:]:
            test = test & x[n].isNotNull()
        return test

    inner = lambda x: _as_map(x["rest"], levels[1:]) if levels[1:] else x["rest"]
    return F.map_from_entries(F.transform(F.filter(entries, known), lambda x: F.struct(_key(names, lambda n: x[n]).alias("key"), inner(x).alias("rest"))))


def _opened(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """``df`` with the columns of a key that is in ``_k``."""
    kept = [c for c in df.columns if c not in ("_k", "_v")]
    return df.select(*kept, *([F.col("_k").alias(names[0])] if len(names) == 1 else [F.col(f"_k.{n}").alias(n) for n in names]), *more)


def merged_levels(plan: FJPlan, inputs: list[Input]) -> dict[int, int]:
    """For each input but the first: how many of its levels are joined at once."""
    at: dict[int, list[int]] = {}
    for k, node in enumerate(plan.nodes):
        for a in node:
            at.setdefault(a.source, []).append(k)
    levels, widths, out = plan.trie_levels(), native.Widths(inputs), {i: 1 for i in at if i}
    for i in sorted(out, key=lambda i: -len(at[i])):
        for m, k in enumerate(at[i][1:], 1):
            other = any(a.cover and a.source not in (0, i) and at[a.source].index(k) >= out[a.source] for a in plan.nodes[k])
            if not other or widths.of(i, {v for level in levels[i][:m] for v in level}) < native.WIDE:
                break
            out[i] = m + 1
    return out


def run(plan: FJPlan, inputs: list[Input], largest: int | None = None) -> Input:
    levels = plan.trie_levels()
    usable = [i for i in range(1, len(inputs)) if i in levels and all(levels[i])]
    complete = all({v for level in levels.get(i, []) for v in level} == set(inputs[i].variables) for i in usable)
    kinds = [{dict(i.df.dtypes)[var(v)] for i in inputs if v in i.variables} for v in merged(inputs)[0]]
    if len(usable) < len(inputs) - 1 or not complete or any(len(k) > 1 for k in kinds):  # keys of different types are compared by Catalyst's rules
        return native.run(plan, inputs)
    largest = LARGEST_GROUP if largest is None else largest
    at_once = merged_levels(plan, inputs)
    waits = {i: at_once[i] - 1 for i in usable}  # levels that are passed before its trie is joined
    levels |= {i: [tuple(v for level in levels[i][: at_once[i]] for v in level), *levels[i][at_once[i] :]] for i in usable}
    names_of = {i: [[var(v) for v in sorted(level)] for level in levels[i]] for i in usable}
    tries = {i: build(inputs[i].df, [[var(v) for v in level] for level in levels[i]], [a.column for a in inputs[i].payload], largest) for i in usable}
    tries = {i: t.withColumn("rest", _as_map(F.col("rest"), names_of[i][1:])) if names_of[i][1:] else t for i, t in tries.items()}
    df, depth = inputs[0].df, dict.fromkeys(usable, 0)
    for node in plan.nodes:
        if 0 not in (a.source for a in node):
            begun = [a for a in node if depth[a.source]]
            covers = [a for a in begun if a.cover] or begun[:1]
            if not covers:
                return native.run(plan, inputs)
            cover, names = covers[0], [var(v) for v in sorted(covers[0].variables)]
            if len(covers) > 1:  # only keys that all of them have go on, and which one is iterated is chosen row by row
                keys = F.map_keys(f"rest{covers[0].source}")
                for c in covers[1:]:
                    keys = smaller_first(keys, F.map_keys(f"rest{c.source}"))
                df, cover = _opened(df.withColumn("_k", F.explode(keys)), names), None
            else:
                rest = f"rest{cover.source}"
                df = df.select("*", F.explode(rest).alias("_k", "_v")).drop(rest)
                df = _opened(df, names, F.col("_v").alias(rest))
                depth[cover.source] += 1
        else:
            cover = node[0]
        for a in node:
            if a is cover or a.source == 0:
                continue
            if waits[a.source]:
                waits[a.source] -= 1
                continue
            names = [var(v) for v in sorted(a.variables)]
            rest = f"rest{a.source}"
            if depth[a.source]:
                df = df.withColumn(rest, F.try_element_at(F.col(rest), _key(names, F.col))).filter(F.col(rest).isNotNull())
            else:
                first = levels[a.source][0]
                df = native.join_pair(df, {*first}, Input(tries[a.source].withColumnRenamed("rest", rest), first, ()))
            depth[a.source] += 1
    for i in usable:
        rest, payload = f"rest{i}", [a.column for a in inputs[i].payload]
        df = df.withColumn("_e", F.explode(rest))
        df = df.select(*[c for c in df.columns if c not in (rest, "_e")], *[F.col(f"_e.{c}").alias(c) for c in payload])
    variables, payload = merged(inputs)
    return Input(df, variables, payload)


def smaller_first(a: Column, b: Column) -> Column:
    """Distinct common elements of two arrays, row by row iterating the smaller against a hash of the larger: the cover choice at run time."""
    return F.when(F.size(a) <= F.size(b), F.array_intersect(a, b)).otherwise(F.array_intersect(b, a))
