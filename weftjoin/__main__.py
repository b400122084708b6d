"""``python -m weftjoin``: run a plan or a profile over a folder of tables, show its plan, turn a profile into a plan, time tries."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftjoin.api import STRATEGIES, Query
from weftjoin.operators import trie
from weftjoin.plans import fjplan, leftmost, plan_json
from weftjoin.sources.catalog import Catalog


def _tables(spark: SparkSession, folder: str, names: set[str]) -> dict[str, DataFrame]:
    catalog = Catalog.from_dir(spark, folder)
    return {n: catalog[n] for n in names}


def load_query(spark: SparkSession, path: str, folder: str) -> Query:
    """A query from a normalised plan or from a captured profile, told apart by the root's name."""
    root = plan_json.load(path)
    if root["name"].strip().lower() == "projection":
        plan = plan_json.from_normalised(root)
        scans = {s.binding: s.table or s.binding for s in plan_json.scans(plan.child)}
        tables = _tables(spark, folder, set(scans.values()))
        return Query.from_plan(plan, {b: tables[t] for b, t in scans.items()})
    profile = plan_json.Profile(root)
    return Query.from_profile(profile, _tables(spark, folder, set(profile.query.tables.values())))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftjoin", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a plan or profile and print its rows and times by phase")
    explain = commands.add_parser("explain", help="print the join tree and the plan of every join")
    for c in (run, explain):
        c.add_argument("--plan", required=True)
        c.add_argument("--data", required=True)
        c.add_argument("--kind", choices=list(fjplan.KINDS), default="fully_active")
        c.add_argument("--leftmost", choices=leftmost.RULES, default="smart")
        c.add_argument("--strategy", choices=list(STRATEGIES), default="native")
    run.add_argument("--threads", type=int, default=0, help="local threads; 0: all")
    run.add_argument("--count", action="store_true", help="only the number of rows of the join")
    prepare = commands.add_parser("prepare", help="write the normalised plan of a captured profile")
    prepare.add_argument("--profile", required=True)
    prepare.add_argument("--out", required=True)
    index = commands.add_parser("bench-index", help="time the building of tries over a key")
    index.add_argument("--table", required=True)
    index.add_argument("--keys", required=True, help="levels, by commas")
    index.add_argument("--threads", type=int, default=0)
    a = parser.parse_args(argv)
    if a.command == "prepare":
        with open(a.out, "w") as f:
            json.dump(plan_json.to_normalised(plan_json.Profile(a.profile).plan()), f, indent=2)
        return 0
    spark = spark or SparkSession.builder.master(f"local[{getattr(a, 'threads', 0) or '*'}]").getOrCreate()
    began = time.perf_counter()
    if a.command == "bench-index":
        df, keys = Catalog(spark).read(a.table), a.keys.split(",")
        n = trie.build(df, [[k] for k in keys], [c for c in df.columns if c not in keys][:1]).agg(F.sum(F.size("rest"))).first()[0]
        print(f"trie building,{time.perf_counter() - began:.6f}\nentries: {n or 0}")
        return 0
    query = load_query(spark, a.plan, a.data).plan(a.kind, a.leftmost, a.strategy)
    if a.command == "explain":
        print(query)
        for join, plan in query.fj_plans():
            print(f"{join}: {plan}")
        return 0
    df = query.count() if a.count else query.to_df()
    planned = time.perf_counter()
    rows = df.collect() if a.count or query.minimum else [(df.count(),)]
    print(f"Query: {a.plan}\nplanning,{planned - began:.6f}\nrunning,{time.perf_counter() - planned:.6f}")
    for r in rows:
        print("\t".join(map(str, r)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
