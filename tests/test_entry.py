import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftjoin import catalogue_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    return ("f", round(x, 6)) if isinstance(x, float) and not math.isnan(x) else ("v", str(x))


@pytest.mark.parametrize("name", sorted(catalogue_queries.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = catalogue_queries.queries()[name](spark, DATA)
    want = duck.execute(catalogue_queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(map(cell, r)) for r in got.select(*names).collect()]
    assert sorted(rows) == sorted(tuple(map(cell, r)) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalogue_queries.queries()) - set(catalogue_queries.oracle_sql())))
def test_rows_only_queries(spark, name):
    assert catalogue_queries.queries()[name](spark, DATA).count() > 0


def test_slots_hold_all_rows(spark):
    rows = catalogue_queries.queries()["trie_partition_counts"](spark, DATA).collect()
    assert sum(r["n_rows"] for r in rows) == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
