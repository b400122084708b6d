"""Logs, the command line, profiles as queries."""

import json

import duckdb
import pytest

from weftjoin.__main__ import main
from weftjoin.api import Query
from weftjoin.functions import analysis
from weftjoin.plans import plan_json, profile_sql

TABLES = {
    "film": ("id bigint, title string, year int", [(i, f"f{i % 7}" if i % 5 else "it's", 1990 + i % 30) for i in range(1, 41)]),
    "link": ("film_id bigint, other_id bigint, kind_id int", [(i % 40 + 1, (i * 7) % 40 + 1, i % 3) for i in range(90)]),
    "kind": ("id int, kind string", [(0, "follows"), (1, "remakes"), (2, None)]),
}
SQL = """SELECT MIN(k.kind) AS how, MIN(a.title) AS first_film, MIN(b.title) AS second_film
FROM film AS a, film AS b, kind AS k, link AS l
WHERE a.year BETWEEN 1995 AND 2012 AND b.title IN ('f1', 'f2', 'it''s') AND (k.kind LIKE '%follow%' OR k.kind = 'remakes')
  AND l.film_id = a.id AND l.other_id = b.id AND k.id = l.kind_id AND a.title != 'f3';"""


def scan(table, columns):
    return {"name": "SEQ_SCAN ", "extra_info": f"{table}\n[INFOSEPARATOR]\n" + "\n".join(columns), "children": []}


def join(conditions, left, right):
    return {"name": "HASH_JOIN", "extra_info": "INNER\n" + "\n".join(conditions), "children": [left, right]}


def profile():
    """Two aliases of one table; the tree alone doesn't say which scan is which."""
    listed = {"name": "FILTER", "extra_info": "IN (...)", "children": [{"name": "HASH_JOIN", "extra_info": "MARK\nb.title = #0\n", "children": [scan("film", ["title", "id"]), {"name": "CHUNK_SCAN", "extra_info": "", "children": []}]}]}
    inner = join(["l.other_id = b.id"], scan("link", ["film_id", "other_id", "kind_id"]), listed)
    tree = join(["l.kind_id = k.id"], join(["l.film_id = a.id"], inner, scan("film", ["id", "title", "year"])), scan("kind", ["id", "kind"]))
    return {"name": "Query", "extra_info": SQL, "children": [{"name": "SIMPLE_AGGREGATE", "extra_info": "min(#0)\nmin(#1)\nmin(#2)", "children": [{"name": "PROJECTION", "extra_info": "k.kind\na.title\nb.title", "children": [tree]}]}]}


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in TABLES.items()}


@pytest.fixture(scope="module")
def folder(tables, tmp_path_factory):
    path = tmp_path_factory.mktemp("films")
    for n, df in tables.items():
        df.write.parquet(f"{path}/{n}.parquet")
    return path


def wanted(folder, sql=SQL):
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet/*.parquet')")
    return c.execute(sql).fetchall()


@pytest.mark.parametrize("strategy", ["native", "trie", "hypercube"])
def test_profile_runs_as_a_query(tables, folder, strategy):
    q = Query.from_profile(plan_json.Profile(profile()), tables).plan(strategy=strategy)
    assert str(q.tree()) == "FJ(l b a k)" and [n for _, n in q.project] == ["how", "first_film", "second_film"]
    assert [tuple(r) for r in q.to_df().collect()] == wanted(folder) != [(None, None, None)]
    body = SQL[SQL.index("FROM") :]
    assert q.count().first()["n"] == wanted(folder, f"SELECT count(*) {body}")[0][0] > 0


def test_sql_of_a_profile():
    q = profile_sql.parse(SQL)
    assert q.tables == {"a": "film", "b": "film", "k": "kind", "l": "link"} and len(q.equalities) == 3
    assert q.filters["a"] == ["`year` BETWEEN 1995 AND 2012", "`title` != 'f3'"] and q.filters["b"] == ["`title` IN ( 'f1' , 'f2' , 'it\\'s' )"]
    for bad in ("SELECT a.x FROM t AS a", "DELETE FROM t", "SELECT MIN(a.x) FROM t AS a, u AS b WHERE a.x < b.y"):
        with pytest.raises(ValueError):
            profile_sql.parse(bad)


def test_aliases_that_fit_no_condition_raise():
    p = profile()
    p["children"][0]["children"][0]["children"][0]["children"][0]["extra_info"] = "INNER\nb.id = l.film_id"
    with pytest.raises(ValueError):
        plan_json.Profile(p).plan()


def test_command_line(spark, folder, tmp_path, capsys):
    (tmp_path / "p.json").write_text(json.dumps(profile()))
    assert main(["prepare", "--profile", str(tmp_path / "p.json"), "--out", str(tmp_path / "plan.json")]) == 0
    again = plan_json.from_normalised(tmp_path / "plan.json")
    assert str(again.child) == "(((l ⋈ b) ⋈ a) ⋈ k)" and [str(a) for a in again.attributes] == ["k.kind", "a.title", "b.title"]
    capsys.readouterr()
    main(["run", "--plan", str(tmp_path / "p.json"), "--data", str(folder)], spark)
    assert capsys.readouterr().out.splitlines()[-1] == "\t".join(wanted(folder)[0])
    main(["run", "--plan", str(tmp_path / "plan.json"), "--data", str(folder), "--count"], spark)
    assert capsys.readouterr().out.splitlines()[-1] == "90"  # a normalised plan has no filters
    main(["explain", "--plan", str(tmp_path / "plan.json"), "--data", str(folder)], spark)
    assert "FJ(l b a k)" in capsys.readouterr().out
    main(["bench-index", "--table", f"{folder}/link.parquet", "--keys", "film_id,kind_id"], spark)
    assert capsys.readouterr().out.startswith("trie building,")


def test_log_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Query: 1a\nUsing: 2 threads\ntrie building,0.25\nnoise, 1\nNum Tuples: 5\nTrie Height: 3\nQuery: 2b\nUsing: 2 threads\ntrie building,x\n")
    lines = analysis.log_lines(spark, str(tmp_path / "a.txt"))
    assert [tuple(r) for r in analysis.phase_times(lines).filter("ms IS NOT NULL").collect()] == [("1a", 2, "GHT building", 250.0)]
    assert [tuple(r) for r in analysis.trie_heights(lines).collect()] == [("1a", 2, 5, 3)]
    assert analysis.plan_statistics(lines).collect() == []
    times = analysis.phase_times(lines)
    assert analysis.compared(times, times).columns == ["query", "operation", "ms_default", "ms_smart"]
