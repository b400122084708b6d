"""The registered queries of the join engine, with the SQL they are held against."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftjoin.api import Query
from weftjoin.functions import analysis
from weftjoin.functions import predicates as P
from weftjoin.operators import graph, inputs, native, trie
from weftjoin.operators.partitions import partition_counts, portable_hash
from weftjoin.plans import agm
from weftjoin.sources.catalog import Catalog

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def register(f: Run) -> Run:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict[str, Run]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- sources and projection


@_query("SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark, d):
    return _t(spark, d, "region")


@_query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice")


@_query("SELECT n_name, n_regionkey FROM nation")
def scan_materialized(spark, d):
    return _t(spark, d, "nation").select("n_name", "n_regionkey").persist()


@_query("SELECT 'region' AS binding, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def catalog_bindings(spark, d):
    catalog = Catalog.from_dir(spark, d)
    out = None
    for b in ("region", "nation", "orders", "lineitem"):
        one = catalog[b].agg(F.lit(b).alias("binding"), F.count(F.lit(1)).alias("n")).select("binding", "n")
        out = one if out is None else out.unionAll(one)
    catalog.clear()  # the views; a DataFrame keeps its plan
    return out


# --- predicates


def _filtered(name: str, table: str, columns: str, column: str, predicate: P.Predicate, where: str) -> None:
    @_query(f"SELECT {columns} FROM {table} WHERE {where}", name)
    def run(spark, d):
        return _t(spark, d, table).filter(predicate(F.col(column))).select(*columns.split(", "))


_LONG_BRANDS = ["Brand#11", "Brand#12", "Brand#23", "Brand#34", "Brand#45", "Brand#51", "Brand#52", "Brand#55"]
_filtered("filter_eq", "customer", "c_custkey, c_name", "c_mktsegment", P.eq("BUILDING"), "c_mktsegment = 'BUILDING'")
_filtered("filter_ne", "customer", "c_custkey, c_mktsegment", "c_mktsegment", P.ne("BUILDING"), "c_mktsegment <> 'BUILDING'")
_filtered("filter_range", "customer", "c_custkey, c_acctbal", "c_acctbal", lambda c: P.gt(1000.0)(c) & P.le(5000.0)(c), "c_acctbal > 1000 AND c_acctbal <= 5000")
_filtered("filter_string_range", "part", "p_partkey, p_type", "p_type", lambda c: P.gt("M")(c) & P.lt("S")(c), "p_type > 'M' AND p_type < 'S'")
_filtered("filter_between", "part", "p_partkey, p_size", "p_size", P.between(10, 20), "p_size BETWEEN 10 AND 20")
_filtered("filter_in", "orders", "o_orderkey, o_orderpriority", "o_orderpriority", P.is_in(["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filtered("filter_contains", "part", "p_partkey, p_name", "p_name", P.contains("a"), "p_name LIKE '%a%'")
_filtered("filter_prefix", "part", "p_partkey, p_type", "p_type", P.prefix("S"), "p_type LIKE 'S%'")
_filtered("filter_like", "part", "p_partkey, p_type", "p_type", P.like("%A%E%"), "p_type LIKE '%A%E%'")
_filtered("filter_not_like", "part", "p_partkey, p_type", "p_type", P.not_like("%A%E%"), "p_type NOT LIKE '%A%E%'")


@_query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR d.lang IS NOT NULL")
def filter_nulls(spark, d):
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    both = _t(spark, d, "documents").select("doc_id", "lang").join(labels, F.col("doc_id") == F.col("l_id"), "left")
    return both.filter(P.is_null()(F.col("quality")) | P.is_not_null()(F.col("lang"))).select("doc_id", "quality")


@_query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal < 0) OR (c_mktsegment LIKE 'A%' AND NOT (c_acctbal < 5000))")
def filter_bool_tree(spark, d):
    s, b = F.col("c_mktsegment"), F.col("c_acctbal")
    return _t(spark, d, "customer").filter((P.eq("BUILDING")(s) & P.lt(0)(b)) | (P.prefix("A")(s) & ~P.lt(5000)(b))).select("c_custkey")


@_query(f"SELECT p_partkey, p_brand FROM part WHERE p_brand IN ({', '.join(repr(b) for b in _LONG_BRANDS)})")
def in_list_mark_join(spark, d):
    return P.mark_join(_t(spark, d, "part"), "p_brand", _LONG_BRANDS).select("p_partkey", "p_brand")


# --- joins


def _of(spark, d, /, **bindings: str) -> dict[str, DataFrame]:
    return {b: _t(spark, d, t) for b, t in bindings.items()}


def _star(spark, d) -> Query:
    q = Query(_of(spark, d, o="orders", c="customer", l="lineitem", s="supplier", p="part"))
    q.join("o.o_custkey = c.c_custkey", "o.o_orderkey = l.l_orderkey", "l.l_suppkey = s.s_suppkey", "l.l_partkey = p.p_partkey")
    return q.where("c", "c_mktsegment = 'BUILDING'").where("p", "p_size < 15")


_STAR = """FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey WHERE c.c_mktsegment = 'BUILDING' AND p.p_size < 15"""
_STAR_ROWS = f"SELECT o.o_orderkey, l.l_linenumber, s.s_name, p.p_name, c.c_name {_STAR}"
_STAR_COLUMNS = ("o.o_orderkey", "l.l_linenumber", "s.s_name", "p.p_name", "c.c_name")
_STAR_MIN = f"SELECT min(c.c_name) AS min_c_name, min(s.s_name) AS min_s_name, min(p.p_name) AS min_p_name {_STAR}"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _star(spark, d).min("c.c_name", "s.s_name", "p.p_name").to_df()


_query(_STAR_MIN, "min_global")(flagship)


@_query("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def join_binary(spark, d):
    return Query(_of(spark, d, c="customer", o="orders")).join("c.c_custkey = o.o_custkey").select("c.c_name", "o.o_orderkey").to_df()


@_query("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey")
def join_multi_condition(spark, d):
    return Query(_of(spark, d, c="customer", s="supplier")).join("c.c_nationkey = s.s_nationkey", "c.c_custkey = s.s_suppkey").select("c.c_custkey", "s.s_suppkey").to_df()


@_query(_STAR_ROWS)
def join_star(spark, d):
    return _star(spark, d).select(*_STAR_COLUMNS).to_df()


@_query("SELECT p.p_name, o.o_orderkey, c.c_name FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE p.p_size = 1")
def join_project_order(spark, d):
    q = Query(_of(spark, d, c="customer", o="orders", l="lineitem", p="part"), ("c", "o", ("l", "p"))).where("p", "p_size = 1")
    return q.join("o.o_custkey = c.c_custkey", "o.o_orderkey = l.l_orderkey", "l.l_partkey = p.p_partkey").select("p.p_name", "o.o_orderkey", "c.c_name").to_df()


def _by_rule(rule: str, name: str) -> None:
    @_query(_STAR_ROWS, name)
    def run(spark, d):
        return _star(spark, d).select(*_STAR_COLUMNS).plan(leftmost=rule).to_df()


_LOCAL = """FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN customer c ON s.s_nationkey = c.c_nationkey
JOIN orders o ON l.l_orderkey = o.o_orderkey AND c.c_custkey = o.o_custkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE l.l_quantity > 49 AND l.l_discount < 0.03 AND c.c_acctbal > 8000"""


def local_trade(spark, d) -> Query:
    """Suppliers, customers and orders of one nation: cyclic, and each kind of plan meets the inputs in an order or in nodes of its own."""
    q = Query(_of(spark, d, l="lineitem", s="supplier", c="customer", o="orders", n="nation")).where("l", "l_quantity > 49 AND l_discount < 0.03").where("c", "c_acctbal > 8000")
    return q.join("l.l_suppkey = s.s_suppkey", "s.s_nationkey = c.c_nationkey", "l.l_orderkey = o.o_orderkey", "c.c_custkey = o.o_custkey", "s.s_nationkey = n.n_nationkey")


def _by_kind(kind: str, strategy: str, name: str) -> None:
    @_query(f"SELECT l.l_linenumber, o.o_orderkey, s.s_suppkey, c.c_custkey, n.n_name {_LOCAL}", name)
    def run(spark, d):
        q = local_trade(spark, d).select("l.l_linenumber", "o.o_orderkey", "s.s_suppkey", "c.c_custkey", "n.n_name")
        return q.plan(kind=kind, leftmost="default", strategy=strategy).to_df()


for _rule in ("smart", "default", "largest", "median"):
    _by_rule(_rule, f"fj_{_rule}")
for _kind in ("canonical", "active", "fully_active", "factored"):
    _by_kind(_kind, "native", f"plan_{_kind}")
    _by_kind(_kind, "reduced", f"plan_{_kind}_reduced")

_CHAIN = """FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON n.n_nationkey = c.c_nationkey
JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE r.r_name = 'ASIA' AND l.l_quantity > 45"""


def _chain(spark, d) -> Query:
    q = Query(_of(spark, d, r="region", n="nation", c="customer", o="orders", l="lineitem")).where("r", "r_name = 'ASIA'").where("l", "l_quantity > 45")
    return q.join("r.r_regionkey = n.n_regionkey", "n.n_nationkey = c.c_nationkey", "c.c_custkey = o.o_custkey", "o.o_orderkey = l.l_orderkey")


@_query(f"SELECT n.n_name, c.c_custkey, o.o_orderkey, l.l_linenumber {_CHAIN}")
def join_chain(spark, d):
    return _chain(spark, d).select("n.n_name", "c.c_custkey", "o.o_orderkey", "l.l_linenumber").to_df()


@_query(f"SELECT n.n_name, c.c_custkey, o.o_orderkey, l.l_linenumber {_CHAIN}")
def join_chain_trie(spark, d):
    return _chain(spark, d).select("n.n_name", "c.c_custkey", "o.o_orderkey", "l.l_linenumber").plan(strategy="trie").to_df()


@_query("""SELECT n.n_name, r.r_name, o.o_orderkey, p.p_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size < 5""")
def join_bushy_nested(spark, d):
    q = Query(_of(spark, d, c="customer", n="nation", r="region", o="orders", l="lineitem", p="part"), ("c", ("n", "r"), ("o", "l", "p"))).where("p", "p_size < 5")
    q.join("c.c_nationkey = n.n_nationkey", "n.n_regionkey = r.r_regionkey", "c.c_custkey = o.o_custkey", "o.o_orderkey = l.l_orderkey", "l.l_partkey = p.p_partkey")
    return q.select("n.n_name", "r.r_name", "o.o_orderkey", "p.p_name").to_df()


_CYCLE = """FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey"""


def _cycle(spark, d) -> Query:
    q = Query(_of(spark, d, l="lineitem", o="orders", c="customer", s="supplier", n="nation"))
    return q.join("o.o_orderkey = l.l_orderkey", "o.o_custkey = c.c_custkey", "l.l_suppkey = s.s_suppkey", "c.c_nationkey = s.s_nationkey", "s.s_nationkey = n.n_nationkey")


def _cycle_by(strategy: str, name: str) -> None:
    @_query(f"SELECT n.n_name, c.c_custkey, o.o_orderkey, l.l_linenumber, s.s_suppkey {_CYCLE}", name)
    def run(spark, d):
        return _cycle(spark, d).select("n.n_name", "c.c_custkey", "o.o_orderkey", "l.l_linenumber", "s.s_suppkey").plan(strategy=strategy).to_df()


_cycle_by("native", "join_cyclic")
_cycle_by("trie", "join_cyclic_trie")
_cycle_by("hypercube", "join_cyclic_hypercube")
_cycle_by("auto", "join_cyclic_auto")

#: A skewed graph: products of remainders, so some vertices have many edges.
_EDGES = "SELECT DISTINCT (l_suppkey % 100) * (l_suppkey % 7) % 100 AS x, (l_partkey % 100) * (l_partkey % 11) % 100 AS y FROM lineitem WHERE l_quantity > 40"


def _triangles_by(strategy: str, name: str) -> None:
    @_query(f"WITH e AS ({_EDGES}) SELECT a.x, a.y, b.y AS z FROM e a JOIN e b ON a.y = b.x JOIN e c ON b.y = c.x AND c.y = a.x", name)
    def run(spark, d):
        mixed = lambda c, m: (F.col(c) % 100) * (F.col(c) % m) % 100
        e = _t(spark, d, "lineitem").filter("l_quantity > 40").select(mixed("l_suppkey", 7).alias("x"), mixed("l_partkey", 11).alias("y")).distinct()
        return Query({"a": e, "b": e, "c": e}).join("a.y = b.x", "b.y = c.x", "c.y = a.x").select("a.x", "a.y", z="b.y").plan(strategy=strategy).to_df()


for _strategy in ("native", "reduced", "trie", "hypercube", "auto"):
    _triangles_by(_strategy, f"join_triangle_{_strategy}")


@_query("SELECT n1.n_name AS supplier_nation, n2.n_name AS customer_nation, s.s_suppkey, c.c_custkey FROM nation n1 JOIN supplier s ON n1.n_nationkey = s.s_nationkey JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey JOIN customer c ON n2.n_nationkey = c.c_nationkey WHERE s.s_acctbal > 9000 AND c.c_acctbal > 9000")
def self_join_alias(spark, d):
    q = Query(_of(spark, d, n1="nation", s="supplier", n2="nation", c="customer")).where("s", "s_acctbal > 9000").where("c", "c_acctbal > 9000")
    q.join("n1.n_nationkey = s.s_nationkey", "n1.n_regionkey = n2.n_regionkey", "n2.n_nationkey = c.c_nationkey")
    return q.select("s.s_suppkey", "c.c_custkey", supplier_nation="n1.n_name", customer_nation="n2.n_name").to_df()


@_query("SELECT count(*) AS n FROM orders o JOIN lineitem a ON o.o_orderkey = a.l_orderkey JOIN lineitem b ON o.o_orderkey = b.l_orderkey")
def bag_multiplicity(spark, d):
    return Query(_of(spark, d, o="orders", a="lineitem", b="lineitem")).join("o.o_orderkey = a.l_orderkey", "o.o_orderkey = b.l_orderkey").count()


@_query("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey < 0")
def join_empty_input(spark, d):
    return Query(_of(spark, d, c="customer", o="orders")).where("o", "o_orderkey < 0").join("c.c_custkey = o.o_custkey").select("c.c_name", "o.o_orderkey").to_df()


@_query("SELECT min(c.c_name) AS min_c_name, min(o.o_totalprice) AS min_o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey < 0")
def min_empty_is_null(spark, d):
    return Query(_of(spark, d, c="customer", o="orders")).where("o", "o_orderkey < 0").join("c.c_custkey = o.o_custkey").min("c.c_name", "o.o_totalprice").to_df()


@_query(_STAR_MIN)
def min_factorized(spark, d):
    return _star(spark, d).min("c.c_name", "s.s_name", "p.p_name").factorised()


@_query(f"SELECT count(*) AS n {_CYCLE}")
def count_factorized(spark, d):
    return _cycle(spark, d).count()


@_query("SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49) AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 9000)")
def semi_reduction(spark, d):
    t = _of(spark, d, o="orders", l="lineitem", c="customer")
    q = Query(t).join("o.o_orderkey = l.l_orderkey", "o.o_custkey = c.c_custkey").select("o.o_orderkey", "o.o_totalprice")
    v, wanted = q.variables, {a for a, _ in q.project}
    o = inputs.scan(t["o"], "o", v, wanted)
    others = [inputs.scan(t["l"].filter("l_quantity > 49"), "l", v, set()), inputs.scan(t["c"].filter("c_acctbal > 9000"), "c", v, set())]
    return native.semi_reduce(o.df, set(o.variables), others).select(*[F.col(a.column).alias(n) for a, n in q.project])


@_query("""SELECT a.l_orderkey AS orderkey, count(*) AS n_common FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3) a
JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber > 3) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_orderkey""")
def cover_choice(spark, d):
    li = _t(spark, d, "lineitem")
    a = li.filter("l_linenumber <= 3").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"))
    b = li.filter("l_linenumber > 3").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("b"))
    common = F.size(trie.smaller_first(F.col("a"), F.col("b"))).cast("long")
    return a.join(b, "l_orderkey").select(F.col("l_orderkey").alias("orderkey"), common.alias("n_common")).filter("n_common > 0")


# --- tries and partitions


@_query("SELECT l_orderkey, count(*) AS n_leaf FROM lineitem GROUP BY l_orderkey")
def trie_build_depth1(spark, d):
    t = trie.build(_t(spark, d, "lineitem"), [["l_orderkey"]], ["l_linenumber"])
    return t.select("l_orderkey", F.size("rest").cast("long").alias("n_leaf"))


@_query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_keys, count(*) AS n_leaf FROM lineitem GROUP BY l_orderkey")
def trie_build_depth2(spark, d):
    t = trie.build(_t(spark, d, "lineitem"), [["l_orderkey"], ["l_suppkey"]], ["l_linenumber"])
    leaves = F.aggregate("rest", F.lit(0).cast("long"), lambda n, x: n + F.size(x["rest"]))
    return t.select("l_orderkey", F.size("rest").cast("long").alias("n_keys"), leaves.alias("n_leaf"))


@_query("SELECT (('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::UBIGINT % 32)::INT AS slot, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys FROM lineitem GROUP BY 1")
def trie_partition_counts(spark, d):
    return partition_counts(_t(spark, d, "lineitem"), "l_orderkey", hashed=portable_hash)


@_query("""SELECT 'FJ(l o c s n)' AS "join", node, n_atoms, n_attributes, n_covers, atoms FROM (VALUES (0, 3, 4, 1, '(l.l_orderkey l.l_suppkey)(o.o_orderkey)(s.s_suppkey)'),
(1, 2, 2, 2, '(o.o_custkey)(c.c_custkey)'), (2, 3, 3, 3, '(c.c_nationkey)(s.s_nationkey)(n.n_nationkey)')) AS t(node, n_atoms, n_attributes, n_covers, atoms)""")
def plan_stats(spark, d):
    return _cycle(spark, d).explain_fj()


# --- analysis kernels


@_query("""SELECT shape, size, round(exact, 9) AS log10_bound FROM (SELECT shape, n::INT AS size, 3.0 * CASE shape WHEN 'clique' THEN n / 2 WHEN 'cycle' THEN n / 2 WHEN 'star' THEN n ELSE n / (n - 1) END AS exact
FROM (VALUES ('clique'), ('cycle'), ('star'), ('loomis_whitney')) AS s(shape), (VALUES (3), (4), (5)) AS t(n))""")
def agm_bound(spark, d):
    rows = [(shape, n, round(math.log10(agm.bound(f(n), [1000] * len(f(n)))), 9)) for shape, f in agm.SHAPES.items() for n in (3, 4, 5)]
    return spark.createDataFrame(rows, "shape string, size int, log10_bound double")


_TRADE = "SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE o.o_orderpriority = '1-URGENT' AND l.l_quantity > 48"


def _trade(spark, d) -> DataFrame:
    q = Query(_of(spark, d, l="lineitem", o="orders", c="customer", s="supplier")).where("o", "o_orderpriority = '1-URGENT'").where("l", "l_quantity > 48")
    q.join("o.o_orderkey = l.l_orderkey", "o.o_custkey = c.c_custkey", "l.l_suppkey = s.s_suppkey")
    return q.select(src="c.c_nationkey", dst="s.s_nationkey").to_df().distinct()


@_query(f"WITH e AS ({_TRADE}) SELECT count(*) AS n_paths FROM e a JOIN e b ON a.dst = b.src")
def graph_paths2(spark, d):
    return graph.paths2(_trade(spark, d))


@_query(f"WITH e AS ({_TRADE}), u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst) SELECT count(*) AS n_triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def graph_triangles(spark, d):
    return graph.triangles(_trade(spark, d))


@_query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_documents_labels(spark, d):
    return Query(_of(spark, d, d="documents", l="labels")).join("d.doc_id = l.doc_id").select("d.doc_id", "d.lang", "l.quality", "l.toxic").to_df()


@_query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o FROM lineitem GROUP BY l_returnflag")
def phase_pivot(spark, d):
    p = _t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@_query("SELECT n, n * (n - 1) AS n_edges, n * (n - 1) * n * (n - 1) AS squared, n * (n - 1) * (n - 1) AS n_paths FROM (SELECT unnest(range(3, 100)) AS n)")
def clique_growth(spark, d):
    return analysis.clique_growth(spark)


@_query("SELECT size::BIGINT AS size, (2 ** p)::BIGINT AS n_lists, size / 2 ** p AS mean_entries FROM (VALUES (1000000), (5000000), (10000000)) AS s(size), (SELECT unnest(range(0, 8)) AS p)")
def list_fill(spark, d):
    return analysis.list_fill(spark)


#: A log of two queries, one of them with one and with four threads.
_LOG = """Query: 1a
Using: 1 threads
Num Nodes: 2
Num Atoms: 3 2
Num Attributes: 4 2
Num Tuples: 100
Trie Height: 2
chunked list building,0.5
trie building,1.5
trie intersection,0.25
trie building,0.5
Query: 1a
Using: 4 threads
chunked list building,0.25
trie building,0.5
trie intersection,0.25
Query: 17e
Using: 1 threads
Num Nodes: 1
Num Atoms: 5
Num Attributes: 6
Num Tuples: 7
Trie Height: 1
"""


def _log(spark) -> DataFrame:
    return spark.createDataFrame([("run", i, line) for i, line in enumerate(_LOG.splitlines())], "file string, pos int, line string")


@_query("SELECT * FROM (VALUES ('1a', 1, 2, '3 2', '4 2'), ('17e', 1, 1, '5', '6')) AS t(query, threads, n_nodes, atoms, attributes)")
def log_plan_statistics(spark, d):
    return analysis.plan_statistics(_log(spark)).withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("atoms", "attributes")})


@_query("SELECT query, threads, n_tuples::BIGINT AS n_tuples, height FROM (VALUES ('1a', 1, 100, 2), ('17e', 1, 7, 1)) AS t(query, threads, n_tuples, height)")
def log_trie_heights(spark, d):
    return analysis.trie_heights(_log(spark))


@_query("""SELECT query, threads, operation, ms::DOUBLE AS ms, speedup::DOUBLE AS speedup FROM (VALUES ('1a', 1, 'chunked list building', 500, 1), ('1a', 1, 'GHT building', 2000, 1), ('1a', 1, 'GHT intersection', 250, 1), ('1a', 1, 'total', 2750, 1),
('1a', 4, 'chunked list building', 250, 8), ('1a', 4, 'GHT building', 500, 16), ('1a', 4, 'GHT intersection', 250, 4), ('1a', 4, 'total', 1000, 11)) AS t(query, threads, operation, ms, speedup)""")
def log_speedups(spark, d):
    return analysis.speedups(analysis.phase_times(_log(spark)))
