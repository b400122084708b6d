import random
from collections import Counter

import pytest

from weftjoin.api import STRATEGIES, Query
from weftjoin.operators import auto, hypercube, native, trie
from weftjoin.operators.inputs import Input, prepare
from weftjoin.plans import fjplan, leftmost


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in columns.split()))


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_bag_semantics(spark):
    t = {"r": frame(spark, "a", [(1,), (1,), (2,)]), "s": frame(spark, "a", [(1,), (1,), (3,)]), "t": frame(spark, "a", [(1,), (2,)])}
    for strategy in STRATEGIES:
        assert bag(Query(t).join("r.a=s.a", "s.a=t.a").select("r.a").plan(strategy=strategy).to_df()) == {(1,): 4}


def test_triangle_in_every_strategy_kind_and_rule(spark):
    e = [(1, 2), (2, 3), (3, 1), (1, 3)]
    t = {"r": frame(spark, "x y", e), "s": frame(spark, "y z", e), "t": frame(spark, "z x", e)}
    want = {(1, 2, 3): 1, (2, 3, 1): 1, (3, 1, 2): 1}
    for strategy in STRATEGIES:
        for kind in fjplan.KINDS:
            q = Query(t).join("r.y=s.y", "s.z=t.z", "t.x=r.x").select("r.x", "r.y", "s.z").plan(kind=kind, strategy=strategy)
            assert bag(q.to_df()) == want, (strategy, kind)


def test_equal_columns_inside_a_relation(spark):
    t = {"r": frame(spark, "a b", [(1, 1), (1, 2)]), "s": frame(spark, "c", [(1,)])}
    assert bag(Query(t).join("r.a=s.c", "r.b=s.c").select("r.b").to_df()) == {(1,): 1}


def test_null_keys_never_match(spark):
    t = {"r": frame(spark, "a", [(None,), (1,)]), "s": frame(spark, "a", [(None,), (1,)]), "u": frame(spark, "a", [(None,), (1,)])}
    for strategy in STRATEGIES:
        assert bag(Query(t).join("r.a=s.a", "s.a=u.a").select("r.a").plan(strategy=strategy).to_df()) == {(1,): 1}


def test_empty_input_and_minimum(spark):
    t = {"r": frame(spark, "a", [(1,)]), "s": frame(spark, "a b", [])}
    assert Query(t).join("r.a=s.a").select("s.b").to_df().collect() == []
    assert [tuple(x) for x in Query(t).join("r.a=s.a").min("s.b").to_df().collect()] == [(None,)]


def test_columns_line_up_when_a_nested_input_leads(spark):
    t = {
        "a": spark.createDataFrame([(1, "one")], "k bigint, name string"),
        "b": frame(spark, "k v", [(1, i) for i in range(50)]),
        "c": spark.createDataFrame([(i, 0.5 * i) for i in range(50)], "v bigint, w double"),
    }
    for rule in leftmost.RULES:
        got = Query(t, ("a", ("b", "c"))).join("a.k=b.k", "b.v=c.v").select("c.w", "a.name", "b.v").plan(leftmost=rule).to_df()
        assert got.columns == ["w", "name", "v"] and bag(got) == {(0.5 * i, "one", i): 1 for i in range(50)}


def test_unconnected_inputs_give_the_product(spark):
    t = {"r": frame(spark, "a", [(1,), (2,)]), "s": frame(spark, "b", [(3,), (4,)])}
    assert len(Query(t).select("r.a", "s.b").to_df().collect()) == 4


def test_same_table_under_two_names_and_projected_join_column(spark):
    n = frame(spark, "k g", [(1, 7), (2, 7), (3, 8)])
    got = Query({"x": n, "y": n}).join("x.g=y.g").select(left="x.k", right="y.k", g="x.g").to_df()
    assert bag(got) == {(1, 1, 7): 1, (1, 2, 7): 1, (2, 1, 7): 1, (2, 2, 7): 1, (3, 3, 8): 1}


@pytest.mark.parametrize("seed", range(3))
def test_random_queries_agree_across_strategies(spark, seed):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, 0, 1, 2, 3])
    rel = lambda n: frame(spark, "p q", [(value(), value()) for _ in range(n)])
    t = {b: rel(rnd.randrange(4, 14)) for b in "abcd"}
    equalities = rnd.choice([["a.p=b.p", "b.q=c.p", "c.q=d.p"], ["a.p=b.p", "b.q=c.p", "c.q=a.q", "c.q=d.p"], ["a.p=b.p", "a.p=c.p", "a.q=d.p"]])
    shape = rnd.choice([("a", "b", "c", "d"), ("a", "b", ("c", "d"))])
    build = lambda **o: bag(Query(t, shape).join(*equalities).select("a.p", "b.q", "c.q", d="d.q").plan(**o).to_df())
    want = build(leftmost="default")
    for strategy in STRATEGIES:
        for rule in ("largest", "median", "smart"):
            assert build(strategy=strategy, leftmost=rule) == want


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(trie, "LARGEST_GROUP", 2)
    t = {"r": frame(spark, "a", [(1,), (2,)]), "s": frame(spark, "a b", [(1, i % 3) for i in range(40)] + [(2, 5)])}
    assert trie.build(t["s"], [["a"]], ["b"]).count() == 2
    parts = trie.build(t["s"], [["a"]], ["b"], largest=2).collect()
    assert len(parts) > 10 and sum(len(r["rest"]) for r in parts) == 41
    assert bag(Query(t).join("r.a=s.a").select("s.a", "s.b").plan(strategy="trie").to_df()) == Counter([(1, i % 3) for i in range(40)] + [(2, 5)])


def test_kinds_of_plans_differ(spark):
    """Orders of the inputs, and by its reducers also the plan that Catalyst gets, for each kind."""
    t = {b: frame(spark, c, [(i, i)[: len(c.split())] if len(c.split()) < 3 else (i, i, i) for i in range(3)]) for b, c in {"l": "o s", "s": "s n", "c": "c n", "o": "o c", "n": "n"}.items()}
    build = lambda **o: Query(t).join("l.s=s.s", "s.n=c.n", "l.o=o.o", "c.c=o.c", "s.n=n.n").select("l.o", "n.n").plan(leftmost="default", **o)
    orders, plans = {}, {}
    for kind in fjplan.KINDS:
        q = build(kind=kind)
        join, p = q.fj_plans()[-1]
        inputs = [Input(t[b.binding], tuple(q.variables.among([b.binding])), ()) for b in join.inputs]
        orders[kind] = native.probe_order(p, inputs)
        steps = []
        real = native.semi_reduce
        native.semi_reduce = lambda df, bound, others: steps.append((sorted(bound), [o.variables for o in others])) or real(df, bound, others)
        try:
            assert bag(build(kind=kind, strategy="reduced").to_df()) == bag(q.to_df()) == {(i, i): 1 for i in range(3)}
        finally:
            native.semi_reduce = real
        plans[kind] = str((orders[kind], steps))
    assert orders == {"fully_active": [0, 1, 3, 2, 4], "canonical": [0, 1, 2, 3, 4], "active": [0, 1, 2, 3, 4], "factored": [0, 1, 4, 2, 3]}
    assert len(set(plans.values())) >= 3 and all(plans[k] != str((orders[k], [])) for k in ("fully_active", "factored"))


@pytest.mark.parametrize("seed", range(4))
def test_factorised_counts_and_minimums(spark, seed):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, 0, 1, 2, 3])
    t = {b: frame(spark, "p q", [(value(), value()) for _ in range(rnd.randrange(0 if seed == 3 else 4, 14))]) for b in "abcd"}
    equalities = [["a.p=b.p", "b.q=c.p", "c.q=d.p"], ["a.p=b.p", "b.q=c.p", "c.q=a.q", "c.q=d.p"], ["a.p=b.p", "c.p=d.p"], ["a.p=b.p", "a.p=c.p", "a.q=d.p"]][seed]
    q = Query(t, ("a", "b", ("c", "d"))).join(*equalities)
    rows = q.select("a.p", "b.q", "c.q", d="d.q").plan(leftmost="default").to_df().collect()
    assert q.count().first()["n"] == len(rows)
    m = Query(t, ("a", "b", ("c", "d"))).join(*equalities).min("a.p", "b.q", d="d.q")
    least = lambda c: min((r[c] for r in rows if r[c] is not None), default=None)
    assert [tuple(r) for r in m.factorised().collect()] == [(least("p"), least(1), least("d"))] == [tuple(r) for r in m.to_df().collect()]


def test_auto_asks_the_bound(spark):
    e = spark.range(5).selectExpr("id AS x", "id AS y")
    of = lambda rows, *variables: Input(e, variables, ())
    plan = Query({"a": e, "b": e, "c": e}).join("a.y=b.x", "b.y=c.x", "c.y=a.x").fj_plans()[0][1]
    inputs = [of(0, 2, 0), of(0, 0, 1), of(0, 1, 2)]
    assert auto.choice(plan, inputs) == "native"  # small
    real = auto.estimated_bytes
    auto.estimated_bytes = lambda df: 32 * 10**7
    try:
        assert auto.choice(plan, [Input(frame(spark, "x y", []), i.variables, ()) for i in inputs]) == "hypercube"
        auto.estimated_bytes = lambda df: 1 << 62
        assert auto.choice(plan, inputs) == "native"
        auto.estimated_bytes = lambda df: 32 * 10**7
        assert auto.choice(plan, inputs) == "hypercube" and auto.choice(plan, [of(0, 0, 1), of(0, 1), of(0, 1, 2)]) == "native"
    finally:
        auto.estimated_bytes = real


def test_shares_follow_sizes():
    i = [Input(None, v, ()) for v in ((0, 1), (1, 2), (0, 2))]
    assert hypercube.shares([0, 1, 2], i, [1, 1, 1], 64) == {0: 4, 1: 4, 2: 4}
    small = hypercube.shares([0, 1, 2], i, [1000, 1, 1], 64)
    assert small[2] == 1 and small[0] * small[1] == 64  # the large input is sent once
    assert hypercube.cells_for([1]) == hypercube.FEWEST and hypercube.cells_for([hypercube.CELL_BYTES * 100]) == 256


def _trade(spark, n_customers=300):
    """Orders of customers and suppliers of few nations, in sizes that Catalyst can tell."""
    of = lambda n, *columns: spark.range(n).selectExpr(*columns)
    t = {"l": of(4 * n_customers, "id % 600 AS o", "id % 211 AS s", "id AS x"), "o": of(2 * n_customers, "id AS o", f"id % {n_customers} AS c"), "c": of(n_customers, "id AS c", "id % 2 AS n"), "s": of(200, "id AS s", "id % 2 AS n"), "n": of(2, "id AS n")}
    return Query(t).join("o.o=l.o", "o.c=c.c", "l.s=s.s", "c.n=s.n", "s.n=n.n").select("l.x", "c.c", "s.s")


def _prepared(q, then):
    return prepare(q.tree(), q.tables, q.variables, {a for a, _ in q.project}, q.options, then)


def test_wide_inputs_wait(spark):
    """Suppliers of a nation aren't met by every order of it before the orders' own lines are."""
    seen = {}
    _prepared(_trade(spark), lambda plan, inputs: seen.update(names=["".join(c for c in "locsn" if c in "".join(i.df.columns)) for i in inputs], order=native.probe_order(plan, inputs), inputs=inputs) or inputs[0])
    of = {frozenset(i.variables): k for k, i in enumerate(seen["inputs"])}
    widest = max(of.values(), key=lambda k: seen["order"].index(k))
    assert any(a.binding == "s" for a in seen["inputs"][widest].payload)  # last, when all its variables are bound
    want = bag(_trade(spark).plan(leftmost="default", kind="canonical").to_df())
    assert want and all(bag(_trade(spark).plan(strategy=s).to_df()) == want for s in STRATEGIES)


def test_small_inputs_are_sent_whole(spark):
    """Rows met so far aren't dealt out again for an input of few bytes that is above Spark's own threshold; if broadcasts are switched off, none is made."""
    key, bytes_ = "spark.sql.autoBroadcastJoinThreshold", native.SMALL_BYTES
    before, found = spark.conf.get(key), {}
    try:
        for threshold, native.SMALL_BYTES in (("1", 4000), ("1", 0), ("-1", 4000)):  # suppliers and nations have less, the others more
            spark.conf.set(key, threshold)
            df = _trade(spark).plan(strategy="auto").to_df()
            found[threshold, native.SMALL_BYTES] = str(df._jdf.queryExecution().sparkPlan()).count("BroadcastHashJoin"), bag(df)
    finally:
        native.SMALL_BYTES = bytes_
        spark.conf.set(key, before)
    assert [n for n, _ in found.values()] == [2, 0, 0]
    (_, want), *others = found.values()
    assert want and all(rows == want for _, rows in others)


def test_tries_of_few_keys_are_not_carried(spark):
    found = []
    _prepared(_trade(spark), lambda plan, inputs: found.append({frozenset(inputs[i].variables): n for i, n in trie.merged_levels(plan, inputs).items()}) or inputs[0])
    assert sorted(found[0].values()) == [1, 1, 1, 2]
    plan = str(_trade(spark).plan(strategy="trie").to_df()._jdf.queryExecution().analyzed())
    assert plan.count("map_from_entries") == 2  # of orders and of lines, not of suppliers


def test_cells_share_columns(spark):
    """A shuffled row has as many columns of a type as the widest input, not those of all inputs."""
    q, widths = _trade(spark), []
    _prepared(q, lambda plan, inputs: widths.append((max(len(i.df.columns) for i in inputs), len({x for s in hypercube._slots(inputs) for x in s.values()}))) or inputs[0])
    assert widths[0][0] == widths[0][1]


def test_explain(spark):
    t = {"r": frame(spark, "a", [(1,)]), "s": frame(spark, "a", [(1,)])}
    q = Query(t).join("r.a=s.a").select("s.a")
    assert str(q) == "π(FJ(r s))"
    assert [tuple(x) for x in q.explain_fj().collect()] == [("FJ(r s)", 0, 2, 2, 2, "(r.a)(s.a)")]
