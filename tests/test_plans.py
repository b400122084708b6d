import json
import math

import pytest

from weftjoin.plans import agm, fjplan, leftmost, plan_json
from weftjoin.plans.ir import Attr, BinaryJoin, NaryJoin, Project, Scan, equalities_under, flatten
from weftjoin.plans.variables import Variables


def tree(shape, equalities):
    """A binary tree from nested tuples, each equality at the lowest join that has both sides."""
    pairs = [tuple(map(Attr.of, e.split("="))) for e in equalities]

    def build(s):
        if isinstance(s, str):
            return Scan(s)
        node = build(s[0])
        for part in s[1:]:
            right = build(part)
            mine = tuple(p for p in pairs if {p[0].binding, p[1].binding} & set(node.bindings) and {p[0].binding, p[1].binding} & set(right.bindings))
            node = BinaryJoin(node, right, mine)
        return node

    return build(shape)


def plans(shape, equalities, kind="fully_active"):
    root = tree(shape, equalities)
    variables, out = Variables(equalities_under(root)), []

    def visit(n):
        if isinstance(n, NaryJoin):
            for i in n.inputs:
                visit(i)
            out.append(str(fjplan.KINDS[kind](n, variables)))

    visit(flatten(root))
    return str(Project(flatten(root), ())), out


MOVIE = ["mk.movie_id=t.id", "mk.movie_id=mc.movie_id"]
GOLDENS = [
    (("mk", "t", "mc", "k", "cn"), [*MOVIE, "mk.keyword_id=k.id", "mc.company_id=cn.id"], "π(FJ(mk t mc k cn))", ["[(mk.keyword_id mk.movie_id)(t.id)(mc.movie_id)(k.id)] [(mc.company_id)(cn.id)]"]),
    (
        ("ci", "n", ("mk", "t", "mc", "k", "cn")),
        ["ci.person_id=n.id", "ci.movie_id=mk.movie_id", *MOVIE, "mk.keyword_id=k.id", "mc.company_id=cn.id"],
        "π(FJ(ci n FJ(mk t mc k cn)))",
        ["[(mk.keyword_id mk.movie_id)(t.id)(mc.movie_id)(k.id)] [(mc.company_id)(cn.id)]", "[(ci.movie_id ci.person_id)(n.id)(mk.movie_id t.id mc.movie_id)]"],
    ),
    (
        ("mc", ("t", "mi_idx"), "it", "ct"),
        ["mc.movie_id=t.id", "t.id=mi_idx.movie_id", "mi_idx.info_type_id=it.id", "mc.company_type_id=ct.id"],
        "π(FJ(mc FJ(t mi_idx) it ct))",
        ["[(t.id)(mi_idx.movie_id)]", "[(mc.company_type_id mc.movie_id)(t.id mi_idx.movie_id)(ct.id)] [(mi_idx.info_type_id)(it.id)]"],
    ),
    (
        ("mk", ("t1", "ml", "t2"), "lt", "k"),
        ["mk.movie_id=t1.id", "t1.id=ml.movie_id", "ml.linked_movie_id=t2.id", "ml.link_type_id=lt.id", "mk.keyword_id=k.id"],
        "π(FJ(mk FJ(t1 ml t2) lt k))",
        ["[(t1.id)(ml.movie_id)] [(ml.linked_movie_id)(t2.id)]", "[(mk.keyword_id mk.movie_id)(t1.id ml.movie_id)(k.id)] [(ml.link_type_id)(lt.id)]"],
    ),
    (
        ("ci", "n1", ("mc", "cn"), "rt", "t", "an1"),
        ["ci.person_id=n1.id", "n1.id=an1.person_id", "mc.company_id=cn.id", "ci.movie_id=mc.movie_id", "mc.movie_id=t.id", "ci.role_id=rt.id"],
        "π(FJ(ci n1 FJ(mc cn) rt t an1))",
        ["[(mc.company_id)(cn.id)]", "[(ci.movie_id ci.person_id ci.role_id)(n1.id)(mc.movie_id)(rt.id)(t.id)(an1.person_id)]"],
    ),
]

GOLDENS += [
    (
        ("ci", "rt", ("mc", "t", "ct", "cn"), "chn"),
        ["ci.movie_id=mc.movie_id", "ci.movie_id=t.id", "ci.role_id=rt.id", "mc.movie_id=t.id", "mc.company_type_id=ct.id", "mc.company_id=cn.id", "ci.person_role_id=chn.id"],
        "π(FJ(ci rt FJ(mc t ct cn) chn))",
        ["[(mc.company_id mc.company_type_id mc.movie_id)(t.id)(ct.id)(cn.id)]", "[(ci.movie_id ci.person_role_id ci.role_id)(rt.id)(mc.movie_id t.id)(chn.id)]"],
    ),
    (
        ("ci", "n", ("mi", ("t", "mi_idx"), "it2", "it1")),
        ["ci.person_id=n.id", "ci.movie_id=mi.movie_id", "mi.movie_id=t.id", "t.id=mi_idx.movie_id", "mi_idx.info_type_id=it2.id", "mi.info_type_id=it1.id"],
        "π(FJ(ci n FJ(mi FJ(t mi_idx) it2 it1)))",
        ["[(t.id)(mi_idx.movie_id)]", "[(mi.info_type_id mi.movie_id)(t.id mi_idx.movie_id)(it1.id)] [(mi_idx.info_type_id)(it2.id)]", "[(ci.movie_id ci.person_id)(n.id)(mi.movie_id t.id mi_idx.movie_id)]"],
    ),
    (
        ("mi", ("mk", "t"), "k"),
        ["mi.movie_id=t.id", "mk.movie_id=t.id", "mk.keyword_id=k.id"],
        "π(FJ(mi FJ(mk t) k))",
        ["[(mk.movie_id)(t.id)]", "[(mi.movie_id)(mk.movie_id t.id)] [(mk.keyword_id)(k.id)]"],
    ),
    (
        ("mk", "t", "mi_idx", "k", "it"),
        ["mk.movie_id=t.id", "mk.movie_id=mi_idx.movie_id", "mk.keyword_id=k.id", "mi_idx.info_type_id=it.id"],
        "π(FJ(mk t mi_idx k it))",
        ["[(mk.keyword_id mk.movie_id)(t.id)(mi_idx.movie_id)(k.id)] [(mi_idx.info_type_id)(it.id)]"],
    ),
    (
        ("mi", "t", "mc", "it", "ct"),
        ["mi.movie_id=t.id", "mi.movie_id=mc.movie_id", "mi.info_type_id=it.id", "mc.company_type_id=ct.id"],
        "π(FJ(mi t mc it ct))",
        ["[(mi.info_type_id mi.movie_id)(t.id)(mc.movie_id)(it.id)] [(mc.company_type_id)(ct.id)]"],
    ),
    (
        ("ci", "n", ("mk", "t", "k")),
        ["ci.person_id=n.id", "ci.movie_id=mk.movie_id", "mk.movie_id=t.id", "mk.keyword_id=k.id"],
        "π(FJ(ci n FJ(mk t k)))",
        ["[(mk.keyword_id mk.movie_id)(t.id)(k.id)]", "[(ci.movie_id ci.person_id)(n.id)(mk.movie_id t.id)]"],
    ),
    (
        ("ci", "n", ("mc", "cn"), "rt", "t", "an"),
        ["ci.person_id=n.id", "mc.company_id=cn.id", "ci.movie_id=mc.movie_id", "ci.role_id=rt.id", "ci.movie_id=t.id", "n.id=an.person_id"],
        "π(FJ(ci n FJ(mc cn) rt t an))",
        ["[(mc.company_id)(cn.id)]", "[(ci.movie_id ci.person_id ci.role_id)(n.id)(mc.movie_id)(rt.id)(t.id)(an.person_id)]"],
    ),
]


@pytest.mark.parametrize("shape,equalities,hybrid,expected", GOLDENS)
def test_fully_active_goldens(shape, equalities, hybrid, expected):
    assert plans(shape, equalities) == (hybrid, expected)


def test_canonical_and_active_keep_bound_columns_as_probes():
    shape, equalities = ("a", "b", "c"), ["a.x=b.x", "b.y=c.y"]
    assert plans(shape, equalities, "canonical")[1] == ["[(a.x)(b.x)] [(b.y)(c.y)]"]
    triangle = ["r.x=t.x", "r.y=s.y", "s.z=t.z"]
    assert plans(("r", "s", "t"), triangle, "canonical")[1] == ["[(r.x r.y)(s.y)] [(s.z)(t.x t.z)]"]
    assert plans(("r", "s", "t"), triangle)[1] == ["[(r.x r.y)(s.y)(t.x)] [(s.z)(t.z)]"]
    assert plans(("r", "s", "t"), triangle, "active")[1] == ["[(r.x r.y)(s.y)] [(s.z)(t.x t.z)]"]


def test_factored_moves_probes_to_where_they_are_bound():
    triangle = ["r.x=t.x", "r.y=s.y", "s.z=t.z"]
    assert plans(("r", "s", "t"), triangle, "factored")[1] == ["[(r.x r.y)(s.y)] [(s.z)(t.x t.z)]"]  # z is bound in the last node only
    late = ["r.x=s.x", "s.y=u.y", "r.x=v.x"]
    assert plans(("r", "s", "u", "v"), late, "canonical")[1] == ["[(r.x)(s.x)] [(s.y)(u.y)(v.x)]"]
    assert plans(("r", "s", "u", "v"), late, "factored")[1] == ["[(r.x)(s.x)(v.x)] [(s.y)(u.y)]"]


def test_bounds_of_many_relations_are_quick():
    assert math.isclose(agm.bound(agm.star(14), [10] * 14), 10**14, rel_tol=1e-9)
    assert math.isclose(agm.bound(agm.clique(8), [100] * 28), 100**4, rel_tol=1e-9)
    assert math.isclose(agm.bound(agm.clique(3), [10, 10, 10**6]), 100, rel_tol=1e-9)


def test_cover_marks_and_statistics():
    node = flatten(tree(("t", "a", "b"), ["t.id=a.id", "t.id=b.id"]))
    plan = fjplan.fully_active(node, Variables(equalities_under(node)))
    assert [a.cover for a in plan.nodes[0]] == [True, True, True]
    assert plan.statistics()["trie_heights"] == [1, 1, 1]
    assert plan.trie_levels() == {0: [(0,)], 1: [(0,)], 2: [(0,)]}


def test_leftmost_rules_and_ties():
    node = flatten(tree(("a", "b", "c", "d"), ["a.x=b.x", "b.y=c.y", "b.y=d.y"]))
    v = Variables(equalities_under(node))
    sizes = [50, 10, 20, 20]
    assert leftmost.choose(node, v, sizes, "default") == 0
    assert leftmost.choose(node, v, sizes, "largest") == 0
    assert leftmost.choose(node, v, sizes, "median") == 3
    assert leftmost.choose(node, v, sizes, "smart") == 2  # y is named four times; c and d tie, the earlier leads
    with pytest.raises(ValueError):
        leftmost.choose(node, v, sizes, "none")


def test_variables_are_closed_transitively():
    v = Variables([(Attr("a", "x"), Attr("b", "x")), (Attr("c", "x"), Attr("d", "x")), (Attr("b", "x"), Attr("c", "x"))])
    assert len(v) == 1 and set(v.of.values()) == {0}


def test_normalised_plan_and_profile(tmp_path):
    attr = lambda b, a: {"binding": b, "attribute": a}
    plan = {
        "name": "projection", "attributes": [attr("a", "name")],
        "children": [{"name": "hashjoin", "conditions": [{"left": attr("a", "id"), "right": attr("b", "a_id")}], "children": [{"name": "scan", "binding": "a", "table": "aa"}, {"name": "scan", "binding": "b", "table": "bb"}]}],
    }
    (tmp_path / "p.json").write_text(json.dumps(plan))
    p = plan_json.from_normalised(tmp_path / "p.json")
    assert str(p.child) == "(a ⋈ b)" and p.attributes == (Attr("a", "name"),)
    scan = lambda t, f="": {"name": "SEQ_SCAN ", "extra_info": f"{t}\n[INFOSEPARATOR]\nid\n[INFOSEPARATOR]\n{f}", "children": []}
    mark = {"name": "HASH_JOIN", "extra_info": "MARK\na.x = #0", "children": [scan("a"), {"name": "CHUNK_SCAN", "extra_info": "", "children": []}]}
    profile = {
        "name": "Query", "children": [{"name": "SIMPLE_AGGREGATE", "extra_info": "min(#0)\nmin(#1)", "children": [
            {"name": "HASH_JOIN", "extra_info": "INNER\na.id = b.a_id", "children": [{"name": "FILTER", "extra_info": "IN (...)", "children": [mark]}, scan("b", "Filters: y>3")]}]}],
    }
    got = plan_json.Profile(profile)
    assert got.tree == ("a", "b", (("a.id", "b.a_id"),)) and got.minimums == ["min(#0)", "min(#1)"]
    assert got.mark_conditions == ["a.x = #0"] and got.constant_lists == 1 and "y>3" in got.filters


def test_bounds():
    assert math.isclose(agm.bound(agm.clique(3), [100] * 3), 1000)
    assert math.isclose(agm.bound(agm.cycle(4), [100] * 4), 100**2)
    assert math.isclose(agm.bound(agm.star(3), [10] * 3), 10**3)
    assert math.isclose(agm.bound(agm.loomis_whitney(3), [100] * 3), 1000)
    assert agm.bound(agm.clique(3), [0, 5, 5]) == 0
    assert agm.is_acyclic(agm.star(4)) and not agm.is_acyclic(agm.cycle(4)) and not agm.is_acyclic(agm.clique(3))
