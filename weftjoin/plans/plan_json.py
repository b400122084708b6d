"""Plans from JSON: normalised plans, and query profiles as DuckDB writes them."""

from __future__ import annotations

import itertools
import json
import re
from pathlib import Path

from weftjoin.plans import profile_sql
from weftjoin.plans.ir import Attr, BinaryJoin, Node, Project, Scan, equalities_under
from weftjoin.plans.variables import Variables

_SEPARATOR = "[INFOSEPARATOR]"


def load(source: str | Path | dict) -> dict:
    return source if isinstance(source, dict) else json.loads(Path(source).read_text())


def _attr(x: dict) -> Attr:
    return Attr(x["binding"], x["attribute"])


def from_normalised(source: str | Path | dict) -> Project:
    """``projection`` over ``hashjoin`` and ``scan`` nodes; the columns' ordinals in the file are not needed."""

    def node(x: dict) -> Node:
        name = x["name"].lower()
        if name == "scan":
            return Scan(x["binding"], x.get("table", ""))
        if name == "hashjoin":
            left, right = map(node, x["children"])
            return BinaryJoin(left, right, tuple((_attr(c["left"]), _attr(c["right"])) for c in x["conditions"]))
        raise ValueError(f"no such node in a join tree: {x['name']}")

    root = load(source)
    if root["name"].lower() != "projection":
        raise ValueError("a normalised plan begins with a projection")
    return Project(node(root["children"][0]), tuple(map(_attr, root["attributes"])))


def scans(node: Node) -> list[Scan]:
    """The scans of a join tree, from left to right."""
    if isinstance(node, Scan):
        return [node]
    return [s for x in ((node.left, node.right) if isinstance(node, BinaryJoin) else node.inputs) for s in scans(x)]


def to_normalised(plan: Project) -> dict:
    """The JSON that ``from_normalised`` reads; ``fj_attribute_idx`` numbers the join variables, -1 stands for columns that are only projected."""
    tables, variables = {s.binding: s.table for s in scans(plan.child)}, Variables(equalities_under(plan.child))

    def column(a: Attr) -> dict:
        return {"binding": a.binding, "attribute": a.name, "table": tables[a.binding]}

    def numbered(a: Attr) -> dict:
        return column(a) | {"fj_attribute_idx": variables.of.get(a, -1)}

    def node(x: Node) -> dict:
        if isinstance(x, Scan):
            required = dict.fromkeys([*variables.attributes([x.binding]), *(a for a in plan.attributes if a.binding == x.binding)])
            return {"name": "scan", "table": x.table, "binding": x.binding, "required_attributes": [numbered(a) for a in required]}
        return {"name": "hashjoin", "conditions": [{"left": numbered(a), "right": numbered(b)} for a, b in x.equalities], "children": [node(x.left), node(x.right)]}

    return {"name": "projection", "attributes": [column(a) for a in plan.attributes], "children": [node(plan.child)]}


def _bound(tree, alias: dict[int, str], leaves: list[str]) -> Node | None:
    """The tree with these aliases, or None where a condition's sides aren't below the join's."""
    if isinstance(tree, int):
        return Scan(alias[tree], leaves[tree])
    left, right = (_bound(x, alias, leaves) for x in tree[:2])
    if left is None or right is None:
        return None
    equalities = tuple((Attr.of(a), Attr.of(b)) for a, b in tree[2])
    if any(a.binding not in left.bindings or b.binding not in right.bindings for a, b in equalities):
        return None
    return BinaryJoin(left, right, equalities)


class Profile:
    """What a profile tells: the join tree, filters as they stand, minimums and constant lists of MARK joins.

    ``plan`` is the tree over aliases, with the conditions as the profile has them, and ``filters_of`` what each alias is
    filtered by; both need the SQL text at the profile's root, which alone has the values of long lists and the aliases.
    """

    def __init__(self, source: str | Path | dict):
        self.filters: list[str] = []
        self.minimums: list[str] = []
        self.mark_conditions: list[str] = []
        self.constant_lists = 0
        self.scans: list[str] = []
        root = load(source)
        self.sql = (root.get("extra_info") or "").strip()
        self.tree = self._node(root)

    @property
    def query(self) -> profile_sql.SqlQuery:
        return profile_sql.parse(self.sql)

    @property
    def filters_of(self) -> dict[str, list[str]]:
        return self.query.filters

    def plan(self) -> Project:
        """The join tree over aliases: of a table's aliases, each scan has the one that the conditions above it ask for."""
        query, leaves = self.query, []

        def number(x):
            if isinstance(x, str):
                leaves.append(x)
                return len(leaves) - 1
            return (number(x[0]), number(x[1]), x[2])

        tree = number(self.tree)
        names = sorted(set(leaves))
        aliases = {t: sorted(a for a, of in query.tables.items() if of == t) for t in names}
        places = {t: [i for i, leaf in enumerate(leaves) if leaf == t] for t in names}
        for choice in itertools.product(*(itertools.permutations(aliases[t], len(places[t])) for t in names)):
            alias = {i: a for t, chosen in zip(names, choice, strict=True) for i, a in zip(places[t], chosen, strict=True)}
            if (node := _bound(tree, alias, leaves)) is not None:
                return Project(node, tuple(a for a, _ in query.minimums), minimum=True)
        raise ValueError("no choice of aliases fits the profile's conditions")

    def _node(self, x: dict):
        """A nested (left, right, conditions) tree of table names; filters and aggregates are noted, not dropped."""
        name, info = x.get("name", "").strip().upper(), x.get("extra_info", "") or ""
        children = [c for c in map(self._node, x.get("children", [])) if c is not None]
        if name == "SIMPLE_AGGREGATE":
            self.minimums += [line for line in info.splitlines() if line.startswith("min(")]
        elif name == "FILTER":
            self.filters.append(info.replace(_SEPARATOR, " ").strip())
        elif name == "SEQ_SCAN":
            table = info.split(_SEPARATOR)[0].strip()
            self.scans.append(table)
            self.filters += [m.strip() for m in re.findall(r"Filters:\s*(.*)", info)]
            return table
        elif name in ("CHUNK_SCAN", "COLUMN_DATA_SCAN"):
            self.constant_lists += 1
            return None
        elif name == "HASH_JOIN":
            lines = [y.strip() for y in info.replace(_SEPARATOR, "\n").splitlines() if y.strip()]
            if "MARK" in (y.upper() for y in lines):
                self.mark_conditions += [y for y in lines if "=" in y]
                return children[0]  # the list side is a membership test, not a relation
            return (children[0], children[1], tuple(tuple(p.strip() for p in y.split("=", 1)) for y in lines if re.fullmatch(r"[^=]+=[^=]+", y)))
        return children[0] if children else None
