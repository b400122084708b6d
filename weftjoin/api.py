"""The query builder: aliased tables, filters, equality joins of any shape, a projection or a global minimum."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftjoin.operators import auto, factorised, hypercube, native, trie
from weftjoin.operators.inputs import Options, prepare, scan
from weftjoin.plans import fjplan
from weftjoin.plans.ir import Attr, BinaryJoin, Equality, NaryJoin, Node, Project, Scan, equalities_under, flatten
from weftjoin.plans.plan_json import Profile, scans
from weftjoin.plans.variables import Variables

STRATEGIES = {"native": native.run, "reduced": native.reduced, "trie": trie.run, "hypercube": hypercube.run, "auto": auto.run}

Shape = str | tuple


class Query:
    """``Query({"o": orders, "c": customer}).join("o.o_custkey = c.c_custkey").select("c.c_name").to_df()``

    ``shape`` nests aliases as ``("o", "c", ("l", "p"))``: a left spine, and joins of their own as right inputs;
    without it the aliases are joined in the order given.
    """

    def __init__(self, tables: Mapping[str, DataFrame], shape: Shape | None = None):
        self.tables = dict(tables)
        self.shape: Shape = shape or tuple(self.tables)
        self.equalities: list[Equality] = []
        self.project: list[tuple[Attr, str]] = []
        self.minimum = False
        self.options = Options()

    @classmethod
    def from_plan(cls, plan: Project, tables: Mapping[str, DataFrame]) -> Query:
        """A query from a plan tree; the join shape and the equalities are the tree's."""
        out = cls({b: tables[b] for b in plan.child.bindings}, _shape(plan.child))
        out.equalities = list(equalities_under(plan.child))
        out.project = [(a, a.name) for a in plan.attributes]
        out.minimum = plan.minimum
        return out

    @classmethod
    def from_profile(cls, profile: Profile, tables: Mapping[str, DataFrame]) -> Query:
        """The query that a captured profile ran, over ``tables`` by table name: its join tree, filters and minimums."""
        query, plan = profile.query, profile.plan()
        out = cls.from_plan(plan, {alias: tables[name] for alias, name in query.tables.items()})
        for alias, conditions in query.filters.items():
            for c in conditions:
                out.where(alias, c)
        out.project = list(query.minimums)
        return out

    def where(self, binding: str, condition: str | Column | Callable[[DataFrame], Column]) -> Query:
        df = self.tables[binding]
        self.tables[binding] = df.filter(condition(df) if callable(condition) and not isinstance(condition, Column) else condition)
        return self

    def join(self, *equalities: str) -> Query:
        for e in equalities:
            left, right = e.split("=")
            self.equalities.append((Attr.of(left), Attr.of(right)))
        return self

    def select(self, *columns: str, **renamed: str) -> Query:
        self.project += [(Attr.of(c), Attr.of(c).name) for c in columns] + [(Attr.of(c), n) for n, c in renamed.items()]
        return self

    def min(self, *columns: str, **renamed: str) -> Query:
        self.minimum = True
        return self.select(**{f"min_{Attr.of(c).name}": c for c in columns}, **renamed)

    def plan(self, kind: str = "fully_active", leftmost: str = "smart", strategy: str = "native") -> Query:
        if kind not in fjplan.KINDS or strategy not in STRATEGIES:
            raise ValueError(f"plan kinds: {', '.join(fjplan.KINDS)}; strategies: {', '.join(STRATEGIES)}")
        self.options = Options(kind, leftmost, strategy)
        return self

    @property
    def variables(self) -> Variables:
        return Variables(self.equalities)

    def tree(self) -> Node:
        return flatten(self._binary(self.shape))

    def _binary(self, shape: Shape) -> Node:
        if isinstance(shape, str):
            return Scan(shape)
        node = self._binary(shape[0])
        for part in shape[1:]:
            right = self._binary(part)
            left_of, right_of = set(node.bindings), set(right.bindings)
            mine = tuple(e for e in self.equalities if {e[0].binding, e[1].binding} & left_of and {e[0].binding, e[1].binding} & right_of)
            node = BinaryJoin(node, right, mine)
        return node

    def fj_plans(self) -> list[tuple[NaryJoin, fjplan.FJPlan]]:
        """The plan of every n-ary join in the order of the tree, nested ones first, with the first input leading."""
        out, variables = [], self.variables

        def visit(node: Node) -> None:
            if isinstance(node, NaryJoin):
                for i in node.inputs:
                    visit(i)
                out.append((node, fjplan.KINDS[self.options.kind](node, variables)))

        visit(self.tree())
        return out

    def factorised(self, count: str | None = None) -> DataFrame:
        """The minimums, or the number of rows under the name ``count``, from reduced inputs; the join's rows are never made.

        An inner join is the same in any order, so nested joins are taken apart and the inputs joined as they stand.
        """
        variables, wanted = self.variables, set() if count else {a for a, _ in self.project}
        inputs = [scan(self.tables[s.binding], s.binding, variables, wanted) for s in scans(self._binary(self.shape))]
        out = factorised.aggregate(inputs, list(range(len(inputs))), counted=count is not None)
        return out.select(F.col(factorised.COUNT).alias(count)) if count else out.select(*[F.col(a.column).alias(n) for a, n in self.project])

    def to_df(self) -> DataFrame:
        wanted = {a for a, _ in self.project}
        result = prepare(self.tree(), self.tables, self.variables, wanted, self.options, STRATEGIES[self.options.strategy])
        if self.minimum:
            return result.df.agg(*[F.min(a.column).alias(n) for a, n in self.project])
        return result.df.select(*[F.col(a.column).alias(n) for a, n in self.project])

    def count(self, name: str = "n") -> DataFrame:
        """The number of rows, repetitions included; by ``factorised`` unless another strategy than ``native`` or ``auto`` is asked for."""
        if self.options.strategy in ("native", "auto"):
            return self.factorised(name)
        return prepare(self.tree(), self.tables, self.variables, set(), self.options, STRATEGIES[self.options.strategy]).df.agg(F.count(F.lit(1)).alias(name))

    def explain_fj(self) -> DataFrame:
        """One row per node of every plan: join, node, atoms, attributes, covers."""
        spark = next(iter(self.tables.values())).sparkSession
        rows = [(str(join), k, len(n), sum(len(a.attributes) for a in n), sum(a.cover for a in n), "".join(map(str, n))) for join, p in self.fj_plans() for k, n in enumerate(p.nodes)]
        return spark.createDataFrame(rows, "join string, node int, n_atoms int, n_attributes int, n_covers int, atoms string")

    def __str__(self) -> str:
        return str(Project(self.tree(), tuple(a for a, _ in self.project)))


def _shape(node: Node) -> Shape:
    if isinstance(node, Scan):
        return node.binding
    left = _shape(node.left)
    return (*left, _shape(node.right)) if isinstance(left, tuple) else (left, _shape(node.right))
