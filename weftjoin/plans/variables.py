"""Join variables: the classes of columns that a query's equalities make equal, closed transitively."""

from __future__ import annotations

from collections.abc import Iterable

from weftjoin.plans.ir import Attr, Equality


class Variables:
    """Numbered in the order in which the equalities first name a column of the class."""

    def __init__(self, equalities: Iterable[Equality]):
        parent: dict[Attr, Attr] = {}

        def find(a: Attr) -> Attr:
            parent.setdefault(a, a)
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        mentioned: list[Attr] = []
        for left, right in equalities:
            mentioned += [left, right]
            parent[find(right)] = find(left)
        numbers: dict[Attr, int] = {}
        self.of: dict[Attr, int] = {}
        for a in mentioned:
            self.of[a] = numbers.setdefault(find(a), len(numbers))

    def __len__(self) -> int:
        return len(set(self.of.values()))

    def attributes(self, bindings: Iterable[str]) -> list[Attr]:
        """The join columns of some aliases, alias by alias in the order given, sorted within one."""
        return [a for b in bindings for a in sorted(x for x in self.of if x.binding == b)]

    def among(self, bindings: Iterable[str]) -> list[int]:
        """Distinct variables of some aliases, in the order of their columns."""
        return list(dict.fromkeys(self.of[a] for a in self.attributes(bindings)))
