"""Join trees: scans of aliased tables, binary joins as a query states them, and flattened n-ary joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True, order=True)
class Attr:
    """A column of an aliased table."""

    binding: str
    name: str

    @classmethod
    def of(cls, text: str) -> Attr:
        binding, _, name = text.strip().partition(".")
        return cls(binding, name)

    @property
    def column(self) -> str:
        """Its name in a DataFrame of the engine, where several aliases of one table may meet."""
        return f"{self.binding}__{self.name}"

    def __str__(self) -> str:
        return f"{self.binding}.{self.name}"


Equality = tuple[Attr, Attr]


@dataclass(frozen=True)
class Scan:
    binding: str
    table: str = ""

    @property
    def bindings(self) -> tuple[str, ...]:
        return (self.binding,)

    def __str__(self) -> str:
        return self.binding


@dataclass(frozen=True)
class BinaryJoin:
    left: Node
    right: Node
    equalities: tuple[Equality, ...] = ()

    @property
    def bindings(self) -> tuple[str, ...]:
        return self.left.bindings + self.right.bindings

    def __str__(self) -> str:
        return f"({self.left} ⋈ {self.right})"


@dataclass(frozen=True)
class NaryJoin:
    """Inputs joined together; an input is a scan or an n-ary join of its own."""

    inputs: tuple[Node, ...]
    equalities: tuple[Equality, ...] = ()

    @property
    def bindings(self) -> tuple[str, ...]:
        return tuple(b for i in self.inputs for b in i.bindings)

    def led_by(self, index: int) -> NaryJoin:
        """The same join with input ``index`` and the first one exchanged."""
        inputs = list(self.inputs)
        inputs[0], inputs[index] = inputs[index], inputs[0]
        return NaryJoin(tuple(inputs), self.equalities)

    def __str__(self) -> str:
        return f"FJ({' '.join(map(str, self.inputs))})"


Node = Scan | BinaryJoin | NaryJoin


@dataclass(frozen=True)
class Project:
    child: Node
    attributes: tuple[Attr, ...]
    minimum: bool = False

    def __str__(self) -> str:
        return f"π({self.child})"


def equalities_under(node: Node) -> Iterator[Equality]:
    if isinstance(node, BinaryJoin):
        yield from node.equalities
        yield from equalities_under(node.left)
        yield from equalities_under(node.right)
    elif isinstance(node, NaryJoin):
        yield from node.equalities
        for i in node.inputs:
            yield from equalities_under(i)


def flatten(node: Node) -> Node:
    """One n-ary join for each left spine; a join that is a right input becomes an n-ary join of its own."""
    if not isinstance(node, BinaryJoin):
        return node
    spine: list[BinaryJoin] = []
    first: Node = node
    while isinstance(first, BinaryJoin):
        spine.append(first)
        first = first.left
    inputs = [flatten(first), *(flatten(j.right) for j in reversed(spine))]
    return NaryJoin(tuple(inputs), tuple(e for j in reversed(spine) for e in j.equalities))
