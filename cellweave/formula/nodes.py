"""Syntax tree of a formula."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, Node):
                yield value
            elif isinstance(value, tuple):
                for x in value:
                    if isinstance(x, Node):
                        yield x
                    elif isinstance(x, tuple):
                        yield from (y for y in x if isinstance(y, Node))

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children():
            yield from child.walk()

    def map(self, change) -> Node:
        """A copy whose children went through ``change``."""
        new = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, Node):
                new[f.name] = change(value)
            elif isinstance(value, tuple):
                new[f.name] = tuple(change(x) if isinstance(x, Node) else tuple(change(y) if isinstance(y, Node) else y for y in x) if isinstance(x, tuple) else x for x in value)
        return replace(self, **new) if new else self


@dataclass(frozen=True)
class Literal(Node):
    """A number, text, boolean or error kind (as ErrorLiteral)."""

    value: object


@dataclass(frozen=True)
class ErrorLiteral(Node):
    kind: str


@dataclass(frozen=True)
class Omitted(Node):
    """An argument that was left out between commas."""


@dataclass(frozen=True)
class CellRef(Node):
    """A cell; absolute flags matter when a formula is moved or filled."""

    sheet: str | None
    row: int
    col: int
    row_abs: bool = False
    col_abs: bool = False


@dataclass(frozen=True)
class RangeRef(Node):
    """A rectangle; None stands for an open side (A:A, 1:3)."""

    sheet: str | None
    row1: int | None
    col1: int | None
    row2: int | None
    col2: int | None
    absolute: tuple[bool, bool, bool, bool] = (False, False, False, False)


@dataclass(frozen=True)
class TableRef(Node):
    """T[Col], T[[a]:[b]], T[#All], [@Col]: table None is the row's own table."""

    table: str | None
    first: str | None
    last: str | None
    items: tuple[str, ...] = ()
    this_row: bool = False


@dataclass(frozen=True)
class NameRef(Node):
    sheet: str | None
    name: str


@dataclass(frozen=True)
class SpillRef(Node):
    """A1#: the whole spill that begins in a cell."""

    cell: Node


@dataclass(frozen=True)
class Unary(Node):
    """op is - + @ or % (postfix)."""

    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    """op is an arithmetic, text or comparison operator, or one of the reference operators : , and space."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Invoke(Node):
    """A call of the value of an expression."""

    target: Node
    args: tuple[Node, ...]


@dataclass(frozen=True)
class ArrayLiteral(Node):
    rows: tuple[tuple[Node, ...], ...]
