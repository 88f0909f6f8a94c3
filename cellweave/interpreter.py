"""Evaluation of formulas on values: the semantics that whole-column plans agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .formula.nodes import ArrayLiteral, Binary, Call, CellRef, ErrorLiteral, Invoke, Literal, NameRef, Node, Omitted, RangeRef, SpillRef, TableRef, Unary
from .formula.parser import MAX_COLS, MAX_ROWS, parse
from .functions import REGISTRY
from .functions.mathematics import raise_to
from .functions.registry import broadcast, guarded
from .values import DIV0, NAME, NIMPL, NULL, REF, VALUE, Error, Grid, Lambda, arithmetic, compare, corner, finite, number, text


@dataclass(frozen=True)
class Area:
    """A rectangle on a sheet."""

    sheet: str | None
    row1: int
    col1: int
    row2: int
    col2: int


@dataclass
class Frame:
    """Where a formula stands, and the names of LET and LAMBDA around it."""

    sheet: str | None = None
    row: int | None = None
    col: int | None = None
    names: dict[str, object] = field(default_factory=dict)
    table: str | None = None

    def inner(self) -> Frame:
        return Frame(self.sheet, self.row, self.col, dict(self.names), self.table)


class Source:
    """What an interpreter reads from; a workbook implements it."""

    def cell(self, sheet: str | None, row: int, col: int) -> object:
        return None

    def used(self, sheet: str | None) -> tuple[int, int]:
        return 0, 0

    def name(self, sheet: str | None, name: str) -> Node | object | None:
        return None

    def table_area(self, ref: TableRef, frame: Frame) -> Area | Grid:
        raise Error(NAME)

    def spill(self, sheet: str | None, row: int, col: int) -> Area | None:
        return None

    def formula(self, sheet: str | None, row: int, col: int) -> str | None:
        return None

    def sheet_names(self) -> list[str]:
        return ["Sheet1"]


BINARY: dict[str, Callable[[object, object], object]] = {}


def operator(symbol: str):
    def keep(call):
        BINARY[symbol] = call
        return call

    return keep


operator("+")(lambda a, b: finite(arithmetic(a) + arithmetic(b)))
operator("-")(lambda a, b: finite(arithmetic(a) - arithmetic(b)))
operator("*")(lambda a, b: finite(arithmetic(a) * arithmetic(b)))
operator("^")(lambda a, b: finite(raise_to(arithmetic(a), arithmetic(b))))
operator("&")(lambda a, b: text(a) + text(b))
operator("=")(lambda a, b: compare(a, b) == 0)
operator("<>")(lambda a, b: compare(a, b) != 0)
operator("<")(lambda a, b: compare(a, b) < 0)
operator(">")(lambda a, b: compare(a, b) > 0)
operator("<=")(lambda a, b: compare(a, b) <= 0)
operator(">=")(lambda a, b: compare(a, b) >= 0)


@operator("/")
def divide(a: object, b: object) -> float:
    x, y = arithmetic(a), arithmetic(b)
    if y == 0:
        raise Error(DIV0)
    return finite(x / y)


class Interpreter:
    def __init__(self, source: Source | None = None):
        self.source = source or Source()

    def formula(self, formula: str, frame: Frame | None = None) -> object:
        """The value of a formula; errors are values."""
        return self.result(parse(formula), frame or Frame())

    def result(self, node: Node, frame: Frame) -> object:
        try:
            got = self.value(node, frame)
        except Error as e:
            return e
        except RecursionError:
            return Error("#NUM!")
        return Error("#CALC!") if isinstance(got, Lambda) else got

    # the interface that lazy functions use

    def single(self, node: Node, frame: Frame) -> object:
        got = corner(self.value(node, frame))
        if isinstance(got, Error):
            raise got
        return got

    def number(self, v: object) -> float:
        return number(v)

    def each(self, call: Callable[..., object], args: list[object], errors: bool = False) -> object:
        return broadcast(call, args, errors)

    def formula_at(self, area: Area) -> str | None:
        return self.source.formula(area.sheet, area.row1, area.col1)

    def sheet_number(self, sheet: str | None) -> int:
        names = [n.lower() for n in self.source.sheet_names()]
        return names.index(sheet.lower()) + 1 if sheet and sheet.lower() in names else 1

    def sheet_count(self) -> int:
        return len(self.source.sheet_names())

    def parsed_reference(self, s: str) -> Node:
        try:
            node = parse(s)
        except ValueError as e:
            raise Error(REF) from e
        if not isinstance(node, (CellRef, RangeRef, NameRef, TableRef, SpillRef)):
            raise Error(REF)
        return node

    def read(self, sheet: str | None, row1: int, col1: int, row2: int, col2: int, frame: Frame) -> object:
        sheet = sheet or frame.sheet
        if row1 == row2 and col1 == col2:
            return self.source.cell(sheet, row1, col1)
        rows, cols = self.source.used(sheet)
        if row2 - row1 > 100_000 or col2 - col1 > 1000:  # open ranges end with the used cells
            row2, col2 = max(row1, min(row2, rows)), max(col1, min(col2, cols))
        return Grid([[self.source.cell(sheet, r, c) for c in range(col1, col2 + 1)] for r in range(row1, row2 + 1)], (sheet or "", row1, col1))

    # evaluation

    def value(self, node: Node, frame: Frame) -> object:
        return getattr(self, "on_" + type(node).__name__.lower())(node, frame)

    def on_literal(self, node: Literal, frame: Frame) -> object:
        return node.value

    def on_errorliteral(self, node: ErrorLiteral, frame: Frame) -> object:
        return Error(node.kind)

    def on_omitted(self, node: Omitted, frame: Frame) -> object:
        return 0

    def on_arrayliteral(self, node: ArrayLiteral, frame: Frame) -> object:
        return Grid([[corner(self.value(v, frame)) for v in row] for row in node.rows])

    def on_cellref(self, node: CellRef, frame: Frame) -> object:
        return self.source.cell(node.sheet or frame.sheet, node.row, node.col)

    def on_rangeref(self, node: RangeRef, frame: Frame) -> object:
        a = self.reference(node, frame)
        return self.read(a.sheet, a.row1, a.col1, a.row2, a.col2, frame)

    def on_tableref(self, node: TableRef, frame: Frame) -> object:
        area = self.source.table_area(node, frame)
        return area if isinstance(area, Grid) else self.read(area.sheet, area.row1, area.col1, area.row2, area.col2, frame)

    def on_spillref(self, node: SpillRef, frame: Frame) -> object:
        a = self.reference(node, frame)
        if a is None:
            raise Error(REF)
        got = self.read(a.sheet, a.row1, a.col1, a.row2, a.col2, frame)
        return got if isinstance(got, Grid) else Grid([[got]])

    def on_nameref(self, node: NameRef, frame: Frame) -> object:
        if node.sheet is None and node.name.lower() in frame.names:
            return frame.names[node.name.lower()]
        found = self.source.name(node.sheet or frame.sheet, node.name)
        if found is None:
            raise Error(NAME)
        return self.value(found, frame) if isinstance(found, Node) else found

    def on_unary(self, node: Unary, frame: Frame) -> object:
        if node.op == "@":
            return self.intersect(node.arg, frame)
        v = self.value(node.arg, frame)
        if node.op == "+":
            return v
        if node.op == "%":
            return broadcast(lambda x: arithmetic(x) / 100, [v])
        return broadcast(lambda x: -arithmetic(x), [v])

    def intersect(self, node: Node, frame: Frame) -> object:
        """One value of a range: the one in the formula's row or column."""
        ref = self.reference(node, frame)
        v = self.value(node, frame)
        if ref is None or not isinstance(v, Grid):
            return corner(v)
        row, col = frame.row, frame.col
        if ref.col1 == ref.col2 and row is not None and ref.row1 <= row <= ref.row2:
            return v.rows[row - ref.row1][0]
        if ref.row1 == ref.row2 and col is not None and ref.col1 <= col <= ref.col2:
            return v.rows[0][col - ref.col1]
        if row is not None and col is not None and ref.row1 <= row <= ref.row2 and ref.col1 <= col <= ref.col2:
            return v.rows[row - ref.row1][col - ref.col1]
        raise Error(VALUE)

    def on_binary(self, node: Binary, frame: Frame) -> object:
        if node.op in (":", " ", ","):
            area = self.reference(node, frame)
            if area is None:
                raise Error(REF if node.op == ":" else NULL if node.op == " " else VALUE)
            return self.read(area.sheet, area.row1, area.col1, area.row2, area.col2, frame)
        left, right = self.value(node.left, frame), self.value(node.right, frame)
        return broadcast(BINARY[node.op], [left, right], errors=node.op == "&")

    def reference(self, node: Node, frame: Frame) -> Area | None:
        """The rectangle that a node refers to, if it is a reference."""
        if isinstance(node, CellRef):
            return Area(node.sheet or frame.sheet, node.row, node.col, node.row, node.col)
        if isinstance(node, RangeRef):
            sheet = node.sheet or frame.sheet
            rows, cols = self.source.used(sheet)
            return Area(sheet, node.row1 or 1, node.col1 or 1, node.row2 or min(MAX_ROWS, max(rows, node.row1 or 1)), node.col2 or min(MAX_COLS, max(cols, node.col1 or 1)))
        if isinstance(node, TableRef):
            area = self.source.table_area(node, frame)
            return area if isinstance(area, Area) else None
        if isinstance(node, SpillRef):
            cell = self.reference(node.cell, frame)
            return self.source.spill(cell.sheet, cell.row1, cell.col1) if cell else None
        if isinstance(node, NameRef):
            found = self.source.name(node.sheet or frame.sheet, node.name) if node.name.lower() not in frame.names else None
            return self.reference(found, frame) if isinstance(found, Node) else None
        if isinstance(node, Binary) and node.op in (":", " "):
            a, b = self.reference(node.left, frame), self.reference(node.right, frame)
            if a is None or b is None:
                return None
            if node.op == ":":
                return Area(a.sheet, min(a.row1, b.row1), min(a.col1, b.col1), max(a.row2, b.row2), max(a.col2, b.col2))
            r1, c1, r2, c2 = max(a.row1, b.row1), max(a.col1, b.col1), min(a.row2, b.row2), min(a.col2, b.col2)
            return Area(a.sheet, r1, c1, r2, c2) if r1 <= r2 and c1 <= c2 and a.sheet == b.sheet else None
        if isinstance(node, Call) and node.name in ("INDEX", "OFFSET", "INDIRECT"):
            got = self.value(node, frame)
            if isinstance(got, Grid) and got.ref:
                sheet, row, col = got.ref
                return Area(sheet or None, row, col, row + got.height - 1, col + got.width - 1)
        return None

    def on_call(self, node: Call, frame: Frame) -> object:
        local = frame.names.get(node.name.lower())
        if isinstance(local, Lambda):
            return local.call(*[self.value(a, frame) for a in node.args])
        f = REGISTRY.get(node.name)
        if f is None:
            found = self.source.name(frame.sheet, node.name)
            target = self.value(found, frame) if isinstance(found, Node) else found
            if isinstance(target, Lambda):
                return target.call(*[self.value(a, frame) for a in node.args])
            raise Error(NAME)
        if not f.least <= len(node.args) <= f.most:
            raise Error(VALUE)
        if f.kind == "lazy":
            return f.call(self, frame, node.args)
        args = [None if isinstance(a, Omitted) else self.evaluated(a, frame) for a in node.args]
        if f.kind == "each":
            args = [0 if a is None and isinstance(n, Omitted) else a for a, n in zip(args, node.args, strict=True)]
            return broadcast(f.call, args, f.errors)
        if not f.errors:
            for a in args:
                if isinstance(a, Error):
                    raise a
        return guarded(f.call, args, True)

    def evaluated(self, node: Node, frame: Frame) -> object:
        try:
            return self.value(node, frame)
        except Error as e:
            return e

    def on_invoke(self, node: Invoke, frame: Frame) -> object:
        target = self.value(node.target, frame)
        if not isinstance(target, Lambda):
            raise Error(NIMPL if isinstance(target, Grid) else VALUE)
        return target.call(*[self.value(a, frame) for a in node.args])
