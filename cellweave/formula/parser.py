"""Formula parser: a regular-expression lexer and precedence climbing."""

from __future__ import annotations

import re

from .nodes import ArrayLiteral, Binary, Call, CellRef, ErrorLiteral, Invoke, Literal, NameRef, Node, Omitted, RangeRef, SpillRef, TableRef, Unary

MAX_ROWS, MAX_COLS = 1_048_576, 16_384

#: The error kinds of the value model.
ERRORS = ("#NULL!", "#REF!", "#NAME?", "#VALUE!", "#DIV/0!", "#N/A", "#NUM!", "#ERROR!", "#N/IMPL!", "#SPILL!", "#CALC!", "#CIRC!", "#CANCELLED!")

#: Binding power of binary operators; comparison binds least, the range operator most.
POWER = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5, ",": 8, " ": 9, ":": 11}
PREFIX_POWER = 6

_LEX = re.compile(
    r"""
    (?P<space>[ \t\r\n]+)
  | (?P<string>"(?:[^"]|"")*")
  | (?P<error>\#(?:NULL!|REF!|NAME\?|VALUE!|DIV/0!|N/A|NUM!|ERROR!|N/IMPL!|SPILL!|CALC!|CIRC!|CANCELLED!))
  | (?P<sheet>(?:'(?:[^']|'')+'|[A-Za-z_\u0080-￿][\w.\u0080-￿]*)!)
  | (?P<cols>\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w.(]))
  | (?P<rows>\$?\d+:\$?\d+(?![\w.]))
  | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<cell>\$?[A-Za-z]{1,3}\$?[1-9]\d*(?![\w.(\[]))
  | (?P<name>[A-Za-z_\\\u0080-￿][\w.\\?\u0080-￿]*)
  | (?P<op><>|<=|>=|[-+*/^&=<>%@:,;(){}\[\]\#])
    """,
    re.VERBOSE,
)


class FormulaError(ValueError):
    """The text is not a formula."""


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse(text: str) -> Node:
    """The tree of a formula; a leading = is optional."""
    return _Parser(text[1:] if text.startswith("=") else text).whole()


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise FormulaError(f"unexpected character {text[at]!r} at {at}")
            kind, value = m.lastgroup or "", m.group()
            if kind == "op" and value == "[":
                end = self._bracket(at)
                kind, value = "bracket", text[at:end]
                self.tokens.append((kind, value, at, end))
                at = end
                continue
            self.tokens.append((kind, value, at, m.end()))
            at = m.end()
        self.at = 0

    def _bracket(self, at: int) -> int:
        depth, i = 0, at
        while i < len(self.text):
            c = self.text[i]
            if c == "'" and depth:
                i += 2
                continue
            depth += (c == "[") - (c == "]")
            i += 1
            if not depth:
                return i
        raise FormulaError("a bracket is not closed")

    def peek(self, skip: bool = True) -> tuple[str, str, int, int]:
        i = self.at
        while skip and i < len(self.tokens) and self.tokens[i][0] == "space":
            i += 1
        return self.tokens[i] if i < len(self.tokens) else ("end", "", len(self.text), len(self.text))

    def take(self) -> tuple[str, str, int, int]:
        while self.at < len(self.tokens) and self.tokens[self.at][0] == "space":
            self.at += 1
        token = self.peek()
        self.at += 1
        return token

    def expect(self, value: str) -> None:
        token = self.take()
        if token[1] != value:
            raise FormulaError(f"expected {value!r} at {token[2]}, found {token[1]!r}")

    def whole(self) -> Node:
        node = self.expression(0, True)
        if self.peek()[0] != "end":
            raise FormulaError(f"unexpected {self.peek()[1]!r} at {self.peek()[2]}")
        return node

    def expression(self, least: int, unions: bool) -> Node:
        """unions: a comma joins references here, as it does in parentheses but not between arguments."""
        left = self.prefix(unions)
        while True:
            op = self.operator(unions)
            if op is None or POWER[op] < least:
                return left
            if op != " ":
                self.take()
            right = self.expression(POWER[op] + (op != "^"), unions)
            left = _range(left, right) if op == ":" else Binary(op, left, right)

    def operator(self, unions: bool) -> str | None:
        kind, value, *_ = self.peek()
        if kind == "op" and value in POWER and (value != "," or unions):
            return value
        spaced = self.at < len(self.tokens) and self.tokens[self.at][0] == "space"
        if spaced and (kind in ("cell", "cols", "rows", "name", "sheet") or value == "("):
            return " "
        return None

    def prefix(self, unions: bool) -> Node:
        kind, value, *_ = self.peek()
        if kind == "op" and value in "+-@":
            self.take()
            return Unary(value, self.expression(PREFIX_POWER, unions))
        return self.postfix(self.primary())

    def postfix(self, node: Node) -> Node:
        while True:
            kind, value, *_ = self.peek(skip=False)
            if value == "%" and kind == "op":
                self.take()
                node = Unary("%", node)
            elif value == "#" and kind == "op":
                self.take()
                node = SpillRef(node)
            elif value == "(" and isinstance(node, (Call, Invoke)) and self.at and self.tokens[self.at - 1][1] == ")":
                node = Invoke(node, self.arguments())
            elif self.peek()[1] == "%":
                self.take()
                node = Unary("%", node)
            else:
                return node

    def primary(self) -> Node:
        kind, value, start, _ = self.take()
        if kind == "number":
            return Literal(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "string":
            return Literal(value[1:-1].replace('""', '"'))
        if kind == "error":
            return ErrorLiteral(value.upper())
        if kind == "sheet":
            sheet = value[:-1]
            sheet = sheet[1:-1].replace("''", "'") if sheet.startswith("'") else sheet
            return self.reference(sheet)
        if kind in ("cell", "cols", "rows"):
            self.at -= 1
            return self.reference(None)
        if kind == "name":
            following = self.peek(skip=False)
            if following[1] == "(" and following[0] == "op":
                return Call(value.upper().removeprefix("_XLFN.").removeprefix("_XLWS."), self.arguments())
            if following[0] == "bracket":
                self.take()
                return _table(value, following[1])
            if value.upper() in ("TRUE", "FALSE"):
                return Literal(value.upper() == "TRUE")
            return NameRef(None, value)
        if kind == "bracket":
            return _table(None, value)
        if value == "(":
            node = self.expression(0, True)
            self.expect(")")
            return node
        if value == "{":
            return self.array()
        raise FormulaError(f"unexpected {value or 'end'!r} at {start}")

    def reference(self, sheet: str | None) -> Node:
        kind, value, start, _ = self.take()
        if kind == "cell":
            return _cell(sheet, value)
        if kind == "cols":
            a, b = value.split(":")
            return RangeRef(sheet, None, column_number(a.strip("$")), None, column_number(b.strip("$")), (False, "$" in a, False, "$" in b))
        if kind == "rows":
            a, b = value.split(":")
            return RangeRef(sheet, int(a.strip("$")), None, int(b.strip("$")), None, ("$" in a, False, "$" in b, False))
        if kind == "name":
            return NameRef(sheet, value)
        if kind == "error":
            return ErrorLiteral(value)
        raise FormulaError(f"a reference is missing at {start}")

    def arguments(self) -> tuple[Node, ...]:
        self.expect("(")
        if self.peek()[1] == ")":
            self.take()
            return ()
        out: list[Node] = []
        while True:
            out.append(Omitted() if self.peek()[1] in (",", ")") and self.peek()[0] == "op" else self.expression(0, False))
            kind, value, start, _ = self.take()
            if value == ")" and kind == "op":
                return tuple(out)
            if value != ",":
                raise FormulaError(f"expected , or ) at {start}, found {value!r}")

    def array(self) -> Node:
        rows: list[tuple[Node, ...]] = []
        row: list[Node] = []
        while True:
            row.append(self.expression(0, False))
            _, value, start, _ = self.take()
            if value == ",":
                continue
            rows.append(tuple(row))
            row = []
            if value == "}":
                break
            if value != ";":
                raise FormulaError(f"expected , ; or }} at {start}")
        if len({len(r) for r in rows}) > 1:
            raise FormulaError("rows of an array differ in length")
        return ArrayLiteral(tuple(rows))


def _cell(sheet: str | None, text: str) -> Node:
    m = re.fullmatch(r"(\$?)([A-Za-z]+)(\$?)(\d+)", text)
    col, row = column_number(m[2]), int(m[4])
    if row > MAX_ROWS or col > MAX_COLS:
        return NameRef(sheet, text)
    return CellRef(sheet, row, col, bool(m[3]), bool(m[1]))


def _range(left: Node, right: Node) -> Node:
    if isinstance(left, CellRef) and isinstance(right, CellRef) and right.sheet in (None, left.sheet):
        a, b = left, right
        (r1, ra1), (r2, ra2) = sorted(((a.row, a.row_abs), (b.row, b.row_abs)), key=lambda x: x[0])
        (c1, ca1), (c2, ca2) = sorted(((a.col, a.col_abs), (b.col, b.col_abs)), key=lambda x: x[0])
        return RangeRef(a.sheet, r1, c1, r2, c2, (ra1, ca1, ra2, ca2))
    return Binary(":", left, right)


def _unquote(name: str) -> str:
    return re.sub(r"'(.)", r"\1", name.strip())


def _table(table: str | None, text: str) -> Node:
    """Structured references: what stands in the brackets, outer pair included."""
    inner = text[1:-1].strip()
    if inner.startswith("@"):
        column = inner[1:].strip()
        if column.startswith("[") and "]:[" in column:
            a, b = column[1:-1].split("]:[")
            return TableRef(table, _unquote(a), _unquote(b), (), True)
        column = column[1:-1] if column.startswith("[") else column
        return TableRef(table, _unquote(column) or None, _unquote(column) or None, (), True)
    if not inner.startswith("["):
        if inner.startswith("#"):
            return TableRef(table, None, None, (inner.lower(),), inner.lower() == "#this row")
        return TableRef(table, _unquote(inner) or None, _unquote(inner) or None)
    parts = re.findall(r"\[((?:'.|[^\]'])*)\]", inner)
    items = tuple(p.strip().lower() for p in parts if p.strip().startswith("#"))
    columns = [_unquote(p) for p in parts if not p.strip().startswith("#")]
    first = columns[0] if columns else None
    return TableRef(table, first, columns[-1] if columns else None, items, "#this row" in items)
