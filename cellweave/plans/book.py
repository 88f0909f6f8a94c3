"""The book: tables, names and formulas over Spark frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formula.nodes import Literal, NameRef, Node, TableRef
from ..formula.parser import parse
from ..functions import REGISTRY, register_custom, unregister_custom
from ..operators.order import Key, Places
from . import columns as C
from .columns import Ex, Unsupported
from .relations import Compiler
from .rows import Rows


@dataclass
class Table:
    """A frame, the keys of its row order, and columns given by formulas."""

    df: DataFrame
    order: list[Key]
    formulas: dict[str, Node] = field(default_factory=dict)
    hidden: Column | None = None
    anchors: dict[str, int] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [*self.df.columns, *self.formulas]


class Book:
    """Spreadsheet formulas over whole tables.

    Tables are frames with named columns; a formula over a row names its columns as [@Column], a
    formula over a table as Table[Column]. Formulas compile to Spark expressions, joins and windows.
    Errors become nulls in results; ``select(..., errors=True)`` adds a column with the error kinds.
    """

    def __init__(self, spark: SparkSession, seed: int = 1):
        self.spark, self.seed = spark, seed
        self.tables: dict[str, Table] = {}
        self.names: dict[str, object] = {}
        self._frames: dict[str, DataFrame] = {}
        self._kinds: dict[str, dict[str, T.DataType]] = {}
        self.places: dict[tuple[str, str], Places] = {}

    # -- definitions

    def table(self, name: str, df: DataFrame, order: Iterable[str | Key] = (), hidden: Column | None = None) -> Book:
        """order: columns (or pairs of column and ascending) whose order is the order of the rows."""
        keys = [(k, True) if isinstance(k, str) else k for k in order]
        self.tables[name.lower()] = Table(df, keys, hidden=hidden)
        self.changed()
        return self

    def name(self, name: str, value: object) -> Book:
        """A constant, or the text of a formula."""
        self.changed()
        self.names[name.lower()] = parse(value) if isinstance(value, str) and value.startswith("=") else Literal(value) if not isinstance(value, Node) else value
        return self

    def column(self, table: str, name: str, formula: str, anchor: int | None = None) -> Book:
        """A computed column. With an anchor, cell references are relative to that row, as in a filled formula."""
        t = self.tables[table.lower()]
        t.formulas[name] = parse(formula)
        if anchor is not None:
            t.anchors[name] = anchor
        self.changed()
        return self

    def changed(self) -> None:
        self._frames.clear()
        self.places.clear()

    def register(self, name: str, call: Callable[..., object], least: int = 0, most: int | None = None, returns: str = "num", volatile: bool = False, override: bool = False) -> Book:
        """A function of the user's; over rows it runs in Arrow batches."""
        register_custom(name, call, least, most, volatile, override)
        C.TEXT_RESULTS.discard(name.upper())
        C.BOOL_RESULTS.discard(name.upper())
        if returns == "text":
            C.TEXT_RESULTS.add(name.upper())
        elif returns == "bool":
            C.BOOL_RESULTS.add(name.upper())
        return self

    def unregister(self, name: str) -> Book:
        unregister_custom(name)
        return self

    def functions(self) -> list[str]:
        return sorted(REGISTRY)

    # -- what the compiler asks

    def order_of(self, table: str) -> list[Key]:
        if not self.tables[table].order:
            raise Unsupported(f"the rows of {table} have no order; give one to table()")
        return self.tables[table].order

    def hidden(self, table: str) -> Column | None:
        return self.tables[table].hidden

    def table_of(self, nodes: Iterable[Node]) -> str:
        found = {n.table.lower() for node in nodes for n in node.walk() if isinstance(n, TableRef) and n.table and not n.this_row}
        if len(found) != 1:
            raise Unsupported("columns of one table are needed here")
        name = found.pop()
        if name not in self.tables:
            raise Unsupported(f"an unknown table {name}")
        return name

    def frame(self, table: str) -> DataFrame:
        """The table with its computed columns, each after the columns it uses."""
        table = table.lower()
        if table not in self._frames:
            t = self.tables[table]
            df = t.df
            self._kinds[table] = {f.name: f.dataType for f in df.schema.fields}
            for name in self.sequence(table):
                rows = Rows(self, table, t.anchors.get(name))
                x = rows.compile(self.bound(t.formulas[name]))
                df = rows.applied(df).withColumn(name, C.guard(x.col, x.err))
                df = df.select(*[c for c in df.columns if not c.startswith(f"__{table}_")])
                self._kinds[table][name] = df.schema[name].dataType
            self._frames[table] = df.select(*[F.col(f"`{c}`") for c in t.names()])
        return self._frames[table]

    def sequence(self, table: str) -> list[str]:
        """Computed columns in an order in which each comes after those it needs."""
        formulas = self.tables[table].formulas
        low = {n.lower(): n for n in formulas}
        out: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise Unsupported(f"column {name} depends on itself (#CIRC!)")
            if name in out:
                return
            for n in formulas[name].walk():
                if isinstance(n, TableRef) and n.first and (n.table is None or n.table.lower() == table) and n.first.lower() in low:
                    visit(low[n.first.lower()], (*above, name))
            out.append(name)

        for name in formulas:
            visit(name, ())
        return out

    def column_ex(self, table: str, name: str) -> Ex:
        if table in self._kinds and name in self._kinds[table]:
            kind = self._kinds[table][name]
        else:
            kind = self.frame(table).schema[name].dataType
        return C.of_column(F.col(f"`{name}`"), kind)

    def bound(self, node: Node) -> Node:
        """A name that is a table's becomes a reference to the whole table."""
        node = node.map(self.bound)
        if isinstance(node, NameRef) and node.sheet is None and node.name.lower() in self.tables and node.name.lower() not in self.names:
            return TableRef(node.name, None, None)
        return node

    def parsed(self, formula: str) -> Node:
        return self.bound(parse(formula))

    # -- results

    def select(self, table: str, formulas: Mapping[str, str], keep: Iterable[str] = (), errors: bool = False, anchor: int | None = None) -> DataFrame:
        """One row for each row of the table: the kept columns and the formulas' values.

        All formulas share their steps, so lookups with one key or aggregates of one table are one join.
        """
        table = table.lower()
        base = self.frame(table)
        rows = Rows(self, table, anchor)
        made = {n: rows.compile(self.parsed(f)) for n, f in formulas.items()}
        df = rows.applied(base)
        out = [F.col(f"`{c}`") for c in keep]
        for n, x in made.items():
            value = C.guard(x.col, x.err)
            if x.kind == "num":
                value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
            out.append(value.alias(n))
            if errors:
                err = x.err if x.err is not None else F.lit(None).cast("string")
                if x.kind == "num":
                    err = F.coalesce(err, C.flag("#NUM!", F.isnan(x.col) | (F.abs(x.col) == float("inf"))))
                out.append(err.alias(f"{n}__err"))
        return df.select(*out)

    def query(self, formula: str) -> DataFrame:
        """The frame that an array formula spills."""
        return Compiler(self).relation(self.parsed(formula)).frame()

    def scalars(self, formulas: Mapping[str, str], errors: bool = False) -> DataFrame:
        """One row with the values of formulas over whole tables; a table is read once for all of them."""
        rows = Rows(self, "")
        made = {n: rows.compile(self.parsed(f)) for n, f in formulas.items()}
        df = rows.applied(self.spark.range(1))
        out = []
        for n, x in made.items():
            out.append(C.guard(x.col, x.err).alias(n))
            if errors:
                out.append((x.err if x.err is not None else F.lit(None).cast("string")).alias(f"{n}__err"))
        return df.select(*out)

    def scalar(self, formula: str, name: str = "value") -> DataFrame:
        return self.scalars({name: formula})

    def scalar_frame(self, node: Node) -> DataFrame:
        rows = Rows(self, "")
        x = rows.compile(node)
        return rows.applied(self.spark.range(1)).select(C.guard(x.col, x.err).alias("value"))

    def value(self, formula: str) -> object:
        """The value of a formula over whole tables, fetched; an error comes back as its kind."""
        row = self.scalars({"v": formula}, errors=True).first()
        return row["v__err"] if row["v__err"] is not None else row["v"]

    def plan(self, df: DataFrame) -> str:
        return df._jdf.queryExecution().toString()


