"""Row formulas as columns.

Compiling a formula over a table's rows gives an expression and a list of steps (joins and windows)
that bring in what the expression needs: one-row aggregates, group-joins for criteria that depend on
the row, lookups, ranks and frames. Steps with the same source and key are one join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..formula.nodes import ArrayLiteral, Binary, Call, CellRef, ErrorLiteral, Invoke, Literal, NameRef, Node, Omitted, RangeRef, TableRef, Unary
from ..formula.parser import parse
from ..operators import lookup, order
from ..values import NA, REF, VALUE, Error, Grid, criterion, has_wildcard
from . import aggregates as A
from . import columns as C
from .columns import Ex, Unsupported, literal
from .criteria import predicate


#: Reductions of FILTER(column, tests) and the criteria aggregates that say the same.
FILTERED = {"SUM": "SUMIFS", "AVERAGE": "AVERAGEIFS", "MAX": "MAXIFS", "MIN": "MINIFS", "COUNT": "COUNTIFS", "COUNTA": "COUNTIFS", "ROWS": "COUNTIFS"}

#: Reductions of FILTER that have no such aggregate, with how many arguments they have then.
GATHERED = {"MEDIAN": 1, "LARGE": 2, "SMALL": 2, "TEXTJOIN": 3, "STDEV.S": 1, "STDEV.P": 1, "VAR.S": 1, "VAR.P": 1, "PRODUCT": 1}


@dataclass
class Step:
    """A change of the frame; columns may be added to it until it is applied."""

    apply: Callable[[DataFrame, dict], DataFrame]
    wants: dict = field(default_factory=dict)


@dataclass
class Closure:
    params: list[str]
    body: Node
    names: dict


class Rows:
    def __init__(self, book, table: str, anchor: int | None = None):
        self.book, self.table, self.anchor = book, table, anchor
        self.steps: dict[object, Step] = {}
        self.found: dict[object, str] = {}
        self.base: DataFrame | None = None
        self.count = 0

    # -- plumbing

    def fresh(self) -> str:
        self.count += 1
        return f"__{self.table}_{self.count}"

    def step(self, key: object, apply: Callable[[DataFrame, dict], DataFrame]) -> Step:
        if key not in self.steps:
            self.steps[key] = Step(apply)
        return self.steps[key]

    def applied(self, df: DataFrame) -> DataFrame:
        self.base = df
        for step in list(self.steps.values()):
            df = step.apply(df, step.wants)
        return df

    def array_over(self, table: str, names: dict) -> Callable[[Node], Ex]:
        inner = Array(self.book, table)

        def compile_(node: Node) -> Ex:
            got = inner.compile(node, names)
            if inner.steps:
                raise Unsupported("a lookup or aggregate inside an aggregated expression; add it to the table as a column first")
            return got

        return compile_

    # -- expressions

    def compile(self, node: Node, names: dict | None = None) -> Ex:
        return getattr(self, "on_" + type(node).__name__.lower())(node, names or {})

    def on_literal(self, node: Literal, names: dict) -> Ex:
        return literal(node.value)

    def on_errorliteral(self, node: ErrorLiteral, names: dict) -> Ex:
        return literal(Error(node.kind))

    def on_omitted(self, node: Omitted, names: dict) -> Ex:
        return literal(0)

    def on_arrayliteral(self, node: ArrayLiteral, names: dict) -> Ex:
        return self.compile(node.rows[0][0], names)

    def on_nameref(self, node: NameRef, names: dict) -> Ex:
        held = names.get(node.name.lower())
        if held is None:
            held = self.book.names.get(node.name.lower())
            if held is None:
                return literal(Error("#NAME?"))
        return held if isinstance(held, Ex) else self.compile(held, names) if isinstance(held, Node) else literal(held)

    def on_tableref(self, node: TableRef, names: dict) -> Ex:
        if node.this_row or node.table is None or self.reads(node):
            return self.column(node.first)
        raise Unsupported(f"a whole column of {node.table} where one value is wanted")

    def reads(self, node: TableRef) -> bool:
        """Whether T[Col] means the row's own value here."""
        return False

    def column(self, name: str | None) -> Ex:
        found = {c.lower(): c for c in self.book.tables[self.table].names()}.get((name or "").lower())
        if found is None:
            return literal(Error(REF))
        return self.book.column_ex(self.table, found)

    def on_unary(self, node: Unary, names: dict) -> Ex:
        x = self.compile(node.arg, names)
        if node.op in "+@":
            return x
        n = C.num(x)
        if n.literal and not isinstance(n.const, Error):
            return literal(-n.const if node.op == "-" else n.const / 100)
        return Ex("num", -n.col if node.op == "-" else n.col / 100, n.err)

    def on_binary(self, node: Binary, names: dict) -> Ex:
        a, b = self.compile(node.left, names), self.compile(node.right, names)
        if node.op == "&":
            return C.concat(a, b)
        if node.op in "+-*/^":
            return C.arithmetic(node.op, a, b)
        if node.op in (":", " ", ","):
            return literal(Error(REF))
        return C.compare(node.op, a, b)

    def on_invoke(self, node: Invoke, names: dict) -> Ex:
        target = self.closure(node.target, names)
        return self.applied_closure(target, node.args, names)

    def closure(self, node: Node, names: dict) -> Closure:
        if isinstance(node, Call) and node.name == "LAMBDA":
            return Closure([a.name.lower() for a in node.args[:-1] if isinstance(a, NameRef)], node.args[-1], dict(names))
        if isinstance(node, NameRef):
            held = names.get(node.name.lower(), self.book.names.get(node.name.lower()))
            if isinstance(held, Closure):
                return held
            if isinstance(held, Node):
                return self.closure(held, names)
        raise Unsupported("a call of something that is no function")

    def applied_closure(self, f: Closure, args: tuple[Node, ...], names: dict) -> Ex:
        if len(args) != len(f.params):
            return literal(Error(VALUE))
        return self.compile(f.body, f.names | {p: self.compile(a, names) for p, a in zip(f.params, args, strict=True)})

    def row_bound(self, node: Node, names: dict) -> bool:
        """Whether a node depends on the row."""
        return any(isinstance(n, TableRef) and (n.this_row or n.table is None) or isinstance(n, CellRef) or isinstance(n, NameRef) and isinstance(names.get(n.name.lower()), Ex) and not names[n.name.lower()].literal for n in node.walk())

    def on_call(self, node: Call, names: dict) -> Ex:
        name, args = node.name, node.args
        held = names.get(name.lower(), self.book.names.get(name.lower()))
        if isinstance(held, Closure) or isinstance(held, Call) and held.name == "LAMBDA":
            return self.applied_closure(held if isinstance(held, Closure) else self.closure(held, names), args, names)
        if name == "LET":
            inner = dict(names)
            for k, v in zip(args[:-1:2], args[1:-1:2], strict=True):
                inner[k.name.lower()] = self.closure(v, inner) if isinstance(v, Call) and v.name == "LAMBDA" else self.compile(v, inner)
            return self.compile(args[-1], inner)
        if self.anchor is not None and args and isinstance(args[0], RangeRef):
            return self.frame_function(name, args, names)
        if name in FILTERED and len(args) == 1 and isinstance(args[0], Call) and args[0].name == "FILTER" and self.row_bound(args[0], names):
            pairs = self.equalities(args[0].args[1])
            if pairs is not None:  # the rows of another table that belong to this one
                tests = tuple(x for p in pairs for x in p)
                n = self.on_call(Call("COUNTIFS", tests), names)
                got = n if FILTERED[name] == "COUNTIFS" else self.on_call(Call(FILTERED[name], (args[0].args[0], *tests)), names)
                return Ex(got.kind, got.col, C.errors(C.flag("#CALC!", n.col == 0), got))
        at = 2 if name == "TEXTJOIN" else 0
        if name in GATHERED and len(args) == GATHERED[name] and isinstance(args[at], Call) and args[at].name == "FILTER" and len(args[at].args) == 2 and self.row_bound(args[at], names):
            tests = self.equalities(args[at].args[1])
            if tests is not None:
                return self.filter_reduce(name, args[at].args[0], tests, args[:at] + args[at + 1 :], names)
        whole = [a for a in args if self.is_range(a)]
        if name in A.CRITERIA and whole and any(self.row_bound(a, names) for a in args):
            return self.group_join(name, args, names)
        if name in ("XLOOKUP", "XMATCH", "MATCH", "VLOOKUP", "LOOKUP", "HLOOKUP"):
            return self.lookup(name, args, names)
        if name == "INDEX" and len(args) >= 2 and isinstance(args[1], Call) and args[1].name in ("MATCH", "XMATCH"):
            m = args[1]
            mode = m.args[2] if len(m.args) > 2 else Literal(1 if m.name == "MATCH" else 0)
            wanted = A.number_of(mode)
            return self.find(m.args[0], m.args[1], args[0], {0: 0, 1: -1, -1: 1}[int(wanted)] if m.name == "MATCH" else int(wanted), 1, None, names)
        if name in ("RANK.EQ", "RANK", "RANK.AVG", "PERCENTRANK.INC", "PERCENTRANK") and whole:
            return self.rank(name, args, names)
        if A.is_reduction(node) and whole and not any(self.row_bound(a, names) for a in args):
            return self.one_row(node, names)
        if name in ("COLUMN", "COLUMNS", "ISREF", "SHEET", "SHEETS", "ISFORMULA", "INDIRECT"):
            return self.shape(name, args, names)
        if name == "INDEX" and whole and not any(self.row_bound(a, names) for a in args):
            from .relations import Compiler

            got = Compiler(self.book).on_index(args).frame()
            v, (column, *_) = self.fresh(), got.columns
            kind = got.schema[0].dataType
            one = got.limit(1).agg(F.first(F.col(f"`{column}`")).alias(v), F.count(F.lit(1)).alias(f"{v}_n"))
            self.step(("one", v), lambda df, wants: df.crossJoin(F.broadcast(one)))  # a frame of one row
            x = C.of_column(F.col(v), kind)
            return Ex(x.kind, x.col, C.flag(REF, F.col(f"{v}_n") == 0))
        if name == "ROW" and not args:
            col = self.fresh()
            self.step(("row",), lambda df, wants: order.with_ordinal(df, self.book.order_of(self.table), next(iter(wants)))).wants.setdefault(col, None)
            first = next(iter(self.steps[("row",)].wants))
            return Ex("num", F.col(first).cast("double"))
        if name in ("ISERROR", "ISNUMBER", "ISNA") and args and isinstance(args[0], Call) and args[0].name in ("MATCH", "XMATCH"):
            return C.call(name, [self.compile(args[0], names)])
        arrays = {i: Grid([[A.constant(v) for v in row] for row in a.rows]) for i, a in enumerate(args) if isinstance(a, ArrayLiteral)}
        return C.call(name, [self.compile(a, names) for a in args], arrays)

    def equalities(self, node: Node) -> list[tuple[Node, Node]] | None:
        """(column, criterion) pairs of a product of comparisons with columns, or None."""
        if isinstance(node, Binary) and node.op == "*":
            a, b = self.equalities(node.left), self.equalities(node.right)
            return a + b if a is not None and b is not None else None
        if isinstance(node, Binary) and node.op in ("=", "<", "<=", ">", ">=", "<>") and isinstance(node.left, TableRef) and node.left.table and not node.left.this_row:
            if node.op == "=":
                return [(node.left, node.right)]
            return [(node.left, Binary("&", Literal(node.op), node.right))]
        return None

    def shape(self, name: str, args: tuple[Node, ...], names: dict) -> Ex:
        """What is known of a reference without reading it."""
        if name == "SHEETS":
            return literal(len(self.book.tables))
        if name == "ISFORMULA":
            return literal(False)
        if name == "ISREF":
            return literal(isinstance(args[0], (TableRef, CellRef, RangeRef)))
        if name == "SHEET":
            table = self.book.table_of(args) if args else self.table
            return literal(list(self.book.tables).index(table) + 1 if table else 1)
        if name == "INDIRECT":
            text_ = A.constant(args[0])
            return self.compile(parse(str(text_)), names)
        ref = args[0] if args else None
        if not isinstance(ref, TableRef):
            raise Unsupported(f"{name} of this")
        low = [c.lower() for c in self.book.tables[(ref.table or self.table).lower()].names()]
        first = low.index(ref.first.lower()) + 1 if ref.first else 1
        last = low.index(ref.last.lower()) + 1 if ref.last else len(low)
        return literal(first if name == "COLUMN" else abs(last - first) + 1)

    def is_range(self, node: Node) -> bool:
        return any(isinstance(n, TableRef) and not n.this_row and n.table is not None for n in node.walk())

    # -- aggregates of a whole column, once for all rows

    def one_row(self, node: Call, names: dict) -> Ex:
        plan = A.reduce_(self.book, self, node.name, node.args, names)
        if plan.one_row is not None:
            v, e = self.fresh(), self.fresh()
            one = plan.one_row.toDF(v, e)
            self.step(("one", v), lambda df, wants: df.crossJoin(F.broadcast(one)))  # a frame of one row
            return plan.finish([F.col(v), F.col(e)])

        def join(df: DataFrame, wants: dict) -> DataFrame:
            return df.crossJoin(F.broadcast(self.book.frame(plan.table).agg(*[a.alias(n) for n, a in wants.items()])))  # one row

        step = self.step(("agg", plan.table), join)
        cols = [self.fresh() for _ in plan.aggs]
        step.wants.update(zip(cols, plan.aggs, strict=True))
        return plan.finish([F.col(c) for c in cols])

    # -- criteria that depend on the row

    def split_criteria(self, array: Callable[[Node], Ex], pairs: list[tuple[Node, Node]], names: dict) -> tuple[list, list, Column]:
        """Equalities with the row, inequalities with it, and what holds for all rows alike."""
        keys, bounds, where = [], [], F.lit(True)
        for area, crit in pairs:
            x = array(area)
            if not self.row_bound(crit, names):
                where = where & predicate(x, criterion(A.constant(crit)))
            elif isinstance(crit, Binary) and crit.op == "&" and isinstance(crit.left, Literal) and crit.left.value in ("<", "<=", ">", ">=", "="):
                mine = self.compile(crit.right, names)
                (keys if crit.left.value == "=" else bounds).append((x, mine) if crit.left.value == "=" else (x, mine, crit.left.value))
            else:
                keys.append((x, self.compile(crit, names)))
        return keys, bounds, where

    def same_key(self, x: Ex, y: Ex) -> tuple[Column, Column]:
        if x.kind == "text":
            return F.lower(F.coalesce(x.col, F.lit(""))), F.lower(C.txt(y).col)
        return F.coalesce(A.lane(x) if x.kind != "bool" else x.col.cast("double"), F.lit(0.0)), C.num(y).col

    def filter_reduce(self, name: str, target: Node, tests: list[tuple[Node, Node]], rest: tuple[Node, ...], names: dict) -> Ex:
        """MEDIAN, LARGE, SMALL, TEXTJOIN and kin of the rows of another table that agree with this one.

        One row a key is joined. LARGE and SMALL rank within the key and keep one place, which Spark cuts before
        the shuffle; TEXTJOIN gathers what it returns.
        """
        table = self.book.table_of([a for a, _ in tests] + [target])
        array = self.array_over(table, names)
        keys, bounds, where = self.split_criteria(array, tests, names)
        if bounds or not keys:
            raise Unsupported(f"{name} of FILTER with these tests")
        x, pairs = array(target), [self.same_key(a, b) for a, b in keys]
        out, n, tag = self.fresh(), self.fresh(), self.fresh()
        k = int(A.number_of(rest[0])) if name in ("LARGE", "SMALL") else 0
        order_ = [F.col(f"`{c}`").alias(f"o{i}") for i, (c, _) in enumerate(self.book.tables[table].order)]

        def join(df: DataFrame, wants: dict) -> DataFrame:
            right = self.book.frame(table).where(where).select(*[r.alias(f"{tag}{i}r") for i, (r, _) in enumerate(pairs)], (C.txt(x).col if name == "TEXTJOIN" else A.lane(x)).alias("v"), F.struct(*order_, F.lit(0).alias("o")).alias("at"))
            by = [F.col(f"{tag}{i}r") for i in range(len(pairs))]
            if name in ("LARGE", "SMALL"):
                place = Window.partitionBy(*by).orderBy(F.desc("v") if name == "LARGE" else F.asc("v"))
                hit = right.where("v is not null").withColumn("i", F.row_number().over(place)).where(F.col("i") <= max(k, 1)).where(F.col("i") == k).select(*by, F.col("v").alias(out))
                held = right.groupBy(*by).agg(F.count(F.lit(1)).alias(n)).join(hit.withColumnsRenamed({f"{tag}{i}r": f"{tag}{i}h" for i in range(len(pairs))}), self.agree(tag, "r", "h", len(pairs)), "left").drop(*[f"{tag}{i}h" for i in range(len(pairs))])
            else:
                held = right.groupBy(*by).agg(self.gathered(name, rest).alias(out), F.count(F.lit(1)).alias(n))
            left = df.withColumns({f"{tag}{i}l": c for i, (_, c) in enumerate(pairs)})
            return left.join(held, self.agree(tag, "l", "r", len(pairs)), "left").drop(*[f"{tag}{i}{s}" for i in range(len(pairs)) for s in "lr"])

        self.step(("filter", out), join)
        empty = C.flag("#CALC!", F.col(n).isNull())
        if name == "TEXTJOIN":
            return Ex("text", F.col(out), empty)
        none = C.flag("#DIV/0!" if name in ("STDEV.S", "STDEV.P", "VAR.S", "VAR.P") else "#NUM!", F.col(out).isNull())
        return Ex("num", F.col(out), F.coalesce(empty, none))

    def agree(self, tag: str, one: str, two: str, n: int) -> Column:
        on = F.lit(True)
        for i in range(n):
            on = on & (F.col(f"{tag}{i}{one}") == F.col(f"{tag}{i}{two}"))
        return on

    def gathered(self, name: str, rest: tuple[Node, ...]) -> Column:
        if name == "TEXTJOIN":
            delimiter, skip = A.constant(rest[0]), bool(A.constant(rest[1]))
            kept = F.when(~F.lit(skip) | (F.coalesce("v", F.lit("")) != ""), F.struct("at", F.coalesce("v", F.lit("")).alias("v")))
            return F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda e: e["v"]), str(delimiter))
        return {"MEDIAN": F.percentile("v", 0.5), "STDEV.S": F.stddev_samp("v"), "STDEV.P": F.stddev_pop("v"), "VAR.S": F.var_samp("v"), "VAR.P": F.var_pop("v"), "PRODUCT": F.product("v")}[name]

    def group_join(self, name: str, args: tuple[Node, ...], names: dict) -> Ex:
        target, pairs = A.criteria_pairs(name, args)
        table = self.book.table_of([a for a, _ in pairs] + ([target] if target is not None else []))
        array = self.array_over(table, names)
        keys, bounds, where = self.split_criteria(array, pairs, names)
        v = A.lane(array(target)) if target is not None else F.lit(1.0)
        extreme = {"MAXIFS": "max", "MINIFS": "min"}.get(name)
        upper = [b for b in bounds if b[2] in ("<", "<=")]
        if len(bounds) > 2 or len(bounds) == 2 and (extreme or len(upper) != 1 or str(bounds[0][0].col) != str(bounds[1][0].col)):
            raise Unsupported(f"{name} with these criteria")

        pairs_ = [self.same_key(x, y) for x, y in keys]
        key = ("group", table, tuple(map(repr, [p[0] for p in A.criteria_pairs(name, args)[1]])), tuple(repr(c) for _, c in A.criteria_pairs(name, args)[1]))
        right_keys = [r for r, _ in pairs_]
        left_keys = [r for _, r in pairs_]

        def frame() -> DataFrame:
            return self.book.frame(table).where(where)

        if not bounds:

            def join(df: DataFrame, wants: dict) -> DataFrame:
                ids = [f"{key_name}_{i}" for i in range(len(right_keys))]
                right = frame().groupBy(*[r.alias(f"{i}r") for i, r in zip(ids, right_keys, strict=True)]).agg(*[a.alias(n) for n, a in wants.items()])
                left = df.withColumns({f"{i}l": c for i, c in zip(ids, left_keys, strict=True)})
                on = F.lit(True)
                for i in ids:
                    on = on & (F.col(f"{i}l") == F.col(f"{i}r"))
                return left.join(right, on, "left").drop(*[f"{i}{s}" for i in ids for s in "lr"])

            key_name = self.fresh()
            step = self.step(key, join)
            total, n = self.fresh(), self.fresh()
            agg = {"MAXIFS": F.max, "MINIFS": F.min}.get(name, F.sum)(v)
            step.wants.update({total: agg, n: F.count(v)})
            return self.conditional(name, F.col(total), F.col(n))

        # an inequality: a fold along the column up to the row's bound; between two bounds the difference of two such
        # totals
        def upto(x: Ex, bound: Column, op: str) -> tuple[Column, Column]:
            total, n = self.fresh(), self.fresh()

            def totals(df: DataFrame, wants: dict) -> DataFrame:
                one = lambda cols: cols[0] if len(cols) == 1 else F.concat_ws("\x1f", *[c.cast("string") for c in cols])
                facts = frame().select((one(right_keys) if right_keys else F.lit(0)).alias("__part"), A.lane(x).alias("__k"), v.alias("v")).where("__k is not null")
                return lookup.reduced_upto(df, one(left_keys) if left_keys else None, bound, facts, extreme or "sum", (total, n), op in ("<", "<="), op in ("<", ">"), base=self.base, alike=table == self.table)

            self.step((*key, op, total), totals)
            return F.col(total), F.col(n)

        def value_of(x: Ex, mine: Ex) -> Column:
            return C.num(mine).col if x.kind not in ("date", "time") or mine.kind == "num" else (C.serial_of_date if mine.kind == "date" else C.serial_of_time)(mine.col)

        if len(bounds) == 1:
            x, mine, op = bounds[0]
            return self.conditional(name, *upto(x, value_of(x, mine), op))
        (x, high, high_op), (_, low, low_op) = sorted(bounds, key=lambda b: b[2] not in ("<", "<="))
        high, low = value_of(x, high), value_of(x, low)
        (s1, n1), (s0, n0) = upto(x, high, high_op), upto(x, low, {">": "<=", ">=": "<"}[low_op])
        some = (low <= high) if (high_op, low_op) == ("<=", ">=") else low < high
        minus = lambda a, b: F.when(some, F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).otherwise(F.lit(0))
        count = minus(n1, n0)
        return self.conditional(name, F.when(count > 0, minus(s1, s0)), count)

    def conditional(self, name: str, total: Column, n: Column) -> Ex:
        if name.startswith("COUNT"):
            return Ex("num", F.coalesce(n, F.lit(0)).cast("double"))
        if name.startswith("AVERAGE"):
            none = F.coalesce(n, F.lit(0)) == 0
            return Ex("num", F.when(~none, total / n), C.flag("#DIV/0!", none))
        return Ex("num", F.coalesce(total, F.lit(0.0)))

    # -- lookups

    def lookup(self, name: str, args: tuple[Node, ...], names: dict) -> Ex:
        given = lambda i: len(args) > i and not isinstance(args[i], Omitted)
        if name in ("VLOOKUP", "HLOOKUP"):
            approximate = not given(3) or bool(A.constant(args[3]))
            area, index = args[1], int(A.number_of(args[2]))
            if isinstance(area, ArrayLiteral):
                cut = area.rows if name == "VLOOKUP" else tuple(zip(*area.rows, strict=True))
                heads = ArrayLiteral(tuple((r[0],) for r in cut))
                results = ArrayLiteral(tuple((r[index - 1],) for r in cut))
                return self.find(args[0], heads, results, -1 if approximate else 0, 1, None, names)
            if not isinstance(area, TableRef) or name == "HLOOKUP":
                raise Unsupported(f"{name} over this range")
            listed = self.book.tables[area.table.lower()].names()
            low = [c.lower() for c in listed]
            start = low.index(area.first.lower()) if area.first else 0
            if not 1 <= index <= len(listed) - start:
                return literal(Error(REF))
            pick = lambda i: TableRef(area.table, listed[start + i], listed[start + i])
            return self.find(args[0], pick(0), pick(index - 1), -1 if approximate else 0, 1, None, names)
        if name == "LOOKUP":
            return self.find(args[0], args[1], args[2] if given(2) else args[1], -1, 1, None, names)
        if name == "MATCH":
            wanted = int(A.number_of(args[2])) if given(2) else 1
            return self.find(args[0], args[1], None, {0: 0, 1: -1, -1: 1}[wanted], 1, None, names)
        if name == "XMATCH":
            return self.find(args[0], args[1], None, int(A.number_of(args[2])) if given(2) else 0, int(A.number_of(args[3])) if given(3) else 1, None, names)
        return self.find(args[0], args[1], args[2], int(A.number_of(args[4])) if given(4) else 0, int(A.number_of(args[5])) if given(5) else 1, args[3] if given(3) else None, names)

    def find(self, needle: Node, heads: Node, results: Node | None, mode: int, search: int, missing: Node | None, names: dict) -> Ex:
        """mode: 0 exact, -1 next smaller, 1 next larger, 2 pattern. results None asks for the position."""
        x = self.compile(needle, names)
        other = self.compile(missing, names) if missing is not None else literal(Error(NA))
        if isinstance(heads, ArrayLiteral):
            return self.find_constant(x, heads, results, mode, search, other, names)
        table = self.book.table_of([heads] + ([results] if results is not None else []))
        array = self.array_over(table, names)
        k = array(heads)
        places = [F.col(f"`{c}`") for c, _ in self.book.order_of(table)] if self.book.tables[table].order else []
        out = self.fresh()
        found = f"{out}_found"
        v = array(results) if results is not None else Ex("num", F.col("__row").cast("double"))
        pattern_wanted = mode == 2 or mode == 0 and x.literal and isinstance(x.const, str) and has_wildcard(x.const)
        step_key = ("find", table, repr(heads), repr(needle), mode, search, results is None)
        right = lambda: order.with_ordinal(self.book.frame(table), self.book.order_of(table)) if results is None else self.book.frame(table)
        if mode in (0, 2):
            left_key, right_key = (F.lower(C.txt(x).col), F.lower(F.coalesce(k.col, F.lit("")))) if k.kind == "text" else (C.num(x).col, F.coalesce(A.lane(k), F.lit(0.0)))
            if k.kind == "text" and x.kind in ("num", "date", "time", "bool"):
                left_key = F.lit(None).cast("string")
            if k.kind != "text" and x.kind == "text":
                left_key = C.parsed(x.col)

            def join(df: DataFrame, wants: dict) -> DataFrame:
                if pattern_wanted:
                    regex = F.concat(F.lit("(?is)^"), F.replace(F.replace(F.concat(F.lit(r"\Q"), left_key, F.lit(r"\E")), F.lit("*"), F.lit(r"\E.*\Q")), F.lit("?"), F.lit(r"\E.\Q")), F.lit("$"))
                    got = lookup.pattern(df, regex, right(), right_key, places, wants)
                else:
                    got = lookup.exact(df, left_key, right(), right_key, places, wants, search == -1)
                return got.withColumnRenamed("__found", found_name)

        else:
            left_key, right_key = (F.lower(C.txt(x).col), F.lower(k.col)) if k.kind == "text" else (C.num(x).col, A.lane(k))

            def join(df: DataFrame, wants: dict) -> DataFrame:
                return lookup.nearest(df, left_key, right(), right_key, wants, larger=mode == 1, base=self.base).withColumnRenamed("__found", found_name)

        found_name = self.found.setdefault(step_key, found)
        step = self.step(step_key, join)
        step.wants[out] = v.col
        if v.err is not None:
            step.wants[f"{out}_err"] = v.err
        hit = Ex(v.kind, F.col(out), F.col(f"{out}_err") if v.err is not None else None)
        got = C.choose([(F.col(found_name), hit)], other)
        return Ex(got.kind, got.col, C.errors(x, got))

    def find_constant(self, x: Ex, heads: ArrayLiteral, results: Node | None, mode: int, search: int, other: Ex, names: dict) -> Ex:
        """A constant table of bands: a chain of comparisons."""
        keys = [A.constant(v) for row in heads.rows for v in row]
        if results is None:
            values: list[object] = list(range(1, len(keys) + 1))
        else:
            values = [A.constant(v) for row in results.rows for v in row] if isinstance(results, ArrayLiteral) else []
        if len(values) != len(keys):
            return literal(Error(VALUE))
        listed = list(zip(keys, values, strict=True))
        if mode == 0:
            cases = [(C.compare("=", x, literal(k)).col, literal(v)) for k, v in (listed if search == 1 else listed[::-1])]
        elif mode in (-1, 1):
            listed = sorted(listed, key=lambda p: (isinstance(p[0], str), p[0]), reverse=mode == -1)
            cases = [(C.compare(">=" if mode == -1 else "<=", x, literal(k)).col, literal(v)) for k, v in listed]
        else:
            raise Unsupported("patterns over a constant array")
        got = C.choose([(F.coalesce(c, F.lit(False)), v) for c, v in cases], other)
        return Ex(got.kind, got.col, C.errors(x, got))

    # -- ranks

    def rank(self, name: str, args: tuple[Node, ...], names: dict) -> Ex:
        if name.startswith("PERCENTRANK"):
            area, needle = args[0], args[1]
        else:
            needle, area = args[0], args[1]
        if not isinstance(area, TableRef) or area.table.lower() != self.table or not isinstance(needle, TableRef) or (needle.first or "").lower() != (area.first or "").lower():
            raise Unsupported(f"{name} of another column's value")
        column = self.column(area.first)
        ascending = len(args) > 2 and not name.startswith("PERCENT") and bool(A.number_of(args[2])) or name.startswith("PERCENT")
        out, value = self.fresh(), self.fresh()

        def join(df: DataFrame, wants: dict) -> DataFrame:
            return order.ranked(df.withColumn(value, A.lane(column)), value, wants).drop(value)

        self.step(("rank", area.first.lower()), join).wants[out] = (not ascending, name == "RANK.AVG")
        if not name.startswith("PERCENT"):
            return Ex("num", F.col(out), C.flag(NA, F.col(out).isNull()))
        digits = int(A.number_of(args[2])) if len(args) > 2 else 3
        n = self.one_row(Call("COUNT", (area,)), names)
        exact_ = (F.col(out) - 1) / (n.col - 1)
        return Ex("num", F.floor(exact_ * 10.0**digits + 1e-12) / 10.0**digits, C.flag(NA, F.col(out).isNull()))

    # -- copied formulas: references relative to the anchor row

    def on_cellref(self, node: CellRef, names: dict) -> Ex:
        if self.anchor is None:
            raise Unsupported("cell references outside a filled formula")
        name = self.book.tables[self.table].names()[node.col - 1]
        shift = 0 if node.row_abs else node.row - self.anchor
        x = self.column(name)
        if node.row_abs:
            raise Unsupported("an absolute row in a filled formula")
        if shift == 0:
            return x
        out = self.fresh()
        self.frames().wants[out] = (shift, shift, lambda w, c=x.col: F.first(c).over(w))
        return Ex(x.kind, F.col(out))

    def frames(self) -> Step:
        """The step of all frames around the row: rows are numbered once."""
        return self.step(("frame",), lambda df, wants: order.framed(df, self.book.order_of(self.table), wants))

    def on_rangeref(self, node: RangeRef, names: dict) -> Ex:
        raise Unsupported("a range where one value is wanted")

    def frame_function(self, name: str, args: tuple[Node, ...], names: dict) -> Ex:
        """SUM, AVERAGE, MIN, MAX and COUNT of a range that moves or grows with the row."""
        r = args[0]
        if len(args) > 1 or r.col1 != r.col2 or name not in ("SUM", "AVERAGE", "MIN", "MAX", "COUNT"):
            raise Unsupported(f"{name} over a moving range")
        x = self.column(self.book.tables[self.table].names()[r.col1 - 1])
        v, out = A.lane(x), self.fresh()
        if r.absolute[0] and not r.absolute[2]:
            if r.row2 != self.anchor or r.row1 != self.anchor:
                raise Unsupported("a growing range must begin and end in the anchor row")
            self.step(("running",), lambda df, wants: order.running(df, self.book.order_of(self.table), wants)).wants[out] = (v, name)
            return Ex("num", F.col(out), C.flag("#DIV/0!", F.col(out).isNull()) if name == "AVERAGE" else None)
        low, high = r.row1 - self.anchor, r.row2 - self.anchor
        agg = {"SUM": F.sum, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[name]
        self.frames().wants[out] = (low, high, lambda w: agg(v).over(w))
        if name == "AVERAGE":
            return Ex("num", F.col(out), C.flag("#DIV/0!", F.col(out).isNull()))
        return Ex("num", F.coalesce(F.col(out).cast("double"), F.lit(0.0)))


class Array(Rows):
    """A formula over a table's columns as arrays: T[Col] is the value in each row."""

    def reads(self, node: TableRef) -> bool:
        return node.table is not None and node.table.lower() == self.table and node.first is not None and node.first == node.last

