"""Array formulas as frames: FILTER, SORT, UNIQUE, GROUPBY and their kin."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formula.nodes import ArrayLiteral, Binary, Call, Literal, NameRef, Node, Omitted, TableRef
from ..functions.lookup import AGGREGATIONS, SYNONYMS
from ..operators import order
from ..values import Criterion, plain
from . import aggregates as A
from . import columns as C
from .columns import Ex, Unsupported
from .criteria import predicate

#: Rows and columns that TRANSPOSE and wide pivots may have.
WIDE = 1000


@dataclass
class Relation:
    """A frame, the columns that come out of it, and the order of its rows (None: no order known)."""

    df: DataFrame
    out: list[tuple[str, Column]]
    order: list[order.Key] | None = None
    sorted: bool = False
    table: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)

    def frame(self) -> DataFrame:
        df = self.df
        if self.sorted and self.order:
            df = df.orderBy(*order.keys_of(self.order))
        return df.select(*[c.alias(n) for n, c in self.out])

    def settled(self) -> Relation:
        """The same rows with the output as plain columns; the order stays in hidden ones."""
        hidden = [(f"__o{i}", up) for i, (_, up) in enumerate(self.order or [])]
        keep = [F.col(f"`{c}`").alias(h) for (c, _), (h, _) in zip(self.order or [], hidden, strict=True)]
        df = self.df.select(*[c.alias(n) for n, c in self.out], *keep)
        return Relation(df, [(n, F.col(f"`{n}`")) for n, _ in self.out], hidden or None, self.sorted)


class Compiler:
    def __init__(self, book):
        self.book, self.spark = book, book.spark

    def relation(self, node: Node, names: dict | None = None) -> Relation:
        if isinstance(node, NameRef) and node.name.lower() in self.book.names and isinstance(self.book.names[node.name.lower()], Node):
            node = self.book.names[node.name.lower()]
        if isinstance(node, NameRef) and node.name.lower() in self.book.tables:
            node = TableRef(node.name, None, None)
        if isinstance(node, TableRef):
            return self.table(node)
        if isinstance(node, ArrayLiteral):
            return self.constant(node)
        if isinstance(node, Call):
            handler = getattr(self, "on_" + node.name.lower().replace(".", "_"), None)
            if handler is not None:
                return handler(node.args)
            if A.is_reduction(node):
                return self.reduction(node)
        return self.expression(node)

    # -- sources

    def table(self, node: TableRef) -> Relation:
        name = (node.table or "").lower()
        if name not in self.book.tables:
            raise Unsupported(f"an unknown table {node.table}")
        listed = self.book.tables[name].names()
        low = [c.lower() for c in listed]
        if node.first is None:
            picked = listed
        else:
            if node.first.lower() not in low or (node.last or node.first).lower() not in low:
                raise Unsupported(f"an unknown column of {node.table}")
            a, b = low.index(node.first.lower()), low.index((node.last or node.first).lower())
            picked = listed[min(a, b) : max(a, b) + 1]
        keys = self.book.tables[name].order
        return Relation(self.book.frame(name), [(c, F.col(f"`{c}`")) for c in picked], list(keys) if keys else None, False, name)

    def constant(self, node: ArrayLiteral) -> Relation:
        rows = [[A.constant(v) for v in r] for r in node.rows]
        names = [f"c{i + 1}" for i in range(len(rows[0]))]
        kinds = ["double" if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in col) else "boolean" if all(isinstance(v, bool) for v in col) else "string" for col in zip(*rows, strict=True)]
        data = [[float(v) if k == "double" else v if k == "boolean" else str(v) for v, k in zip(r, kinds, strict=True)] + [i] for i, r in enumerate(rows)]
        df = self.spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", __o0 int")
        return Relation(df, [(n, F.col(n)) for n in names], [("__o0", True)])

    def reduction(self, node: Call) -> Relation:
        return Relation(self.book.scalar_frame(node), [("value", F.col("value"))])

    def expression(self, node: Node) -> Relation:
        """A formula over one table's columns, row by row."""
        from .rows import Array, Rows

        tables = {n.table.lower() for n in node.walk() if isinstance(n, TableRef) and n.table}
        if not tables:
            rows = Rows(self.book, "")
            x = rows.compile(node)
            return Relation(rows.applied(self.spark.range(1)), [("value", C.guard(x.col, x.err))])
        name = self.book.table_of([node])
        rows = Array(self.book, name)
        x = rows.compile(node)
        keys = self.book.tables[name].order
        return Relation(rows.applied(self.book.frame(name)), [("value", C.guard(x.col, x.err))], list(keys) if keys else None, False, name)

    def given(self, args: tuple[Node, ...], i: int) -> Node | None:
        return args[i] if len(args) > i and not isinstance(args[i], Omitted) else None

    def number(self, args: tuple[Node, ...], i: int, default: float | None) -> float | None:
        node = self.given(args, i)
        return default if node is None else A.number_of(node)

    def flag(self, args: tuple[Node, ...], i: int) -> bool:
        node = self.given(args, i)
        return node is not None and bool(A.constant(node))

    # -- selection, order, projection

    def over(self, rel: Relation, node: Node) -> tuple[Relation, Ex]:
        """An expression over the rows of a relation that still has its table's columns."""
        from .rows import Array

        if rel.table is None:
            raise Unsupported("an expression over a derived array; name it as a table first")
        rows = Array(self.book, rel.table)
        x = rows.compile(node)
        return replace(rel, df=rows.applied(rel.df)), x

    def membership(self, node: Node) -> tuple[Node, TableRef, bool] | None:
        """(needle, column, wanted) of a test whether a value stands in another table's column."""
        if isinstance(node, Call) and node.name == "NOT" and len(node.args) == 1:
            inner = self.membership(node.args[0])
            return inner and (inner[0], inner[1], not inner[2])
        if isinstance(node, Call) and node.name in ("ISNUMBER", "ISNA", "ISERROR") and len(node.args) == 1:
            m = node.args[0]
            exact = isinstance(m, Call) and (m.name == "MATCH" and len(m.args) == 3 and m.args[2] == Literal(0) or m.name == "XMATCH" and len(m.args) == 2)
            if exact and isinstance(m.args[1], TableRef):
                return m.args[0], m.args[1], node.name == "ISNUMBER"
        if isinstance(node, Binary) and node.op in (">", "=") and node.right == Literal(0) and isinstance(node.left, Call) and node.left.name == "COUNTIF" and isinstance(node.left.args[0], TableRef):
            return node.left.args[1], node.left.args[0], node.op == ">"
        return None

    def joined(self, rel: Relation, needle: Node, column: TableRef, wanted: bool) -> Relation | None:
        """A semi or anti join, where the needle is a column and the keys are of one kind."""
        other = self.book.table_of([column])
        rel, x = self.over(rel, needle)
        base = self.book.frame(other)
        k = self.book.column_ex(other, {c.lower(): c for c in self.book.tables[other].names()}[column.first.lower()])
        if (x.kind == "text") != (k.kind == "text") or x.err is not None or x.literal:
            return None
        own, keys = (F.lower(F.coalesce(x.col, F.lit(""))), F.lower(F.coalesce(k.col, F.lit("")))) if x.kind == "text" else (C.num(x).col, F.coalesce(A.lane(k), F.lit(0.0)))
        right = base.select(keys.alias("__key"))
        return replace(rel, df=rel.df.withColumn("__own", own).join(right, F.col("__own") == F.col("__key"), "left_semi" if wanted else "left_anti").drop("__own"))

    def on_filter(self, args: tuple[Node, ...]) -> Relation:
        test_of = self.membership(args[1])
        if test_of is not None and self.given(args, 2) is None:
            rel = self.relation(args[0])
            if rel.table is not None and rel.table != self.book.table_of([test_of[1]]):
                got = self.joined(rel, *test_of)
                if got is not None:
                    return got
        rel, test = self.over(self.relation(args[0]), args[1])
        kept = replace(rel, df=rel.df.where(F.coalesce(C.guard(C.boolean(test).col if test.kind != "text" else F.lit(False), test.err), F.lit(False))))
        other = self.given(args, 2)
        if other is None:
            return kept
        value = A.constant(other)  # one row where nothing is left
        done = kept.settled()
        first = done.out[0][0]
        types = {f.name: f.dataType for f in done.df.schema.fields}
        fill = self.spark.range(1).select(*[F.lit(plain(value) if n == first else None).cast(types[n]).alias(n) for n in done.df.columns])
        none = done.df.limit(1).agg(F.count(F.lit(1)).alias("__any"))
        fill = fill.crossJoin(F.broadcast(none)).where("__any = 0").drop("__any")
        return replace(done, df=done.df.unionByName(fill))

    def on_sort(self, args: tuple[Node, ...]) -> Relation:
        rel = self.relation(args[0])
        if self.flag(args, 3):
            raise Unsupported("SORT by column of a frame")
        index, up = int(self.number(args, 1, 1)), self.number(args, 2, 1) > 0
        name, col = rel.out[index - 1]
        return self.ordered(rel, [(col, up)])

    def ordered(self, rel: Relation, keys: list[tuple[Column, bool]]) -> Relation:
        df, added = rel.df, []
        for i, (col, up) in enumerate(keys):
            name = f"__s{i}_{len(rel.order or [])}"
            kind = df.select(col.alias("x")).schema[0].dataType
            df = df.withColumn(name, F.lower(F.coalesce(col, F.lit(""))) if isinstance(kind, T.StringType) else col)
            added.append((name, up))
        return replace(rel, df=df, order=added + list(rel.order or []), sorted=True)

    def on_sortby(self, args: tuple[Node, ...]) -> Relation:
        rel, keys = self.relation(args[0]), []
        for i in range(1, len(args), 2):
            rel, x = self.over(rel, args[i])
            keys.append((x.col, self.number(args, i + 1, 1) > 0))
        return self.ordered(rel, keys)

    def cut(self, args: tuple[Node, ...], take: bool) -> Relation:
        rel = self.relation(args[0])
        rows, cols = self.number(args, 1, None), self.number(args, 2, None)
        if cols is not None:
            n = int(cols)
            out = rel.out[:n] if n > 0 else rel.out[n:]
            rel = replace(rel, out=out if take else [o for o in rel.out if o not in out])
        if rows is None:
            return rel
        n = int(rows)
        if rel.order is None:
            if take and n > 0:
                return replace(rel, df=rel.df.limit(n))
            raise Unsupported("TAKE and DROP need a table with an order")
        flipped = [(c, not up) for c, up in rel.order]
        if take:
            keys = order.keys_of(rel.order if n > 0 else flipped)
            return replace(rel, df=rel.df.orderBy(*keys).limit(abs(n)))
        numbered = order.with_ordinal(rel.df, rel.order if n > 0 else flipped, "__at")
        return replace(rel, df=numbered.where(F.col("__at") > abs(n)).drop("__at"))

    def on_take(self, args: tuple[Node, ...]) -> Relation:
        return self.cut(args, True)

    def on_drop(self, args: tuple[Node, ...]) -> Relation:
        return self.cut(args, False)

    def on_unique(self, args: tuple[Node, ...]) -> Relation:
        if self.flag(args, 1):
            raise Unsupported("UNIQUE by column of a frame")
        rel = self.relation(args[0]).settled()
        names = [n for n, _ in rel.out]
        kinds = {f.name: f.dataType for f in rel.df.schema.fields}
        keys = [F.lower(F.col(f"`{n}`")).alias(f"__k{i}") if isinstance(kinds[n], T.StringType) else F.col(f"`{n}`").alias(f"__k{i}") for i, n in enumerate(names)]
        place = F.struct(*[F.col(c) for c, _ in rel.order]) if rel.order else F.lit(0)
        firsts = [F.min_by(F.struct(*[F.col(f"`{n}`") for n in names]), place).alias("__first"), F.count(F.lit(1)).alias("__n")]
        df = rel.df.groupBy(*keys).agg(*firsts, *([F.min(place).alias("__place")] if rel.order else []))
        if self.flag(args, 2):
            df = df.where("__n = 1")
        df = df.select(*[F.col(f"__first.`{n}`").alias(n) for n in names], *([F.col("__place")] if rel.order else []))
        return Relation(df, [(n, F.col(f"`{n}`")) for n in names], [("__place", True)] if rel.order else None)

    def on_choosecols(self, args: tuple[Node, ...]) -> Relation:
        rel = self.relation(args[0])
        return replace(rel, out=[rel.out[int(i) - 1 if i > 0 else int(i)] for i in map(A.number_of, args[1:])])

    def on_chooserows(self, args: tuple[Node, ...]) -> Relation:
        rel = self.relation(args[0])
        if rel.order is None:
            raise Unsupported("CHOOSEROWS needs a table with an order")
        wanted = [int(i) for i in map(A.number_of, args[1:])]
        done = order.with_ordinal(rel.settled().df, rel.settled().order, "__at")
        n = done.count() if any(i < 0 for i in wanted) else 0
        picks = self.spark.createDataFrame([(i if i > 0 else n + i + 1, p) for p, i in enumerate(wanted)], "__at long, __p int")
        return Relation(done.join(F.broadcast(picks), "__at"), rel.settled().out, [("__p", True)], True)

    def on_index(self, args: tuple[Node, ...]) -> Relation:
        """A row, a column or one value, by position."""
        rel = self.relation(args[0])
        r, c = int(self.number(args, 1, 0)), int(self.number(args, 2, 0))
        if c:
            rel = replace(rel, out=[rel.out[c - 1]])
        if not r:
            return rel
        if rel.order is None:
            raise Unsupported("INDEX needs a table with an order")
        near = rel.df.orderBy(*order.keys_of(rel.order)).limit(r)  # r rows at most
        last = near.orderBy(*order.keys_of([(n, not up) for n, up in rel.order])).limit(1)
        short = near.agg(F.count(F.lit(1)).alias("__n")).where(f"__n = {r}")
        return replace(rel, df=last.crossJoin(F.broadcast(short)), order=None)

    def on_xlookup(self, args: tuple[Node, ...]) -> Relation:
        """The row of a constant key: the first (or last) match, in the table's order."""
        key, heads, results = A.constant(args[0]), self.relation(args[1]), self.relation(args[2])
        if heads.table is None or heads.table != results.table or self.number(args, 4, 0) != 0:
            raise Unsupported("XLOOKUP of a constant over columns of one table")
        kind = heads.df.select(heads.out[0][1].alias("x")).schema[0].dataType
        hit = predicate(C.of_column(heads.out[0][1], kind), Criterion("=", key))
        found = results.df.where(hit)
        keys = results.order or []
        up = self.number(args, 5, 1) > 0
        first = found.orderBy(*order.keys_of(keys if up else [(n, not a) for n, a in keys])).limit(1) if keys else found.limit(1)
        got = replace(results, df=first, order=None)
        if self.given(args, 3) is None:
            return got
        value = A.constant(args[3])
        done = got.settled()
        types = {f.name: f.dataType for f in done.df.schema.fields}
        fill = self.spark.range(1).select(*[F.lit(plain(value)).cast("string").alias(n) for n in types])
        some = done.df.agg(F.count(F.lit(1)).alias("__n"))
        fill = fill.crossJoin(F.broadcast(some)).where("__n = 0").drop("__n")
        return replace(done, df=done.df.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in types]).unionByName(fill) if any(t.simpleString() != "string" for t in types.values()) and isinstance(value, str) else done.df.unionByName(fill.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in types.items()])))

    # -- stacking and reshaping

    def on_vstack(self, args: tuple[Node, ...]) -> Relation:
        rels = [self.relation(a) for a in args]
        if len({len(r.out) for r in rels}) > 1:
            raise Unsupported("VSTACK of different widths")
        names = [n for n, _ in rels[0].out]
        df = None
        for i, r in enumerate(rels):
            part = (order.with_ordinal(r.df, r.order, "__at") if r.order else r.df.withColumn("__at", F.lit(0))).select(*[c.alias(n) for (_, c), n in zip(r.out, names, strict=True)], F.lit(i).alias("__part"), F.col("__at").cast("long"))
            df = part if df is None else df.union(part)
        return Relation(df, [(n, F.col(f"`{n}`")) for n in names], [("__part", True), ("__at", True)] if all(r.order for r in rels) else None)

    def on_hstack(self, args: tuple[Node, ...]) -> Relation:
        rels = [self.relation(a) for a in args]
        if len({r.table for r in rels}) == 1 and rels[0].table is not None:
            out: list[tuple[str, Column]] = []
            for r in rels:
                out += [(n if n not in dict(out) else f"{n}_{len(out)}", c) for n, c in r.out]
            return replace(rels[0], out=out)
        if not all(r.order for r in rels):
            raise Unsupported("HSTACK of tables needs their orders")
        df, out = None, []
        for i, r in enumerate(rels):
            names = [f"c{i}_{j}" for j in range(len(r.out))]
            part = order.with_ordinal(r.df, r.order, "__at").select("__at", *[c.alias(n) for (_, c), n in zip(r.out, names, strict=True)])
            df = part if df is None else df.join(part, "__at", "full")
            out += [(n if n not in dict(out) else f"{n}_{i}", F.col(m)) for (n, _), m in zip(r.out, names, strict=True)]
        return Relation(df, out, [("__at", True)])

    def flat(self, args: tuple[Node, ...]) -> Relation:
        rel = self.relation(args[0])
        ignore, down = int(self.number(args, 1, 0)), self.flag(args, 2)
        kinds = {str(f.dataType) for f in rel.df.select(*[c for _, c in rel.out]).schema.fields}
        cells = [c if len(kinds) == 1 else C.txt(C.of_column(c, rel.df.select(c.alias("x")).schema[0].dataType)).col for _, c in rel.out]
        base = order.with_ordinal(rel.df, rel.order, "__r") if rel.order else rel.df.withColumn("__r", F.lit(0))
        df = base.select("__r", F.posexplode(F.array(*cells)).alias("__c", "value"))
        if ignore & 1:
            df = df.where("value is not null")
        return Relation(df, [("value", F.col("value"))], [("__c", True), ("__r", True)] if down else [("__r", True), ("__c", True)])

    def on_tocol(self, args: tuple[Node, ...]) -> Relation:
        return self.flat(args)

    def on_torow(self, args: tuple[Node, ...]) -> Relation:
        rel = self.flat(args)
        return self.across(rel, ["value"])

    def across(self, rel: Relation, names: list[str]) -> Relation:
        """Rows become columns; bounded, as a frame has few columns."""
        df = rel.frame() if not rel.order else rel.df.orderBy(*order.keys_of(rel.order)).select(*[c.alias(n) for n, c in rel.out])
        rows = df.limit(WIDE + 1).collect()
        if len(rows) > WIDE:
            raise Unsupported(f"more than {WIDE} rows as columns")
        kinds = [f.dataType for f in df.schema.fields]
        kind = kinds[0].simpleString() if len({k.simpleString() for k in kinds}) == 1 else "string"
        data = [[(str(plain(r[i])) if kind == "string" and r[i] is not None else r[i]) for r in rows] for i in range(len(names))]
        listed = [f"c{j + 1}" for j in range(len(rows))]
        out = self.spark.createDataFrame([[*d, i] for i, d in enumerate(data)], ", ".join(f"{n} {kind}" for n in listed) + ", __o0 int")
        return Relation(out, [(n, F.col(n)) for n in listed], [("__o0", True)])

    def on_transpose(self, args: tuple[Node, ...]) -> Relation:
        rel = self.relation(args[0])
        return self.across(rel, [n for n, _ in rel.out])

    def on_textsplit(self, args: tuple[Node, ...]) -> Relation:
        """(a row of the column, its pieces): a frame with a piece a row."""
        rel = self.expression(args[0])
        d = str(A.constant(args[1]))
        pieces = F.split(F.col("__t"), "\\Q" + d + "\\E", -1)
        if self.flag(args, 3):
            pieces = F.filter(pieces, lambda p: p != "")
        df = rel.df.withColumn("__t", rel.out[0][1]).select(*[F.col(f"`{c}`") for c in rel.df.columns], F.posexplode(pieces).alias("__p", "value"))
        return Relation(df, [("value", F.col("value"))], [*(rel.order or []), ("__p", True)] if rel.order else None)

    # -- generated arrays

    def on_sequence(self, args: tuple[Node, ...]) -> Relation:
        rows, cols, start, step = (self.number(args, i, 1) for i in range(4))
        at = F.col("id") * int(cols)
        return Relation(self.spark.range(int(rows)), [(f"c{j + 1}" if cols > 1 else "value", (F.lit(float(start)) + float(step) * (at + j)).cast("double")) for j in range(int(cols))], [("id", True)])

    def on_randarray(self, args: tuple[Node, ...]) -> Relation:
        rows, cols, low, high = int(self.number(args, 0, 1)), int(self.number(args, 1, 1)), self.number(args, 2, 0), self.number(args, 3, 1)
        whole = self.flag(args, 4)

        def draw(j: int) -> Column:
            # seeded by place, so that a lost task draws the same numbers again
            u = F.pmod(F.xxhash64(F.lit(self.book.seed), F.col("id"), F.lit(j)), F.lit(1 << 53)) / float(1 << 53)
            return F.floor(u * (high - low + 1)) + F.lit(low) if whole else u * (high - low) + low

        return Relation(self.spark.range(rows), [(f"c{j + 1}" if cols > 1 else "value", draw(j).cast("double")) for j in range(cols)], [("id", True)])

    # -- grouping

    def aggregation(self, node: Node) -> str:
        if isinstance(node, NameRef):
            v: object = node.name
        else:
            v = A.constant(node)
        name = AGGREGATIONS.get(int(v)) if isinstance(v, (int, float)) else SYNONYMS.get(str(v).upper(), str(v).upper())
        if name not in {*AGGREGATIONS.values(), "MODE.SNGL"}:
            raise Unsupported(f"aggregation {v}")
        return name

    def measured(self, name: str, col: Column, kind: T.DataType) -> Column:
        x = C.of_column(col, kind)
        x = Ex("num", x.col.cast("double")) if x.kind == "bool" else x
        aggs, finish = A.simple(name, x)
        done = finish(aggs)
        return C.guard(done.col, done.err)

    def on_groupby(self, args: tuple[Node, ...]) -> Relation:
        """Typed keys, in the order of the keys; a grand total is one more row with text keys."""
        keys, values, name = self.relation(args[0]), self.relation(args[1]), self.aggregation(args[2])
        if keys.table is None or keys.table != values.table:
            raise Unsupported("GROUPBY over columns of different tables")
        totals, way = int(self.number(args, 4, 0)), int(self.number(args, 5, 1))
        base = self.joint(keys, values)
        kinds = {f.name: f.dataType for f in base.schema.fields}
        ks, vs = [f"__k{i}" for i in range(len(keys.out))], [f"__v{i}" for i in range(len(values.out))]
        names = [n for n, _ in keys.out] + [n if n not in dict(keys.out) else f"{n}_{name.lower()}" for n, _ in values.out]
        aggs = [self.measured(name, F.col(v), kinds[v]).alias(v) for v in vs]
        df = base.groupBy(*ks).agg(*aggs).select(*[F.col(c).alias(n) for c, n in zip(ks + vs, names, strict=True)], F.lit(0).alias("__t"))
        if totals >= 1:
            total = base.agg(*aggs).select(*[F.lit("Grand Total" if i == 0 else "").alias(names[i]) for i in range(len(ks))], *[F.col(v).alias(n) for v, n in zip(vs, names[len(ks) :], strict=True)], F.lit(1).alias("__t"))
            df = df.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in names[: len(ks)]], *[F.col(f"`{n}`") for n in names[len(ks) :]], "__t").unionByName(total)
        return Relation(df, [(n, F.col(f"`{n}`")) for n in names], [("__t", True), *[(n, way >= 0) for n in names[: len(ks)]]], True)

    def joint(self, *rels: Relation) -> DataFrame:
        """One pass over the table for keys and values that may be computed."""
        prefixes = ["__k", "__v", "__h"]
        if len({id(r.df) for r in rels}) > 1:
            df = self.book.frame(rels[0].table)
        else:
            df = rels[0].df
        return df.select(*[c.alias(f"{p}{i}") for p, r in zip(prefixes, rels, strict=False) for i, (_, c) in enumerate(r.out)])

    def on_pivotby(self, args: tuple[Node, ...]) -> Relation:
        rows, heads, values, name = self.relation(args[0]), self.relation(args[1]), self.relation(args[2]), self.aggregation(args[3])
        if len({rows.table, heads.table, values.table}) > 1 or rows.table is None:
            raise Unsupported("PIVOTBY over columns of different tables")
        base = self.joint(rows, Relation(values.df, values.out[:1], table=values.table), heads)
        kinds = {f.name: f.dataType for f in base.schema.fields}
        ks = [f"__k{i}" for i in range(len(rows.out))]
        hs = [F.coalesce(C.txt(C.of_column(F.col(f"__h{i}"), kinds[f"__h{i}"])).col, F.lit("")) for i in range(len(heads.out))]
        base = base.withColumn("__head", F.concat_ws(" ", *hs))
        listed = sorted(r[0] for r in base.select("__head").distinct().limit(WIDE + 1).collect())  # bounded
        if len(listed) > WIDE:
            raise Unsupported(f"a pivot of more than {WIDE} columns")
        measure = self.measured(name, F.col("__v0"), kinds["__v0"])
        df = base.groupBy(*ks).pivot("__head", listed).agg(measure)
        names = [n for n, _ in rows.out]
        out = df.select(*[F.col(k).alias(n) for k, n in zip(ks, names, strict=True)], *[F.col(f"`{h}`").alias(h) for h in listed])
        if int(self.number(args, 7, 0)) >= 1:
            total = base.groupBy(*[F.col(k).alias(f"{k}t") for k in ks]).agg(measure.alias("Grand Total"))
            on = [F.col(f"`{n}`").eqNullSafe(F.col(f"{k}t")) for k, n in zip(ks, names, strict=True)]
            out = out.join(total, on).drop(*[f"{k}t" for k in ks])
            listed = [*listed, "Grand Total"]
        if int(self.number(args, 5, 0)) >= 1:
            bottom = base.groupBy().pivot("__head", [h for h in listed if h != "Grand Total"]).agg(measure)
            if "Grand Total" in listed:
                bottom = bottom.crossJoin(base.agg(measure.alias("Grand Total")))
            out = out.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in names], *[F.col(f"`{h}`") for h in listed])
            out = out.unionByName(bottom.select(*[F.lit("Grand Total" if i == 0 else "").alias(n) for i, n in enumerate(names)], *[F.col(f"`{h}`") for h in listed]))
        return Relation(out, [(n, F.col(f"`{n}`")) for n in [*names, *listed]], [(n, True) for n in names])

    def on_frequency(self, args: tuple[Node, ...]) -> Relation:
        rel = self.expression(args[0])
        edges = [float(v) for v in self.constants(args[1])]
        listed = sorted(set(edges))
        v = A.lane(C.of_column(rel.out[0][1], rel.df.select(rel.out[0][1].alias("x")).schema[0].dataType))
        bounds = F.array(*[F.lit(e) for e in listed])
        counts = rel.df.select(v.alias("v")).where("v is not null").groupBy(F.size(F.filter(bounds, lambda b: b < F.col("v"))).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        bins = [(i, listed.index(e) if edges.index(e) == i else -1, e) for i, e in enumerate(edges)] + [(len(edges), len(listed), None)]
        frame = self.spark.createDataFrame(bins, "i int, b int, upto double")
        got = frame.join(counts, "b", "left").select("i", "upto", F.coalesce("n", F.lit(0)).alias("value"))
        return Relation(got, [("upto", F.col("upto")), ("value", F.col("value"))], [("i", True)], True)

    def constants(self, node: Node) -> list[object]:
        return [A.constant(v) for row in node.rows for v in row] if isinstance(node, ArrayLiteral) else [A.constant(node)]

    def on_mode_mult(self, args: tuple[Node, ...]) -> Relation:
        rel = self.expression(args[0])
        counts = rel.df.select(rel.out[0][1].cast("double").alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n").alias("m")).where("m > 1")
        return Relation(counts.join(F.broadcast(most), F.col("n") == F.col("m")), [("value", F.col("value"))], [("value", True)], True)

    def fitted(self, args: tuple[Node, ...], logs: bool) -> tuple[DataFrame, str]:
        """One row of regression sums over (y, x)."""
        tables = [self.expression(a) for a in args[:2]]
        if len(tables) < 2 or tables[0].table != tables[1].table:
            raise Unsupported("regression over columns of one table")
        df = self.book.frame(tables[0].table)
        y = F.ln(tables[0].out[0][1].cast("double")) if logs else tables[0].out[0][1].cast("double")
        x = tables[1].out[0][1].cast("double")
        sums = df.agg(F.regr_slope(y, x).alias("m"), F.regr_intercept(y, x).alias("b"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mx"))
        return sums, tables[0].table

    def line(self, args: tuple[Node, ...], logs: bool) -> Relation:
        sums, _ = self.fitted(args, logs)
        head = (lambda c: F.exp(c)) if logs else (lambda c: c)
        if not self.flag(args, 3):
            return Relation(sums, [("slope", head(F.col("m"))), ("intercept", head(F.col("b")))])
        residual = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
        df, se = F.col("n") - 2, F.sqrt(residual / (F.col("n") - 2))
        explained = F.col("syy") - residual
        pairs = [(head(F.col("m")), head(F.col("b"))), (se / F.sqrt("sxx"), se * F.sqrt(1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx"))), (explained / F.col("syy"), se), (explained / (residual / df), df.cast("double")), (explained, residual)]
        rows = F.array(*[F.struct(F.lit(i).alias("i"), a.alias("c1"), b.alias("c2")) for i, (a, b) in enumerate(pairs)])
        return Relation(sums.select(F.inline(rows)), [("c1", F.col("c1")), ("c2", F.col("c2"))], [("i", True)], True)

    def on_linest(self, args: tuple[Node, ...]) -> Relation:
        return self.line(args, False)

    def on_logest(self, args: tuple[Node, ...]) -> Relation:
        return self.line(args, True)

    def along(self, args: tuple[Node, ...], logs: bool) -> Relation:
        sums, _ = self.fitted(args, logs)
        new = self.relation(args[2]) if self.given(args, 2) is not None else self.expression(args[1])
        value = F.col("b") + F.col("m") * new.out[0][1].cast("double")
        return Relation(new.df.crossJoin(F.broadcast(sums.select("m", "b"))), [("value", F.exp(value) if logs else value)], new.order)

    def on_trend(self, args: tuple[Node, ...]) -> Relation:
        return self.along(args, False)

    def on_growth(self, args: tuple[Node, ...]) -> Relation:
        return self.along(args, True)


