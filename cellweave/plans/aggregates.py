"""Reductions over table columns as Spark aggregates.

A reduction compiles to aggregate expressions over one table and a finishing step over their results,
so that many reductions of a table share a single pass (partial aggregation, then a final one).
Reductions that need more than one pass build their own frame of one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formula.nodes import ArrayLiteral, Call, Literal, Node, Omitted, TableRef, Unary
from ..functions.mathematics import SUBTOTALS
from ..operators.order import Places, with_ordinal
from ..values import DIV0, NA, NIMPL, NUM, VALUE, Error, criterion
from . import columns as C
from .columns import Ex, Unsupported, errors, flag, literal
from .criteria import predicate


@dataclass
class Reduction:
    """aggs over the rows of ``table``, then ``finish`` over their results; or a frame of one row."""

    table: str
    aggs: list[Column]
    finish: Callable[[list[Column]], Ex]
    one_row: DataFrame | None = None
    where: Column | None = None
    kind: str = "num"
    more: dict = field(default_factory=dict)


def constant(node: Node) -> object:
    """The literal value of an argument."""
    if isinstance(node, Literal):
        return node.value
    if isinstance(node, Unary) and node.op in "+-" and isinstance(node.arg, Literal):
        return -node.arg.value if node.op == "-" else node.arg.value
    if isinstance(node, Unary) and node.op == "%" and isinstance(node.arg, Literal):
        return node.arg.value / 100
    from ..interpreter import Frame, Interpreter

    if any(isinstance(n, TableRef) for n in node.walk()):
        raise Unsupported("this argument must be a constant")
    return Interpreter().result(node, Frame())


def number_of(node: Node) -> float:
    v = constant(node)
    if isinstance(v, Error) or not isinstance(v, (int, float)):
        raise Unsupported("this argument must be a number")
    return v


def lane(x: Ex) -> Column:
    """What a reduction sees of a range: numbers and dates, not text, logical values or blanks."""
    if x.kind == "num":
        return x.col
    if x.kind == "date":
        return C.serial_of_date(x.col)
    if x.kind == "time":
        return C.serial_of_time(x.col)
    return F.lit(None).cast("double")


def lane_a(x: Ex) -> Column:
    """The A variants: logical values are 1 and 0, text is 0."""
    if x.kind == "bool":
        return x.col.cast("double")
    return F.when(x.col.isNotNull(), F.lit(0.0)) if x.kind == "text" else lane(x)


def failed(*xs: Ex) -> Column | None:
    e = errors(*xs)
    return None if e is None else F.min(e)


def plain(result: Callable[..., Column], *aggs: Column, bad: Callable[..., Column | None] | None = None, err: Column | None = None) -> tuple[list[Column], Callable[[list[Column]], Ex]]:
    """aggs and their finish; err is an aggregate that holds an error met in the range."""
    every = [*aggs, *([err] if err is not None else [])]

    def finish(cols: list[Column]) -> Ex:
        own = cols[: len(aggs)]
        e = errors(cols[len(aggs)] if err is not None else None, bad(*own) if bad else None)
        return Ex("num", C.guard(result(*own), e).cast("double"), e)

    return every, finish


def few(n: int, kind: str = DIV0) -> Callable[..., Column]:
    return lambda *cols: flag(kind, cols[-1] < n)


def simple(name: str, x: Ex) -> tuple[list[Column], Callable[[list[Column]], Ex]]:
    """Reductions of one lane."""
    a = name in ("AVERAGEA", "MAXA", "MINA", "STDEVA", "STDEVPA", "VARA", "VARPA")
    v, err = (lane_a(x) if a else lane(x)), failed(x)
    n = F.count(v)
    if name == "SUM":
        return plain(lambda s: F.coalesce(s, F.lit(0.0)), F.sum(v), err=err)
    if name == "COUNT":
        return plain(lambda c: c, F.count(C.guard(v, x.err)))
    if name in ("AVERAGE", "AVERAGEA"):
        return plain(lambda s, c: F.try_divide(s, c), F.sum(v), n, bad=few(1), err=err)
    if name in ("MIN", "MINA", "MAX", "MAXA"):
        return plain(lambda m: F.coalesce(m, F.lit(0.0)), (F.min if name.startswith("MIN") else F.max)(v), err=err)
    if name == "PRODUCT":
        return plain(lambda p, c: F.when(c == 0, F.lit(0.0)).otherwise(p), F.product(v), n, err=err)
    if name == "SUMSQ":
        return plain(lambda s: F.coalesce(s, F.lit(0.0)), F.sum(v * v), err=err)
    if name == "COUNTA":
        return plain(lambda c: c, F.count_if(x.col.isNotNull() if x.err is None else x.col.isNotNull() | x.err.isNotNull()))
    if name == "COUNTBLANK":
        blank = x.col.isNull() if x.err is None else x.col.isNull() & x.err.isNull()
        return plain(lambda c: c, F.count_if(F.coalesce(blank | (x.col == "") if x.kind == "text" else blank, F.lit(False))))
    if name == "MEDIAN":
        return plain(lambda m, c: m, F.median(v), n, bad=few(1, NUM), err=err)
    if name in ("STDEV.S", "STDEVA", "VAR.S", "VARA"):
        return plain(lambda s, c: s, (F.stddev_samp if name.startswith("STDEV") else F.var_samp)(v), n, bad=few(2), err=err)
    if name in ("STDEV.P", "STDEVPA", "VAR.P", "VARPA"):
        return plain(lambda s, c: s, (F.stddev_pop if name.startswith("STDEV") else F.var_pop)(v), n, bad=few(1), err=err)
    if name == "MODE.SNGL":
        return plain(lambda m, d, c: m, F.mode(v, True), F.count_distinct(v), n, bad=lambda m, d, c: flag(NA, d == c), err=err)
    if name == "GEOMEAN":
        return plain(lambda m, low, c: F.exp(m), F.avg(F.ln(v)), F.min(v), n, bad=lambda m, low, c: flag(NUM, (c == 0) | (low <= 0)), err=err)
    if name == "HARMEAN":
        return plain(lambda s, low, c: F.try_divide(c, s), F.sum(F.try_divide(F.lit(1.0), v)), F.min(v), n, bad=lambda s, low, c: flag(NUM, (c == 0) | (low <= 0)), err=err)
    if name == "DEVSQ":
        return plain(lambda s, c: s * c, F.var_pop(v), n, bad=few(1, NUM), err=err)
    if name == "SKEW":
        return plain(lambda s, d, c: s * F.sqrt(c * (c - 1)) / (c - 2), F.skewness(v), F.var_pop(v), n, bad=lambda s, d, c: flag(DIV0, (c < 3) | (d == 0)), err=err)
    if name == "SKEW.P":
        return plain(lambda s, d, c: s, F.skewness(v), F.var_pop(v), n, bad=lambda s, d, c: flag(DIV0, (c < 3) | (d == 0)), err=err)
    if name == "KURT":
        return plain(lambda k, d, c: (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * k + 6), F.kurtosis(v), F.var_pop(v), n, bad=lambda k, d, c: flag(DIV0, (c < 4) | (d == 0)), err=err)
    if name in ("AND", "OR", "XOR"):
        b = x.col if x.kind == "bool" else lane(x) != 0
        agg = F.bool_and(b) if name == "AND" else F.bool_or(b) if name == "OR" else F.count_if(b) % 2 == 1
        return [agg], lambda cols: Ex("bool", cols[0], flag(VALUE, cols[0].isNull()))
    raise Unsupported(name)


#: Reductions of one lane; several arguments of one table are joined as one range.
ONE = set("SUM COUNT AVERAGE MIN MAX PRODUCT SUMSQ COUNTA COUNTBLANK MEDIAN STDEV.S STDEV.P VAR.S VAR.P AVERAGEA MAXA MINA STDEVA STDEVPA VARA VARPA MODE.SNGL GEOMEAN HARMEAN DEVSQ SKEW SKEW.P KURT AND OR XOR".split())
#: Older names.
OLD = {"STDEV": "STDEV.S", "STDEVP": "STDEV.P", "VAR": "VAR.S", "VARP": "VAR.P", "MODE": "MODE.SNGL", "PERCENTILE": "PERCENTILE.INC", "QUARTILE": "QUARTILE.INC", "FORECAST": "FORECAST.LINEAR", "COVAR": "COVARIANCE.P", "ZTEST": "Z.TEST", "TTEST": "T.TEST", "FTEST": "F.TEST", "CHITEST": "CHISQ.TEST"}
TWO = set("CORREL PEARSON SLOPE INTERCEPT RSQ STEYX COVARIANCE.P COVARIANCE.S SUMX2MY2 SUMX2PY2 SUMXMY2 CHISQ.TEST".split())
CRITERIA = set("SUMIF COUNTIF AVERAGEIF SUMIFS COUNTIFS AVERAGEIFS MAXIFS MINIFS".split())
DATABASE = {"DSUM": "SUM", "DAVERAGE": "AVERAGE", "DCOUNT": "COUNT", "DCOUNTA": "COUNTA", "DMAX": "MAX", "DMIN": "MIN", "DPRODUCT": "PRODUCT", "DSTDEV": "STDEV.S", "DSTDEVP": "STDEV.P", "DVAR": "VAR.S", "DVARP": "VAR.P"}
OTHERS = set("SUMPRODUCT PERCENTILE.INC PERCENTILE.EXC QUARTILE.INC QUARTILE.EXC LARGE SMALL AVEDEV TRIMMEAN FORECAST.LINEAR NPV MIRR XNPV IRR XIRR Z.TEST T.TEST F.TEST SUBTOTAL AGGREGATE CONCAT TEXTJOIN ROWS DGET GCD LCM".split())
NAMES = ONE | TWO | CRITERIA | set(DATABASE) | OTHERS | set(OLD)


def paired(name: str, y: Ex, x: Ex) -> tuple[list[Column], Callable[[list[Column]], Ex]]:
    a, b, err = lane(y), lane(x), failed(y, x)
    both = a.isNotNull() & b.isNotNull()
    n = F.count_if(both)
    if name in ("SUMX2MY2", "SUMX2PY2", "SUMXMY2"):
        term = {"SUMX2MY2": a * a - b * b, "SUMX2PY2": a * a + b * b, "SUMXMY2": (a - b) * (a - b)}[name]
        return plain(lambda s: F.coalesce(s, F.lit(0.0)), F.sum(term), err=err)
    if name in ("CORREL", "PEARSON", "RSQ"):
        sx, sy, sxy = F.regr_sxx(a, b), F.regr_syy(a, b), F.regr_sxy(a, b)
        got = (lambda p, q, r, c: r * r / (p * q)) if name == "RSQ" else (lambda p, q, r, c: r / F.sqrt(p * q))
        return plain(got, sx, sy, sxy, n, bad=lambda p, q, r, c: flag(DIV0, (c < 2) | (p == 0) | (q == 0)), err=err)
    if name in ("SLOPE", "INTERCEPT"):
        f = F.regr_slope if name == "SLOPE" else F.regr_intercept
        return plain(lambda s, q, c: s, f(a, b), F.regr_sxx(a, b), n, bad=lambda s, q, c: flag(DIV0, (c < 2) | (q == 0)), err=err)
    if name == "STEYX":
        return plain(lambda p, q, r, c: F.sqrt(F.greatest(q - r * r / p, F.lit(0.0)) / (c - 2)), F.regr_sxx(a, b), F.regr_syy(a, b), F.regr_sxy(a, b), n, bad=lambda p, q, r, c: flag(DIV0, (c < 3) | (p == 0)), err=err)
    if name == "CHISQ.TEST":
        aggs, _ = plain(lambda s, c: s, F.sum((a - b) * (a - b) / b), n, err=err)
        return aggs, lambda cols: C.call("CHISQ.DIST.RT", [Ex("num", cols[0]), Ex("num", (cols[1] - 1).cast("double"))])
    f = F.covar_pop if name == "COVARIANCE.P" else F.covar_samp
    return plain(lambda s, c: s, f(a, b), n, bad=few(1 if name == "COVARIANCE.P" else 2), err=err)


def conditional(name: str, v: Ex | None, where: Column) -> tuple[list[Column], Callable[[list[Column]], Ex]]:
    if name.startswith("COUNT"):
        return plain(lambda c: c, F.count_if(where))
    inner = {"SUM": "SUM", "AVERAGE": "AVERAGE", "MAX": "MAX", "MIN": "MIN"}[name.rstrip("S").removesuffix("IF")]
    return simple(inner, Ex("num", F.when(where, lane(v)), None if v.err is None else F.when(where, v.err)))


def criteria_pairs(name: str, args: tuple[Node, ...]) -> tuple[Node | None, list[tuple[Node, Node]]]:
    """The aggregated range and the (range, criterion) pairs."""
    if name in ("SUMIF", "AVERAGEIF", "COUNTIF"):
        target = None if name == "COUNTIF" else args[2] if len(args) > 2 and not isinstance(args[2], Omitted) else args[0]
        return target, [(args[0], args[1])]
    rest = args if name == "COUNTIFS" else args[1:]
    return None if name == "COUNTIFS" else args[0], list(zip(rest[::2], rest[1::2], strict=True))


def reduce_(book, rows, name: str, args: tuple[Node, ...], locals_: dict) -> Reduction:
    """The plan of a reduction; rows.array compiles an argument over its table."""
    name = OLD.get(name, name)
    table = book.table_of(args)
    array = rows.array_over(table, locals_)
    if name in ("SUBTOTAL", "AGGREGATE"):
        code = int(number_of(args[0]))
        option = int(number_of(args[1])) if name == "AGGREGATE" else (1 if code > 100 else 0)
        if code % 100 not in SUBTOTALS or not 0 <= option <= 3:
            return Reduction(table, [F.lit(1)], lambda cols: literal(Error(NIMPL)))
        x = array(args[-1])
        if option in (2, 3):
            x = Ex(x.kind, C.guard(x.col, x.err))
        hidden = book.hidden(table) if option in (1, 3) else None
        if hidden is not None:
            x = Ex(x.kind, F.when(~hidden, x.col), None if x.err is None else F.when(~hidden, x.err))
        return Reduction(table, *simple(SUBTOTALS[code % 100], x))
    if name == "MEDIAN" and len(args) == 1:
        return several_passes(book, name, args, table, array, locals_)
    if name in ONE:
        parts = [array(a) for a in args]
        if len(parts) > 1:
            raise Unsupported(f"{name} over several ranges")
        return Reduction(table, *simple(name, parts[0]))
    if name in TWO:
        return Reduction(table, *paired(name, array(args[0]), array(args[1])))
    if name == "FORECAST.LINEAR":
        at, (y, x) = number_of(args[0]), (lane(array(a)) for a in args[1:])
        return Reduction(table, *plain(lambda s, i, q: i + s * at, F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_sxx(y, x), bad=lambda s, i, q: flag(DIV0, F.coalesce(q == 0, F.lit(True)))))
    if name == "SUMPRODUCT":
        xs = [array(a) for a in args]
        cols = [F.coalesce(C.parsed(x.col), F.lit(0.0)) if x.kind == "text" else C.num(x).col for x in xs]
        return Reduction(table, *plain(lambda s: F.coalesce(s, F.lit(0.0)), F.sum(C.multiplied(*cols)), err=failed(*xs)))
    if name in CRITERIA:
        target, pairs = criteria_pairs(name, args)
        where = None
        for area, crit in pairs:
            p = predicate(array(area), criterion(constant(crit)))
            where = p if where is None else where & p
        return Reduction(table, *conditional(name, array(target) if target is not None else None, where))
    if name in DATABASE or name == "DGET":
        return database(book, rows, name, args, table, array)
    if name == "ROWS":
        if isinstance(args[0], TableRef):
            return Reduction(table, *plain(lambda c: c, F.count(F.lit(1))))
        from .relations import Compiler

        made = Compiler(book).relation(args[0]).frame()
        return Reduction(table, [], lambda c: Ex("num", c[0].cast("double"), c[1]), made.agg(F.count(F.lit(1)).alias("v"), F.lit(None).cast("string").alias("e")))
    if name == "Z.TEST":
        v, at = lane(array(args[0])), number_of(args[1])
        sigma = F.lit(float(number_of(args[2]))) if len(args) > 2 else None
        return Reduction(table, [F.avg(v), F.stddev_samp(v), F.count(v)], lambda c: C.arithmetic("-", literal(1), C.call("NORM.S.DIST", [Ex("num", (c[0] - at) / ((sigma if sigma is not None else c[1]) / F.sqrt(c[2]))), literal(True)])))
    if name in ("T.TEST", "F.TEST"):
        return two_samples(name, args, table, array)
    return several_passes(book, name, args, table, array, locals_)


def two_samples(name: str, args: tuple[Node, ...], table: str, array) -> Reduction:
    x, y = lane(array(args[0])), lane(array(args[1]))
    if name == "F.TEST":

        def finish_f(c: list[Column]) -> Ex:
            p = C.call("F.DIST", [Ex("num", c[0] / c[2]), Ex("num", (c[1] - 1).cast("double")), Ex("num", (c[3] - 1).cast("double")), literal(True)])
            return Ex("num", 2 * F.least(p.col, 1 - p.col), errors(flag(DIV0, (c[0] == 0) | (c[2] == 0)), p))

        return Reduction(table, [F.var_samp(x), F.count(x), F.var_samp(y), F.count(y)], finish_f)
    tails, kind = int(number_of(args[2])), int(number_of(args[3]))
    tail = "T.DIST.2T" if tails == 2 else "T.DIST.RT"
    if kind == 1:
        gap = x - y
        return Reduction(table, [F.avg(gap), F.stddev_samp(gap), F.count(gap)], lambda c: C.call(tail, [Ex("num", F.abs(c[0] / (c[1] / F.sqrt(c[2])))), Ex("num", (c[2] - 1).cast("double"))]))

    def finish(c: list[Column]) -> Ex:
        mx, vx, n, my, vy, m = c
        if kind == 2:
            df = (n + m - 2).cast("double")
            error = F.sqrt(((n - 1) * vx + (m - 1) * vy) / df * (1 / n + 1 / m))
        else:
            error = F.sqrt(vx / n + vy / m)
            df = F.pow(vx / n + vy / m, F.lit(2.0)) / (F.pow(vx / n, F.lit(2.0)) / (n - 1) + F.pow(vy / m, F.lit(2.0)) / (m - 1))
        return C.call(tail, [Ex("num", F.abs((mx - my) / error)), Ex("num", df)])

    return Reduction(table, [F.avg(x), F.var_samp(x), F.count(x), F.avg(y), F.var_samp(y), F.count(y)], finish)


def database(book, rows, name: str, args: tuple[Node, ...], table: str, array) -> Reduction:
    """Criteria come as an array literal: headers, then rows that are alternatives."""
    if not isinstance(args[2], ArrayLiteral):
        raise Unsupported("criteria of database functions must be an array")
    names = {c.lower(): c for c in book.tables[table].names()}
    heads = [str(constant(h)).strip().lower() for h in args[2].rows[0]]
    where = None
    for row in args[2].rows[1:]:
        every = F.lit(True)
        for h, v in zip(heads, row, strict=True):
            value = constant(v)
            if value not in (None, "") and h in names:
                every = every & predicate(array(TableRef(table, names[h], names[h])), criterion(value))
        where = every if where is None else where | every
    field_ = constant(args[1])
    if isinstance(field_, str):
        column = names.get(field_.strip().lower())
    else:
        listed = book.tables[table].names()
        column = listed[int(field_) - 1] if 1 <= int(field_) <= len(listed) else None
    if column is None:
        return Reduction(table, [F.lit(1)], lambda cols: literal(Error(VALUE)))
    x = array(TableRef(table, column, column))
    if name == "DGET":
        return Reduction(table, [F.count_if(where), F.first(F.when(where, x.col), ignorenulls=True)], lambda c: Ex(x.kind, F.when(c[0] == 1, c[1]), errors(flag(VALUE, c[0] == 0), flag(NUM, c[0] > 1))))
    return Reduction(table, *simple(DATABASE[name], Ex(x.kind, F.when(where, x.col), None if x.err is None else F.when(where, x.err))))


def several_passes(book, name: str, args: tuple[Node, ...], table: str, array, locals_: dict) -> Reduction:
    def frame(*nodes: Node) -> DataFrame:
        xs = [array(n) for n in nodes]
        return book.frame(table).select(*[lane(x).alias(f"v{i}") for i, x in enumerate(xs)], *[F.col(f"`{c}`") for c, _ in book.tables[table].order])

    def finished(one: DataFrame, err: Column | None = None) -> Reduction:
        return Reduction(table, [], lambda c: Ex("num", C.guard(c[0].cast("double"), c[1]), c[1]), one.select(one[one.columns[0]].alias("v"), (err if err is not None else F.lit(None)).cast("string").alias("e")))

    spark = book.spark
    if name in ("LARGE", "SMALL"):
        k = int(number_of(args[1]))
        v = frame(args[0]).where("v0 is not null").select("v0")
        top = v.orderBy(F.desc("v0") if name == "LARGE" else F.asc("v0")).limit(max(k, 0))
        one = top.agg((F.min if name == "LARGE" else F.max)("v0").alias("v"), F.count(F.lit(1)).alias("n"))
        return finished(one, flag(NUM, (F.col("n") < k) | F.lit(k < 1)))
    if name in ("MEDIAN", "PERCENTILE.INC", "QUARTILE.INC", "PERCENTILE.EXC", "QUARTILE.EXC"):
        p = 0.5 if name == "MEDIAN" else number_of(args[1]) if name.startswith("PERCENTILE") else int(number_of(args[1])) / 4
        x = array(args[0])
        met = None if x.err is None else book.frame(table).select(x.err.alias("e")).where("e is not null").first()
        if met is not None:
            return Reduction(table, [F.lit(1)], lambda cols: literal(Error(met["e"])))

        def place(n: int) -> float:
            return p * (n + 1) - 1 if name.endswith("EXC") else p * (n - 1)

        held = (table, repr(args[0]))
        if held not in book.places:  # ranges and counts serve all percentiles of a column
            book.places[held] = Places(frame(args[0]).select("v0"), "v0")
        n = book.places[held].total
        found = book.places[held].at((math.floor(place(n)), math.ceil(place(n)))) if n and 0 <= place(n) <= n - 1 else {}
        if not found:
            return Reduction(table, [F.lit(1)], lambda cols: literal(Error(NUM)))
        low, high = found[math.floor(place(n))], found[math.ceil(place(n))]
        got = low + (place(n) - math.floor(place(n))) * (high - low)
        return Reduction(table, [F.lit(1)], lambda cols: literal(float(got)))
    if name == "AVEDEV":
        v = frame(args[0])
        one = v.crossJoin(F.broadcast(v.agg(F.avg("v0").alias("m")))).agg(F.avg(F.abs(F.col("v0") - F.col("m"))).alias("v"), F.count("v0").alias("n"))
        return finished(one, flag(NUM, F.col("n") == 0))
    if name == "TRIMMEAN":
        p = number_of(args[1])
        v = frame(args[0]).where("v0 is not null").select("v0")
        n = v.count()
        cut = math.floor(n * p / 2) if 0 <= p < 1 else n
        if not n or cut * 2 >= n:
            return Reduction(table, [F.lit(1)], lambda cols: literal(Error(NUM)))
        kept = with_ordinal(v, [("v0", True)]).where((F.col("__row") > cut) & (F.col("__row") <= n - cut))
        return finished(kept.agg(F.avg("v0").alias("v")))
    if name in ("NPV", "MIRR", "IRR"):
        area = args[1] if name == "NPV" else args[0]
        v = with_ordinal(frame(area).where("v0 is not null"), book.order_of(table)).withColumn("t", (F.col("__row") - 1).cast("double"))
        if name == "NPV":
            r = number_of(args[0])
            return finished(v.agg(F.coalesce(F.sum(F.col("v0") / F.pow(F.lit(1.0 + r), F.col("t") + 1)), F.lit(0.0)).alias("v")))
        if name == "MIRR":
            finance, reinvest = number_of(args[1]), number_of(args[2])
            sums = v.agg(F.sum(F.when(F.col("v0") > 0, F.col("v0") / F.pow(F.lit(1.0 + reinvest), F.col("t")))).alias("g"), F.sum(F.when(F.col("v0") < 0, F.col("v0") / F.pow(F.lit(1.0 + finance), F.col("t")))).alias("c"), F.count(F.lit(1)).alias("n"))
            got = F.pow(F.col("g") * F.pow(F.lit(1.0 + reinvest), (F.col("n") - 1).cast("double")) / -F.col("c"), 1 / (F.col("n") - 1)) - 1
            return finished(sums.select(got.alias("v"), "g", "c"), flag(DIV0, F.col("g").isNull() | F.col("c").isNull()))
        return rate(spark, table, v.select("v0", "t"), number_of(args[1]) if len(args) > 1 else 0.1, finished)
    if name in ("XNPV", "XIRR"):
        values, dates = (args[1], args[2]) if name == "XNPV" else (args[0], args[1])
        v = frame(values, dates).where("v0 is not null and v1 is not null")
        first = v.agg(F.min_by("v1", F.struct(*[F.col(f"`{c}`") for c, _ in book.order_of(table)])).alias("d"))
        v = v.crossJoin(F.broadcast(first)).select("v0", ((F.floor("v1") - F.floor("d")) / 365).alias("t"))
        if name == "XNPV":
            return finished(v.agg(F.sum(F.col("v0") / F.pow(F.lit(1.0 + number_of(args[0])), F.col("t"))).alias("v")))
        return rate(spark, table, v, number_of(args[2]) if len(args) > 2 else 0.1, finished)
    if name in ("CONCAT", "TEXTJOIN"):
        delimiter = str(constant(args[0])) if name == "TEXTJOIN" else ""
        skip = bool(constant(args[1])) if name == "TEXTJOIN" else True
        x = C.txt(array(args[-1]))
        order = F.struct(*[F.col(f"`{c}`") for c, _ in book.order_of(table)])
        df = book.frame(table)
        kept = df.where(x.col != "") if skip else df
        size = kept.agg(F.sum(F.char_length(x.col) + len(delimiter))).first()[0] or 0
        if size - len(delimiter) > 32767:  # such a text is an error, so it is never built
            return Reduction(table, [F.lit(1)], lambda cols: literal(Error(VALUE)))
        one = kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), x.col.alias("s")))), lambda r: r["s"]), delimiter).alias("v"))
        return Reduction(table, [], lambda c: Ex("text", c[0], c[1]), one.select("v", F.lit(None).cast("string").alias("e")))
    raise Unsupported(f"{name} over a table")


def rate(spark, table: str, flows: DataFrame, guess: float, finished) -> Reduction:
    """Newton's method; each step is one distributed aggregation of the value and its slope."""
    flows = flows.cache()
    signs = flows.agg(F.count_if(F.col("v0") > 0).alias("p"), F.count_if(F.col("v0") < 0).alias("n")).first()
    if not signs["p"] or not signs["n"]:
        return Reduction(table, [F.lit(1)], lambda cols: literal(Error(NUM)))
    r = guess
    for _ in range(60):
        base = F.lit(1.0 + r)
        got = flows.agg(F.sum(F.col("v0") / F.pow(base, F.col("t"))).alias("f"), F.sum(-F.col("t") * F.col("v0") / F.pow(base, F.col("t") + 1)).alias("d"), F.sum(F.abs("v0")).alias("s")).first()
        if not got["d"] or abs(got["f"]) < 1e-13 * got["s"]:
            break
        step = got["f"] / got["d"]
        while r - step <= -0.999999:
            step /= 2
        r -= step
        if abs(step) < 1e-14 * max(1, abs(r)):
            break
    flows.unpersist()
    if abs(got["f"]) > 1e-6 * got["s"]:
        return Reduction(table, [F.lit(1)], lambda cols: literal(Error(NUM)))
    return finished(spark.range(1).select(F.lit(float(r)).alias("v")))


def is_reduction(node: Node) -> bool:
    return isinstance(node, Call) and node.name in NAMES
