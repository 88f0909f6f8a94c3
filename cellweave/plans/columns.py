"""Scalar functions as Spark expressions.

A formula over rows compiles to an Ex: a value column of a known kind and, where errors can occur, a
column with the error kind (null where there is none). Everything here stays inside code generation;
functions without a Spark expression run the function library in Arrow batches instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import REGISTRY
from ..functions.registry import guarded
from ..values import DIV0, NA, NUM, VALUE, Error, Grid, serial_date

NO = object()


@dataclass
class Ex:
    """kind: num, text, bool, date, time (a timestamp) or blank. const: the literal behind it, if any."""

    kind: str
    col: Column
    err: Column | None = None
    const: object = NO

    @property
    def literal(self) -> bool:
        return self.const is not NO


class Unsupported(ValueError):
    """The formula has no plan."""


def literal(v: object) -> Ex:
    if isinstance(v, Error):
        return Ex("num", F.lit(None).cast("double"), F.lit(v.kind), v)
    if isinstance(v, bool):
        return Ex("bool", F.lit(v), None, v)
    if isinstance(v, (int, float)):
        return Ex("num", F.lit(float(v)), None, v)
    if v is None:
        return Ex("blank", F.lit(None).cast("double"), None, None)
    return Ex("text", F.lit(str(v)), None, str(v))


def of_column(col: Column, kind: T.DataType) -> Ex:
    if isinstance(kind, T.BooleanType):
        return Ex("bool", col)
    if isinstance(kind, T.NumericType):
        return Ex("num", col.cast("double"))
    if isinstance(kind, T.DateType):
        return Ex("date", col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Ex("time", col.cast("timestamp_ntz"))
    if isinstance(kind, T.StringType):
        return Ex("text", col)
    raise Unsupported(f"columns of type {kind.simpleString()} hold no spreadsheet values")


def errors(*exs: Ex | Column | None) -> Column | None:
    """The first error, left to right."""
    found = [e.err if isinstance(e, Ex) else e for e in exs]
    found = [e for e in found if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def flag(kind: str, test: Column) -> Column:
    return F.when(test, F.lit(kind))


def serial_of_date(d: Column) -> Column:
    days = F.datediff(d, F.lit("1899-12-31").cast("date"))
    return (days + F.when(days >= 60, 1).otherwise(0)).cast("double")


def serial_of_time(t: Column) -> Column:
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return serial_of_date(t.cast("date")) + seconds / F.lit(86400.0)


def date_of_serial(n: Column) -> Column:
    whole = F.floor(n)
    return F.date_add(F.lit("1899-12-31").cast("date"), (whole - F.when(whole >= 60, 1).otherwise(0)).cast("int"))


def parsed(s: Column) -> Column:
    """Numeric text, a trailing percent sign included; null if it does not read as a number."""
    t = F.trim(s)
    bare = F.rtrim(F.regexp_replace(t, "%$", ""))
    value = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    return F.when(t.endswith("%"), value / 100).otherwise(value)


def num(x: Ex) -> Ex:
    """As a number: blank is 0, logical values 1 and 0, dates their serials, text if it reads as a number."""
    if x.literal and x.kind == "text":
        from ..values import parse_datetime, parse_number

        got = parse_number(x.const)
        got = parse_datetime(x.const) if got is None else got
        return literal(Error(VALUE)) if got is None else literal(got)
    if x.kind == "num":
        return Ex("num", x.col if x.literal else F.coalesce(x.col, F.when(x.err.isNull(), F.lit(0.0)) if x.err is not None else F.lit(0.0)), x.err, x.const)
    if x.kind == "bool":
        return Ex("num", F.coalesce(x.col.cast("double"), F.lit(0.0)), x.err)
    if x.kind == "blank":
        return Ex("num", F.lit(0.0), None, 0)
    if x.kind == "date":
        return Ex("num", F.coalesce(serial_of_date(x.col), F.lit(0.0)), x.err)
    if x.kind == "time":
        return Ex("num", F.coalesce(serial_of_time(x.col), F.lit(0.0)), x.err)
    value = F.when(x.col.isNull(), F.lit(0.0)).otherwise(parsed(x.col))
    return Ex("num", value, errors(x, flag(VALUE, value.isNull())))


def number_text(v: Column) -> Column:
    whole = (v == F.floor(v)) & (F.abs(v) < 1e18)
    plain = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,15)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(whole, v.cast("bigint").cast("string")).when((F.abs(v) < 1e7) & (F.abs(v) >= 1e-3), v.cast("string")).otherwise(plain)


def txt(x: Ex) -> Ex:
    if x.literal:
        from ..values import text

        return x if isinstance(x.const, Error) else literal(text(x.const))
    if x.kind == "text":
        return Ex("text", F.coalesce(x.col, F.lit("")), x.err)
    if x.kind == "bool":
        return Ex("text", F.coalesce(F.upper(x.col.cast("string")), F.lit("")), x.err)
    if x.kind in ("date", "time"):
        return Ex("text", F.coalesce(number_text(serial_of_date(x.col) if x.kind == "date" else serial_of_time(x.col)), F.lit("")), x.err)
    return Ex("text", F.coalesce(number_text(x.col), F.lit("")), x.err)


def boolean(x: Ex) -> Ex:
    if x.kind == "bool":
        return Ex("bool", F.coalesce(x.col, F.lit(False)), x.err)
    if x.kind == "text":
        low = F.lower(x.col)
        value = F.when(x.col.isNull() | (low == "false"), F.lit(False)).when(low == "true", F.lit(True))
        return Ex("bool", value, errors(x, flag(VALUE, value.isNull())))
    n = num(x)
    return Ex("bool", n.col != 0, n.err)


def date(x: Ex) -> Ex:
    """As a Spark date, for calendar functions; a blank is the day with serial 0."""
    zero_day = F.lit("1899-12-31").cast("date")
    if x.kind == "date":
        return Ex("date", F.coalesce(x.col, zero_day), x.err)
    if x.kind == "time":
        return Ex("date", F.coalesce(x.col.cast("date"), zero_day), x.err)
    n = num(x)
    bad = (n.col < 0) | (n.col >= 2958466)
    return Ex("date", F.when(~bad, date_of_serial(n.col)), errors(n, flag(NUM, bad)))


def guard(value: Column, err: Column | None) -> Column:
    return value if err is None else F.when(err.isNull(), value)


# -- operators ------------------------------------------------------------------------------


def arithmetic(op: str, a: Ex, b: Ex) -> Ex:
    x, y = num(a), num(b)
    err = errors(x, y)
    if op == "+":
        return Ex("num", x.col + y.col, err)
    if op == "-":
        return Ex("num", x.col - y.col, err)
    if op == "*":
        return Ex("num", x.col * y.col, err)
    if op == "/":
        if y.literal and not isinstance(y.const, Error) and y.const != 0:
            return Ex("num", x.col / y.col, err)
        return Ex("num", F.try_divide(x.col, y.col), errors(err, flag(DIV0, y.col == 0)))
    bad = errors(flag(DIV0, (x.col == 0) & (y.col < 0)), flag(NUM, (x.col < 0) & (y.col != F.floor(y.col))))
    return Ex("num", F.pow(x.col, y.col), errors(err, bad))


def compare(op: str, a: Ex, b: Ex) -> Ex:
    if a.kind == b.kind and a.kind in ("date", "time"):
        x, y, err = a.col, b.col, errors(a, b)
    elif a.kind == "text" and b.kind == "text":
        x, y, err = F.lower(F.coalesce(a.col, F.lit(""))), F.lower(F.coalesce(b.col, F.lit(""))), errors(a, b)
    elif "text" in (a.kind, b.kind):
        # numbers if the text reads as one, else as texts
        t, o = (a, b) if a.kind == "text" else (b, a)
        n, number = F.when(t.col.isNull(), F.lit(0.0)).otherwise(parsed(t.col)), num(o).col
        left, right = (n, number) if t is a else (number, n)
        s, u = F.lower(txt(a).col), F.lower(txt(b).col)
        return Ex("bool", F.when(n.isNotNull(), relation(op, left, right)).otherwise(relation(op, s, u)), errors(a, b))
    else:
        x, y, err = num(a).col, num(b).col, errors(a, b)
    return Ex("bool", relation(op, x, y), err)


def relation(op: str, x: Column, y: Column) -> Column:
    return {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()


def concat(a: Ex, b: Ex) -> Ex:
    """Errors become their text."""
    return Ex("text", F.concat(*[F.coalesce(x.err, txt(x).col) if x.err is not None else txt(x).col for x in (a, b)]))


def choose(cases: list[tuple[Column, Ex]], otherwise: Ex) -> Ex:
    """The first case that holds; branches of different kinds meet as text, blanks take any kind."""
    branches = [e for _, e in cases] + [otherwise]
    kinds = {e.kind for e in branches if e.kind != "blank" and not isinstance(e.const, Error)}
    if kinds <= {"num", "bool", "date", "time"} and len(kinds) > 1 and "bool" not in kinds:
        branches = [num(e) for e in branches]
        kinds = {"num"}
    kind = kinds.pop() if len(kinds) == 1 else "num" if not kinds else "text"
    null = F.lit(None).cast({"num": "double", "text": "string", "bool": "boolean", "date": "date", "time": "timestamp_ntz"}[kind])
    values = [null if e.kind == "blank" or isinstance(e.const, Error) else e.col if e.kind == kind else txt(e).col for e in branches]
    value, err, has = values[-1], branches[-1].err if branches[-1].err is not None else F.lit(None).cast("string"), any(e.err is not None for e in branches)
    for (test, _), v, e in reversed(list(zip(cases, values, branches, strict=False))):
        value = F.when(test, v).otherwise(value)
        err = F.when(test, e.err if e.err is not None else F.lit(None).cast("string")).otherwise(err)
    return Ex(kind, value, err if has else None)


# -- functions ------------------------------------------------------------------------------

FUNCTIONS: dict[str, Callable[..., Ex]] = {}


def define(names: str):
    def keep(call: Callable[..., Ex]):
        for n in names.split():
            FUNCTIONS[n] = call
        return call

    return keep


def numeric(names: str, call: Callable[..., Column], bad: Callable[..., Column | None] | None = None, *defaults: float) -> None:
    """A function of numbers; defaults stand for trailing arguments that may be left out."""

    def run(*args: Ex) -> Ex:
        xs = [num(a) for a in args]
        missing = run.arity - len(xs)
        xs += [literal(d) for d in defaults[len(defaults) - missing :]] if missing else []
        cols = [x.col for x in xs]
        err = errors(*xs, bad(*cols) if bad else None)
        return Ex("num", guard(call(*cols), err).cast("double"), err)

    run.arity = call.__code__.co_argcount
    for n in names.split():
        FUNCTIONS[n] = run


def neg(x: Column) -> Column:
    return flag(NUM, x < 0)


def power10(d: Column) -> Column:
    return F.pow(F.lit(10.0), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("double"))


def toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def at_digits(x: Column, d: Column, how: Callable[[Column], Column]) -> Column:
    up, down = power10(d), power10(-d)
    return F.when(d >= 0, how(x * up) / up).otherwise(how(x / down) * down)


def zero(x: Column) -> Column:
    return flag(DIV0, x == 0)


numeric("ABS", lambda x: F.abs(x))
numeric("SIGN", lambda x: F.signum(x))
numeric("INT", lambda x: F.floor(x))
numeric("EXP", lambda x: F.exp(x))
numeric("SQRT", lambda x: F.sqrt(x), neg)
numeric("SQRTPI", lambda x: F.sqrt(x * math.pi), neg)
numeric("LN", lambda x: F.ln(x), lambda x: flag(NUM, x <= 0))
numeric("LOG10", lambda x: F.log10(x), lambda x: flag(NUM, x <= 0))
numeric("LOG", lambda x, b: F.when(b == 10, F.log10(x)).otherwise(F.ln(x) / F.ln(b)), lambda x, b: flag(NUM, (x <= 0) | (b <= 0) | (b == 1)), 10)
numeric("POWER", lambda x, y: F.pow(x, y), lambda x, y: errors(flag(DIV0, (x == 0) & (y < 0)), flag(NUM, (x < 0) & (y != F.floor(y)))))
numeric("MOD", lambda x, y: x - y * F.floor(x / y), lambda x, y: zero(y))
numeric("QUOTIENT", lambda x, y: toward_zero(x / y), lambda x, y: zero(y))
numeric("ROUND", lambda x, d: at_digits(x, d, half_away))
numeric("ROUNDDOWN", lambda x, d: at_digits(x, d, toward_zero))
numeric("TRUNC", lambda x, d: at_digits(x, d, toward_zero), None, 0)
numeric("ROUNDUP", lambda x, d: at_digits(x, d, lambda v: F.signum(v) * F.ceil(F.abs(v))))
numeric("EVEN", lambda x: F.signum(x) * F.ceil(F.abs(x) / 2) * 2)
numeric("ODD", lambda x: F.when(x < 0, -1.0).otherwise(1.0) * F.greatest(F.ceil((F.abs(x) - 1) / 2) * 2 + 1, F.lit(1)))
numeric("CEILING", lambda x, s: F.ceil(x / s) * s, lambda x, s: errors(zero(s), flag(NUM, (s < 0) & (x > 0))), 1)
numeric("FLOOR", lambda x, s: F.floor(x / s) * s, lambda x, s: errors(zero(s), flag(NUM, (s < 0) & (x > 0))), 1)


def significance(s: Column) -> Column:
    return F.when(s == 0, F.lit(1.0)).otherwise(F.abs(s))


numeric("CEILING.MATH", lambda x, s, m: F.when((x < 0) & (m != 0), F.floor(x / significance(s))).otherwise(F.ceil(x / significance(s))) * significance(s), None, 1, 0)
numeric("FLOOR.MATH", lambda x, s, m: F.when((x < 0) & (m != 0), F.ceil(x / significance(s))).otherwise(F.floor(x / significance(s))) * significance(s), None, 1, 0)
numeric("CEILING.PRECISE ISO.CEILING", lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(F.ceil(x / significance(s)) * F.abs(s)), None, 1)
numeric("FLOOR.PRECISE", lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(F.floor(x / significance(s)) * F.abs(s)), None, 1)
numeric("MROUND", lambda x, m: F.when((x == 0) | (m == 0), F.lit(0.0)).otherwise(F.floor(F.abs(F.try_divide(x, m)) + 0.5) * m), lambda x, m: flag(NUM, x * m < 0))
for _name, _call in {"SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "RADIANS": F.radians, "DEGREES": F.degrees}.items():
    numeric(_name, lambda x, call=_call: call(x))
    FUNCTIONS[_name].arity = 1
numeric("ASIN", lambda x: F.asin(x), lambda x: flag(NUM, F.abs(x) > 1))
numeric("ACOS", lambda x: F.acos(x), lambda x: flag(NUM, F.abs(x) > 1))
numeric("ACOSH", lambda x: F.acosh(x), lambda x: flag(NUM, x < 1))
numeric("ATANH FISHER", lambda x: F.atanh(x), lambda x: flag(NUM, F.abs(x) >= 1))
numeric("ATAN2", lambda x, y: F.atan2(y, x), lambda x, y: flag(DIV0, (x == 0) & (y == 0)))
for _name, _call in {"SEC": lambda x: F.cos(x), "CSC": lambda x: F.sin(x), "COT": lambda x: F.tan(x), "CSCH": lambda x: F.sinh(x), "COTH": lambda x: F.tanh(x)}.items():
    numeric(_name, lambda x, call=_call: F.try_divide(F.lit(1.0), call(x)), lambda x, call=_call: flag(DIV0, F.abs(call(x)) < 1e-12))
    FUNCTIONS[_name].arity = 1
numeric("SECH", lambda x: 1 / F.cosh(x))
numeric("ACOT", lambda x: math.pi / 2 - F.atan(x))
numeric("ACOTH", lambda x: 0.5 * F.ln((x + 1) / (x - 1)), lambda x: flag(NUM, F.abs(x) <= 1))
numeric("FISHERINV", lambda x: F.tanh(x))
numeric("PHI", lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi))
numeric("STANDARDIZE", lambda x, m, s: (x - m) / s, lambda x, m, s: flag(NUM, s <= 0))
numeric("DELTA", lambda a, b: F.when(F.abs(a - b) < 1e-12, 1.0).otherwise(0.0), None, 0)
numeric("GESTEP", lambda a, b: F.when(a >= b, 1.0).otherwise(0.0), None, 0)
numeric("N", lambda x: x)


@define("PI")
def pi() -> Ex:
    return literal(math.pi)


def whole(x: Column) -> Column:
    return toward_zero(x).cast("bigint")


def outside(*xs: Column) -> Column:
    bad = None
    for x in xs:
        test = (x < 0) | (x != F.floor(x)) | (x >= float(2**48))
        bad = test if bad is None else bad | test
    return flag(NUM, bad)


numeric("BITAND", lambda a, b: whole(a).bitwiseAND(whole(b)), outside)
numeric("BITOR", lambda a, b: whole(a).bitwiseOR(whole(b)), outside)
numeric("BITXOR", lambda a, b: whole(a).bitwiseXOR(whole(b)), outside)


def factorial(n: Column) -> Column:
    """From a table of 171 values; larger arguments are an error before this is reached."""
    return F.element_at(F.array(*[F.lit(float(math.factorial(i))) for i in range(171)]), (n + 1).cast("int"))


numeric("FACT", lambda x: factorial(F.when((x >= 0) & (x < 171), toward_zero(x)).otherwise(0)), lambda x: flag(NUM, (x < 0) | (x >= 171)))


def steps(n: Column) -> Column:
    """1, 2, ... n; at least one element, so that a sequence never runs downwards."""
    return F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))


def combinations(n: Column, k: Column) -> Column:
    n, k = toward_zero(n), toward_zero(k)
    got = F.aggregate(steps(F.least(k, n - k)), F.lit(1.0), lambda acc, i: acc * (n - F.least(k, n - k) + i) / i)
    return F.round(F.when(F.least(k, n - k) <= 0, F.lit(1.0)).otherwise(got))


numeric("COMBIN", combinations, lambda n, k: flag(NUM, (n < 0) | (k < 0) | (toward_zero(k) > toward_zero(n))))
numeric("PERMUT", lambda n, k: F.when(toward_zero(k) == 0, F.lit(1.0)).otherwise(F.aggregate(steps(toward_zero(k)), F.lit(1.0), lambda acc, i: acc * (toward_zero(n) - toward_zero(k) + i))), lambda n, k: flag(NUM, (n < 0) | (k < 0) | (toward_zero(k) > toward_zero(n))))


def many(names: str, call: Callable[..., Column]) -> None:
    """A reduction of the row's own arguments."""

    def run(*args: Ex) -> Ex:
        xs = [num(a) for a in args]
        return Ex("num", call(*[x.col for x in xs]), errors(*xs))

    for n in names.split():
        FUNCTIONS[n] = run


def added(*cols: Column) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def multiplied(*cols: Column) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total * c
    return total


many("SUM", added)
many("PRODUCT SUMPRODUCT", multiplied)
many("AVERAGE", lambda *c: added(*c) / len(c))
many("MIN", lambda *c: F.least(*c) if len(c) > 1 else c[0])
many("MAX", lambda *c: F.greatest(*c) if len(c) > 1 else c[0])
many("SUMSQ", lambda *c: added(*[x * x for x in c]))

# logic


@define("NOT")
def not_(x: Ex) -> Ex:
    b = boolean(x)
    return Ex("bool", ~b.col, b.err)


def all_of(*args: Ex) -> Ex:
    """False wins over errors, errors over true."""
    bs = [boolean(a) for a in args]
    err = errors(*bs)
    value = bs[0].col
    for b in bs[1:]:
        value = value & b.col
    if err is None:
        return Ex("bool", value)
    no = [F.coalesce(~b.col, F.lit(False)) & (b.err.isNull() if b.err is not None else F.lit(True)) for b in bs]
    stop = no[0]
    for n in no[1:]:
        stop = stop | n
    return Ex("bool", F.when(stop, F.lit(False)).otherwise(value), F.when(~stop, err))


FUNCTIONS["AND"] = all_of


@define("OR")
def any_of(*args: Ex) -> Ex:
    got = all_of(*[not_(a) for a in args])
    return Ex("bool", ~got.col, got.err)


@define("XOR")
def odd_of(*args: Ex) -> Ex:
    bs = [boolean(a) for a in args]
    return Ex("bool", added(*[b.col.cast("int") for b in bs]) % 2 == 1, errors(*bs))


def condition(x: Ex) -> tuple[Column, Column | None]:
    """Numbers and logical values; text and errors in a condition are #VALUE!."""
    if x.kind == "text":
        return F.lit(False), errors(flag(VALUE, x.col.isNotNull()), None if x.err is None else flag(VALUE, x.err.isNotNull()))
    b = boolean(x)
    return (F.coalesce(b.col, F.lit(False)), None) if b.err is None else (F.coalesce(b.col, F.lit(False)), flag(VALUE, b.err.isNotNull()))


@define("IF")
def if_(test: Ex, yes: Ex, no: Ex | None = None) -> Ex:
    c, bad = condition(test)
    got = choose([(c, yes)], no if no is not None else literal(False))
    return Ex(got.kind, got.col, errors(bad, got))


@define("IFS")
def ifs(*args: Ex) -> Ex:
    cases, bad = [], []
    for test, value in zip(args[::2], args[1::2], strict=True):
        c, b = condition(test)
        cases.append((c, value))
        bad.append(b)
    got = choose(cases, literal(Error(NA)))
    return Ex(got.kind, got.col, errors(*bad, got))


@define("SWITCH")
def switch(key: Ex, *rest: Ex) -> Ex:
    cases = [(compare("=", key, rest[i]).col, rest[i + 1]) for i in range(0, len(rest) - 1, 2)]
    got = choose(cases, rest[-1] if len(rest) % 2 else literal(Error(NA)))
    return Ex(got.kind, got.col, errors(key, got))


@define("CHOOSE")
def choose_(index: Ex, *rest: Ex) -> Ex:
    i = num(index)
    got = choose([(toward_zero(i.col) == k, e) for k, e in enumerate(rest, 1)], literal(Error(VALUE)))
    return Ex(got.kind, got.col, errors(i, got))


@define("IFERROR")
def iferror(x: Ex, other: Ex) -> Ex:
    return x if x.err is None else choose([(x.err.isNull(), Ex(x.kind, x.col, None, NO if isinstance(x.const, Error) else x.const))], other)


@define("IFNA")
def ifna(x: Ex, other: Ex) -> Ex:
    return x if x.err is None else choose([(F.coalesce(x.err != NA, F.lit(True)), Ex(x.kind, x.col, x.err))], other)


def test(names: str, call: Callable[[Ex], Column]) -> None:
    for n in names.split():
        FUNCTIONS[n] = lambda x: Ex("bool", call(x))


def without_error(x: Ex, yes: Column) -> Column:
    return yes if x.err is None else yes & x.err.isNull()


test("ISBLANK", lambda x: without_error(x, x.col.isNull()))
test("ISERROR", lambda x: F.lit(False) if x.err is None else x.err.isNotNull())
test("ISNA", lambda x: F.lit(False) if x.err is None else F.coalesce(x.err == NA, F.lit(False)))
test("ISERR", lambda x: F.lit(False) if x.err is None else F.coalesce(x.err != NA, F.lit(False)))
test("ISNUMBER", lambda x: without_error(x, x.col.isNotNull()) if x.kind in ("num", "date", "time") else F.lit(False))
test("ISTEXT", lambda x: without_error(x, x.col.isNotNull()) if x.kind == "text" else F.lit(False))
test("ISNONTEXT", lambda x: ~without_error(x, x.col.isNotNull()) if x.kind == "text" else F.lit(True))
test("ISLOGICAL", lambda x: without_error(x, x.col.isNotNull()) if x.kind == "bool" else F.lit(False))


def parity(odd: int):
    def run(x: Ex) -> Ex:
        n = num(x)
        return Ex("bool", F.pmod(toward_zero(n.col), F.lit(2.0)) == odd, n.err)

    return run


FUNCTIONS["ISEVEN"], FUNCTIONS["ISODD"] = parity(0), parity(1)
FUNCTIONS["NA"] = lambda: literal(Error(NA))
FUNCTIONS["TRUE"], FUNCTIONS["FALSE"] = lambda: literal(True), lambda: literal(False)


@define("T")
def t_(x: Ex) -> Ex:
    return txt(x) if x.kind == "text" else Ex("text", F.lit(""), x.err)


@define("TYPE")
def type_(x: Ex) -> Ex:
    code = {"text": 2.0, "bool": 4.0}.get(x.kind, 1.0)
    return Ex("num", F.when(x.col.isNull(), F.lit(1.0)).otherwise(F.lit(code)), x.err)


@define("ERROR.TYPE")
def error_type(x: Ex) -> Ex:
    from ..functions.information import ERROR_TYPES

    if x.err is None:
        return literal(Error(NA))
    code = F.element_at(F.create_map(*[F.lit(v) for pair in ERROR_TYPES.items() for v in pair]), x.err).cast("double")
    return Ex("num", code, flag(NA, x.err.isNull() | code.isNull()))


# text


def textual(names: str, call: Callable[..., Column], kind: str = "text", numbers: tuple[int, ...] = (), bad: Callable[..., Column | None] | None = None, defaults: tuple[object, ...] = ()) -> None:
    """A function of texts; arguments at ``numbers`` are whole numbers."""

    def run(*args: Ex) -> Ex:
        args = [*args, *map(literal, defaults[len(defaults) - (run.arity - len(args)) :] if run.arity > len(args) else ())]
        xs = [num(a) if i in numbers else txt(a) for i, a in enumerate(args)]
        cols = [toward_zero(x.col).cast("int") if i in numbers else x.col for i, x in enumerate(xs)]
        err = errors(*xs, bad(*cols) if bad else None)
        return Ex(kind, guard(call(*cols), err), err)

    run.arity = call.__code__.co_argcount
    for n in names.split():
        FUNCTIONS[n] = run


#: ASCII letters; upper and lower case change nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def negative(i: int):
    return lambda *cols: flag(VALUE, cols[i] < 0)


textual("LEN LENB", lambda s: F.char_length(s).cast("double"), "num")
textual("UPPER", lambda s: F.translate(s, LOWER, UPPER))
textual("LOWER", lambda s: F.translate(s, UPPER, LOWER))
textual("TRIM", lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
textual("CLEAN", lambda s: F.regexp_replace(s, r"[\x00-\x1f]", ""))
textual("LEFT LEFTB", lambda s, n: F.substring(s, F.lit(1), F.greatest(n, F.lit(0))), numbers=(1,), bad=negative(1), defaults=(1,))
textual("RIGHT RIGHTB", lambda s, n: F.when(n > 0, F.substring(s, F.greatest(F.char_length(s) - n + 1, F.lit(1)), n)).otherwise(""), numbers=(1,), bad=negative(1), defaults=(1,))
textual("MID MIDB", lambda s, a, n: F.substring(s, F.greatest(a, F.lit(1)), F.greatest(n, F.lit(0))), numbers=(1, 2), bad=lambda s, a, n: flag(VALUE, (a < 1) | (n < 0)))
textual("REPLACE REPLACEB", lambda s, a, n, new: F.concat(F.substring(s, F.lit(1), a - 1), new, F.substring(s, a + n, F.char_length(s))), numbers=(1, 2), bad=lambda s, a, n, new: flag(VALUE, (a < 1) | (n < 0)))
textual("EXACT", lambda a, b: a == b, "bool")
textual("REPT", lambda s, n: F.repeat(s, n), numbers=(1,), bad=lambda s, n: flag(VALUE, (n < 0) | (F.char_length(s).cast("long") * n > 32767)))
textual("UNICODE", lambda s: F.ascii(s).cast("double"), "num", bad=lambda s: flag(VALUE, s == ""))


def located(what: Column, within: Column, start: Column) -> Column:
    return F.call_function("locate", what, within, F.greatest(start, F.lit(1))).cast("double")


textual("FIND FINDB", lambda a, s, n: located(a, s, n), "num", numbers=(2,), bad=lambda a, s, n: flag(VALUE, (n < 1) | (n > F.char_length(s) + 1) | (located(a, s, n) == 0)), defaults=(1,))


@define("SEARCH SEARCHB")
def search(what: Ex, within: Ex, start: Ex | None = None) -> Ex:
    if not what.literal or start is not None:
        raise Unsupported("SEARCH with a pattern or start from a column")
    from ..values import text, wildcard

    pattern = "(?is)" + wildcard(text(what.const)).pattern.replace(".*", ".*?")
    s = txt(within)
    # characters before the match
    at = F.when(s.col.rlike(pattern), F.char_length(F.element_at(F.split(s.col, pattern, 2), 1)) + 1).cast("double")
    return Ex("num", at, errors(s, flag(VALUE, at.isNull())))


@define("SUBSTITUTE")
def substitute(s: Ex, old: Ex, new: Ex, instance: Ex | None = None) -> Ex:
    x, a, b = txt(s), txt(old), txt(new)
    if instance is None:
        return Ex("text", F.when(a.col == "", x.col).otherwise(F.replace(x.col, a.col, b.col)), errors(x, a, b))
    n = num(instance)
    i = toward_zero(n.col).cast("int")
    parts = F.split(x.col, F.concat(F.lit(r"\Q"), a.col, F.lit(r"\E")))
    size = F.size(parts)
    got = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(i, F.lit(1))), "\x00"), F.lit("\x01"), F.array_join(F.slice(parts, F.greatest(i, F.lit(1)) + 1, size), "\x00"))
    got = F.replace(F.replace(got, F.lit("\x00"), a.col), F.lit("\x01"), b.col)
    return Ex("text", F.when((a.col == "") | (i >= size), x.col).otherwise(got), errors(x, a, b, n, flag(VALUE, i < 1)))


@define("PROPER")
def proper(s: Ex) -> Ex:
    x = txt(s)
    parts = F.regexp_extract_all(x.col, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return Ex("text", F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.char_length(p))))), ""), x.err)


@define("CONCATENATE CONCAT")
def concatenate(*args: Ex) -> Ex:
    xs = [txt(a) for a in args]
    value = F.concat(*[x.col for x in xs])
    return Ex("text", value, errors(*xs, flag(VALUE, F.char_length(value) > 32767)))


@define("TEXTJOIN")
def textjoin(delimiter: Ex, skip: Ex, *args: Ex) -> Ex:
    d, xs = txt(delimiter), [txt(a) for a in args]
    parts = F.array(*[x.col for x in xs])
    kept = F.filter(parts, lambda p: p != "")
    whole_ = F.when(boolean(skip).col, F.array_join(kept, "\x00")).otherwise(F.array_join(parts, "\x00"))
    return Ex("text", F.replace(whole_, F.lit("\x00"), d.col), errors(d, skip, *xs))


def around(after: bool):
    def run(s: Ex, delimiter: Ex, instance: Ex | None = None) -> Ex:
        if instance is not None and not instance.literal:
            raise Unsupported("TEXTBEFORE and TEXTAFTER with an instance from a column")
        x, d, n = txt(s), txt(delimiter), int(instance.const) if instance is not None else 1
        parts = F.split(x.col, F.concat(F.lit(r"\Q"), d.col, F.lit(r"\E")), -1)
        size = F.size(parts) - 1
        cut = F.lit(n) if n > 0 else size + n + 1
        piece = F.slice(parts, cut + 1, F.greatest(size - cut + 1, F.lit(0))) if after else F.slice(parts, F.lit(1), F.greatest(cut, F.lit(0)))
        err = errors(x, d, flag(VALUE, (d.col == "") | F.lit(n == 0)), flag(NA, size < abs(n)))
        safe = F.when(size >= abs(n), F.replace(F.array_join(piece, "\x00"), F.lit("\x00"), d.col))
        return Ex("text", safe, err)

    return run


FUNCTIONS["TEXTBEFORE"], FUNCTIONS["TEXTAFTER"] = around(False), around(True)


@define("VALUE")
def value(x: Ex) -> Ex:
    return Ex("num", F.lit(None).cast("double"), F.lit(VALUE)) if x.kind == "bool" else num(x)


def fixed_text(x: Column, d: Column, commas: bool) -> Column:
    v = F.abs(at_digits(x, d, half_away))
    whole_ = F.floor(v)
    digits = F.greatest(d, F.lit(0)).cast("int")
    return F.concat(F.regexp_replace(whole_.cast("bigint").cast("string"), r"(?<=\d)(?=(\d{3})+$)", "," if commas else ""), F.when(digits > 0, F.concat(F.lit("."), F.lpad(F.round((v - whole_) * F.pow(F.lit(10.0), digits)).cast("bigint").cast("string"), digits, "0"))).otherwise(""))


@define("FIXED")
def fixed(x: Ex, digits: Ex | None = None, no_commas: Ex | None = None) -> Ex:
    n, d = num(x), num(digits) if digits is not None else literal(2)
    if no_commas is not None and not no_commas.literal:
        raise Unsupported("FIXED with a flag from a column")
    s = fixed_text(n.col, d.col, not (no_commas is not None and no_commas.const))
    return Ex("text", F.concat(F.when((n.col < 0) & s.rlike("[1-9]"), F.lit("-")).otherwise(""), s), errors(n, d))


@define("DOLLAR")
def dollar(x: Ex, digits: Ex | None = None) -> Ex:
    n, d = num(x), num(digits) if digits is not None else literal(2)
    s = F.concat(F.lit("$"), fixed_text(n.col, d.col, True))
    return Ex("text", F.when(n.col < 0, F.concat(F.lit("("), s, F.lit(")"))).otherwise(s), errors(n, d))


# dates


def day_number(x: Ex) -> Ex:
    """The whole serial, which counts a 29 February 1900."""
    n = num(x)
    bad = (n.col < 0) | (n.col >= 2958466)
    return Ex("num", F.floor(n.col).cast("double"), n.err if x.kind in ("date", "time") else errors(n, flag(NUM, bad)))


def calendar(names: str, call: Callable[[Column], Column], at_zero: int | None = None, at_sixty: int | None = None) -> None:
    """at_zero and at_sixty: what serials 0 and 60 show, which no calendar has."""

    def run(x: Ex) -> Ex:
        d = date(x)
        got = call(d.col).cast("double")
        if at_zero is not None:
            got = F.when(d.col == F.lit("1899-12-31").cast("date"), F.lit(float(at_zero))).otherwise(got)
        if at_sixty is not None and x.kind not in ("date", "time"):
            got = F.when(F.floor(num(x).col) == 60, F.lit(float(at_sixty))).otherwise(got)
        return Ex("num", got, d.err)

    for n in names.split():
        FUNCTIONS[n] = run


calendar("YEAR", F.year, 1900)
calendar("MONTH", F.month, 1)
calendar("DAY", F.dayofmonth, 0, 29)
calendar("ISOWEEKNUM", F.weekofyear)


def clock(names: str, of_time: Callable[[Column], Column], of_seconds: Callable[[Column], Column]) -> None:
    def run(x: Ex) -> Ex:
        if x.kind == "time":
            return Ex("num", of_time(x.col).cast("double"), x.err)
        if x.kind == "date":
            return Ex("num", F.lit(0.0), x.err)
        n = num(x)
        seconds = F.pmod(F.round((n.col - F.floor(n.col)) * 86400), F.lit(86400.0))
        return Ex("num", of_seconds(seconds).cast("double"), errors(n, flag(NUM, (n.col < 0) | (n.col >= 2958466))))

    for n in names.split():
        FUNCTIONS[n] = run


clock("HOUR", F.hour, lambda s: F.floor(s / 3600))
clock("MINUTE", F.minute, lambda s: F.floor(s / 60) % 60)
clock("SECOND", F.second, lambda s: s % 60)


@define("DATE")
def date_(y: Ex, m: Ex, d: Ex) -> Ex:
    xs = [num(v) for v in (y, m, d)]
    if all(x.literal and not isinstance(x.const, Error) for x in xs):
        day = guarded(REGISTRY["DATE"].call, [x.const for x in xs])
        if not isinstance(day, Error) and day > 60:
            return Ex("date", F.lit(serial_date(day)))
    yy, mm, dd = (toward_zero(x.col).cast("int") for x in xs)
    year = F.when((yy >= 0) & (yy < 1900), yy + 1900).otherwise(yy)
    bad = (year < 1900) | (year > 9999)
    first = F.add_months(F.make_date(F.when(~bad, year), F.lit(1), F.lit(1)), mm - 1)
    return Ex("date", F.date_add(first, dd - 1), errors(*xs, flag(NUM, bad)))


@define("TIME")
def time_(h: Ex, m: Ex, s: Ex) -> Ex:
    xs = [num(v) for v in (h, m, s)]
    total = toward_zero(xs[0].col) * 3600 + toward_zero(xs[1].col) * 60 + toward_zero(xs[2].col)
    return Ex("num", F.pmod(total, F.lit(86400.0)) / 86400, errors(*xs, neg(total)))


def months_moved(end: bool):
    def run(start: Ex, months: Ex) -> Ex:
        d, n = date(start), num(months)
        first = F.when(d.col == F.lit("1899-12-31").cast("date"), F.lit("1900-01-01").cast("date")).otherwise(d.col)
        # add_months keeps the day where it can, as these functions do
        got = F.add_months(first, toward_zero(n.col).cast("int"))
        return Ex("date", F.last_day(got) if end else got, errors(d, n, flag(NUM, (got < F.lit("1900-01-01").cast("date")) | (got > F.lit("9999-12-31").cast("date")))))

    return run


FUNCTIONS["EDATE"], FUNCTIONS["EOMONTH"] = months_moved(False), months_moved(True)


@define("DAYS")
def days(end: Ex, start: Ex) -> Ex:
    a, b = day_number(end), day_number(start)
    return Ex("num", a.col - b.col, errors(a, b))


def constant(x: Ex | None, default: int) -> int:
    if x is None:
        return default
    if not x.literal:
        raise Unsupported("this argument must be a constant")
    return int(x.const)


@define("WEEKDAY")
def weekday(x: Ex, kind: Ex | None = None) -> Ex:
    k, d = constant(kind, 1), day_number(x)
    sunday = (d.col + 6) % 7  # 0 for Sunday
    shift = {1: (0, 1), 17: (0, 1), 2: (6, 1), 11: (6, 1), 3: (6, 0), **{12 + i: (5 - i, 1) for i in range(5)}}.get(k)
    if shift is None:
        return literal(Error(NUM))
    return Ex("num", ((sunday + shift[0]) % 7 + shift[1]).cast("double"), d.err)


@define("WEEKNUM")
def weeknum(x: Ex, kind: Ex | None = None) -> Ex:
    k, d, n = constant(kind, 1), date(x), day_number(x)
    if k == 21:
        return Ex("num", F.weekofyear(d.col).cast("double"), d.err)
    first = {1: 0, 17: 0, 2: 1, 11: 1, 12: 2, 13: 3, 14: 4, 15: 5, 16: 6}.get(k)  # Sunday is 0
    if first is None:
        return literal(Error(NUM))
    start = n.col - F.dayofyear(d.col) + 1 - F.when((F.year(d.col) == 1900) & (n.col >= 61), 1).otherwise(0)
    week = F.floor((n.col - start + F.pmod((start + 6) % 7 - first, F.lit(7))) / 7) + 1
    return Ex("num", F.when(n.col == 0, F.lit(0.0)).otherwise(week).cast("double"), n.err)


@define("DATEDIF")
def datedif(start: Ex, end: Ex, unit: Ex) -> Ex:
    a, b = date(start), date(end)
    u = str(unit.const).upper() if unit.literal else ""
    months = (F.year(b.col) - F.year(a.col)) * 12 + F.month(b.col) - F.month(a.col) - F.when(F.dayofmonth(b.col) < F.dayofmonth(a.col), 1).otherwise(0)
    got = {"D": F.datediff(b.col, a.col), "M": months, "Y": F.floor(months / 12), "YM": months % 12}.get(u)
    if got is None:
        raise Unsupported("DATEDIF with this unit")
    return Ex("num", got.cast("double"), errors(a, b, flag(NUM, a.col > b.col)))


@define("TODAY")
def today() -> Ex:
    return Ex("date", F.current_date())


@define("NOW")
def now() -> Ex:
    return Ex("time", F.current_timestamp().cast("timestamp_ntz"))


def weekdays_before(d: Column) -> Column:
    """Weekdays from a fixed Monday up to and with a day."""
    n = F.datediff(d, F.lit("1899-12-25").cast("date")) + 1
    return F.floor(n / 7) * 5 + F.least(n % 7, F.lit(5))


@define("NETWORKDAYS")
def networkdays(start: Ex, end: Ex) -> Ex:
    a, b = date(start), date(end)
    low, high = F.least(a.col, b.col), F.greatest(a.col, b.col)
    got = weekdays_before(high) - weekdays_before(F.date_sub(low, 1))
    return Ex("num", F.when(a.col <= b.col, got).otherwise(-got).cast("double"), errors(a, b))


@define("DAYS360")
def days360(start: Ex, end: Ex, european: Ex | None = None) -> Ex:
    a, b = date(start), date(end)
    d1, d2 = F.dayofmonth(a.col), F.dayofmonth(b.col)
    months = (F.year(b.col) - F.year(a.col)) * 360 + (F.month(b.col) - F.month(a.col)) * 30
    if european is not None and european.literal and european.const:
        got = months + F.least(d2, F.lit(30)) - F.least(d1, F.lit(30))
    else:
        d1 = F.when(a.col == F.last_day(a.col), F.lit(30)).otherwise(d1)
        last = b.col == F.last_day(b.col)
        got = months + F.when(last & (d1 < 30), F.lit(31)).when(last, F.lit(30)).otherwise(d2) - d1
    return Ex("num", got.cast("double"), errors(a, b))


# money


def annuity(r: Column, n: Column) -> Column:
    return F.when(r == 0, n).otherwise((F.pow(1 + r, n) - 1) / F.when(r == 0, F.lit(1.0)).otherwise(r))


def one_if(t: Column) -> Column:
    return F.when(t != 0, F.lit(1.0)).otherwise(F.lit(0.0))


def pmt_(r, n, pv, fv, t):
    return -(pv * F.pow(1 + r, n) + fv) / (annuity(r, n) * (1 + r * one_if(t)))


def fv_(r, n, pmt, pv, t):
    return -(pv * F.pow(1 + r, n) + pmt * (1 + r * one_if(t)) * annuity(r, n))


def ipmt_(r, per, n, pv, fv, t):
    pmt = pmt_(r, n, pv, fv, t)
    zero_ = F.lit(0.0)
    return F.when((t != 0) & (per == 1), zero_).when(t != 0, fv_(r, per - 2, pmt, pv + pmt, zero_) * r).otherwise(fv_(r, per - 1, pmt, pv, zero_) * r)


def period(r, per, n, *rest):
    return flag(NUM, (per < 1) | (per > n))


numeric("PMT", lambda r, n, pv, fv, t: pmt_(r, n, pv, fv, t), lambda r, n, pv, fv, t: flag(NUM, n == 0), 0, 0)
numeric("FV", lambda r, n, pmt, pv, t: fv_(r, n, pmt, pv, t), None, 0, 0)
numeric("PV", lambda r, n, pmt, fv, t: -(fv + pmt * (1 + r * one_if(t)) * annuity(r, n)) / F.pow(1 + r, n), None, 0, 0)
numeric("NPER", lambda r, pmt, pv, fv, t: F.when(r == 0, -(pv + fv) / pmt).otherwise(F.ln((pmt * (1 + r * one_if(t)) / r - fv) / (pv + pmt * (1 + r * one_if(t)) / r)) / F.ln(1 + r)), lambda r, pmt, pv, fv, t: flag(NUM, (r == 0) & (pmt == 0)), 0, 0)
numeric("IPMT", ipmt_, period, 0, 0)
numeric("PPMT", lambda r, per, n, pv, fv, t: pmt_(r, n, pv, fv, t) - ipmt_(r, per, n, pv, fv, t), period, 0, 0)
numeric("ISPMT", lambda r, per, n, pv: pv * r * (per / n - 1), lambda r, per, n, pv: flag(NUM, n == 0))
numeric("EFFECT", lambda r, n: F.pow(1 + r / toward_zero(n), toward_zero(n)) - 1, lambda r, n: flag(NUM, (r <= 0) | (n < 1)))
numeric("NOMINAL", lambda r, n: toward_zero(n) * (F.pow(1 + r, 1 / toward_zero(n)) - 1), lambda r, n: flag(NUM, (r <= 0) | (n < 1)))
numeric("RRI", lambda n, pv, fv: F.pow(fv / pv, 1 / n) - 1, lambda n, pv, fv: flag(NUM, (n <= 0) | (pv == 0) | (fv / pv < 0)))
numeric("PDURATION", lambda r, pv, fv: (F.ln(fv) - F.ln(pv)) / F.ln(1 + r), lambda r, pv, fv: flag(NUM, (r <= 0) | (pv <= 0) | (fv <= 0)))
numeric("SLN", lambda c, s, n: (c - s) / n, lambda c, s, n: zero(n))
numeric("SYD", lambda c, s, n, p: (c - s) * (n - p + 1) * 2 / (n * (n + 1)), lambda c, s, n, p: flag(NUM, (n <= 0) | (p <= 0) | (p > n)))
numeric("EXPON.DIST EXPONDIST", lambda x, r, c: F.when(c != 0, 1 - F.exp(-r * x)).otherwise(r * F.exp(-r * x)), lambda x, r, c: flag(NUM, (x < 0) | (r <= 0)))
numeric("WEIBULL.DIST WEIBULL", lambda x, a, b, c: F.when(c != 0, 1 - F.exp(-F.pow(x / b, a))).otherwise(a / b * F.pow(x / b, a - 1) * F.exp(-F.pow(x / b, a))), lambda x, a, b, c: flag(NUM, (x < 0) | (a <= 0) | (b <= 0)))


# notations of numbers, characters, addresses

#: Radix and bits of the two's complement of each notation, as in the library.
NOTATIONS = {"BIN": (2, 10), "OCT": (8, 30), "HEX": (16, 40)}


def truncated(x: Column) -> Column:
    """The whole part as a long; null where it does not fit."""
    return x.try_cast("bigint")


def beyond(n: Column, low: int, high: int) -> Column:
    return flag(NUM, F.coalesce(~n.between(low, high), F.lit(True)))


def in_radix(n: Column, radix: Column) -> Column:
    """Digits of a whole number that is not negative."""
    return F.call_function("conv", n.cast("string"), F.lit(10), radix)


def padded(s: Column, size: Column) -> Column:
    return F.lpad(s, F.greatest(F.char_length(s), size), F.lit("0"))


# Values below are computed without a look at the errors, so that nested calls stay small expressions.


def read_notation(x: Ex, kind: str) -> Ex:
    radix, width = NOTATIONS[kind]
    t = txt(x)
    digits = F.substring(F.regexp_replace(t.col, r"^\s+", ""), 1, 10)
    n = F.coalesce(F.call_function("conv", digits, F.lit(radix), F.lit(10)).try_cast("bigint"), F.lit(0))
    signed = F.shiftright(F.shiftleft(n, 64 - width), 64 - width)
    return Ex("num", signed.cast("double"), errors(t, flag(NUM, ~t.col.rlike({2: r"^\s*[01]{0,10}\s*$", 8: r"^\s*[0-7]{0,10}\s*$", 16: r"^\s*[0-9a-fA-F]{0,10}\s*$"}[radix]))))


def write_notation(n: Ex, kind: str, places: Ex | None) -> Ex:
    radix, width = NOTATIONS[kind]
    whole_ = truncated(n.col)
    err = errors(n, beyond(whole_, -(1 << width - 1), (1 << width - 1) - 1))
    s = in_radix(whole_.bitwiseAND(F.lit((1 << width) - 1)), F.lit(radix))
    if places is None or places.kind == "blank":
        return Ex("text", guard(s, err), err)
    size, plain_ = num(places).col.try_cast("int"), (whole_ < 0) | places.col.isNull()
    err = errors(err, num(places), flag(NUM, ~plain_ & F.coalesce((size < F.char_length(s)) | (size > 10), F.lit(True))))
    return Ex("text", guard(F.when(plain_, s).otherwise(padded(s, size)), err), err)


def notation(a: str, b: str):
    def run(x: Ex, places: Ex | None = None) -> Ex:
        n = num(x) if a == "DEC" else read_notation(x, a)
        return Ex("num", guard(n.col, n.err), n.err) if b == "DEC" else write_notation(n, b, places)

    return run


for _a in ("DEC", *NOTATIONS):
    for _b in ("DEC", *NOTATIONS):
        if _a != _b:
            FUNCTIONS[f"{_a}2{_b}"] = notation(_a, _b)


@define("BASE")
def base(x: Ex, radix: Ex, least: Ex | None = None) -> Ex:
    n, r, w = num(x), num(radix), num(least) if least is not None else literal(0)
    whole_, to, size = truncated(n.col), r.col.try_cast("int"), w.col.try_cast("int")
    err = errors(n, r, w, beyond(to, 2, 36), beyond(whole_, 0, 2**53 - 1), beyond(size, 0, 255))
    return Ex("text", guard(padded(in_radix(whole_, to), size), err), err)


def shifted(v: Column, places: Column) -> Column:
    return F.floor(v * F.pow(F.lit(2.0), places.try_cast("int")))


def too_far(v: Column, places: Column) -> Column:
    return errors(outside(v), flag(NUM, (F.abs(places) >= 54) | (v * F.pow(F.lit(2.0), places.try_cast("int")) >= float(2**48))))


numeric("BITLSHIFT", shifted, too_far)
numeric("BITRSHIFT", lambda v, n: shifted(v, -n), lambda v, n: too_far(v, -n))


def characters() -> list[str]:
    """The text of CHAR for each of the codes 1 to 255."""
    return [REGISTRY["CHAR"].call(i) for i in range(1, 256)]


@define("CHAR")
def char(x: Ex) -> Ex:
    n = num(x)
    place = n.col.try_cast("int")
    err = errors(n, flag(VALUE, F.coalesce(~place.between(1, 255), F.lit(True))))
    return Ex("text", F.get(F.array(*map(F.lit, characters())), place - 1), err)


@define("CODE")
def code(x: Ex) -> Ex:
    t = txt(x)
    point = F.ascii(t.col)
    #: characters whose code is not their code point
    moved = [(c, i) for i, c in enumerate(characters(), 1) if ord(c) != i]
    got = F.when(F.substring(t.col, 1, 1).isin([c for c, _ in moved]), F.element_at(F.create_map(*[F.lit(v) for pair in moved for v in pair]), F.substring(t.col, 1, 1)))
    err = errors(t, flag(VALUE, t.col == ""))
    return Ex("num", guard(F.coalesce(got, F.when(point < 256, point).otherwise(63)).cast("double"), err), err)


@define("UNICHAR")
def unichar(x: Ex) -> Ex:
    n = num(x)
    point = truncated(n.col)
    err = errors(n, flag(VALUE, F.coalesce(~point.between(1, 0x10FFFF) | point.between(0xD800, 0xDFFF), F.lit(True))))
    made = guard(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"), err)
    return Ex("text", F.when(point == 0xFEFF, F.lit("﻿")).otherwise(made), err)  # alone it would be read as a byte order mark


@define("ADDRESS")
def address(row: Ex, col: Ex, kind: Ex | None = None, a1: Ex | None = None, sheet: Ex | None = None) -> Ex:
    if sheet is not None or a1 is not None:
        raise Unsupported("ADDRESS with a notation or sheet")
    k = constant(kind, 1) if kind is None or kind.kind != "blank" else 1
    r, c = num(row), num(col)
    down, along = truncated(r.col), truncated(c.col)
    if k not in (1, 2, 3, 4):
        return literal(Error(VALUE))
    err = errors(r, c, flag(VALUE, F.coalesce(~(down.between(1, 1048576) & along.between(1, 16384)), F.lit(True))))
    i = F.when(along.between(1, 16384), along - 1)
    # one, two or three letters: A to Z, then AA to ZZ from 26 on, then AAA from 702 on
    letters = F.concat(
        F.when(i >= 702, F.chr(F.floor((i - 702) / 676) + 65)).otherwise(""),
        F.when(i >= 26, F.chr(F.floor((i - 26) / 26) % 26 + 65)).otherwise(""),
        F.chr(i % 26 + 65),
    )
    return Ex("text", guard(F.concat(F.lit("$" if k in (1, 3) else ""), letters, F.lit("$" if k in (1, 2) else ""), down.cast("string")), err), err)


def double_factorial(n: Column) -> Column:
    """From a table of the results for -1 to 300."""
    return F.element_at(F.array(*[F.lit(float(math.prod(range(i, 0, -2)))) for i in range(-1, 301)]), (n + 2).cast("int"))


numeric("FACTDOUBLE", lambda x: double_factorial(F.when((toward_zero(x) >= -1) & (toward_zero(x) <= 300), toward_zero(x)).otherwise(0)), lambda x: flag(NUM, (toward_zero(x) < -1) | (toward_zero(x) > 300)))
numeric("COMBINA", lambda n, k: combinations(toward_zero(n) + toward_zero(k) - 1, k), lambda n, k: flag(NUM, (toward_zero(n) < 1) | (toward_zero(k) < 0)))

# years and bills


@define("YEARFRAC")
def yearfrac(start: Ex, end: Ex, basis: Ex | None = None) -> Ex:
    kind, a, b = constant(basis, 0), date(start), date(end)
    if kind not in (2, 3):
        raise Unsupported("YEARFRAC by months")
    return Ex("num", F.abs(F.datediff(b.col, a.col)) / F.lit({2: 360.0, 3: 365.0}[kind]), errors(a, b))


def bill(names: str, call: Callable[[Column, Column], Column], sold: Callable[[Column, Column], Column]) -> None:
    """A treasury bill: days left and a rate or price; sold says which of these make sense."""

    def run(settlement: Ex, maturity: Ex, x: Ex) -> Ex:
        a, b, v = date(settlement), date(maturity), num(x)
        n = F.datediff(b.col, a.col).cast("double")
        err = errors(a, b, v, flag(NUM, (n <= 0) | (b.col > F.add_months(a.col, 12)) | ~sold(n, v.col)))
        return Ex("num", guard(call(n, v.col), err), err)

    for name in names.split():
        FUNCTIONS[name] = run


def bond_equivalent(n: Column, d: Column) -> Column:
    p, t = 1 - d * n / 360, n / F.when(n == 366, 366.0).otherwise(365.0)
    far = (-2 * t + 2 * F.sqrt(F.greatest(t * t - (2 * t - 1) * (1 - 1 / p), F.lit(0.0)))) / F.when(n > 182, 2 * t - 1).otherwise(1)
    return F.when(n <= 182, 365 * d / (360 - d * n)).otherwise(far)


bill("TBILLPRICE", lambda n, d: 100 * (1 - d * n / 360), lambda n, d: (d > 0) & (d * n < 360))
bill("TBILLYIELD", lambda n, p: (100 - p) / p * 360 / n, lambda n, p: p > 0)
bill("TBILLEQ", bond_equivalent, lambda n, d: (d > 0) & (d * n < 360))


def fraction_digits(f: Column) -> Column:
    return F.when(f == 1, 10.0).otherwise(F.pow(F.lit(10.0), F.ceil(F.log10(F.greatest(f, F.lit(1.0)))).cast("double")))


numeric("DOLLARDE", lambda x, f: toward_zero(x) + (x - toward_zero(x)) * fraction_digits(toward_zero(f)) / toward_zero(f), lambda x, f: flag(NUM, toward_zero(f) < 1))
numeric("DOLLARFR", lambda x, f: toward_zero(x) + (x - toward_zero(x)) * toward_zero(f) / fraction_digits(toward_zero(f)), lambda x, f: flag(NUM, toward_zero(f) < 1))


# -- functions that run the library ---------------------------------------------------------

#: Functions of the library whose results are text or logical; the rest give numbers.
TEXT_RESULTS = set(
    "ROMAN BASE CHAR UNICHAR ASC VALUETOTEXT ARRAYTOTEXT TEXT DEC2BIN DEC2HEX DEC2OCT BIN2HEX BIN2OCT HEX2BIN HEX2OCT OCT2BIN OCT2HEX COMPLEX IMCONJUGATE IMSUM IMSUB IMPRODUCT IMDIV "
    "IMEXP IMLN IMLOG10 IMLOG2 IMPOWER IMSQRT IMSIN IMCOS IMCOSH IMSINH IMSEC IMSECH IMCSC IMCSCH IMTAN IMCOT ADDRESS SUBSTITUTE TEXTBEFORE TEXTAFTER FIXED".split()
)
BOOL_RESULTS = {"EXACT"}


def library(name: str, args: list[Ex], arrays: dict[int, Grid] | None = None) -> Ex:
    """Runs a function of the library on Arrow batches, once for each distinct argument row of a batch.

    arrays: constant arrays among the arguments, by position.
    """
    fixed, size = arrays or {}, len(args)
    kind = "text" if name in TEXT_RESULTS else "bool" if name in BOOL_RESULTS else "num"
    call, takes_errors = REGISTRY[name].call, REGISTRY[name].errors
    spark_type = {"text": "string", "bool": "boolean", "num": "double"}[kind]
    cols = [num(a) if a.kind in ("date", "time") else a for i, a in enumerate(args) if i not in fixed]

    def whole_row(values: list[object]) -> list[object]:
        rest = iter(values)
        return [fixed[i] if i in fixed else next(rest) for i in range(size)]

    def run(*series: pd.Series) -> pd.DataFrame:
        memory: dict[tuple, tuple] = {}
        out = []
        for row in zip(*series, strict=True) if series else [()]:
            key = tuple((None if v is None or v != v else v) for v in row)
            if key not in memory:
                got = guarded(call, whole_row([v.item() if hasattr(v, "item") else v for v in key]), takes_errors)
                if isinstance(got, Error):
                    memory[key] = (None, got.kind)
                else:
                    memory[key] = ({"text": str, "bool": bool, "num": float}[kind](got) if got is not None else None, None)
            out.append(memory[key])
        return pd.DataFrame(out, columns=["v", "e"])

    made = F.pandas_udf(run, f"v {spark_type}, e string")
    if REGISTRY[name].volatile:
        made = made.asNondeterministic()
    got = made(*[c.col for c in cols]) if cols else made(F.lit(0))
    err = errors(*cols, got["e"])
    return Ex(kind, got["v"], err)


def call(name: str, args: list[Ex], arrays: dict[int, Grid] | None = None) -> Ex:
    f = REGISTRY.get(name)
    if f is not None and not f.least <= len(args) <= f.most:
        return literal(Error(VALUE))
    if arrays and f is not None and f.kind != "lazy":
        return library(name, args, arrays)
    if name in FUNCTIONS:
        try:
            return FUNCTIONS[name](*args)
        except Unsupported:
            pass
    if f is None:
        return literal(Error("#NAME?"))
    if f.kind in ("each", "custom", "whole"):
        return library(name, args)
    raise Unsupported(f"{name} over rows")
