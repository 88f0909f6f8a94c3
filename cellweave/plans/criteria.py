"""Criteria as predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import Criterion, has_wildcard, wildcard
from .columns import Ex, parsed, serial_of_date, serial_of_time, txt


def predicate(x: Ex, c: Criterion) -> Column:
    """Never null: rows with an error do not match."""
    got = F.coalesce(raw(x, c), F.lit(False))
    return got if x.err is None else got & x.err.isNull()


def number_of(x: Ex) -> Column:
    """The cell as a number where it is one or reads as one, else null."""
    if x.kind == "text":
        return parsed(x.col)
    return {"num": x.col, "bool": x.col.cast("double"), "date": serial_of_date(x.col) if x.kind == "date" else x.col, "time": serial_of_time(x.col) if x.kind == "time" else x.col, "blank": x.col}[x.kind]


def raw(x: Ex, c: Criterion) -> Column:
    v = c.value
    if c.op in (">", ">=", "<", "<="):
        n = F.when(x.col.isNull(), F.lit(0.0)).otherwise(number_of(x))
        return {">": n > v, ">=": n >= v, "<": n < v, "<=": n <= v}[c.op]
    if c.op == "like":
        return like(x, v)
    if c.op == "<>":
        hit = like(x, v) if isinstance(v, str) and has_wildcard(v) else equals(x, v)
        return ~F.coalesce(hit, F.lit(False))
    return equals(x, v)


def like(x: Ex, pattern: str) -> Column:
    t = F.lower(txt(x).col)
    simple = re.fullmatch(r"(\*?)([^*?~]*)(\*?)", pattern)
    if simple:  # plain prefixes, suffixes and parts keep to string functions
        part = simple[2].lower()
        if simple[1] and simple[3]:
            return t.contains(part)
        return t.startswith(part) if simple[3] else t.endswith(part) if simple[1] else t == part
    return txt(x).col.rlike("(?is)^(?:" + wildcard(pattern).pattern + ")$")


def equals(x: Ex, v: object) -> Column:
    if v is None or v == "" and isinstance(v, str):
        blank = x.col.isNull()
        return blank | (x.col == "") if x.kind == "text" else blank | (F.abs(x.col) < 1e-12) if x.kind == "num" and v is None else blank
    if isinstance(v, bool):
        return x.col == F.lit(v) if x.kind == "bool" else F.lit(False)
    if isinstance(v, (int, float)):
        if x.kind == "bool":
            return x.col.cast("double") == float(v)
        n = number_of(x)
        near = F.abs(n - float(v)) < 1e-12 if not float(v).is_integer() else n == float(v)
        return near | x.col.isNull() if abs(v) < 1e-12 else near
    if x.kind == "text":
        return F.lower(x.col) == F.lit(v.lower())
    return F.lit(False)


