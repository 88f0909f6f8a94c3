"""Database functions: a table with headers, a field, and criteria rows (OR of rows, AND within)."""

from __future__ import annotations

from ..values import NUM, VALUE, Error, Grid, corner, criterion, is_num, parse_number, text
from .registry import REGISTRY, integer, whole


def selected(table: object, criteria: object) -> list[list[object]]:
    if not isinstance(table, Grid) or not isinstance(criteria, Grid):
        raise Error(VALUE)
    heads = [text(h).strip().lower() for h in table.rows[0]]
    names = [text(h).strip().lower() for h in criteria.rows[0]]
    tests = []
    for row in criteria.rows[1:]:
        tests.append([(heads.index(name), criterion(v)) for name, v in zip(names, row, strict=True) if v is not None and v != "" and name in heads])
    if not tests:
        tests = [[]]
    return [r for r in table.rows[1:] if any(all(c.matches(r[i]) for i, c in row) for row in tests)]


def column(table: Grid, field: object) -> int | None:
    field = corner(field)
    if isinstance(field, Error):
        raise field
    if field is None:
        return None
    if isinstance(field, str):
        heads = [text(h).strip().lower() for h in table.rows[0]]
        if field.strip().lower() not in heads:
            raise Error(VALUE)
        return heads.index(field.strip().lower())
    i = integer(field)
    if not 1 <= i <= table.width:
        raise Error(VALUE)
    return i - 1


def values(table, field, criteria) -> list[object]:
    i = column(table, field)
    rows = selected(table, criteria)
    return [r[i] if i is not None else 1 for r in rows]


def numeric(found: list[object]) -> list[float]:
    out = []
    for v in found:
        if isinstance(v, Error):
            raise v
        if is_num(v):
            out.append(v)
        elif isinstance(v, str) and parse_number(v) is not None:
            out.append(parse_number(v))
    return out


def reduction(name: str, base: str) -> None:
    whole(name, 3, errors=True)(lambda t, f, c: REGISTRY[base].call(Grid([[v] for v in numeric(values(t, f, c))])))


for _name, _base in {"DSUM": "SUM", "DAVERAGE": "AVERAGE", "DMAX": "MAX", "DMIN": "MIN", "DPRODUCT": "PRODUCT", "DSTDEV": "STDEV.S", "DSTDEVP": "STDEV.P", "DVAR": "VAR.S", "DVARP": "VAR.P"}.items():
    reduction(_name, _base)
whole("DCOUNT", 3, errors=True)(lambda t, f, c: sum(is_num(v) for v in values(t, f, c)))
whole("DCOUNTA", 3, errors=True)(lambda t, f, c: sum(v is not None for v in values(t, f, c)))


@whole("DGET", 3, errors=True)
def dget(table, field, criteria):
    found = values(table, field, criteria)
    if len(found) != 1:
        raise Error(NUM if found else VALUE)
    return found[0]
