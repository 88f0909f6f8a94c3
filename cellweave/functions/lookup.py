"""Lookup, reference and dynamic-array functions."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

from ..formula.nodes import CellRef, Omitted, RangeRef
from ..formula.parser import MAX_COLS, MAX_ROWS, column_letters
from ..values import CALC, NA, NIMPL, REF, VALUE, Error, Grid, compare, corner, has_wildcard, is_num, logical, number, plain, same, text, wildcard
from .registry import REGISTRY, each, given, integer, lazy, single, whole


def grid(v: object) -> Grid:
    if isinstance(v, Error):
        raise v
    return v if isinstance(v, Grid) else Grid([[v]])


def line(v: object) -> list[object]:
    """A range of one row or one column."""
    g = grid(v)
    if g.height != 1 and g.width != 1:
        raise Error(VALUE)
    return list(g.flat())


def kind(v: object) -> str:
    return "n" if is_num(v) else "s" if isinstance(v, str) else "b" if isinstance(v, bool) else ""


def first_match(key: object, found: list[object], patterns: bool, last: bool = False) -> int | None:
    order = range(len(found) - 1, -1, -1) if last else range(len(found))
    if patterns and isinstance(key, str) and has_wildcard(key):
        p = wildcard(key)
        return next((i for i in order if isinstance(found[i], str) and p.fullmatch(found[i])), None)
    return next((i for i in order if same(key, found[i])), None)


def order_key(v: object):
    return v.lower() if isinstance(v, str) else v


def nearest(key: object, found: list[object], larger: bool = False, check: bool = True) -> int | None:
    """The last entry not above the key in ascending entries of its type (or the last not below, descending)."""
    k = kind(key if key is not None else 0)
    at = [i for i, v in enumerate(found) if kind(v) == k]
    keys = [order_key(found[i]) for i in at]
    key = order_key(key if key is not None else 0)
    if larger:
        if key in keys:
            return at[keys.index(key)]
        if check and any(a < b for a, b in zip(keys, keys[1:], strict=False)):
            raise Error(NA)
        n = sum(v >= key for v in keys)
        return at[n - 1] if n else None
    if check and any(a > b for a, b in zip(keys, keys[1:], strict=False)):
        raise Error(NA)
    n = bisect_right(keys, key)
    return at[n - 1] if n else None


def match(key, area, mode=None):
    key, found = single(key), line(area)
    mode = number(single(mode)) if mode is not None else 1
    got = first_match(key, found, True) if mode == 0 else nearest(key, found, larger=mode < 0)
    if got is None:
        raise Error(NA)
    return got + 1


def table_lookup(key, area, index, approximate, across):
    key, g, index = single(key), grid(area), integer(single(index))
    rows = g.columns() if across else g.rows
    if index < 1:
        raise Error(VALUE)
    if index > len(rows[0]):
        raise Error(REF)
    heads = [r[0] for r in rows]
    got = nearest(key, heads, check=False) if approximate is None or logical(single(approximate)) else first_match(key, heads, True)
    if got is None:
        raise Error(NA)
    return rows[got][index - 1]


def per_key(call):
    """A lookup of many keys gives as many results."""

    @functools.wraps(call)
    def run(key, *rest):
        if isinstance(key, Grid) and (key.height > 1 or key.width > 1):

            def one(k):
                try:
                    return corner(call(k, *rest))
                except Error as e:
                    return e

            return Grid([[one(k) for k in row] for row in key.rows])
        return call(key, *rest)

    return run


whole("VLOOKUP", 3, 4)(per_key(lambda k, a, i, m=None: table_lookup(k, a, i, m, False)))
whole("HLOOKUP", 3, 4)(per_key(lambda k, a, i, m=None: table_lookup(k, a, i, m, True)))
whole("MATCH", 2, 3)(per_key(match))


@whole("LOOKUP", 2, 3)
def lookup(key, area, results=None):
    key, g = single(key), grid(area)
    if results is None:
        across = g.width > g.height
        heads = g.rows[0] if across else [r[0] for r in g.rows]
        values = g.rows[-1] if across else [r[-1] for r in g.rows]
    else:
        heads, values = line(area), line(results)
    got = nearest(key, heads, check=False)
    if got is None or got >= len(values):
        raise Error(NA)
    return values[got]


def xfind(key: object, found: list[object], mode: int, search: int) -> int | None:
    if mode not in (-1, 0, 1, 2) or search not in (1, -1, 2, -2):
        raise Error(VALUE)
    last = search == -1
    if mode in (0, 2):
        return first_match(key, found, mode == 2, last)
    got = first_match(key, found, False, last)
    if got is not None:
        return got
    k = kind(key if key is not None else 0)
    of_kind = [i for i, v in enumerate(found) if kind(v) == k]
    keys = [order_key(found[i]) for i in of_kind]
    ascending = all(a <= b for a, b in zip(keys, keys[1:], strict=False))
    if not ascending and not all(a >= b for a, b in zip(keys, keys[1:], strict=False)):
        raise Error(NA)
    key = order_key(key if key is not None else 0)
    fit = [(v, i) for v, i in zip(keys, of_kind, strict=True) if (v < key if mode < 0 else v > key)]
    if not fit:
        return None
    best = max(v for v, _ in fit) if mode < 0 else min(v for v, _ in fit)
    places = [i for v, i in fit if v == best]
    return places[-1] if last else places[0]


@lazy("XLOOKUP", 3, 6)
def xlookup(interp, frame, args):
    key, area, results = (interp.value(a, frame) for a in args[:3])
    mode = integer(interp.single(args[4], frame)) if len(args) > 4 and not isinstance(args[4], Omitted) else 0
    search = integer(interp.single(args[5], frame)) if len(args) > 5 and not isinstance(args[5], Omitted) else 1
    heads_grid, results = grid(area), grid(results)
    heads = line(area)
    down = heads_grid.width == 1 and (heads_grid.height > 1 or results.height == 1 or results.width > 1)
    if (results.height if down else results.width) != len(heads):
        raise Error(VALUE)

    def one(k):
        if isinstance(k, Error):
            raise k
        got = xfind(k, heads, mode, search)
        if got is None:
            if len(args) > 3 and not isinstance(args[3], Omitted):
                return interp.value(args[3], frame)
            raise Error(NA)
        return Grid([results.rows[got]]) if down else Grid([[r[got]] for r in results.rows])

    if isinstance(key, Grid) and (key.height > 1 or key.width > 1):

        def safe(k):
            try:
                return corner(one(k))
            except Error as e:
                return e

        return Grid([[safe(k) for k in row] for row in key.rows])
    got = one(corner(key))
    return corner(got) if isinstance(got, Grid) and got.height == got.width == 1 else got


@whole("XMATCH", 2, 4)
def xmatch(key, area, mode=None, search=None):
    found = line(area)
    mode, search = integer(given(single(mode), 0)) if mode is not None else 0, integer(single(search)) if search is not None else 1

    def one(k):
        if isinstance(k, Error):
            return k
        got = xfind(k, found, mode, search)
        return Error(NA) if got is None else got + 1

    if isinstance(key, Grid) and (key.height > 1 or key.width > 1):
        return Grid([[one(k) for k in row] for row in key.rows])
    return one(single(key))


# -- dynamic arrays -------------------------------------------------------------------------


def ordering(a: object, b: object) -> int:
    """Numbers that read as such before by value, else text without case; pairs that do not compare tie."""
    try:
        return compare(a, b) or 0
    except Error:
        return 0


def sorted_rows(rows: list[list[object]], keys: list[tuple[list[object], int]]) -> list[list[object]]:
    def before(i: int, j: int) -> int:
        for values, direction in keys:
            got = ordering(values[i], values[j])
            if got:
                return got * direction
        return 0

    return [rows[i] for i in sorted(range(len(rows)), key=functools.cmp_to_key(before))]


def direction(v: object) -> int:
    n = integer(given(single(v), 1)) if v is not None else 1
    if n not in (1, -1):
        raise Error(VALUE)
    return n


@whole("SORT", 1, 4, errors=True)
def sort(area, index=None, order=None, by_col=None):
    g = grid(area)
    across = by_col is not None and logical(single(by_col))
    rows = g.columns() if across else g.rows
    i = integer(given(single(index), 1)) if index is not None else 1
    if not 1 <= i <= len(rows[0]):
        raise Error(VALUE)
    out = sorted_rows(rows, [([r[i - 1] for r in rows], direction(order))])
    return Grid([list(c) for c in zip(*out, strict=True)] if across else out)


@whole("SORTBY", 2, None, errors=True)
def sortby(area, *keys):
    g, found = grid(area), []
    across = False
    for i in range(0, len(keys), 2):
        k = grid(keys[i])
        across = k.height == 1 and k.width == g.width and g.height != 1
        values = line(keys[i])
        if len(values) != (g.width if across else g.height):
            raise Error(VALUE)
        found.append((values, direction(keys[i + 1] if i + 1 < len(keys) else None)))
    rows = g.columns() if across else g.rows
    out = sorted_rows(rows, found)
    return Grid([list(c) for c in zip(*out, strict=True)] if across else out)


def truthy(v: object) -> bool:
    if isinstance(v, Error):
        raise v
    return bool(v) if isinstance(v, bool) or is_num(v) else False


@whole("FILTER", 2, 3, errors=True)
def filter_(area, include, empty=None):
    g, mask = grid(area), grid(include)
    if mask.height == g.height and (mask.width == 1 or g.width == mask.width):
        rows = [r for r, m in zip(g.rows, mask.rows, strict=True) if any(truthy(v) for v in m)]
    elif mask.height == 1 and mask.width == g.width:
        keep = [i for i, v in enumerate(mask.rows[0]) if truthy(v)]
        rows = [[r[i] for i in keep] for r in g.rows] if keep else []
    else:
        raise Error(VALUE)
    if not rows:
        if empty is None:
            raise Error(CALC)
        return empty
    return Grid(rows)


def cell_key(v: object) -> object:
    return v.lower() if isinstance(v, str) else ("e", v.kind) if isinstance(v, Error) else (type(v) is bool, v)


@whole("UNIQUE", 1, 3, errors=True)
def unique(area, by_col=None, once=None):
    g = grid(area)
    across = by_col is not None and logical(single(by_col))
    rows = g.columns() if across else g.rows
    counts: dict[tuple, int] = {}
    for r in rows:
        k = tuple(map(cell_key, r))
        counts[k] = counts.get(k, 0) + 1
    seen, out = set(), []
    for r in rows:
        k = tuple(map(cell_key, r))
        if k not in seen and (counts[k] == 1 or once is None or not logical(single(once))):
            out.append(r)
        seen.add(k)
    if not out:
        raise Error(CALC)
    return Grid([list(c) for c in zip(*out, strict=True)] if across else out)


@whole("SEQUENCE", 1, 4)
def sequence(rows, cols=None, start=None, step=None):
    rows, cols = integer(single(rows)), integer(single(cols)) if cols is not None else 1
    start, step = number(single(start)) if start is not None else 1, number(single(step)) if step is not None else 1
    if rows < 1 or cols < 1:
        raise Error(VALUE)
    return Grid([[start + step * (r * cols + c) for c in range(cols)] for r in range(rows)])


whole("TRANSPOSE", 1, errors=True)(lambda g: Grid(grid(g).columns()))


def part(n: object, size: int, take: bool) -> slice:
    if n is None:
        return slice(None)
    n = integer(single(n))
    if take:
        if n == 0 or abs(n) > size:
            raise Error(VALUE if n else CALC)
        return slice(0, n) if n > 0 else slice(n, None)
    if abs(n) >= size:
        raise Error(CALC)
    return slice(n, None) if n >= 0 else slice(0, n)


@whole("TAKE", 2, 3, errors=True)
def take(area, rows, cols=None):
    g = grid(area)
    return Grid([r[part(cols, g.width, True)] for r in g.rows[part(rows, g.height, True)]])


@whole("DROP", 2, 3, errors=True)
def drop(area, rows, cols=None):
    g = grid(area)
    return Grid([r[part(cols, g.width, False)] for r in g.rows[part(rows, g.height, False)]])


@whole("VSTACK", 1, None, errors=True)
def vstack(*args):
    grids = [grid(a) if not isinstance(a, Error) else Grid([[a]]) for a in args]
    if len({g.width for g in grids}) > 1:
        raise Error(VALUE)
    return Grid([r for g in grids for r in g.rows])


@whole("HSTACK", 1, None, errors=True)
def hstack(*args):
    grids = [grid(a) if not isinstance(a, Error) else Grid([[a]]) for a in args]
    if len({g.height for g in grids}) > 1:
        raise Error(VALUE)
    return Grid([[v for g in grids for v in g.rows[r]] for r in range(grids[0].height)])


def flattened(area, ignore, by_col) -> list[object]:
    g = grid(area) if not isinstance(area, Error) else Grid([[area]])
    ignore = integer(single(ignore)) if ignore is not None else 0
    if not 0 <= ignore <= 3:
        raise Error(VALUE)
    rows = g.columns() if by_col is not None and logical(single(by_col)) else g.rows
    out = [v for r in rows for v in r if not (ignore & 1 and v is None or ignore & 2 and isinstance(v, Error))]
    if not out:
        raise Error(CALC)
    return out


whole("TOCOL", 1, 3, errors=True)(lambda a, i=None, b=None: Grid([[v] for v in flattened(a, i, b)]))
whole("TOROW", 1, 3, errors=True)(lambda a, i=None, b=None: Grid([flattened(a, i, b)]))


def chosen(args, size: int) -> list[int]:
    out = []
    for a in args:
        for v in a.flat() if isinstance(a, Grid) else [a]:
            i = integer(v)
            if i == 0 or abs(i) > size:
                raise Error(VALUE)
            out.append(i - 1 if i > 0 else size + i)
    return out


@whole("CHOOSECOLS", 2, None, errors=True)
def choosecols(area, *index):
    g = grid(area)
    at = chosen(index, g.width)
    return Grid([[r[i] for i in at] for r in g.rows])


@whole("CHOOSEROWS", 2, None, errors=True)
def chooserows(area, *index):
    g = grid(area)
    return Grid([g.rows[i] for i in chosen(index, g.height)])


# -- grouping -------------------------------------------------------------------------------

#: Aggregations by code.
AGGREGATIONS = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV.S", 8: "STDEV.P", 9: "SUM", 10: "VAR.S", 11: "VAR.P", 12: "MEDIAN"}
SYNONYMS = {"STDEV": "STDEV.S", "STDEVP": "STDEV.P", "VAR": "VAR.S", "VARP": "VAR.P", "MODE": "MODE.SNGL"}


def aggregation(v: object):
    v = single(v)
    name = AGGREGATIONS.get(integer(v)) if is_num(v) else SYNONYMS.get(text(v).upper(), text(v).upper())
    if name not in {*AGGREGATIONS.values(), "MODE.SNGL"}:
        raise Error(VALUE)

    def run(found: list[object]) -> object:
        if name in ("COUNTA",):
            return sum(v is not None for v in found)
        data = [int(v) if isinstance(v, bool) else v for v in found if isinstance(v, bool) or is_num(v)]
        try:
            return plain(REGISTRY[name].call(Grid([[v] for v in data])))
        except Error as e:
            return e

    return run


def shown_key(v: object) -> str:
    if isinstance(v, float) and not v.is_integer():
        return f"{v:.10f}".rstrip("0").rstrip(".")
    return text(v)


@whole("GROUPBY", 3, 6, errors=True)
def groupby(fields, values, how, headers=None, totals=None, order=None):
    keys, data, run = grid(fields), grid(values), aggregation(how)
    if keys.height != data.height:
        raise Error(VALUE)
    headers = integer(single(headers)) if headers is not None else 0
    totals = integer(single(totals)) if totals is not None else 0
    order = integer(single(order)) if order is not None else 0
    first = 1 if headers in (1, 3) else 0
    groups: dict[tuple, list[list[object]]] = {}
    for k, v in zip(keys.rows[first:], data.rows[first:], strict=True):
        groups.setdefault(tuple(map(shown_key, k)), []).append(v)
    listed = sorted(groups, key=lambda k: tuple(x.lower() for x in k), reverse=order < 0) if order else list(groups)
    out = [[*k, *(run([r[c] for r in groups[k]]) for c in range(data.width))] for k in listed]
    if totals >= 1:
        rows = data.rows[first:]
        out.append(["Grand Total", *[""] * (keys.width - 1), *(run([r[c] for r in rows]) for c in range(data.width))])
    if headers == 3:
        out.insert(0, [*keys.rows[0], *data.rows[0]])
    return Grid(out)


@whole("PIVOTBY", 4, 9, errors=True)
def pivotby(rows, cols, values, how, headers=None, row_totals=None, row_order=None, col_totals=None, col_order=None):
    r, c, data, run = grid(rows), grid(cols), grid(values), aggregation(how)
    if not r.height == c.height == data.height:
        raise Error(VALUE)
    headers = integer(single(headers)) if headers is not None else 0
    first = 1 if headers in (1, 3) else 0
    cells: dict[tuple, list[object]] = {}
    for a, b, v in zip(r.rows[first:], c.rows[first:], data.rows[first:], strict=True):
        cells.setdefault((tuple(map(shown_key, a)), " ".join(map(shown_key, b))), []).append(v[0])

    def listed(keys, order):
        n = integer(single(order)) if order is not None else 0
        keys = list(dict.fromkeys(keys))
        return sorted(keys, key=lambda k: str(k).lower(), reverse=n < 0) if n else keys

    down, across = listed([k[0] for k in cells], row_order), listed([k[1] for k in cells], col_order)
    with_row = col_totals is not None and integer(single(col_totals)) >= 1
    with_col = row_totals is not None and integer(single(row_totals)) >= 1
    out = [["" for _ in range(r.width)] + across + (["Grand Total"] if with_row else [])]
    for k in down:
        row = [*k, *(run(cells[(k, h)]) if (k, h) in cells else None for h in across)]
        out.append(row + ([run([v for h in across for v in cells.get((k, h), [])])] if with_row else []))
    if with_col:
        total = ["Grand Total", *[""] * (r.width - 1), *(run([v for k in down for v in cells.get((k, h), [])]) for h in across)]
        out.append(total + ([run([v for found in cells.values() for v in found])] if with_row else []))
    return Grid(out)


# -- references -----------------------------------------------------------------------------


@each("ADDRESS", 2, 5)
def address(row, col, kind_=1, a1=True, sheet=None):
    row, col = integer(row), integer(col)
    kind_ = integer(kind_) if kind_ is not None else 1
    if not 1 <= row <= MAX_ROWS or not 1 <= col <= MAX_COLS or kind_ not in (1, 2, 3, 4):
        raise Error(VALUE)
    fixed_row, fixed_col = kind_ in (1, 2), kind_ in (1, 3)
    if a1 is None or logical(a1):
        out = ("$" if fixed_col else "") + column_letters(col) + ("$" if fixed_row else "") + str(row)
    else:
        out = (f"R{row}" if fixed_row else f"R[{row}]") + (f"C{col}" if fixed_col else f"C[{col}]")
    if sheet is None:
        return out
    name = text(sheet)
    return ("'" + name.replace("'", "''") + "'" if not re.fullmatch(r"[A-Za-z_][\w.]*", name) else name) + "!" + out


def place(names, attribute):
    @lazy(names, 0, 1)
    def run(interp, frame, args):
        if not args:
            return getattr(frame, attribute) or Error(VALUE)
        ref = interp.reference(args[0], frame)
        if ref is None:
            v = interp.value(args[0], frame)
            if isinstance(v, Error):
                raise v
            raise Error(VALUE)
        low, high = (ref.row1, ref.row2) if attribute == "row" else (ref.col1, ref.col2)
        if high == low:
            return low
        return Grid([[i] for i in range(low, high + 1)] if attribute == "row" else [list(range(low, high + 1))])


place("ROW", "row")
place("COLUMN", "col")


def extent(names, side):
    @lazy(names, 1)
    def run(interp, frame, args):
        if isinstance(args[0], RangeRef) and (args[0].row1 if side == "height" else args[0].col1) is None:
            return MAX_ROWS if side == "height" else MAX_COLS
        ref = interp.reference(args[0], frame)
        if ref is not None:
            return ref.row2 - ref.row1 + 1 if side == "height" else ref.col2 - ref.col1 + 1
        v = interp.value(args[0], frame)
        if isinstance(v, Error):
            raise v
        return getattr(v, side) if isinstance(v, Grid) else 1


extent("ROWS", "height")
extent("COLUMNS", "width")


def area_of(ref) -> RangeRef | CellRef:
    if ref.row1 == ref.row2 and ref.col1 == ref.col2:
        return CellRef(ref.sheet, ref.row1, ref.col1)
    return RangeRef(ref.sheet, ref.row1, ref.col1, ref.row2, ref.col2)


@lazy("INDEX", 2, 4)
def index(interp, frame, args):
    r = interp.single(args[1], frame)
    r = integer(r) if r is not None else 0
    c = None
    if len(args) > 2 and not isinstance(args[2], Omitted):
        c = integer(interp.single(args[2], frame))
    ref = interp.reference(args[0], frame)
    if ref is not None:
        height, width = ref.row2 - ref.row1 + 1, ref.col2 - ref.col1 + 1
    else:
        g = grid(interp.value(args[0], frame))
        height, width = g.height, g.width
    if c is None:
        r, c = (1, r) if height == 1 and width > 1 else (r, 1 if width == 1 or len(args) == 2 else 0)
    if r < 0 or c < 0:
        raise Error(VALUE)
    if r > height or c > width:
        raise Error(REF)
    if ref is not None:
        top, bottom = (ref.row1, ref.row2) if r == 0 else (ref.row1 + r - 1, ref.row1 + r - 1)
        left, right = (ref.col1, ref.col2) if c == 0 else (ref.col1 + c - 1, ref.col1 + c - 1)
        return interp.read(ref.sheet, top, left, bottom, right, frame)
    rows = g.rows if r == 0 else [g.rows[r - 1]]
    out = rows if c == 0 else [[x[c - 1]] for x in rows]
    return out[0][0] if len(out) == len(out[0]) == 1 else Grid(out)


@lazy("OFFSET", 3, 5, volatile=True)
def offset(interp, frame, args):
    ref = interp.reference(args[0], frame)
    if ref is None:
        raise Error(REF)
    r, c = integer(interp.single(args[1], frame)), integer(interp.single(args[2], frame))
    height, width = ref.row2 - ref.row1 + 1, ref.col2 - ref.col1 + 1
    if len(args) > 3 and not isinstance(args[3], Omitted):
        height = integer(interp.single(args[3], frame))
    if len(args) > 4 and not isinstance(args[4], Omitted):
        width = integer(interp.single(args[4], frame))
    top, left = ref.row1 + r, ref.col1 + c
    if height < 1 or width < 1 or top < 1 or left < 1 or top + height - 1 > MAX_ROWS or left + width - 1 > MAX_COLS:
        raise Error(REF)
    return interp.read(ref.sheet, top, left, top + height - 1, left + width - 1, frame)


@lazy("INDIRECT", 1, 2, volatile=True)
def indirect(interp, frame, args):
    if len(args) > 1 and not logical(interp.single(args[1], frame)):
        raise Error(NIMPL)
    return interp.value(interp.parsed_reference(text(interp.single(args[0], frame))), frame)

