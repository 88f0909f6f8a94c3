"""Spreadsheet values in Python: coercions, errors, dates, comparison and criteria.

Numbers are int or float, text is str, logical values bool, blanks None. Errors are Error objects,
two-dimensional results lists of rows in a Grid. Dates and times are serial numbers of the 1900 date
system, which counts a 29 February 1900 that never was.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


class Error(Exception):
    """An error value; raised inside functions and returned by evaluation."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind

    def __repr__(self) -> str:
        return self.kind

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Error) and other.kind == self.kind

    def __hash__(self) -> int:
        return hash(self.kind)


VALUE, NA, DIV0, NUM, REF, NAME, CALC, NIMPL, SPILL, CIRC, NULL = ("#VALUE!", "#N/A", "#DIV/0!", "#NUM!", "#REF!", "#NAME?", "#CALC!", "#N/IMPL!", "#SPILL!", "#CIRC!", "#NULL!")


@dataclass
class Grid:
    """Rows of values. ``ref`` is the rectangle it was read from, if any: (sheet, row, col)."""

    rows: list[list[object]]
    ref: tuple[str, int, int] | None = None

    @property
    def height(self) -> int:
        return len(self.rows)

    @property
    def width(self) -> int:
        return len(self.rows[0]) if self.rows else 0

    def flat(self) -> Iterator[object]:
        for row in self.rows:
            yield from row

    def columns(self) -> list[list[object]]:
        return [list(c) for c in zip(*self.rows, strict=True)]


@dataclass
class Lambda:
    params: list[str]
    call: Callable[..., object] = field(repr=False)


def plain(v: object) -> object:
    """Floats without a fraction print and compare as integers; the type stays float inside formulas."""
    return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v


def is_num(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def parse_number(text: str) -> float | None:
    """Invariant number text: a decimal point, no thousands, an optional percent sign."""
    s = text.strip()
    percent = s.endswith("%")
    s = s[:-1].rstrip() if percent else s
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s):
        return None
    value = float(s)
    return value / 100 if percent else value


def number(v: object) -> float:
    """Lenient: numeric text counts; blank is 0; logical values are 1 and 0."""
    if isinstance(v, bool):
        return float(v)
    if is_num(v):
        return v
    if v is None:
        return 0
    if isinstance(v, Error):
        raise v
    if isinstance(v, str):
        got = parse_number(v)
        if got is not None:
            return got
    if isinstance(v, Grid):
        return number(corner(v))
    raise Error(VALUE)


def arithmetic(v: object) -> float:
    """As number, and date or time text counts too."""
    if isinstance(v, str):
        got = parse_number(v)
        got = parse_datetime(v) if got is None else got
        if got is None:
            raise Error(VALUE)
        return got
    return number(v)


def strict(v: object) -> float:
    """Text is refused."""
    if isinstance(v, str):
        raise Error(VALUE)
    return number(v)


def logical(v: object) -> bool:
    if isinstance(v, bool):
        return v
    if is_num(v):
        return v != 0
    if v is None:
        return False
    if isinstance(v, Error):
        raise v
    if isinstance(v, str) and v.lower() in ("true", "false"):
        return v.lower() == "true"
    if isinstance(v, Grid):
        return logical(corner(v))
    raise Error(VALUE)


def corner(v: object) -> object:
    """A single value: the top left one of a grid."""
    if isinstance(v, Grid):
        return v.rows[0][0] if v.rows and v.rows[0] else None
    return v


def number_text(v: float) -> str:
    """The shortest decimal that reads back as the same number, without exponent."""
    if isinstance(v, int) or float(v).is_integer() and abs(v) < 1e21:
        return str(int(v))
    text = repr(float(v))
    if "e" in text:
        mantissa, exponent = text.split("e")
        sign = "-" if mantissa.startswith("-") else ""
        whole, _, part = mantissa.lstrip("-").partition(".")
        digits, point = whole + part, len(whole) + int(exponent)
        text = sign + ("0." + "0" * -point + digits if point <= 0 else digits.ljust(point, "0")[:point] + ("." + digits[point:] if digits[point:] else ""))
    return text


def text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return v
    if isinstance(v, Error):
        return v.kind
    if isinstance(v, Grid):
        return text(corner(v))
    return number_text(v)


def finite(v: float) -> float:
    if isinstance(v, complex) or isinstance(v, float) and (math.isnan(v) or math.isinf(v)):
        raise Error(NUM)
    return v


# -- dates ----------------------------------------------------------------------------------

_EPOCH = dt.date(1899, 12, 31)
LAST_SERIAL = 2958465


def date_serial(d: dt.date) -> int:
    n = (d - _EPOCH).days
    return n + (n >= 60)


def serial_date(serial: float) -> dt.date:
    n = math.floor(serial)
    if n < 0 or n > LAST_SERIAL:
        raise Error(NUM)
    return _EPOCH + dt.timedelta(days=n - (n >= 60))


def date_parts(serial: float) -> tuple[int, int, int]:
    """Year, month and day as displayed: 60 is 29 February 1900 and 0 is 0 January 1900."""
    n = math.floor(serial)
    if n == 60:
        return 1900, 2, 29
    if n == 0:
        return 1900, 1, 0
    d = serial_date(n)
    return d.year, d.month, d.day


def day_seconds(serial: float) -> int:
    return round((serial - math.floor(serial)) * 86400) % 86400


#: English month names.
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "september" else "sep(?:t(?:ember)?)?" for m in _MONTHS) + r")\.?"


def _year(y: str) -> int:
    n = int(y)
    return n if len(y) > 2 else n + (2000 if n < 30 else 1900)


def _month(m: str) -> int:
    return next(i for i, name in enumerate(_MONTHS, 1) if name.startswith(m.lower()[:3]))


def parse_date(s: str) -> int | None:
    s = s.strip()
    forms: list[tuple[str, Callable[[re.Match], tuple[int, int, int]]]] = [
        (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", lambda m: (int(m[1]), int(m[2]), int(m[3]))),
        (r"(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})", lambda m: (_year(m[3]), int(m[1]), int(m[2]))),
        (rf"(\d{{1,2}})[- ]{_MONTH}[- ,]+(\d{{4}}|\d{{2}})", lambda m: (_year(m[3]), _month(m[2]), int(m[1]))),
        (rf"{_MONTH}[- ](\d{{1,2}}),?[- ]+(\d{{4}})", lambda m: (int(m[3]), _month(m[1]), int(m[2]))),
        (rf"{_MONTH}[- ](\d{{4}})", lambda m: (int(m[2]), _month(m[1]), 1)),
    ]
    for form, parts in forms:
        m = re.fullmatch(form, s, re.IGNORECASE)
        if m:
            y, mo, d = parts(m)
            if (y, mo, d) == (1900, 2, 29):
                return 60
            try:
                serial = date_serial(dt.date(y, mo, d))
            except ValueError:
                return None
            return serial if serial >= 0 else None
    return None


def parse_time(s: str) -> float | None:
    m = re.fullmatch(r"(\d{1,4}):(\d{1,2})(?::(\d{1,2})(\.\d+)?)?\s*([ap]\.?m\.?)?|(\d{1,2})\s*([ap]\.?m\.?)", s.strip(), re.IGNORECASE)
    if not m:
        return None
    half = (m[5] or m[7] or "").lower()[:1]
    h, mi, sec = int(m[1] or m[6]), int(m[2] or 0), int(m[3] or 0)
    if mi > 59 or sec > 59 or half and not 1 <= h <= 12 or not half and h > 23:
        return None
    h = h % 12 + 12 * (half == "p") if half else h
    return (h * 3600 + mi * 60 + sec + float(m[4] or 0)) / 86400


def parse_datetime(s: str) -> float | None:
    s = s.strip()
    whole = parse_date(s)
    if whole is not None:
        return whole
    time = parse_time(s)
    if time is not None:
        return time
    m = re.fullmatch(r"(.+?)[T ]+(\d{1,2}:.+)", s)
    if m:
        day, time = parse_date(m[1]), parse_time(m[2])
        if day is not None and time is not None:
            return day + time
    return None


def to_serial(v: object) -> object:
    """Python dates and times as serials; other values stay."""
    if isinstance(v, dt.datetime):
        return date_serial(v.date()) + (v.hour * 3600 + v.minute * 60 + v.second) / 86400
    if isinstance(v, dt.date):
        return date_serial(v)
    if isinstance(v, dt.time):
        return (v.hour * 3600 + v.minute * 60 + v.second) / 86400
    if isinstance(v, dt.timedelta):
        return v.total_seconds() / 86400
    return v


# -- comparison -----------------------------------------------------------------------------


def compare(a: object, b: object) -> int | None:
    """-1, 0 or 1: numbers by value, texts without case, mixed as numbers if both read as such, else as text."""
    for v in (a, b):
        if isinstance(v, Error):
            raise v
    if isinstance(a, str) and isinstance(b, str):
        x, y = a.lower(), b.lower()
    else:
        try:
            x, y = number(a), number(b)
        except Error:
            x, y = text(a).lower(), text(b).lower()
    return (x > y) - (x < y)


def same(a: object, b: object) -> bool:
    """Equality of lookups and criteria: numbers within 1e-12, text without case, blank as "" and 0."""
    if isinstance(a, Error) or isinstance(b, Error):
        return False
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b or is_num(a) and number(b) == a or is_num(b) and number(a) == b
    if isinstance(a, str) and isinstance(b, str):
        return a.lower() == b.lower()
    if a is None or b is None:
        other = b if a is None else a
        return other is None or other == "" or is_num(other) and abs(other) < 1e-12
    if is_num(a) and is_num(b):
        return abs(a - b) < 1e-12
    n, s = (a, b) if is_num(a) else (b, a)
    got = parse_number(s)
    return got is not None and abs(got - n) < 1e-12


def wildcard(pattern: str) -> re.Pattern:
    """* any run, ? one character, ~ before either takes it literally."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return re.compile(out, re.IGNORECASE | re.DOTALL)


def has_wildcard(s: str) -> bool:
    return bool(re.search(r"[*?~]", s))


@dataclass(frozen=True)
class Criterion:
    """What SUMIFS and its kin test: op is = <> > >= < <= or like."""

    op: str
    value: object

    def matches(self, v: object) -> bool:
        if isinstance(v, Error):
            return False
        if self.op == "like":
            return (v is None or isinstance(v, (str, bool)) or is_num(v)) and wildcard(self.value).fullmatch(text(v)) is not None
        if self.op == "=":
            return same(v, self.value)
        if self.op == "<>":
            return not (wildcard(self.value).fullmatch(text(v)) if isinstance(self.value, str) and has_wildcard(self.value) else same(v, self.value))
        try:
            n = number(v)
        except Error:
            return False
        return {">": n > self.value, ">=": n >= self.value, "<": n < self.value, "<=": n <= self.value}[self.op]


def criterion(v: object) -> Criterion:
    """The grammar of criteria: an operator and a number, text, TRUE or FALSE; or a pattern."""
    v = corner(v)
    if isinstance(v, Error):
        raise v
    if not isinstance(v, str):
        return Criterion("=", v)
    m = re.match(r"\s*(>=|<=|<>|>|<|=)", v)
    op, rest = (m[1], v[m.end() :]) if m else ("=", v)
    value: object = rest
    got = parse_number(rest)
    got = parse_datetime(rest) if got is None and rest.strip() else got
    if got is not None:
        value = got
    elif rest.strip().upper() in ("TRUE", "FALSE"):
        value = rest.strip().upper() == "TRUE"
    elif len(rest) > 1 and rest[0] == rest[-1] == '"':
        value = rest[1:-1]
    if op in (">", ">=", "<", "<="):
        return Criterion(op, value) if is_num(value) else Criterion("=", v)
    if op == "=" and isinstance(value, str) and has_wildcard(value):
        return Criterion("like", value)
    return Criterion(op, value)
