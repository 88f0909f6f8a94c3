"""Text functions."""

from __future__ import annotations

import math
import re

from ..values import NA, VALUE, Error, Grid, corner, date_parts, day_seconds, is_num, logical, number, number_text, parse_datetime, parse_number, text, wildcard
from .registry import cells, each, given, integer, single, whole

LIMIT = 32767


def limited(s: str) -> str:
    if len(s) > LIMIT:
        raise Error(VALUE)
    return s


def upto(n) -> int:
    n = integer(n)
    if n < 0:
        raise Error(VALUE)
    return n


each("LEN LENB", 1)(lambda s: len(text(s)))
each("LEFT LEFTB", 1, 2)(lambda s, n=1: text(s)[: upto(n)])


@each("RIGHT RIGHTB", 1, 2)
def right(s, n=1):
    s, n = text(s), upto(n)
    return s[max(0, len(s) - n) :] if n else ""


@each("MID MIDB", 3)
def mid(s, start, n):
    start, n = integer(start), upto(n)
    if start < 1:
        raise Error(VALUE)
    return text(s)[start - 1 : start - 1 + n]


@each("REPLACE REPLACEB", 4)
def replace(s, start, n, new):
    s, start, n = text(s), integer(start), upto(n)
    if start < 1:
        raise Error(VALUE)
    return s[: start - 1] + text(new) + s[start - 1 + n :]


@each("SUBSTITUTE", 3, 4)
def substitute(s, old, new, instance=None):
    s, old, new = text(s), text(old), text(new)
    if instance is None:
        return s.replace(old, new) if old else s
    n = integer(instance)
    if n < 1:
        raise Error(VALUE)
    parts = s.split(old) if old else [s]
    return old.join(parts[:n]) + new + old.join(parts[n:]) if n < len(parts) else s


def ascii_only(s: str, how) -> str:
    return "".join(how(c) if c.isascii() else c for c in s)


each("UPPER", 1)(lambda s: ascii_only(text(s), str.upper))
each("LOWER", 1)(lambda s: ascii_only(text(s), str.lower))
each("TRIM", 1)(lambda s: " ".join(text(s).split()))
each("CLEAN", 1)(lambda s: re.sub(r"[\x00-\x1f]", "", text(s)))
each("EXACT", 2)(lambda a, b: text(a) == text(b))
each("CONCATENATE", 1, None)(lambda *args: limited("".join(map(text, args))))


@each("PROPER", 1)
def proper(s):
    out, inside = "", False
    for c in text(s):
        out += c.lower() if inside else c.upper()
        inside = c.isalnum()
    return out


@each("FIND FINDB", 2, 3)
def find(what, within, start=1):
    what, within, start = text(what), text(within), integer(start)
    if start < 1 or start > len(within) + 1:
        raise Error(VALUE)
    at = within.find(what, start - 1)
    if at < 0:
        raise Error(VALUE)
    return at + 1


@each("SEARCH SEARCHB", 2, 3)
def search(what, within, start=1):
    what, within, start = text(what), text(within), integer(start)
    if start < 1 or start > len(within) + 1:
        raise Error(VALUE)
    m = re.compile(wildcard(what).pattern.replace(".*", ".*?"), re.IGNORECASE | re.DOTALL).search(within, start - 1)
    if not m:
        raise Error(VALUE)
    return m.start() + 1


def joined(args, delimiter="", skip=True) -> str:
    out = []
    for v, _ in cells(args):
        if isinstance(v, Error):
            raise v
        s = text(v)
        if s or not skip:
            out.append(s)
    return limited(delimiter.join(out))


whole("CONCAT", 1, None)(lambda *args: joined(args))


@whole("TEXTJOIN", 3, None)
def textjoin(delimiter, skip, *args):
    return joined(args, text(single(delimiter)), logical(single(skip)))


@each("REPT", 2)
def rept(s, n):
    s, n = text(s), upto(n)
    if len(s) * n > LIMIT:
        raise Error(VALUE)
    return s * n


@each("CHAR", 1)
def char(n):
    n = integer(n)
    if not 1 <= n <= 255:
        raise Error(VALUE)
    return bytes([n]).decode("cp1252", "replace") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n)


@each("CODE", 1)
def code(s):
    s = text(s)
    if not s:
        raise Error(VALUE)
    try:
        return s[0].encode("cp1252")[0]
    except UnicodeEncodeError:
        return ord(s[0]) if ord(s[0]) < 256 else 63


@each("UNICHAR", 1)
def unichar(n):
    n = integer(n)
    if n <= 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        raise Error(VALUE)
    return chr(n)


@each("UNICODE", 1)
def unicode_(s):
    if not text(s):
        raise Error(VALUE)
    return ord(text(s)[0])


#: Full-width forms of printable ASCII stand 0xFEE0 above it; the ideographic space is a blank.
each("ASC", 1)(lambda s: "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if c == "　" else c for c in text(s)))


def cut(s, delimiter, instance):
    """Start and end of the wanted occurrence."""
    s, d, n = text(s), text(delimiter), integer(instance)
    if not d or n == 0:
        raise Error(VALUE)
    places = [m.start() for m in re.finditer(re.escape(d), s)]
    if abs(n) > len(places):
        raise Error(NA)
    at = places[n - 1] if n > 0 else places[n]
    return s, at, at + len(d)


@each("TEXTBEFORE", 2, 3)
def textbefore(s, d, n=1):
    s, at, _ = cut(s, d, n)
    return s[:at]


@each("TEXTAFTER", 2, 3)
def textafter(s, d, n=1):
    s, _, end = cut(s, d, n)
    return s[end:]


@whole("TEXTSPLIT", 2, 6)
def textsplit(s, col, row=None, skip=None, mode=None, pad=None):
    s = text(single(s))
    skip = logical(single(skip)) if skip is not None else False
    flags = re.IGNORECASE if mode is not None and number(single(mode)) else 0

    def pieces(t: str, d: object) -> list[str]:
        ds = [text(v) for v, _ in cells([d]) if v is not None and text(v)] if d is not None else []
        if d is not None and not ds:
            raise Error(VALUE)
        found = re.split("|".join(map(re.escape, sorted(ds, key=len, reverse=True))), t, flags=flags) if ds else [t]
        return [p for p in found if p or not skip]

    rows = [pieces(r, col) for r in pieces(s, row)]
    width = max(map(len, rows), default=0)
    if not width:
        raise Error("#CALC!")
    fill = corner(pad) if pad is not None else Error(NA)
    return Grid([r + [fill] * (width - len(r)) for r in rows])


def shown(v: object, strict_: bool) -> str:
    if strict_ and isinstance(v, str):
        return '"' + v.replace('"', '""') + '"'
    return text(v)


@each("VALUETOTEXT", 1, 2, errors=True)
def valuetotext(v, mode=0):
    if isinstance(mode, Error):
        raise mode
    if integer(mode) not in (0, 1):
        raise Error(VALUE)
    return shown(v, integer(mode) == 1)


@whole("ARRAYTOTEXT", 1, 2, errors=True)
def arraytotext(v, mode=None):
    mode = integer(single(mode)) if mode is not None else 0
    if mode not in (0, 1):
        raise Error(VALUE)
    grid = v if isinstance(v, Grid) else Grid([[v]])
    if mode:
        return "{" + ";".join(",".join(shown(x, True) for x in row) for row in grid.rows) + "}"
    return ", ".join(shown(x, False) for x in grid.flat())


@each("VALUE", 1)
def value(v):
    if isinstance(v, bool):
        raise Error(VALUE)
    if is_num(v) or v is None:
        return given(v, 0)
    got = parse_number(v)
    if got is None:
        got = parse_datetime(v)
    if got is None:
        raise Error(VALUE)
    return got


@each("NUMBERVALUE", 1, 3)
def numbervalue(v, decimal=".", group=","):
    s, decimal, group = text(v), text(decimal)[:1], text(group)[:1]
    if not decimal or decimal == group:
        raise Error(VALUE)
    s = "".join(s.split())
    if not s:
        return 0
    whole_, point, part = s.partition(decimal)
    if group and group in part:
        raise Error(VALUE)
    percent = len(part if point else whole_) - len((part if point else whole_).rstrip("%"))
    got = parse_number((whole_.replace(group, "") if group else whole_) .rstrip("%") + ("." + part.rstrip("%") if point else ""))
    if got is None:
        raise Error(VALUE)
    return got / 100**percent


def fixed_point(x: float, digits: int, commas: bool) -> str:
    """Rounded half away from zero, with a fixed number of decimals."""
    factor = 10.0 ** abs(digits)
    n = math.floor(abs(x) * factor + 0.5) / factor if digits >= 0 else math.floor(abs(x) / factor + 0.5) * factor
    return f"{n:{',' if commas else ''}.{max(0, digits)}f}"


@each("FIXED", 1, 3)
def fixed(x, digits=2, no_commas=False):
    x, digits = number(x), integer(digits)
    s = fixed_point(x, digits, not logical(no_commas))
    return ("-" if x < 0 and re.search("[1-9]", s) else "") + s


@each("DOLLAR", 1, 2)
def dollar(x, digits=2):
    x = number(x)
    s = "$" + fixed_point(x, integer(digits), True)
    return f"({s})" if x < 0 else s


#: Names of months and days.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


@each("TEXT", 2)
def text_(v, form):
    form = text(form)
    if isinstance(v, str):
        got = parse_number(v)
        got = parse_datetime(v) if got is None else got
        if got is None:
            return v
        v = got
    if isinstance(v, bool):
        return text(v)
    return format_number(number(v), form)


def format_number(x: float, form: str) -> str:
    if not form or form.lower() == "general":
        return number_text(x) if form else ""
    sections = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', form)
    if x < 0 and len(sections) > 1:
        return format_section(-x, sections[1])
    if x == 0 and len(sections) > 2:
        return format_section(0, sections[2])
    return format_section(x, sections[0])


def format_section(x: float, form: str) -> str:
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", form)
    if re.search(r"[ymdhs]", bare, re.IGNORECASE) and not re.search(r"[0#?]", bare.replace("0", "") if "." in bare and re.search(r"s\.0", bare) else bare):
        return format_date(x, form)
    return format_digits(x, form)


def format_digits(x: float, form: str) -> str:
    tokens = re.findall(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.|[0#?.,%]+|[eE][+-]|.', form)
    core = "".join(t for t in tokens if re.fullmatch(r"[0#?.,%]+|[eE][+-]", t))
    if not re.search(r"[0#?]", core):
        return "".join(t.strip('"') if t[0] == '"' else t[1:] if t[0] == "\\" else "" if t[0] in "[_*" else t for t in tokens)
    x *= 100 ** core.count("%")
    science = re.search(r"[eE]([+-])(0+)", form)
    digits = re.sub(r"[%eE+-]", "", core if not science else core[: re.search(r"[eE]", core).start()])
    scale = len(digits) - len(digits.rstrip(","))
    digits = digits.rstrip(",")
    x /= 1000**scale
    left, _, right = digits.partition(".")
    commas, left = "," in left, left.replace(",", "")
    sign = "-" if x < 0 else ""
    exponent = 0
    if science and x:
        exponent = math.floor(math.log10(abs(x)))
        x /= 10.0**exponent
    s = fixed_point(x, len(right), False)
    whole_, _, part = s.partition(".")
    least = left.count("0")
    whole_ = whole_.lstrip("0").rjust(least, "0")
    if commas:
        whole_ = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", whole_)
    keep = len(part)
    while keep and right[keep - 1] in "#?" and part[keep - 1] == "0":
        keep -= 1
    body = whole_ + ("." + part[:keep] if "." in digits else "")
    if science:
        body += "E" + ("-" if exponent < 0 else "+" if science[1] == "+" else "") + str(abs(exponent)).rjust(len(science[2]), "0")
    if not re.search("[1-9]", body):
        sign = ""
    out, done = "", False
    for t in tokens:
        if re.fullmatch(r"[0#?.,%]+", t):
            out += ("" if done else body) + "%" * t.count("%")
            done = True
        elif re.fullmatch(r"[eE][+-]", t):
            continue
        else:
            out += t.strip('"') if t[0] == '"' else t[1:] if t[0] == "\\" else "" if t[0] in "[_*" else t
    return sign + out


def format_date(x: float, form: str) -> str:
    y, mo, d = date_parts(x)
    sec = day_seconds(x)
    weekday = DAYS[(math.floor(x) + 6) % 7]
    tokens = re.findall(r'"[^"]*"|\\.|\[h+\]|\[m+\]|\[s+\]|AM/PM|am/pm|A/P|y+|m+|d+|h+|s+|.', form, re.IGNORECASE)
    half = any(t.upper() in ("AM/PM", "A/P") for t in tokens)
    out, last = [], ""
    for i, t in enumerate(tokens):
        low = t.lower()
        h = sec // 3600
        if t[0] == '"':
            out.append(t[1:-1])
        elif t[0] == "\\":
            out.append(t[1:])
        elif low in ("am/pm", "a/p"):
            mark = ("AM", "PM")[h >= 12] if low == "am/pm" else "AP"[h >= 12]
            out.append(mark)
        elif low.startswith("[h"):
            out.append(str(math.floor(x) * 24 + h))
            last = "h"
        elif low.startswith("["):
            out.append(str(math.floor(x * (1440 if "m" in low else 86400))))
        elif low[0] == "y":
            out.append(f"{y % 100:02d}" if len(t) <= 2 else f"{y:04d}")
        elif low[0] == "m":
            following = next((u.lower() for u in tokens[i + 1 :] if re.match(r"[ymdhs]", u, re.IGNORECASE)), "")
            if len(t) <= 2 and (last == "h" or following.startswith("s")):
                out.append(str(sec // 60 % 60).rjust(len(t), "0"))
            else:
                out.append({1: str(mo), 2: f"{mo:02d}", 3: MONTHS[mo - 1][:3], 4: MONTHS[mo - 1], 5: MONTHS[mo - 1][0]}[min(len(t), 5)])
        elif low[0] == "d":
            out.append({1: str(d), 2: f"{d:02d}", 3: weekday[:3], 4: weekday}[min(len(t), 4)])
        elif low[0] == "h":
            out.append(str((h % 12 or 12) if half else h).rjust(len(t), "0"))
        elif low[0] == "s":
            out.append(str(sec % 60).rjust(len(t), "0"))
        else:
            out.append(t)
        if low[0] in "ymdhs":
            last = low[0]
    return "".join(out)
