"""Arithmetic, trigonometric, combinatorial and criteria functions."""

from __future__ import annotations

import math
import random

from ..values import DIV0, NA, NIMPL, NUM, VALUE, Criterion, Error, Grid, corner, criterion, is_num, logical, number, parse_number, text
from .registry import REGISTRY, cells, each, fsum, given, integer, numbers, whole

# -- reductions -----------------------------------------------------------------------------


@whole("SUM", 0, None)
def sum_(*args):
    return fsum(numbers(args)) if args else 0


@whole("COUNT", 0, None, errors=True)
def count(*args):
    n = 0
    for v, inside in cells(args):
        n += is_num(v) or not inside and (isinstance(v, bool) or isinstance(v, str) and parse_number(v) is not None)
    return n


@whole("COUNTA", 1, None, errors=True)
def counta(*args):
    return sum(v is not None for v, _ in cells(args))


@whole("COUNTBLANK", 1, None, errors=True)
def countblank(*args):
    return sum(v is None or v == "" and isinstance(v, str) for v, _ in cells(args))


@whole("AVERAGE", 1, None)
def average(*args):
    found = numbers(args)
    if not found:
        raise Error(DIV0)
    return fsum(found) / len(found)


@whole("MIN", 1, None)
def min_(*args):
    return min(numbers(args), default=0)


@whole("MAX", 1, None)
def max_(*args):
    return max(numbers(args), default=0)


@whole("PRODUCT", 1, None)
def product(*args):
    found = numbers(args)
    return math.prod(found) if found else 0


@whole("SUMSQ", 1, None)
def sumsq(*args):
    return fsum(x * x for x in numbers(args))


def loose(v: object) -> float:
    """SUMPRODUCT's view of a cell: numeric text counts, other text is 0."""
    if isinstance(v, Error):
        raise v
    if isinstance(v, str):
        return parse_number(v) or 0
    return number(v)


@whole("SUMPRODUCT", 1, None)
def sumproduct(*args):
    grids = [a if isinstance(a, Grid) else Grid([[a]]) for a in args]
    height, width = max(g.height for g in grids), max(g.width for g in grids)
    if any(g.height not in (1, height) or g.width not in (1, width) for g in grids):
        raise Error(VALUE)
    return fsum(math.prod(loose(g.rows[r if g.height > 1 else 0][c if g.width > 1 else 0]) for g in grids) for r in range(height) for c in range(width))


def two_arrays(names, term):
    @whole(names, 2)
    def run(a, b):
        x, y = a if isinstance(a, Grid) else Grid([[a]]), b if isinstance(b, Grid) else Grid([[b]])
        if x.height * x.width != y.height * y.width:
            raise Error(NA)
        both = list(zip(x.flat(), y.flat(), strict=True))
        for p, q in both:
            for v in (p, q):
                if isinstance(v, Error):
                    raise v
        return fsum(term(p, q) for p, q in both if is_num(p) and is_num(q))


two_arrays("SUMX2MY2", lambda x, y: x * x - y * y)
two_arrays("SUMX2PY2", lambda x, y: x * x + y * y)
two_arrays("SUMXMY2", lambda x, y: (x - y) ** 2)

#: Function codes of SUBTOTAL and AGGREGATE.
SUBTOTALS = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV.S", 8: "STDEV.P", 9: "SUM", 10: "VAR.S", 11: "VAR.P"}


@whole("SUBTOTAL", 2, None)
def subtotal(code, *args):
    n = integer(corner(code))
    if n % 100 not in SUBTOTALS or n not in (n % 100, n % 100 + 100):
        raise Error(VALUE)
    return REGISTRY[SUBTOTALS[n % 100]].call(*args)


@whole("AGGREGATE", 3, None, errors=True)
def aggregate(code, option, *args):
    n, option = integer(corner(code)), integer(corner(option))
    if n not in SUBTOTALS or not 0 <= option <= 3:
        raise Error(NIMPL if 12 <= n <= 19 or 4 <= option <= 7 else VALUE)
    if option in (2, 3):
        args = [Grid([[None if isinstance(v, Error) else v for v in row] for row in a.rows]) if isinstance(a, Grid) else a for a in args]
        args = [a for a in args if not isinstance(a, Error)]
    return REGISTRY[SUBTOTALS[n]].call(*args)


# -- criteria -------------------------------------------------------------------------------


def matching(pairs: tuple[object, ...], shape: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Places where every (range, criterion) pair holds; ranges of one cell stretch."""
    if len(pairs) % 2:
        raise Error(VALUE)
    tests: list[tuple[Grid, Criterion]] = []
    for grid, crit in zip(pairs[::2], pairs[1::2], strict=True):
        grid = grid if isinstance(grid, Grid) else Grid([[grid]])
        if shape is None:
            shape = (grid.height, grid.width)
        if (grid.height, grid.width) != shape:
            raise Error(VALUE)
        tests.append((grid, criterion(crit)))
    height, width = shape or (0, 0)
    return [(r, c) for r in range(height) for c in range(width) if all(t.matches(g.rows[r][c]) for g, t in tests)]


def picked(target: object, places: list[tuple[int, int]]) -> list[float]:
    grid = target if isinstance(target, Grid) else Grid([[target]])
    out = []
    for r, c in places:
        v = grid.rows[r][c] if r < grid.height and c < grid.width else None
        if isinstance(v, Error):
            raise v
        if is_num(v):
            out.append(v)
    return out


def shape_of(target: object) -> tuple[int, int]:
    return (target.height, target.width) if isinstance(target, Grid) else (1, 1)


@whole("SUMIF", 2, 3, errors=True)
def sumif(area, crit, target=None):
    return fsum(picked(area if target is None else target, matching((area, crit))))


@whole("COUNTIF", 2, errors=True)
def countif(area, crit):
    return len(matching((area, crit)))


@whole("AVERAGEIF", 2, 3, errors=True)
def averageif(area, crit, target=None):
    found = picked(area if target is None else target, matching((area, crit)))
    if not found:
        raise Error(DIV0)
    return fsum(found) / len(found)


@whole("SUMIFS", 3, None, errors=True)
def sumifs(target, *pairs):
    return fsum(picked(target, matching(pairs, shape_of(target))))


@whole("COUNTIFS", 2, None, errors=True)
def countifs(*pairs):
    return len(matching(pairs))


@whole("AVERAGEIFS", 3, None, errors=True)
def averageifs(target, *pairs):
    found = picked(target, matching(pairs, shape_of(target)))
    if not found:
        raise Error(DIV0)
    return fsum(found) / len(found)


@whole("MAXIFS", 3, None, errors=True)
def maxifs(target, *pairs):
    return max(picked(target, matching(pairs, shape_of(target))), default=0)


@whole("MINIFS", 3, None, errors=True)
def minifs(target, *pairs):
    return min(picked(target, matching(pairs, shape_of(target))), default=0)


# -- rounding -------------------------------------------------------------------------------


def unary(names, call):
    each(names, 1)(lambda x: call(number(x)))


unary("ABS", abs)
unary("SIGN", lambda x: (x > 0) - (x < 0))
unary("INT", math.floor)
unary("EXP", math.exp)
unary("SQRT", math.sqrt)
unary("SQRTPI", lambda x: math.sqrt(x * math.pi))
unary("LOG10", math.log10)
unary("LN", math.log)
unary("EVEN", lambda x: math.copysign(math.ceil(abs(x) / 2) * 2, x) if x else 0)
unary("ODD", lambda x: math.copysign(math.ceil((abs(x) - 1) / 2) * 2 + 1, x) if abs(x) > 1 else (-1 if x < 0 else 1))


def half_away(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x)


def scaled(x: float, digits: int, how) -> float:
    if digits >= 0:
        factor = 10.0**digits
        return how(x * factor) / factor
    factor = 10.0**-digits
    return how(x / factor) * factor


@each("ROUND", 2)
def round_(x, digits):
    return scaled(number(x), integer(digits), half_away)


@each("ROUNDDOWN", 2)
def rounddown(x, digits):
    return scaled(number(x), integer(digits), math.trunc)


@each("TRUNC", 1, 2)
def trunc(x, digits=0):
    return scaled(number(x), integer(digits), math.trunc)


@each("ROUNDUP", 2)
def roundup(x, digits):
    return scaled(number(x), integer(digits), lambda v: math.copysign(math.ceil(abs(v)), v))


@each("MOD", 2)
def mod(x, y):
    x, y = number(x), number(y)
    if y == 0:
        raise Error(DIV0)
    return x - y * math.floor(x / y) if isinstance(x, int) and isinstance(y, int) else math.fmod(x, y) + (y if math.fmod(x, y) and (math.fmod(x, y) < 0) != (y < 0) else 0)


@each("QUOTIENT", 2)
def quotient(x, y):
    x, y = number(x), number(y)
    if y == 0:
        raise Error(DIV0)
    return math.trunc(x / y)


def multiple(x, s, how):
    return how(x / s) * s


@each("CEILING", 1, 2)
def ceiling(x, s=1):
    x, s = number(x), number(s)
    if s == 0:
        raise Error(DIV0)
    if s < 0 < x:
        raise Error(NUM)
    return multiple(x, abs(s) if x > 0 else s, math.ceil) if s > 0 else multiple(x, s, math.ceil)


@each("FLOOR", 1, 2)
def floor(x, s=1):
    x, s = number(x), number(s)
    if s == 0:
        raise Error(DIV0)
    if s < 0 < x:
        raise Error(NUM)
    return multiple(x, s, math.floor)


@each("CEILING.MATH", 1, 3)
def ceiling_math(x, s=1, mode=0):
    x, s = number(x), abs(number(s)) or 1
    return multiple(x, s, math.floor if x < 0 and number(mode) else math.ceil)


@each("FLOOR.MATH", 1, 3)
def floor_math(x, s=1, mode=0):
    x, s = number(x), abs(number(s)) or 1
    return multiple(x, s, math.ceil if x < 0 and number(mode) else math.floor)


@each("CEILING.PRECISE ISO.CEILING", 1, 2)
def ceiling_precise(x, s=1):
    x, s = number(x), abs(number(s))
    return multiple(x, s, math.ceil) if s else 0


@each("FLOOR.PRECISE", 1, 2)
def floor_precise(x, s=1):
    x, s = number(x), abs(number(s))
    return multiple(x, s, math.floor) if s else 0


@each("MROUND", 2)
def mround(x, m):
    x, m = number(x), number(m)
    if x == 0 or m == 0:
        return 0
    if (x < 0) != (m < 0):
        raise Error(NUM)
    return half_away(abs(x / m)) * m


@each("POWER", 2)
def power(x, y):
    return raise_to(number(x), number(y))


def raise_to(x: float, y: float) -> float:
    if x == 0 and y < 0:
        raise Error(DIV0)
    if x < 0 and not float(y).is_integer():
        raise Error(NUM)
    return float(x) ** float(y)


@each("LOG", 1, 2)
def log(x, base=10):
    x, base = number(x), number(base)
    if x <= 0 or base <= 0 or base == 1:
        raise Error(NUM)
    return math.log10(x) if base == 10 else math.log2(x) if base == 2 else math.log(x) / math.log(base)


@whole("SERIESSUM", 4)
def seriessum(x, n, m, coefficients):
    x, n, m = number(x), number(n), number(m)
    return fsum(c * x ** (n + i * m) for i, c in enumerate(numbers([coefficients])))


@each("BASE", 2, 3)
def base(x, radix, least=0):
    x, radix, least = integer(x), integer(radix), integer(least)
    if not 2 <= radix <= 36 or x < 0 or x >= 2**53 or not 0 <= least <= 255:
        raise Error(NUM)
    return in_radix(x, radix).rjust(least, "0")


def in_radix(x: int, radix: int) -> str:
    out = ""
    while x:
        x, r = divmod(x, radix)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[r] + out
    return out or "0"


@each("DECIMAL", 2)
def decimal(digits, radix):
    s, radix = text(digits).strip(), integer(radix)
    if not 2 <= radix <= 36:
        raise Error(NUM)
    return int(s, radix) if s else 0


#: Roman numerals, with the steps that the concise forms add.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
CONCISE = {1: [(950, "LM"), (450, "LD"), (95, "VC"), (45, "VL")], 2: [(990, "XM"), (490, "XD"), (99, "IC"), (49, "IL")], 3: [(995, "VM"), (495, "VD")], 4: [(999, "IM"), (499, "ID")]}


@each("ROMAN", 1, 2)
def roman(x, form=0):
    n = integer(x)
    form = (0 if form else 4) if isinstance(form, bool) else integer(form)
    if not 0 <= n <= 3999 or not 0 <= form <= 4:
        raise Error(VALUE)
    steps = sorted(ROMAN + [s for f in range(1, form + 1) for s in CONCISE[f]], reverse=True)
    out = ""
    for value, letters in steps:
        while n >= value:
            out, n = out + letters, n - value
    return out


@each("ARABIC", 1)
def arabic(s):
    s = text(s).strip().upper()
    sign = -1 if s.startswith("-") else 1
    s = s.lstrip("-")
    values = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    if any(c not in values for c in s) or len(s) > 255:
        raise Error(VALUE)
    total = 0
    for i, c in enumerate(s):
        total += -values[c] if i + 1 < len(s) and values[c] < values[s[i + 1]] else values[c]
    return sign * total


# -- trigonometry ---------------------------------------------------------------------------


def over(x: float) -> float:
    if abs(x) < 1e-12:
        raise Error(DIV0)
    return 1 / x


for _names, _call in {
    "SIN": math.sin,
    "COS": math.cos,
    "TAN": math.tan,
    "ASIN": math.asin,
    "ACOS": math.acos,
    "ATAN": math.atan,
    "SINH": math.sinh,
    "COSH": math.cosh,
    "TANH": math.tanh,
    "ASINH": math.asinh,
    "ACOSH": math.acosh,
    "ATANH": math.atanh,
    "SEC": lambda x: over(math.cos(x)),
    "CSC": lambda x: over(math.sin(x)),
    "COT": lambda x: over(math.tan(x)),
    "ACOT": lambda x: math.pi / 2 - math.atan(x),
    "SECH": lambda x: 1 / math.cosh(x),
    "CSCH": lambda x: over(math.sinh(x)),
    "COTH": lambda x: over(math.tanh(x)),
    "ACOTH": lambda x: math.atanh(1 / x) if abs(x) > 1 else math.log(-1),
    "RADIANS": math.radians,
    "DEGREES": math.degrees,
}.items():
    unary(_names, _call)


@each("ATAN2", 2)
def atan2(x, y):
    x, y = number(x), number(y)
    if x == 0 and y == 0:
        raise Error(DIV0)
    return math.atan2(y, x)


each("PI", 0)(lambda: math.pi)

# -- combinatorics --------------------------------------------------------------------------


@each("FACT", 1)
def fact(x):
    n = integer(x)
    if n < 0 or n > 170:
        raise Error(NUM)
    return float(math.factorial(n))


@each("FACTDOUBLE", 1)
def factdouble(x):
    n = integer(x)
    if n < -1 or n > 300:
        raise Error(NUM)
    return float(math.prod(range(n, 0, -2)))


def counts(n, k):
    n, k = integer(n), integer(k)
    if n < 0 or k < 0:
        raise Error(NUM)
    return n, k


@each("COMBIN", 2)
def combin(n, k):
    n, k = counts(n, k)
    if k > n:
        raise Error(NUM)
    return float(math.comb(n, k))


@each("COMBINA", 2)
def combina(n, k):
    n, k = counts(n, k)
    return float(math.comb(n + k - 1, k)) if n or not k else math.log(-1)


@each("PERMUT", 2)
def permut(n, k):
    n, k = counts(n, k)
    if k > n:
        raise Error(NUM)
    return float(math.perm(n, k))


def whole_numbers(args):
    found = [math.trunc(v) for v in numbers(args)]
    if any(v < 0 or v > 9.99999999e9 for v in found):
        raise Error(NUM)
    return found


whole("GCD", 1, None)(lambda *args: math.gcd(*whole_numbers(args)))
whole("LCM", 1, None)(lambda *args: math.lcm(*whole_numbers(args)))


@whole("MULTINOMIAL", 1, None)
def multinomial(*args):
    found = [math.trunc(v) for v in numbers(args)]
    if any(v < 0 for v in found) or sum(found) > 170:
        raise Error(NUM)
    return float(math.factorial(sum(found)) // math.prod(math.factorial(v) for v in found))


# -- random ---------------------------------------------------------------------------------

#: One generator an evaluation; the workbook seeds it.
source = random.Random()

each("RAND", 0, volatile=True)(lambda: source.random())


@each("RANDBETWEEN", 2, volatile=True)
def randbetween(low, high):
    low, high = math.ceil(number(low)), math.floor(number(high))
    if high < low:
        raise Error(NUM)
    return source.randint(low, high)


@whole("RANDARRAY", 0, 5, volatile=True)
def randarray(rows=None, cols=None, low=None, high=None, integers=None):
    rows, cols = integer(given(rows, 1)), integer(given(cols, 1))
    low, high, integers = number(given(low, 0)), number(given(high, 1)), logical(given(integers, False))
    if rows <= 0 or cols <= 0 or low > high or integers and (low != int(low) or high != int(high)):
        raise Error(VALUE)
    return Grid([[source.randint(int(low), int(high)) if integers else low + source.random() * (high - low) for _ in range(cols)] for _ in range(rows)])


