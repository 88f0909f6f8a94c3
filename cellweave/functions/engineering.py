"""Bit, radix, complex, error and Bessel functions, and unit conversion."""

from __future__ import annotations

import cmath
import math
import re

from ..values import DIV0, NA, NUM, VALUE, Error, is_num, number, number_text, plain, text
from .registry import cells, each, integer, whole
from .special import bessel_i, bessel_j, bessel_k, bessel_y

WORD = 2**48


def bits(v: object) -> int:
    x = number(v)
    if x < 0 or x != math.floor(x) or x >= WORD:
        raise Error(NUM)
    return int(x)


each("BITAND", 2)(lambda a, b: bits(a) & bits(b))
each("BITOR", 2)(lambda a, b: bits(a) | bits(b))
each("BITXOR", 2)(lambda a, b: bits(a) ^ bits(b))


def shifted(v, n, sign):
    x, n = bits(v), sign * integer(n)
    if abs(n) > 53:
        raise Error(NUM)
    got = x << n if n >= 0 else x >> -n
    if got >= WORD:
        raise Error(NUM)
    return got


each("BITLSHIFT", 2)(lambda v, n: shifted(v, n, 1))
each("BITRSHIFT", 2)(lambda v, n: shifted(v, n, -1))

#: Radix and bits of the ten-digit two's complement of each notation.
NOTATIONS = {"BIN": (2, 10), "OCT": (8, 30), "HEX": (16, 40)}


def read(v: object, kind: str) -> int:
    radix, width = NOTATIONS[kind]
    s = (number_text(v) if is_num(v) else text(v)).strip()
    if len(s) > 10 or not re.fullmatch({2: "[01]*", 8: "[0-7]*", 16: "[0-9a-fA-F]*"}[radix], s):
        raise Error(NUM)
    n = int(s, radix) if s else 0
    return n - (1 << width) if n >= 1 << width - 1 else n


def write(n: int, kind: str, places: object) -> str:
    radix, width = NOTATIONS[kind]
    if not -(1 << width - 1) <= n < 1 << width - 1:
        raise Error(NUM)
    s = format(n % (1 << width) if n < 0 else n, {2: "b", 8: "o", 16: "X"}[radix])
    if places is None or n < 0:
        return s
    places = integer(places)
    if places < len(s) or places > 10:
        raise Error(NUM)
    return s.rjust(places, "0")


for _a in NOTATIONS:
    each(f"{_a}2DEC", 1)(lambda v, a=_a: read(v, a))
    each(f"DEC2{_a}", 1, 2)(lambda v, places=None, a=_a: write(integer(v), a, places))
    for _b in NOTATIONS:
        if _a != _b:
            each(f"{_a}2{_b}", 1, 2)(lambda v, places=None, a=_a, b=_b: write(read(v, a), b, places))

each("DELTA", 1, 2)(lambda a, b=0: int(abs(number(a) - number(b)) < 1e-12))
each("GESTEP", 1, 2)(lambda a, b=0: int(number(a) >= number(b)))


@each("ERF", 1, 2)
def erf(a, b=None):
    a = float(number(a))
    return math.erf(a) if b is None else math.erf(float(number(b))) - math.erf(a)


each("ERF.PRECISE", 1)(lambda a: math.erf(float(number(a))))
each("ERFC ERFC.PRECISE", 1)(lambda a: math.erfc(float(number(a))))


def order(n: object) -> int:
    n = integer(n)
    if n < 0:
        raise Error(NUM)
    return n


def above(x: object) -> float:
    x = float(number(x))
    if x <= 0:
        raise Error(NUM)
    return x


each("BESSELI", 2)(lambda x, n: bessel_i(float(number(x)), order(n)))
each("BESSELJ", 2)(lambda x, n: bessel_j(float(number(x)), order(n)))
each("BESSELK", 2)(lambda x, n: bessel_k(above(x), order(n)))
each("BESSELY", 2)(lambda x, n: bessel_y(above(x), order(n)))

# -- complex numbers ------------------------------------------------------------------------

_NUM = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def parse_complex(v: object) -> tuple[complex, str]:
    """The number and its suffix, i by default."""
    if isinstance(v, bool):
        raise Error(VALUE)
    if is_num(v) or v is None:
        return complex(number(v)), "i"
    s = text(v).strip()
    m = re.fullmatch(rf"([+-]?{_NUM})", s)
    if m:
        return complex(float(s)), "i"
    m = re.fullmatch(rf"([+-]?{_NUM})?([+-]?(?:{_NUM})?)([ij])", s)
    if not m or (m[1] and not m[2]) and not re.fullmatch(rf"[+-]?{_NUM}[ij]", s):
        raise Error(NUM)
    real, imag = m[1], m[2]
    if real and not imag:
        real, imag = None, real
    if real and imag and imag[0] not in "+-":
        raise Error(NUM)
    unit = {"": 1.0, "+": 1.0, "-": -1.0}
    return complex(float(real or 0), unit[imag] if imag in unit else float(imag)), m[3]


def coefficient(x: float) -> str:
    text_ = repr(x)
    return number_text(plain(x)) if "e" not in text_ or abs(x) < 1e21 and abs(x) > 1e-7 else text_.replace("e", "E")


def show_complex(z: complex, suffix: str = "i") -> str:
    a, b = z.real, z.imag
    if not (math.isfinite(a) and math.isfinite(b)):
        raise Error(NUM)
    tiny = 1e-15 * max(abs(a), abs(b), 1e-300)
    a, b = (0.0 if abs(a) < max(tiny, 1e-15) and abs(a) < abs(b) else a), (0.0 if abs(b) < max(tiny, 1e-15) and abs(b) < abs(a) else b)
    if b == 0:
        return coefficient(a)
    part = {1.0: "", -1.0: "-"}.get(b, coefficient(b)) + suffix
    return part if a == 0 else coefficient(a) + ("" if part.startswith("-") else "+") + part


@each("COMPLEX", 2, 3)
def complex_(a, b, suffix="i"):
    suffix = text(suffix) or "i"
    if suffix not in ("i", "j"):
        raise Error(VALUE)
    return show_complex(complex(number(a), number(b)), suffix)


each("IMREAL", 1)(lambda z: parse_complex(z)[0].real)
each("IMAGINARY", 1)(lambda z: parse_complex(z)[0].imag)
each("IMABS", 1)(lambda z: abs(parse_complex(z)[0]))


@each("IMARGUMENT", 1)
def imargument(z):
    z = parse_complex(z)[0]
    if z == 0:
        raise Error(DIV0)
    return cmath.phase(z)


def complex_function(name, call, zero=None):
    @each(name, 1)
    def run(z):
        z, suffix = parse_complex(z)
        if zero and z == 0:
            raise Error(zero)
        return show_complex(call(z), suffix)


for _name, _call in {
    "IMCONJUGATE": lambda z: z.conjugate(),
    "IMEXP": cmath.exp,
    "IMSQRT": cmath.sqrt,
    "IMSIN": cmath.sin,
    "IMCOS": cmath.cos,
    "IMSINH": cmath.sinh,
    "IMCOSH": cmath.cosh,
    "IMTAN": cmath.tan,
    "IMSEC": lambda z: 1 / cmath.cos(z),
    "IMSECH": lambda z: 1 / cmath.cosh(z),
}.items():
    complex_function(_name, _call)
for _name, _call in {
    "IMLN": cmath.log,
    "IMLOG10": cmath.log10,
    "IMLOG2": lambda z: cmath.log(z) / math.log(2),
}.items():
    complex_function(_name, _call, NUM)
for _name, _call in {
    "IMCSC": lambda z: 1 / cmath.sin(z),
    "IMCSCH": lambda z: 1 / cmath.sinh(z),
    "IMCOT": lambda z: cmath.cos(z) / cmath.sin(z),
}.items():
    complex_function(_name, _call, NUM)


@each("IMPOWER", 2)
def impower(z, n):
    z, suffix = parse_complex(z)
    n = float(number(n))
    if z == 0:
        if n <= 0:
            raise Error(NUM)
        return "0"
    r, angle = abs(z) ** n, cmath.phase(z) * n
    got = z ** int(n) if n.is_integer() and abs(n) < 1000 else cmath.rect(r, angle)
    return show_complex(got, suffix)


def gathered(args) -> tuple[list[complex], str]:
    found, suffix = [], "i"
    for v, inside in cells(args):
        if isinstance(v, Error):
            raise v
        if v is None and inside:
            continue
        z, s = parse_complex(v)
        suffix = s if z.imag else suffix
        found.append(z)
    return found, suffix


@whole("IMSUM", 1, None)
def imsum(*args):
    found, suffix = gathered(args)
    return show_complex(sum(found), suffix)


@whole("IMPRODUCT", 1, None)
def improduct(*args):
    found, suffix = gathered(args)
    return show_complex(math.prod(found), suffix)


@each("IMSUB", 2)
def imsub(a, b):
    (x, s), (y, t) = parse_complex(a), parse_complex(b)
    return show_complex(x - y, s if x.imag else t)


@each("IMDIV", 2)
def imdiv(a, b):
    (x, s), (y, t) = parse_complex(a), parse_complex(b)
    if y == 0:
        raise Error(DIV0)
    return show_complex(x / y, s if x.imag else t)


# -- units ----------------------------------------------------------------------------------

#: Units by quantity, each with its size in the quantity's base unit.
UNITS = {
    "mass": {"g": 1, "sg": 14593.9029372064, "lbm": 453.59237, "u": 1.66053906660e-24, "ozm": 28.349523125, "grain": 0.06479891, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088, "cwt": 45359.237, "uk_cwt": 50802.34544},
    "length": {"m": 1, "mi": 1609.344, "Nmi": 1852, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9.4607304725808e15, "parsec": 3.0856775814913673e16, "pc": 3.0856775814913673e16, "Picapt": 0.0254 / 72, "Pica": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 1609.347218694437},
    "time": {"sec": 1, "s": 1, "mn": 60, "min": 60, "hr": 3600, "day": 86400, "d": 86400, "yr": 31557600},
    "pressure": {"Pa": 1, "p": 1, "atm": 101325, "at": 101325, "mmHg": 133.322, "psi": 6894.757293168361, "Torr": 133.3223684210526},
    "force": {"N": 1, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176634e-19, "ev": 1.602176634e-19, "HPh": 2684519.5376961729, "hh": 2684519.5376961729, "Wh": 3600, "wh": 3600, "flb": 1.3558179483314004, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1, "w": 1, "HP": 745.6998715822702, "h": 745.6998715822702, "PS": 735.49875},
    "magnetism": {"T": 1, "ga": 1e-4},
    "volume": {"l": 1, "L": 1, "lt": 1, "tsp": 0.00492892159375, "tspm": 0.005, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "uk_pt": 0.56826125, "qt": 0.946352946, "uk_qt": 1.1365225, "gal": 3.785411784, "uk_gal": 4.54609, "m3": 1000, "ft3": 28.316846592, "in3": 0.016387064, "yd3": 764.554857984, "mi3": 4168181825440.579584, "barrel": 158.987294928, "bushel": 35.23907016688},
    "area": {"m2": 1, "ft2": 0.09290304, "in2": 0.00064516, "yd2": 0.83612736, "mi2": 2589988.110336, "ha": 10000, "ar": 100, "uk_acre": 4046.8564224, "us_acre": 4046.872609874252},
    "information": {"bit": 1, "byte": 8},
    "speed": {"m/s": 1, "m/sec": 1, "m/h": 1 / 3600, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 0.514773333333333},
}
#: Prefixes and the units that take them.
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "e": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
METRIC = {"g", "m", "sec", "s", "Pa", "p", "atm", "at", "mmHg", "N", "dyn", "dy", "pond", "J", "e", "c", "cal", "eV", "ev", "Wh", "wh", "W", "w", "T", "ga", "l", "L", "lt", "m2", "m3", "u", "ang", "ly", "parsec", "bit", "byte", "m/s", "m/sec", "K", "kel"}
TEMPERATURES = {"C": "C", "cel": "C", "F": "F", "fah": "F", "K": "K", "kel": "K", "Rank": "R", "Reau": "Re"}


def unit(name: str) -> tuple[str, float]:
    for quantity, table in UNITS.items():
        if name in table:
            return quantity, table[name]
    for quantity, table in UNITS.items():
        for prefix, size in PREFIXES.items():
            bare = name.removeprefix(prefix)
            if bare != name and bare in table and bare in METRIC:
                return quantity, table[bare] * size ** (int(bare[-1]) if bare[-1] in "23" else 1)
    raise Error(NA)


@each("CONVERT", 3)
def convert(x, a, b):
    x, a, b = float(number(x)), text(a), text(b)
    if a in TEMPERATURES and b in TEMPERATURES:
        kelvin = {"C": lambda t: t + 273.15, "F": lambda t: (t + 459.67) * 5 / 9, "K": lambda t: t, "R": lambda t: t * 5 / 9, "Re": lambda t: t * 1.25 + 273.15}[TEMPERATURES[a]](x)
        if TEMPERATURES[a] == TEMPERATURES[b]:
            return x
        if {TEMPERATURES[a], TEMPERATURES[b]} == {"C", "F"}:
            return x * 9 / 5 + 32 if TEMPERATURES[a] == "C" else (x - 32) * 5 / 9
        return {"C": lambda t: t - 273.15, "F": lambda t: t * 9 / 5 - 459.67, "K": lambda t: t, "R": lambda t: t * 9 / 5, "Re": lambda t: (t - 273.15) * 0.8}[TEMPERATURES[b]](kelvin)
    (p, m), (q, n) = unit(a), unit(b)
    if p != q:
        raise Error(NA)
    return x * m / n
