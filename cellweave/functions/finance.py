"""Time value of money, depreciation and securities."""

from __future__ import annotations

import calendar
import datetime as dt
import math
from collections.abc import Callable

from ..values import CALC, DIV0, NUM, Error, Grid, Lambda, is_num, number
from .dates import day, months_on, year_fraction
from .registry import each, fsum, integer, single, whole


def need(ok: object, kind: str = NUM) -> None:
    if not ok:
        raise Error(kind)


def floats(*args: object) -> list[float]:
    return [float(number(a)) for a in args]


def annuity(rate: float, n: float) -> float:
    """Value now of 1 at the end of each of n periods, times (1 + rate) ** n."""
    return ((1 + rate) ** n - 1) / rate if rate else n


def payment(rate, n, pv, fv=0.0, kind=0.0):
    need(n != 0)
    return -(pv * (1 + rate) ** n + fv) / (annuity(rate, n) * (1 + rate * kind))


def future(rate, n, pmt, pv=0.0, kind=0.0):
    return -(pv * (1 + rate) ** n + pmt * (1 + rate * kind) * annuity(rate, n))


def due(kind: object) -> float:
    return 1.0 if number(kind) else 0.0


each("PMT", 3, 5)(lambda r, n, pv, fv=0, t=0: payment(*floats(r, n, pv, fv), due(t)))
each("FV", 3, 5)(lambda r, n, pmt, pv=0, t=0: future(*floats(r, n, pmt, pv), due(t)))


@each("PV", 3, 5)
def pv(r, n, pmt, fv=0, t=0):
    r, n, pmt, fv = floats(r, n, pmt, fv)
    return -(fv + pmt * (1 + r * due(t)) * annuity(r, n)) / (1 + r) ** n


@each("NPER", 3, 5)
def nper(r, pmt, pv, fv=0, t=0):
    r, pmt, pv, fv = floats(r, pmt, pv, fv)
    if r == 0:
        need(pmt)
        return -(pv + fv) / pmt
    z = pmt * (1 + r * due(t)) / r
    ratio = (z - fv) / (pv + z) if pv + z else -1
    need(ratio > 0)
    return math.log(ratio) / math.log1p(r)


def newton(f: Callable[[float], float], x: float, low: float = -0.999999999) -> float:
    """A root near x: Newton steps with a numeric slope, kept above low; then bisection if they fail."""
    start = x
    for _ in range(100):
        y = f(x)
        if abs(y) < 1e-13:
            return x
        h = max(1e-7, abs(x) * 1e-7)
        slope = (f(x + h) - f(x - h)) / (2 * h)
        if not slope or math.isnan(slope):
            break
        step = y / slope
        new = x - step
        while new <= low:
            step /= 2
            new = x - step
        if abs(new - x) < 1e-15 * max(1, abs(x)):
            return new
        x = new
    if abs(f(x)) < 1e-7:
        return x
    grid = [low + 1e-6, -0.9, -0.7, -0.5, -0.3, -0.1, 0.0, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 100.0]
    for a, b in sorted(zip(grid, grid[1:], strict=False), key=lambda ab: abs(ab[0] - start)):
        fa, fb = f(a), f(b)
        if fa * fb <= 0:
            for _ in range(200):
                m = (a + b) / 2
                fm = f(m)
                a, b, fa = (m, b, fm) if fa * fm > 0 else (a, m, fa)
            return (a + b) / 2
    raise Error(NUM)


@each("RATE", 3, 6)
def rate(n, pmt, pv, fv=0, t=0, guess=0.1):
    n, pmt, pv, fv, guess = floats(n, pmt, pv, fv, guess)
    need(n > 0)
    kind = due(t)
    scale = max(abs(pv), abs(fv), abs(pmt), 1.0)

    def gap(r: float) -> float:
        if abs(r) < 1e-10:
            return (pv + pmt * n + fv) / scale
        return (pv * (1 + r) ** n + pmt * (1 + r * kind) * annuity(r, n) + fv) / scale

    return newton(gap, guess)


def interest(r, per, n, pv, fv, kind):
    need(1 <= per <= n)
    pmt = payment(r, n, pv, fv, kind)
    if kind and per == 1:
        return 0.0
    due_ = future(r, per - 1 - kind, pmt, pv, 0.0) if not kind else future(r, per - 2, pmt, pv + pmt, 0.0)
    return due_ * r


@each("IPMT", 4, 6)
def ipmt(r, per, n, pv, fv=0, t=0):
    return interest(*floats(r, per, n, pv, fv), due(t))


@each("PPMT", 4, 6)
def ppmt(r, per, n, pv, fv=0, t=0):
    r, per, n, pv, fv = floats(r, per, n, pv, fv)
    return payment(r, n, pv, fv, due(t)) - interest(r, per, n, pv, fv, due(t))


def cumulative(names, principal):
    @each(names, 6)
    def run(r, n, pv, start, end, t):
        r, n, pv = floats(r, n, pv)
        start, end, kind = integer(start), integer(end), integer(t)
        need(r > 0 and n > 0 and pv > 0 and 1 <= start <= end <= n and kind in (0, 1))
        pmt = payment(r, n, pv, 0.0, kind)
        found = [interest(r, k, n, pv, 0.0, kind) for k in range(start, end + 1)]
        return fsum(pmt - i if principal else i for i in found)


cumulative("CUMIPMT", False)
cumulative("CUMPRINC", True)


@each("ISPMT", 4)
def ispmt(r, per, n, pv):
    r, per, n, pv = floats(r, per, n, pv)
    need(n)
    return pv * r * (per / n - 1)


@each("EFFECT", 2)
def effect(nominal, n):
    nominal, n = float(number(nominal)), integer(n)
    need(nominal > 0 and n >= 1)
    return (1 + nominal / n) ** n - 1


@each("NOMINAL", 2)
def nominal(effective, n):
    effective, n = float(number(effective)), integer(n)
    need(effective > 0 and n >= 1)
    return n * ((1 + effective) ** (1 / n) - 1)


@each("RRI", 3)
def rri(n, pv, fv):
    n, pv, fv = floats(n, pv, fv)
    need(n > 0 and pv != 0 and fv / pv >= 0)
    return (fv / pv) ** (1 / n) - 1


@each("PDURATION", 3)
def pduration(r, pv, fv):
    r, pv, fv = floats(r, pv, fv)
    need(r > 0 and pv > 0 and fv > 0)
    return (math.log(fv) - math.log(pv)) / math.log1p(r)


def flows(args) -> list[float]:
    """Numbers of ranges; single values are coerced."""
    out = []
    for a in args:
        if isinstance(a, Lambda):
            raise Error(CALC)
        for v in a.flat() if isinstance(a, Grid) else [a]:
            if isinstance(v, Error):
                raise v
            if isinstance(a, Grid):
                if is_num(v):
                    out.append(float(v))
            else:
                out.append(float(number(v)))
    return out


@whole("NPV", 2, None)
def npv(r, *values):
    r = float(number(single(r)))
    need(r != -1, DIV0)
    return fsum(v / (1 + r) ** i for i, v in enumerate(flows(values), 1))


def net(r: float, found: list[float]) -> float:
    return fsum(v / (1 + r) ** i for i, v in enumerate(found))


@whole("IRR", 1, 2)
def irr(values, guess=None):
    found = flows([values])
    need(any(v > 0 for v in found) and any(v < 0 for v in found))
    scale = max(map(abs, found))
    return newton(lambda r: net(r, found) / scale, float(number(single(guess))) if guess is not None else 0.1)


@whole("MIRR", 3)
def mirr(values, finance, reinvest):
    found = flows([values])
    finance, reinvest = float(number(single(finance))), float(number(single(reinvest)))
    n = len(found)
    need(any(v > 0 for v in found) and any(v < 0 for v in found), DIV0)
    gains = fsum(v * (1 + reinvest) ** (n - 1 - i) for i, v in enumerate(found) if v > 0)
    costs = fsum(v / (1 + finance) ** i for i, v in enumerate(found) if v < 0)
    return (gains / -costs) ** (1 / (n - 1)) - 1


def dated(values, dates) -> tuple[list[float], list[float]]:
    v, d = flows([values]), [math.floor(x) for x in flows([dates])]
    need(v and len(v) == len(d))
    need(all(x >= d[0] for x in d))
    return v, [(x - d[0]) / 365 for x in d]


@whole("XNPV", 3)
def xnpv(r, values, dates):
    r = float(number(single(r)))
    need(r > -1)
    v, t = dated(values, dates)
    return fsum(a / (1 + r) ** b for a, b in zip(v, t, strict=True))


@whole("XIRR", 2, 3)
def xirr(values, dates, guess=None):
    v, t = dated(values, dates)
    need(any(x > 0 for x in v) and any(x < 0 for x in v))
    scale = max(map(abs, v))
    return newton(lambda r: fsum(a / (1 + r) ** b for a, b in zip(v, t, strict=True)) / scale, float(number(single(guess))) if guess is not None else 0.1)


def fraction_digits(f: int) -> float:
    return 10.0 ** math.ceil(math.log10(f)) if f > 1 else 10.0 if f == 1 else 1.0


@each("DOLLARDE", 2)
def dollarde(x, f):
    x, f = float(number(x)), integer(f)
    need(f >= 1)
    whole_ = math.trunc(x)
    return whole_ + (x - whole_) * fraction_digits(f) / f


@each("DOLLARFR", 2)
def dollarfr(x, f):
    x, f = float(number(x)), integer(f)
    need(f >= 1)
    whole_ = math.trunc(x)
    return whole_ + (x - whole_) * f / fraction_digits(f)


# -- depreciation ---------------------------------------------------------------------------


@each("SLN", 3)
def sln(cost, salvage, life):
    cost, salvage, life = floats(cost, salvage, life)
    need(life, DIV0)
    return (cost - salvage) / life


@each("SYD", 4)
def syd(cost, salvage, life, per):
    cost, salvage, life, per = floats(cost, salvage, life, per)
    need(life > 0 and 0 < per <= life)
    return (cost - salvage) * (life - per + 1) * 2 / (life * (life + 1))


@each("DB", 4, 5)
def db(cost, salvage, life, period, month=12):
    cost, salvage = floats(cost, salvage)
    life, period, month = integer(life), integer(period), integer(month)
    need(cost >= 0 and salvage >= 0 and life > 0 and 1 <= period <= life + (month < 12) and 1 <= month <= 12)
    if cost == 0:
        return 0.0
    r = round(1 - (salvage / cost) ** (1 / life), 3)
    total = now = cost * r * month / 12
    for k in range(2, period + 1):
        now = (cost - total) * r * ((12 - month) / 12 if k == life + 1 else 1)
        total += now
    return now


@each("DDB", 4, 5)
def ddb(cost, salvage, life, period, factor=2):
    cost, salvage, life, factor = floats(cost, salvage, life, factor)
    period = integer(period)
    need(cost >= 0 and salvage >= 0 and life > 0 and factor > 0 and 1 <= period <= life)
    total = now = 0.0
    for _ in range(period):
        now = max(0.0, min((cost - total) * min(factor / life, 1.0), cost - salvage - total))
        total += now
    return now


# -- securities -----------------------------------------------------------------------------


def basis_of(b: object) -> int:
    b = integer(b)
    need(0 <= b <= 4)
    return b


def frequency_of(f: object) -> int:
    f = integer(f)
    need(f in (1, 2, 4))
    return f


def coupon_before(maturity: dt.date, k: int, frequency: int) -> dt.date:
    """The coupon date k periods before maturity."""
    y, m = months_on(maturity.year, maturity.month, -k * 12 // frequency)
    last = calendar.monthrange(y, m)[1]
    at_end = maturity.day == calendar.monthrange(maturity.year, maturity.month)[1]
    return dt.date(y, m, last if at_end else min(maturity.day, last))


def accrual(a: dt.date, b: dt.date, basis: int) -> float:
    """Years of accrued interest; actual days count against each calendar year's own length."""
    if basis != 1:
        return year_fraction(a, b, basis)
    total = 0.0
    for y in range(a.year, b.year + 1):
        begin, end = max(a, dt.date(y, 1, 1)), min(b, dt.date(y + 1, 1, 1))
        total += (end - begin).days / (366 if calendar.isleap(y) else 365)
    return total


def schedule(settlement: dt.date, maturity: dt.date, frequency: int, basis: int) -> tuple[int, float]:
    """Coupons left and the share of the running period that is still to come."""
    need(settlement < maturity)
    n = 1
    while coupon_before(maturity, n, frequency) > settlement:
        n += 1
    before, after = coupon_before(maturity, n, frequency), coupon_before(maturity, n - 1, frequency)
    length = year_fraction(before, after, basis)
    return n, year_fraction(settlement, after, basis) / length if length else 0.0


def clean_price(n: int, left: float, coupon: float, yld: float, redemption: float, frequency: int) -> float:
    c = 100 * coupon / frequency
    y = yld / frequency
    if n == 1:
        return (redemption + c) / (1 + left * y) - c * (1 - left)
    return redemption / (1 + y) ** (n - 1 + left) + fsum(c / (1 + y) ** (k + left) for k in range(n)) - c * (1 - left)


@each("PRICE", 6, 7)
def price(settlement, maturity, coupon, yld, redemption, frequency, basis=0):
    coupon, yld, redemption = floats(coupon, yld, redemption)
    frequency, basis = frequency_of(frequency), basis_of(basis)
    need(coupon >= 0 and yld >= 0 and redemption > 0)
    n, left = schedule(day(settlement), day(maturity), frequency, basis)
    return clean_price(n, left, coupon, yld, redemption, frequency)


@each("YIELD", 6, 7)
def yield_(settlement, maturity, coupon, price_, redemption, frequency, basis=0):
    coupon, price_, redemption = floats(coupon, price_, redemption)
    frequency, basis = frequency_of(frequency), basis_of(basis)
    need(coupon >= 0 and price_ > 0 and redemption > 0)
    n, left = schedule(day(settlement), day(maturity), frequency, basis)
    return newton(lambda y: (clean_price(n, left, coupon, y, redemption, frequency) - price_) / price_, coupon or 0.05)


@each("ACCRINT", 6, 8)
def accrint(issue, first, settlement, rate_, par, frequency, basis=0, method=True):
    rate_, par = floats(rate_, par)
    frequency, basis = frequency_of(frequency), basis_of(basis)
    a, f, s = day(issue), day(first), day(settlement)
    need(rate_ > 0 and par > 0 and a < s)
    start = a if number(method) or s <= f else f
    return par * rate_ * accrual(start, s, basis)


@each("ACCRINTM", 4, 5)
def accrintm(issue, settlement, rate_, par, basis=0):
    rate_, par = floats(rate_, par)
    a, s = day(issue), day(settlement)
    need(rate_ > 0 and par > 0 and a < s)
    return par * rate_ * accrual(a, s, basis_of(basis))


def bill(settlement: object, maturity: object) -> int:
    a, b = day(settlement), day(maturity)
    y, m = months_on(a.year, a.month, 12)
    need(a < b <= dt.date(y, m, min(a.day, calendar.monthrange(y, m)[1])))
    return (b - a).days


@each("TBILLPRICE", 3)
def tbillprice(settlement, maturity, discount):
    n, d = bill(settlement, maturity), float(number(discount))
    need(d > 0 and d * n < 360)
    return 100 * (1 - d * n / 360)


@each("TBILLYIELD", 3)
def tbillyield(settlement, maturity, price_):
    n, p = bill(settlement, maturity), float(number(price_))
    need(p > 0)
    return (100 - p) / p * 360 / n


@each("TBILLEQ", 3)
def tbilleq(settlement, maturity, discount):
    n, d = bill(settlement, maturity), float(number(discount))
    need(d > 0 and d * n < 360)
    if n <= 182:
        return 365 * d / (360 - d * n)
    p = (100 - d * 100 * n / 360) / 100
    t = n / (366 if n == 366 else 365)
    return (-2 * t + 2 * math.sqrt(t * t - (2 * t - 1) * (1 - 1 / p))) / (2 * t - 1)


