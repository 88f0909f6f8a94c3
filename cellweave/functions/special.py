"""Special functions that the standard library lacks: incomplete gamma and beta, inverses, Bessel."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from ..values import NUM, Error

NORMAL = NormalDist()
TINY = 1e-300


def phi(z: float) -> float:
    """Normal distribution function through erfc, which keeps its precision in both tails."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_density(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_inverse(p: float) -> float:
    if not 0 < p < 1:
        raise Error(NUM)
    z = NORMAL.inv_cdf(p)
    for _ in range(2):  # Newton steps to full precision
        z -= (phi(z) - p) / normal_density(z)
    return z


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a power series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    return 1 - gamma_q_fraction(a, x) * scale


def gamma_q(a: float, x: float) -> float:
    """The upper function, without the cancellation of 1 - P in the far tail."""
    if x < a + 1:
        return 1 - gamma_p(a, x)
    return math.exp(a * math.log(x) - x - math.lgamma(a)) * gamma_q_fraction(a, x)


def gamma_q_fraction(a: float, x: float) -> float:
    """Lentz's method on the continued fraction of the upper function."""
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or TINY)
        c = b + an / c or TINY
        step = c * d
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, on the side where that converges fast."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1 - front * beta_fraction(b, a, 1 - x) / b


def beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 100_000):
        for factor in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + factor * d or TINY)
            c = 1 + factor / c or TINY
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h


def invert(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """The x with cdf(x) = p of a growing function, by bisection to the last bit."""
    if math.isinf(high):
        high = max(1.0, low + 1)
        while cdf(high) < p:
            high *= 2
            if high > 1e300:
                raise Error(NUM)
    if math.isinf(low):
        low = -1.0
        while cdf(low) > p:
            low *= 2
            if low < -1e300:
                raise Error(NUM)
    for _ in range(400):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if cdf(middle) < p:
            low = middle
        else:
            high = middle
    return high if abs(cdf(high) - p) <= abs(cdf(low) - p) else low


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_inverse(p: float, df: float) -> float:
    if not 0 < p < 1:
        raise Error(NUM)
    if p == 0.5:
        return 0.0
    x = invert(lambda t: -t_cdf(-t, df), -min(p, 1 - p), 0.0, math.inf)
    return -x if p < 0.5 else x


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def f_tail(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def simpson(f: Callable[[float], float], a: float, b: float, n: int) -> float:
    """Composite Simpson rule with n (even) steps; exact to rounding for smooth periodic integrands."""
    h = (b - a) / n
    return h / 3 * math.fsum([f(a), f(b), *(4 * f(a + i * h) for i in range(1, n, 2)), *(2 * f(a + i * h) for i in range(2, n, 2))])


def bessel_j(x: float, n: int) -> float:
    """The mean of cos(n t - x sin t) over half a turn."""
    steps = 2 * (int(abs(x)) + n + 60)
    h = math.pi / steps
    return math.fsum([(1 + math.cos(n * math.pi)) / 2, *(math.cos(n * i * h - x * math.sin(i * h)) for i in range(1, steps))]) / steps


def bessel_i(x: float, n: int) -> float:
    steps = 2 * (int(abs(x)) + n + 60)
    h = math.pi / steps
    ends = (math.exp(x) + math.exp(-x) * math.cos(n * math.pi)) / 2
    return math.fsum([ends, *(math.exp(x * math.cos(i * h)) * math.cos(n * i * h) for i in range(1, steps))]) / steps


def bessel_k(x: float, n: int) -> float:
    """The integral of exp(-x cosh t) cosh(n t) over t > 0; the trapezoid rule converges geometrically."""
    top = math.acosh(1 + 745 / x) + 1
    steps = 4000
    h = top / steps

    def f(t: float) -> float:
        return math.exp(-x * math.cosh(t) + n * t) * (1 + math.exp(-2 * n * t)) / 2

    return h * math.fsum([f(0) / 2, *(f(i * h) for i in range(1, steps))])


def bessel_y(x: float, n: int) -> float:
    """Two integrals: sin(x sin t - n t) over half a turn and a decaying one."""
    first = simpson(lambda t: math.sin(x * math.sin(t) - n * t), 0, math.pi, 4000) / math.pi
    top = math.asinh(745 / x) + 1

    def f(t: float) -> float:
        e = -x * math.sinh(t)
        return math.exp(e + n * t) + (-1) ** n * math.exp(e - n * t)

    return first - simpson(f, 0, top, 20_000) / math.pi
