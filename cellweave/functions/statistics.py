"""Descriptive statistics, regression and distributions."""

from __future__ import annotations

import math
from collections import Counter

from ..values import DIV0, NA, NUM, Error, Grid, logical, number
from .registry import each, fsum, integer, numbers, numbers_a, pairs, single, whole
from .special import beta_i, f_cdf, f_tail, gamma_p, gamma_q, invert, normal_density, normal_inverse, phi, t_cdf, t_inverse


def need(ok: object, kind: str = NUM) -> None:
    if not ok:
        raise Error(kind)


def spread(found: list[float]) -> float:
    """Sum of squared deviations from the mean."""
    mean = fsum(found) / len(found)
    return fsum((x - mean) ** 2 for x in found)


def variance(found: list[float], sample: bool) -> float:
    need(len(found) > sample, DIV0)
    return spread(found) / (len(found) - sample)


for _names, _pick, _sample, _root in (
    ("STDEV.S STDEV", numbers, True, True),
    ("STDEV.P STDEVP", numbers, False, True),
    ("VAR.S VAR", numbers, True, False),
    ("VAR.P VARP", numbers, False, False),
    ("STDEVA", numbers_a, True, True),
    ("STDEVPA", numbers_a, False, True),
    ("VARA", numbers_a, True, False),
    ("VARPA", numbers_a, False, False),
):
    whole(_names, 1, None)(lambda *args, pick=_pick, sample=_sample, root=_root: variance(pick(args), sample) ** (0.5 if root else 1))


@whole("AVERAGEA", 1, None)
def averagea(*args):
    found = numbers_a(args)
    need(found, DIV0)
    return fsum(found) / len(found)


whole("MAXA", 1, None)(lambda *args: max(numbers_a(args), default=0))
whole("MINA", 1, None)(lambda *args: min(numbers_a(args), default=0))


def some(args) -> list[float]:
    found = numbers(args)
    need(found)
    return found


@whole("MEDIAN", 1, None)
def median(*args):
    found = sorted(some(args))
    n = len(found)
    return found[n // 2] if n % 2 else (found[n // 2 - 1] + found[n // 2]) / 2


def modes(args) -> list[float]:
    counts = Counter(numbers(args))
    most = max(counts.values(), default=0)
    need(most > 1, NA)
    return [x for x, n in counts.items() if n == most]


whole("MODE.SNGL MODE", 1, None)(lambda *args: min(modes(args)))
whole("MODE.MULT", 1, None)(lambda *args: Grid([[x] for x in sorted(modes(args))]))


@whole("LARGE", 2)
def large(data, k):
    found, k = numbers([data]), integer(single(k))
    need(1 <= k <= len(found))
    return sorted(found, reverse=True)[k - 1]


@whole("SMALL", 2)
def small(data, k):
    found, k = numbers([data]), integer(single(k))
    need(1 <= k <= len(found))
    return sorted(found)[k - 1]


def ranked(x, data, order):
    x, order = number(single(x)), number(single(order)) if order is not None else 0
    found = numbers([data])
    need(any(v == x for v in found), NA)
    before = sum(v < x if order else v > x for v in found)
    return before + 1, found.count(x)


whole("RANK.EQ RANK", 2, 3)(lambda x, data, order=None: ranked(x, data, order)[0])


@whole("RANK.AVG", 2, 3)
def rank_avg(x, data, order=None):
    first, ties = ranked(x, data, order)
    return first + (ties - 1) / 2


def at(found: list[float], place: float) -> float:
    """Linear interpolation at a 0-based place in sorted values."""
    low = math.floor(place)
    rest = place - low
    return found[low] + (rest * (found[low + 1] - found[low]) if rest > 0 and low + 1 < len(found) else 0)


def percentile(found: list[float], p: float, inclusive: bool) -> float:
    found, n = sorted(found), len(found)
    need(found)
    if inclusive:
        need(0 <= p <= 1)
        return at(found, p * (n - 1))
    place = p * (n + 1)
    need(0 < p < 1 and 1 <= place <= n)
    return at(found, place - 1)


whole("PERCENTILE.INC PERCENTILE", 2)(lambda data, p: percentile(numbers([data]), number(single(p)), True))
whole("PERCENTILE.EXC", 2)(lambda data, p: percentile(numbers([data]), number(single(p)), False))


@whole("QUARTILE.INC QUARTILE", 2)
def quartile_inc(data, q):
    q = integer(single(q))
    need(0 <= q <= 4)
    return percentile(numbers([data]), q / 4, True)


@whole("QUARTILE.EXC", 2)
def quartile_exc(data, q):
    q = integer(single(q))
    need(1 <= q <= 3)
    return percentile(numbers([data]), q / 4, False)


def percent_rank(data, x, significance, inclusive):
    found, x = sorted(some([data])), number(single(x))
    digits = integer(single(significance)) if significance is not None else 3
    need(digits >= 1)
    need(found[0] <= x <= found[-1], NA)
    n, below = len(found), sum(v < x for v in found)
    if found[min(below, n - 1)] == x:
        place = below
    else:
        place = below - 1 + (x - found[below - 1]) / (found[below] - found[below - 1])
    rank = (place / (n - 1) if n > 1 else 1.0) if inclusive else (place + 1) / (n + 1)
    return math.floor(rank * 10**digits + 1e-12) / 10**digits


whole("PERCENTRANK.INC PERCENTRANK", 2, 3)(lambda data, x, s=None: percent_rank(data, x, s, True))
whole("PERCENTRANK.EXC", 2, 3)(lambda data, x, s=None: percent_rank(data, x, s, False))


def positive(args) -> list[float]:
    found = some(args)
    need(all(x > 0 for x in found))
    return found


@whole("GEOMEAN", 1, None)
def geomean(*args):
    found = positive(args)
    return math.exp(fsum(map(math.log, found)) / len(found))


@whole("HARMEAN", 1, None)
def harmean(*args):
    found = positive(args)
    return len(found) / fsum(1 / x for x in found)


@whole("AVEDEV", 1, None)
def avedev(*args):
    found = some(args)
    mean = fsum(found) / len(found)
    return fsum(abs(x - mean) for x in found) / len(found)


whole("DEVSQ", 1, None)(lambda *args: spread(some(args)))


@whole("TRIMMEAN", 2)
def trimmean(data, percent):
    found, p = sorted(some([data])), number(single(percent))
    need(0 <= p < 1)
    cut = math.floor(len(found) * p / 2)
    kept = found[cut : len(found) - cut]
    need(kept)
    return fsum(kept) / len(kept)


def moments(found: list[float], sample: bool) -> tuple[float, float]:
    """Mean and standard deviation; the latter not zero."""
    mean = fsum(found) / len(found)
    sd = math.sqrt(spread(found) / (len(found) - sample))
    need(sd > 0, DIV0)
    return mean, sd


@whole("SKEW", 1, None)
def skew(*args):
    found = numbers(args)
    n = len(found)
    need(n > 2, DIV0)
    mean, sd = moments(found, True)
    return fsum(((x - mean) / sd) ** 3 for x in found) * n / ((n - 1) * (n - 2))


@whole("SKEW.P", 1, None)
def skew_p(*args):
    found = numbers(args)
    need(len(found) > 2, DIV0)
    mean, sd = moments(found, False)
    return fsum(((x - mean) / sd) ** 3 for x in found) / len(found)


@whole("KURT", 1, None)
def kurt(*args):
    found = numbers(args)
    n = len(found)
    need(n > 3, DIV0)
    mean, sd = moments(found, True)
    total = fsum(((x - mean) / sd) ** 4 for x in found)
    return n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * total - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))


# -- regression -----------------------------------------------------------------------------


def sums(x: list[float], y: list[float]) -> tuple[float, float, float, float, float]:
    """Means, and sums of squares and products of deviations."""
    mx, my = fsum(x) / len(x), fsum(y) / len(y)
    return mx, my, fsum((a - mx) ** 2 for a in x), fsum((b - my) ** 2 for b in y), fsum((a - mx) * (b - my) for a, b in zip(x, y, strict=True))


def fitted(known_y, known_x) -> tuple[list[float], list[float], float, float]:
    y, x = pairs(known_y, known_x)
    need(x, NA if not isinstance(known_y, Grid) else DIV0)
    mx, my, sxx, _, sxy = sums(x, y)
    need(sxx > 0, DIV0)
    return x, y, sxy / sxx, my - sxy / sxx * mx


whole("SLOPE", 2)(lambda y, x: fitted(y, x)[2])
whole("INTERCEPT", 2)(lambda y, x: fitted(y, x)[3])


@whole("FORECAST.LINEAR FORECAST", 3)
def forecast(x, known_y, known_x):
    _, _, slope, icept = fitted(known_y, known_x)
    return icept + slope * number(single(x))


def correlation(a, b) -> float:
    x, y = pairs(a, b)
    need(len(x) > 1, DIV0)
    _, _, sxx, syy, sxy = sums(x, y)
    need(sxx > 0 and syy > 0, DIV0)
    return sxy / math.sqrt(sxx * syy)


whole("CORREL PEARSON", 2)(correlation)
whole("RSQ", 2)(lambda y, x: correlation(y, x) ** 2)


@whole("STEYX", 2)
def steyx(known_y, known_x):
    y, x = pairs(known_y, known_x)
    need(len(x) > 2, DIV0)
    _, _, sxx, syy, sxy = sums(x, y)
    need(sxx > 0, DIV0)
    return math.sqrt(max(0, syy - sxy * sxy / sxx) / (len(x) - 2))


def covariance(a, b, sample):
    x, y = pairs(a, b)
    need(len(x) > sample, DIV0)
    return sums(x, y)[4] / (len(x) - sample)


whole("COVARIANCE.P COVAR", 2)(lambda a, b: covariance(a, b, False))
whole("COVARIANCE.S", 2)(lambda a, b: covariance(a, b, True))


def line(known_y, known_x, const, logs=False):
    """Slope, intercept and the pairs; known_x defaults to 1, 2, 3 and so on."""
    y = numbers([known_y])
    x = numbers([known_x]) if known_x is not None else [float(i + 1) for i in range(len(y))]
    need(y and len(x) == len(y), "#REF!" if y else NA)
    if logs:
        need(all(v > 0 for v in y))
        y = [math.log(v) for v in y]
    if const is None or logical(single(const)):
        mx, my, sxx, _, sxy = sums(x, y)
        need(sxx > 0, DIV0)
        return sxy / sxx, my - sxy / sxx * mx, x, y, True
    sxx = fsum(a * a for a in x)
    need(sxx > 0, DIV0)
    return fsum(a * b for a, b in zip(x, y, strict=True)) / sxx, 0.0, x, y, False


def fit_table(known_y, known_x, const, stats, logs):
    slope, icept, x, y, free = line(known_y, known_x, const, logs)
    head = [math.exp(slope), math.exp(icept)] if logs else [slope, icept]
    if stats is None or not logical(single(stats)):
        return Grid([head])
    n, df = len(x), len(x) - 1 - free
    mx = fsum(x) / n if free else 0.0
    my = fsum(y) / n if free else 0.0
    sxx = fsum((a - mx) ** 2 for a in x)
    residual = fsum((b - icept - slope * a) ** 2 for a, b in zip(x, y, strict=True))
    total = fsum((b - my) ** 2 for b in y)
    explained = total - residual
    se = math.sqrt(residual / df) if df > 0 else 0.0
    se_icept = se * math.sqrt(1 / n + mx * mx / sxx) if free else Error(NA)
    f = explained / (residual / df) if df > 0 and residual > 0 else Error(NUM)
    return Grid([head, [se / math.sqrt(sxx), se_icept], [explained / total if total else 1.0, se], [f, df], [explained, residual]])


whole("LINEST", 1, 4)(lambda y, x=None, c=None, s=None: fit_table(y, x, c, s, False))
whole("LOGEST", 1, 4)(lambda y, x=None, c=None, s=None: fit_table(y, x, c, s, True))


def along(known_y, known_x, new_x, const, logs):
    slope, icept, x, _, _ = line(known_y, known_x, const, logs)
    to = new_x if new_x is not None else known_x if known_x is not None else Grid([[v] for v in x])
    to = to if isinstance(to, Grid) else Grid([[to]])
    return Grid([[(math.exp if logs else float)(icept + slope * number(v)) for v in row] for row in to.rows])


whole("TREND", 1, 4)(lambda y, x=None, new=None, c=None: along(y, x, new, c, False))
whole("GROWTH", 1, 4)(lambda y, x=None, new=None, c=None: along(y, x, new, c, True))


@whole("FREQUENCY", 2)
def frequency(data, bins):
    found, edges = numbers([data]), numbers([bins])
    if not edges:
        return Grid([[len(found)]])
    counts, low = {}, -math.inf
    for edge in sorted(set(edges)):
        counts[edge] = sum(low < x <= edge for x in found)
        low = edge
    out = []
    for edge in edges:
        out.append([counts.pop(edge, 0)])
    return Grid([*out, [sum(x > max(edges) for x in found)]])


# -- distributions --------------------------------------------------------------------------


def floats(*args):
    return [float(number(a)) for a in args]


def distribution(names, arity, cdf, density, check, extra=None):
    """Registers NAME(x, parameters..., cumulative)."""

    def run(*args):
        *values, cumulative = args
        values = floats(*values)
        need(check(*values))
        return cdf(*values) if logical(cumulative) else density(*values)

    each(names, arity + 1)(run)


distribution("NORM.S.DIST", 1, phi, normal_density, lambda z: True)
distribution("NORM.DIST NORMDIST", 3, lambda x, m, s: phi((x - m) / s), lambda x, m, s: normal_density((x - m) / s) / s, lambda x, m, s: s > 0)
distribution("LOGNORM.DIST", 3, lambda x, m, s: phi((math.log(x) - m) / s), lambda x, m, s: normal_density((math.log(x) - m) / s) / (s * x), lambda x, m, s: x > 0 and s > 0)
distribution("EXPON.DIST EXPONDIST", 2, lambda x, r: 1 - math.exp(-r * x), lambda x, r: r * math.exp(-r * x), lambda x, r: x >= 0 and r > 0)
distribution("WEIBULL.DIST WEIBULL", 3, lambda x, a, b: 1 - math.exp(-((x / b) ** a)), lambda x, a, b: a / b * (x / b) ** (a - 1) * math.exp(-((x / b) ** a)), lambda x, a, b: x >= 0 and a > 0 and b > 0)
distribution("GAMMA.DIST GAMMADIST", 3, lambda x, a, b: gamma_p(a, x / b), lambda x, a, b: gamma_density(x, a, b), lambda x, a, b: x >= 0 and a > 0 and b > 0)
distribution("CHISQ.DIST", 2, lambda x, d: gamma_p(d / 2, x / 2), lambda x, d: gamma_density(x, d / 2, 2), lambda x, d: x >= 0 and d >= 1)


def gamma_density(x, a, b):
    if x == 0:
        return 0.0 if a > 1 else 1 / b if a == 1 else math.inf
    return math.exp((a - 1) * math.log(x) - x / b - a * math.log(b) - math.lgamma(a))


def t_density(t, d):
    return math.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - (d + 1) / 2 * math.log1p(t * t / d)) / math.sqrt(d * math.pi)


def f_density(x, a, b):
    if x == 0:
        return 0.0 if a > 2 else 1.0 if a == 2 else math.inf
    return math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2) + a / 2 * math.log(a / b) + (a / 2 - 1) * math.log(x) - (a + b) / 2 * math.log1p(a * x / b))


def degrees(d):
    d = math.floor(number(d))
    need(d >= 1)
    return d


each("T.DIST", 3)(lambda t, d, c: (t_cdf if logical(c) else t_density)(float(number(t)), degrees(d)))
each("F.DIST", 4)(lambda x, a, b, c: (f_cdf if logical(c) else f_density)(not_negative(x), degrees(a), degrees(b)))


def not_negative(x):
    x = float(number(x))
    need(x >= 0)
    return x


def probability(p, low_open=True, high_open=True):
    p = float(number(p))
    need((0 < p if low_open else 0 <= p) and (p < 1 if high_open else p <= 1))
    return p


@each("T.DIST.2T", 2)
def t_dist_2t(t, d):
    return 2 * t_cdf(-not_negative(t), degrees(d))


each("T.DIST.RT", 2)(lambda t, d: t_cdf(-float(number(t)), degrees(d)))
each("T.INV", 2)(lambda p, d: t_inverse(probability(p), degrees(d)))


@each("T.INV.2T TINV", 2)
def t_inv_2t(p, d):
    return t_inverse(1 - probability(p, high_open=False) / 2, degrees(d))


each("CHISQ.DIST.RT CHIDIST", 2)(lambda x, d: gamma_q(degrees(d) / 2, not_negative(x) / 2))
each("F.DIST.RT FDIST", 3)(lambda x, a, b: f_tail(not_negative(x), degrees(a), degrees(b)))


def chi_inverse(p, d):
    return 0.0 if p == 0 else invert(lambda x: gamma_p(d / 2, x / 2), p, 0.0, math.inf)


def f_inverse(p, a, b):
    if p == 0:
        return 0.0
    return invert(lambda x: f_cdf(x, a, b), p, 0.0, math.inf)


each("CHISQ.INV", 2)(lambda p, d: chi_inverse(probability(p, low_open=False), degrees(d)))
each("CHISQ.INV.RT CHIINV", 2)(lambda p, d: chi_inverse(1 - probability(p, high_open=False), degrees(d)))
each("F.INV", 3)(lambda p, a, b: f_inverse(probability(p, low_open=False), degrees(a), degrees(b)))
each("F.INV.RT FINV", 3)(lambda p, a, b: f_inverse(1 - probability(p, high_open=False), degrees(a), degrees(b)))
each("NORM.S.INV NORMSINV", 1)(lambda p: normal_inverse(float(number(p))))
each("NORMSDIST", 1)(lambda z: phi(float(number(z))))
each("PHI", 1)(lambda z: normal_density(float(number(z))))
each("GAUSS", 1)(lambda z: phi(float(number(z))) - 0.5)


@each("NORM.INV NORMINV", 3)
def norm_inv(p, m, s):
    need(number(s) > 0)
    return number(m) + number(s) * normal_inverse(float(number(p)))


@each("LOGNORM.INV LOGINV", 3)
def lognorm_inv(p, m, s):
    return math.exp(norm_inv(p, m, s))


@each("STANDARDIZE", 3)
def standardize(x, m, s):
    need(number(s) > 0)
    return (number(x) - number(m)) / number(s)


def binomial(k, n, p):
    if p in (0, 1):
        return float(k == n * p)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) if n > 1000 else math.comb(n, k) * p**k * (1 - p) ** (n - k)


@each("BINOM.DIST BINOMDIST", 4)
def binom_dist(k, n, p, cumulative):
    k, n, p = math.floor(number(k)), math.floor(number(n)), float(number(p))
    need(0 <= k <= n and 0 <= p <= 1)
    return fsum(binomial(i, n, p) for i in range(k + 1)) if logical(cumulative) else binomial(k, n, p)


@each("BINOM.DIST.RANGE", 3, 4)
def binom_range(n, p, low, high=None):
    n, p, low = math.floor(number(n)), float(number(p)), math.floor(number(low))
    high = low if high is None else math.floor(number(high))
    need(n >= 0 and 0 <= p <= 1 and 0 <= low <= high <= n)
    return fsum(binomial(i, n, p) for i in range(low, high + 1))


@each("BINOM.INV CRITBINOM", 3)
def binom_inv(n, p, alpha):
    n, p, alpha = math.floor(number(n)), float(number(p)), float(number(alpha))
    need(n >= 0 and 0 <= p <= 1 and 0 <= alpha <= 1)
    total = 0.0
    for k in range(n + 1):
        total += binomial(k, n, p)
        if total >= alpha:
            return k
    return n


@each("POISSON.DIST POISSON", 3)
def poisson(k, mean, cumulative):
    k, mean = math.floor(number(k)), float(number(mean))
    need(k >= 0 and mean >= 0)

    def mass(i):
        return math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) if mean else float(i == 0)

    return fsum(map(mass, range(k + 1))) if logical(cumulative) else mass(k)


@each("NEGBINOM.DIST", 4)
def negbinom(f, s, p, cumulative):
    f, s, p = math.floor(number(f)), math.floor(number(s)), float(number(p))
    need(f >= 0 and s >= 1 and 0 < p < 1 or p == 1)
    return beta_i(s, f + 1, p) if logical(cumulative) else math.comb(f + s - 1, f) * p**s * (1 - p) ** f


@each("HYPGEOM.DIST", 5)
def hypgeom(k, n, big_k, big_n, cumulative):
    k, n, big_k, big_n = (math.floor(number(v)) for v in (k, n, big_k, big_n))
    need(k >= 0 and 0 < n <= big_n and 0 <= big_k <= big_n)

    def mass(i):
        return math.comb(big_k, i) * math.comb(big_n - big_k, n - i) / math.comb(big_n, n) if 0 <= i <= min(n, big_k) and n - i <= big_n - big_k else 0.0

    return fsum(map(mass, range(k + 1))) if logical(cumulative) else mass(k)


@each("BETA.DIST", 4, 6)
def beta_dist(x, a, b, cumulative, low=0, high=1):
    x, a, b, low, high = floats(x, a, b, low, high)
    need(a > 0 and b > 0 and low < high and low <= x <= high)
    z = (x - low) / (high - low)
    if logical(cumulative):
        return beta_i(a, b, z)
    if z in (0, 1):
        edge = a if z == 0 else b
        return 0.0 if edge > 1 else math.inf if edge < 1 else math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / (high - low)
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(z) + (b - 1) * math.log1p(-z)) / (high - low)


@each("BETA.INV BETAINV", 3, 5)
def beta_inv(p, a, b, low=0, high=1):
    a, b, low, high = floats(a, b, low, high)
    p = probability(p, low_open=False, high_open=False)
    need(a > 0 and b > 0 and low < high)
    if p in (0, 1):
        return high if p else low
    return low + (high - low) * invert(lambda x: beta_i(a, b, x), p, 0.0, 1.0)


@each("GAMMA.INV GAMMAINV", 3)
def gamma_inv(p, a, b):
    a, b = floats(a, b)
    p = probability(p, low_open=False)
    need(a > 0 and b > 0)
    return 0.0 if p == 0 else b * invert(lambda x: gamma_p(a, x), p, 0.0, math.inf)


@each("GAMMA", 1)
def gamma(x):
    x = float(number(x))
    need(x > 0 or x != math.floor(x))
    return math.gamma(x)


@each("GAMMALN GAMMALN.PRECISE", 1)
def gammaln(x):
    x = float(number(x))
    need(x > 0)
    return math.lgamma(x)


each("FISHER", 1)(lambda x: math.atanh(float(number(x))))
each("FISHERINV", 1)(lambda x: math.tanh(float(number(x))))


@each("CONFIDENCE.NORM CONFIDENCE", 3)
def confidence_norm(alpha, sd, n):
    alpha, sd, n = probability(alpha), float(number(sd)), math.floor(number(n))
    need(sd > 0 and n >= 1)
    return normal_inverse(1 - alpha / 2) * sd / math.sqrt(n)


@each("CONFIDENCE.T", 3)
def confidence_t(alpha, sd, n):
    alpha, sd, n = probability(alpha), float(number(sd)), math.floor(number(n))
    need(sd > 0 and n >= 1)
    need(n > 1, DIV0)
    return t_inverse(1 - alpha / 2, n - 1) * sd / math.sqrt(n)


# -- tests ----------------------------------------------------------------------------------


@whole("Z.TEST ZTEST", 2, 3)
def z_test(data, x, sigma=None):
    found = some([data])
    if sigma is None:
        need(len(found) > 1, DIV0)
        sd = math.sqrt(variance(found, True))
        need(sd > 0, DIV0)
    else:
        sd = number(single(sigma))
        need(sd > 0)
    return 1 - phi((fsum(found) / len(found) - number(single(x))) / (sd / math.sqrt(len(found))))


@whole("T.TEST TTEST", 4)
def t_test(a, b, tails, kind):
    tails, kind = integer(single(tails)), integer(single(kind))
    need(tails in (1, 2) and kind in (1, 2, 3))
    if kind == 1:
        x, y = pairs(a, b)
        need(len(x) > 1, DIV0)
        gaps = [p - q for p, q in zip(x, y, strict=True)]
        mean, sd, df = fsum(gaps) / len(gaps), math.sqrt(variance(gaps, True)), len(gaps) - 1
        if sd == 0:
            need(mean == 0, DIV0)
            return 1.0 if tails == 2 else 0.5
        t = mean / (sd / math.sqrt(len(gaps)))
    else:
        x, y = numbers([a]), numbers([b])
        n, m = len(x), len(y)
        need(n > 1 and m > 1, DIV0)
        vx, vy = variance(x, True), variance(y, True)
        if kind == 2:
            df = n + m - 2
            error = math.sqrt(((n - 1) * vx + (m - 1) * vy) / df * (1 / n + 1 / m))
        else:
            error = math.sqrt(vx / n + vy / m)
            need(error > 0, DIV0)
            df = (vx / n + vy / m) ** 2 / ((vx / n) ** 2 / (n - 1) + (vy / m) ** 2 / (m - 1))
        need(error > 0, DIV0)
        t = (fsum(x) / n - fsum(y) / m) / error
    return tails * t_cdf(-abs(t), df)


@whole("F.TEST FTEST", 2)
def f_test(a, b):
    x, y = numbers([a]), numbers([b])
    need(len(x) > 1 and len(y) > 1, DIV0)
    vx, vy = variance(x, True), variance(y, True)
    need(vx > 0 and vy > 0, DIV0)
    p = f_cdf(vx / vy, len(x) - 1, len(y) - 1)
    return 2 * min(p, 1 - p)


@whole("CHISQ.TEST CHITEST", 2)
def chisq_test(actual, expected):
    if not isinstance(actual, Grid) or not isinstance(expected, Grid):
        raise Error(NA)
    o, e = pairs(actual, expected)
    need(o, NA)
    need(all(v > 0 for v in e))
    stat = fsum((p - q) ** 2 / q for p, q in zip(o, e, strict=True))
    h, w = actual.height, actual.width
    df = (h - 1) * (w - 1) if h > 1 and w > 1 else len(o) - 1
    need(df >= 1, NA)
    return gamma_q(df / 2, stat / 2)


