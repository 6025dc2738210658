"""Distribution functions.

The normal distribution is a Column expression, so it stays in generated code even over whole
tables. The other tails are only ever needed on a handful of result rows and use small Arrow
functions over the standard library.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from verdigris.functions.text import bound

# ---- fixed values: rational approximation of the normal tail (Hart 1968), high order first
HART_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
# ---- fixed values: normal quantile (Wichura 1988, AS 241), high order first
AS241_CENTRE_NUM = [
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
    13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608,
]
AS241_CENTRE_DEN = [
    5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
    5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0,
]
AS241_MID_NUM = [
    7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
    1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
    4.6303378461565452959, 1.42343711074968357734,
]
AS241_MID_DEN = [
    1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
    0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
    2.05319162663775882187, 1.0,
]
AS241_FAR_NUM = [
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
    0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
    5.4637849111641143699, 6.6579046435011037772,
]
AS241_FAR_DEN = [
    2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
    7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
    0.59983220655588793769, 1.0,
]

Z975 = NormalDist().inv_cdf(0.975)
Z80 = NormalDist().inv_cdf(0.80)


def _poly(x: Column, coefs) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), coefs[1:], F.lit(coefs[0]))


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    b = reduce(lambda acc, k: a + F.lit(k) / acc, (4.0, 3.0, 2.0, 1.0), a + F.lit(0.65))
    bell = F.exp(-a * a / 2)
    near = bell * _poly(a, HART_NUM) / _poly(a, HART_DEN)
    tail = F.when(a < 7.07106781186547, near).otherwise(bell / b / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """normal_cdf as SQL text over a column name, for plans that are rebuilt many times."""

    def poly(coefs):
        return reduce(lambda acc, k: f"({acc} * abs({x}) + {k!r}D)", coefs[1:], f"{coefs[0]!r}D")

    deep = reduce(
        lambda acc, k: f"(abs({x}) + {k!r}D / {acc})", (4.0, 3.0, 2.0, 1.0), f"(abs({x}) + 0.65D)"
    )
    near = f"exp(-{x} * {x} / 2) * {poly(HART_NUM)} / {poly(HART_DEN)}"
    far = f"exp(-{x} * {x} / 2) / {deep} / 2.506628274631D"
    tail = f"(CASE WHEN abs({x}) < 7.07106781186547D THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def two_sided_p(z: Column) -> Column:
    return 2 * normal_cdf(-F.abs(z))


def chi2_1_sf(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return 2 * normal_cdf(-F.sqrt(x))


def normal_quantile(p: Column) -> Column:
    def centre(q: Column) -> Column:
        return q * bound(
            F.lit(0.180625) - q * q, lambda r: _poly(r, AS241_CENTRE_NUM) / _poly(r, AS241_CENTRE_DEN)
        )

    def outer(s: Column) -> Column:
        mid = bound(s - 1.6, lambda m: _poly(m, AS241_MID_NUM) / _poly(m, AS241_MID_DEN))
        far = bound(s - 5.0, lambda f: _poly(f, AS241_FAR_NUM) / _poly(f, AS241_FAR_DEN))
        return F.when(s <= 5.0, mid).otherwise(far)

    def whole(v: Column) -> Column:
        tail = bound(F.sqrt(-F.log(F.least(v, 1 - v))), outer)
        return F.when(F.abs(v - 0.5) <= 0.425, bound(v - 0.5, centre)).otherwise(
            F.when(v < 0.5, -tail).otherwise(tail)
        )

    return bound(p, whole)


def wilson(k: Column, n: Column, z: float = Z975) -> tuple[Column, Column]:
    """Wilson score interval, clipped to 0..1; the whole range where n is 0."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


# ------------------------------------------------ tails for single result rows
#: Steps after which a fraction counts as divergent; at n trials it needs about the root of n.
MOST_STEPS = 50_000_000


def _fraction(terms, start: float) -> float:
    """Continued fraction by forward evaluation; terms yields (numerator, denominator) for ever. Raises
    where it does not settle."""
    tiny = 1e-300
    h = c = start or tiny
    d = 0.0
    for step, (num, den) in enumerate(terms):
        d = den + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = den + num / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
        if step > MOST_STEPS:
            raise ArithmeticError("a tail probability does not converge")


def _beta_terms(a: float, b: float, x: float):
    yield 1.0, 1.0
    yield -(a + b) * x / (a + 1.0), 1.0
    for m in itertools.count(1):
        yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0


def _stirling_rest(n: float) -> float:
    """log n! minus Stirling's formula, which keeps its digits where n is large."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation near the mean."""
    v = (x - mean) / (x + mean)
    if abs(v) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, j = (x - mean) * v, 2 * x * v, 0
    while True:
        j += 1
        term *= v * v
        new = total + term / (2 * j + 1)
        if new == total:
            return new
        total = new


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    n = a + b
    log = _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) - _deviance(a, n * x) - _deviance(b, n * (1 - x))
    front = math.exp(log) * math.sqrt(a * b / n / (2 * math.pi))
    if x < (a + 1.0) / (n + 2.0):
        return front * _fraction(_beta_terms(a, b, x), 0.0) / a
    return 1.0 - front * _fraction(_beta_terms(b, a, 1.0 - x), 0.0) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def binomial_upper(k: float, n: float, p: float = 0.5) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    return 1.0 if k <= 0 else beta_inc(k, n - k + 1, p)


def binomial_quantile(q: float, n: float, p: float) -> float:
    """Smallest k with P(X <= k) >= q, by bisection on the exact tail."""
    lo, hi = 0, int(n)
    while lo < hi:
        mid = (lo + hi) // 2
        if 1.0 - binomial_upper(mid + 1, n, p) >= q:
            hi = mid
        else:
            lo = mid + 1
    return float(lo)


def chi2_sf_scalar(x: float, df: float) -> float:
    """Upper tail of chi-square: series below the mean, continued fraction above."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(-_stirling_rest(a) - _deviance(a, x)) * math.sqrt(a / (2 * math.pi))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    terms = ((-i * (i - a) if i else 1.0, x + 1 - a + 2 * i) for i in itertools.count())
    return front * _fraction(terms, 0.0)


def _lift(fn, *series):
    return pd.Series(
        [None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*series)],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _lift(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def binomial_tail_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return _lift(binomial_upper, k, n)


@F.pandas_udf(DoubleType())
def binomial_ppf(q: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _lift(binomial_quantile, q, n, p)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _lift(chi2_sf_scalar, x, df)
