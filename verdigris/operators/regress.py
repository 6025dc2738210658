"""Probit, linear probability and propensity models on compressed designs.

Regressors of these studies take few distinct values, so a design is first reduced to its covariate
patterns with counts. The fit then runs over patterns, whatever the number of rows; a continuous
regressor only makes the pattern table longer. Only k x k moment matrices reach the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.rules import p_stars
from verdigris.functions.stats import Z80, Z975, normal_cdf, normal_cdf_sql, two_sided_p
from verdigris.session import cut_lineage

COEF_SCHEMA = T.StructType(
    [
        T.StructField("spec", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("coef", T.DoubleType()),
        T.StructField("se", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("pseudo_r2", T.DoubleType()),
    ]
)


class Fit:
    """Coefficients and their covariance, in the order of `names`."""

    def __init__(self, spec, names, beta, cov, n, pseudo_r2):
        self.spec, self.names, self.beta, self.cov = spec, names, beta, cov
        self.n, self.pseudo_r2 = n, pseudo_r2

    def at(self, name: str) -> int:
        return self.names.index(name)

    def rows(self):
        se = np.sqrt(np.diag(self.cov))
        return [
            (self.spec, name, float(b), float(s), self.n, self.pseudo_r2)
            for name, b, s in zip(self.names, self.beta, se)
        ]


def patterns(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Distinct regressor values with counts n and successes k; rows missing any value drop out.
    Counts combine in each task first, so a pattern shared by most rows is no hot key."""
    cols = [F.col(x).cast("double").alias(x) for x in xs]
    return (
        df.select(F.col(y).cast("int").alias("__y"), *cols)
        .dropna()
        .groupBy(*xs)
        .agg(F.count("*").alias("__n"), F.sum("__y").alias("__k"))
    )


def _outer_sums(names: list[str], weight: Column) -> list[Column]:
    x = [F.lit(1.0)] + [F.col(n) for n in names]
    return [
        F.sum(weight * x[i] * x[j]).alias(f"m{i}_{j}") for i in range(len(x)) for j in range(i, len(x))
    ]


def _matrix(row, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m{i}_{j}"]
    return m


def linear_index(names: list[str], beta) -> Column:
    return reduce(
        lambda a, b: a + b, [F.col(n) * float(b) for n, b in zip(names, beta[1:])], F.lit(float(beta[0]))
    )


class _Climb:
    """The way of one specification up its log-likelihood, which is concave: steps of score over information, halved
    while they lead down."""

    def __init__(self, spec: str, xs: list[str], rows: str, ones: str):
        self.spec, self.xs, self.halved, self.steps = spec, xs, 0, 0
        self.rows, self.ones = rows, ones  # SQL for how many rows and successes of a pattern count
        self.beta, self.step, self.ll = np.zeros(len(xs) + 1), np.zeros(len(xs) + 1), -np.inf
        self.score = self.info = None
        self.done = self.failed = False

    def take(self, ll: float, score: np.ndarray, info: np.ndarray) -> None:
        """The sums at beta + step."""
        if self.info is not None and ll < self.ll - 1e-9 * abs(self.ll) and self.halved < 30:
            self.step, self.halved = self.step / 2, self.halved + 1
            return
        self.beta, self.ll, self.score, self.info = self.beta + self.step, ll, score, info
        if self.steps and np.max(np.abs(self.step) / (1 + np.abs(self.beta))) < 1e-8:
            self.done = True
        elif self.steps == 40 or not np.all(np.isfinite(info)) or np.linalg.cond(info) > 1e14:
            self.failed = True  # still climbing: the outcomes are separated
        else:
            self.step, self.halved, self.steps = np.linalg.solve(info, score), 0, self.steps + 1


def _probit_sums(pats: DataFrame, climbs: list[_Climb]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Log-likelihood, score and observed information of every climb at its next place: one aggregate over the
    patterns for all of them. A pattern counts where it has all values of a specification."""
    # Text expressions keep plan building cheap, and the coefficients enter as one array value, so every step runs
    # the same generated code.
    rows, sums, designs = pats.selectExpr("*", *[f"{v} AS {name}{i}" for i, c in enumerate(climbs) for v, name in ((c.rows, "n"), (c.ones, "k"))]), [], []
    for i, climb in enumerate(climbs):
        b = ", ".join(f"{float(v)!r}D" for v in climb.beta + climb.step)
        x = ["1.0D", *[f"`{c}`" for c in climb.xs]]
        designs.append(x)
        rows = rows.selectExpr("*", f"aggregate(zip_with(array({', '.join(x)}), array({b}), (a, c) -> a * c), 0.0D, (s, v) -> s + v) AS xb{i}")
        sums += [f"sum(ll{i}) AS ll{i}", *[f"sum(s{i} * {v}) AS s{i}_{j}" for j, v in enumerate(x)]]
        sums += [f"sum(w{i} * {x[j]} * {x[k]}) AS m{i}_{j}_{k}" for j in range(len(x)) for k in range(j, len(x))]
    every = range(len(climbs))
    rows = rows.selectExpr(
        "*", *[f"n{i} - k{i} AS rest{i}" for i in every], *[f"exp(-xb{i} * xb{i} / 2) / sqrt(2 * pi()) AS phi{i}" for i in every],
        *[f"{normal_cdf_sql(f'xb{i}')} AS up{i}" for i in every], *[f"{normal_cdf_sql(f'(-xb{i})')} AS down{i}" for i in every],
    )
    rows = rows.selectExpr(
        "*", *[f"if(k{i} > 0, k{i} * ln(up{i}), 0D) + if(rest{i} > 0, rest{i} * ln(down{i}), 0D) AS ll{i}" for i in every],
        *[f"if(k{i} > 0, k{i} * phi{i} / up{i}, 0D) - if(rest{i} > 0, rest{i} * phi{i} / down{i}, 0D) AS s{i}" for i in every],
        *[f"if(k{i} > 0, k{i} * phi{i} / up{i} * (phi{i} / up{i} + xb{i}), 0D) + if(rest{i} > 0, rest{i} * phi{i} / down{i} * (phi{i} / down{i} - xb{i}), 0D) AS w{i}" for i in every],
    )
    found, out = rows.selectExpr(*sums).first(), []
    for i, x in enumerate(designs):
        k = len(x)
        values = [found[f"ll{i}"], *[found[f"s{i}_{j}"] for j in range(k)]]
        if any(v is None for v in values):
            out.append((-np.inf, np.full(k, np.nan), np.full((k, k), np.nan)))
            continue
        info = np.array([[found[f"m{i}_{min(j, h)}_{max(j, h)}"] for h in range(k)] for j in range(k)])
        out.append((values[0], np.array(values[1:]), info))
    return out


class Spec(NamedTuple):
    """One model: its name, outcome, regressors, and the condition on its rows as SQL."""

    name: str
    y: str
    xs: list[str]
    where: str = "true"


def fit_probits(df: DataFrame, specs: list[Spec], min_rows: int = 1) -> list[Fit | None]:
    """Probit fits of several models with standard errors from the observed information; None where the data are too
    few or the maximum does not exist.

    The rows are read once, into a table of the patterns of all regressors and conditions; each step is one
    aggregate over it for all models that still climb. A pattern counts for a model where it meets the condition and
    has all values."""
    every, outcomes = (list(dict.fromkeys(v)) for v in ((x for s in specs for x in s.xs), (s.y for s in specs)))
    flags = {w: f"__f{i}" for i, w in enumerate(dict.fromkeys(s.where for s in specs))}
    cols = [f"CAST(`{x}` AS DOUBLE) AS `{x}`" for x in every if x not in outcomes]
    if both := set(every) & set(outcomes):
        raise ValueError(f"outcome and regressor at once: {both}")
    cols += [f"coalesce({w}, false) AS {name}" for w, name in flags.items()] + [f"CAST(`{y}` AS INT) AS `{y}`" for y in outcomes]
    sums = [F.count(y).alias(f"__n_{y}") for y in outcomes] + [F.coalesce(F.sum(y), F.lit(0)).alias(f"__k_{y}") for y in outcomes]
    pats = cut_lineage(df.selectExpr(*cols).groupBy(*every, *flags.values()).agg(*sums))
    climbs, sizes = [], []
    for i, s in enumerate(specs):
        here = " and ".join([flags[s.where], *[f"`{x}` is not null" for x in s.xs]])
        climbs.append(_Climb(s.name, s.xs, *[f"if({here}, `__{c}_{s.y}`, 0L)" for c in "nk"]))
        sizes += [f"coalesce(sum({v}), 0L) AS {c}{i}" for v, c in ((climbs[-1].rows, "n"), (climbs[-1].ones, "k"))]
    size = pats.selectExpr(*sizes).first()
    for i, climb in enumerate(climbs):
        climb.n, climb.k = size[f"n{i}"], size[f"k{i}"]
        climb.failed = climb.n < max(min_rows, len(climb.xs) + 1) or climb.k in (0, climb.n)
    while live := [c for c in climbs if not (c.done or c.failed)]:
        for climb, sums in zip(live, _probit_sums(pats, live)):
            climb.take(*sums)
    fits = []
    for c in climbs:
        if c.failed:
            fits.append(None)
            continue
        p = c.k / c.n
        ll0 = c.n * (p * np.log(p) + (1 - p) * np.log(1 - p))
        fits.append(Fit(c.spec, ["Intercept", *c.xs], c.beta, np.linalg.inv(c.info), int(c.n), float(1 - c.ll / ll0)))
    return fits


def fit_probit(df: DataFrame, y: str, xs: list[str], spec: str, min_rows: int = 1) -> Fit | None:
    return fit_probits(df, [Spec(spec, y, xs)], min_rows)[0]


def tidy(spark: SparkSession, fits, digits: int = 4) -> DataFrame:
    """Coefficient table: estimate, error, z, p, 95% interval, stars, N and pseudo R2."""
    rows = [r for f in fits if f is not None for r in f.rows()]
    df = spark.createDataFrame(rows, COEF_SCHEMA)
    z = F.col("coef") / F.col("se")
    p = two_sided_p(z)

    def rnd(c: Column, name: str) -> Column:
        return F.round(c, digits).alias(name)

    return df.select(
        "spec", "variable",
        rnd(F.col("coef"), "coef"), rnd(F.col("se"), "se"), rnd(z, "z"), rnd(p, "p"),
        rnd(F.col("coef") - Z975 * F.col("se"), "ci_low"),
        rnd(F.col("coef") + Z975 * F.col("se"), "ci_high"),
        p_stars(p).alias("stars"), "n", rnd(F.col("pseudo_r2"), "pseudo_r2"),
    )


def difference(spark: SparkSession, a: Fit, b: Fit, name: str) -> DataFrame:
    """Difference of one coefficient between two separately fitted models."""
    d = a.beta[a.at(name)] - b.beta[b.at(name)]
    se = float(np.sqrt(a.cov[a.at(name), a.at(name)] + b.cov[b.at(name), b.at(name)]))
    df = spark.createDataFrame([(f"{a.spec} vs {b.spec}", float(d), se)], "spec string, diff double, se double")
    return df.withColumn("z", F.col("diff") / F.col("se")).withColumn("p", two_sided_p(F.col("z")))


def wald_equal(spark: SparkSession, fit: Fit, a: str, b: str) -> DataFrame:
    """Test of equal coefficients and the difference detectable with 80% power."""
    i, j = fit.at(a), fit.at(b)
    var = fit.cov[i, i] + fit.cov[j, j] - 2 * fit.cov[i, j]
    d, se = float(fit.beta[i] - fit.beta[j]), float(np.sqrt(var))
    df = spark.createDataFrame([(fit.spec, d, se)], "spec string, diff double, se double")
    z = F.col("diff") / F.col("se")
    return df.select(
        "spec", "diff", "se", (z * z).alias("chi2"), two_sided_p(z).alias("p"),
        (F.lit(Z975 + Z80) * F.col("se")).alias("mdd_80"),
    )


def average_marginal_effect(df: DataFrame, fit: Fit, name: str) -> DataFrame:
    """Mean change in probability when a 0/1 regressor goes from 0 to 1, over all rows."""
    xs, i = fit.names[1:], fit.at(name)
    others = linear_index([x for x in xs if x != name], [fit.beta[0], *[fit.beta[fit.at(x)] for x in xs if x != name]])
    effect = normal_cdf(others + float(fit.beta[i])) - normal_cdf(others)
    base = normal_cdf(F.lit(float(fit.beta[0])) + float(fit.beta[i])) - normal_cdf(F.lit(float(fit.beta[0])))
    return df.agg(F.avg(effect).alias("average_effect"), F.avg(base).alias("baseline_effect"))


def fit_linear(df: DataFrame, y: str, xs: list[str], spec: str) -> Fit | None:
    """Least squares with HC3 errors in two passes: moments, then leverages and the sandwich."""
    pats = cut_lineage(patterns(df, y, xs))
    x = [F.lit(1.0)] + [F.col(c) for c in xs]
    first = pats.agg(
        *_outer_sums(xs, F.col("__n").cast("double")),
        *[F.sum(F.col("__k") * v).alias(f"v{i}") for i, v in enumerate(x)],
    ).first()
    k = len(x)
    if first["m0_0"] is None or first["m0_0"] <= k:
        return None
    xtx = _matrix(first, k)
    if np.linalg.matrix_rank(xtx) < k:
        return None
    inv = np.linalg.inv(xtx)
    beta = inv @ np.array([first[f"v{i}"] for i in range(k)])
    leverage = reduce(
        lambda a, b: a + b, [x[i] * x[j] * float(inv[i, j]) for i in range(k) for j in range(k)]
    )
    fitted = linear_index(xs, beta)
    sq = F.col("__k") * (1 - fitted) * (1 - fitted) + (F.col("__n") - F.col("__k")) * fitted * fitted
    meat = _matrix(pats.agg(*_outer_sums(xs, sq / ((1 - leverage) * (1 - leverage)))).first(), k)
    return Fit(spec, ["Intercept", *xs], beta, inv @ meat @ inv, int(first["m0_0"]), None)


def propensity(df: DataFrame, treat: str, x: str, c: float = 1.0) -> DataFrame:
    """(x, score): ridge logistic regression of treatment on one standardised covariate."""
    pats = cut_lineage(
        df.groupBy(F.col(x).cast("double").alias(x), F.col(treat).cast("double").alias("label")).agg(
            F.count("*").cast("double").alias("w")
        )
    )
    n = pats.agg(F.sum("w")).first()[0]
    data = VectorAssembler(inputCols=[x], outputCol="features").transform(pats)
    model = LogisticRegression(
        weightCol="w", regParam=1.0 / (c * n), standardization=False, maxIter=500, tol=1e-10
    ).fit(data)
    xb = F.lit(float(model.intercept)) + F.col(x) * float(model.coefficients[0])
    return pats.select(x).distinct().withColumn("score", 1 / (1 + F.exp(-xb)))
