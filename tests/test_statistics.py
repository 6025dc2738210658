"""Published figures that follow from counts alone, and distribution functions."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import stats as st
from verdigris.operators import agreement as ag
from verdigris.operators import caliper as ca
from verdigris.operators import rates as ra
from verdigris.operators import regress as rg
from verdigris.operators import resample as rs


def counted(spark, rows, schema):
    """Rows repeated by their last column."""
    df = spark.createDataFrame(rows, schema + ", reps int")
    return df.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("reps")))).drop("r", "reps")


def test_normal_functions(spark):
    xs = [-9.0, -4.2, -1.0, 0.0, 0.3, 2.5, 8.0]
    ps = [1e-9, 0.003, 0.08, 0.5, 0.77, 0.9999]
    nd = NormalDist()
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", st.normal_cdf(F.col("x")).alias("c")).collect()
    assert all(abs(r.c - nd.cdf(r.x)) < 1e-9 for r in got)
    text = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{st.normal_cdf_sql('x')} AS c").collect()
    assert all(abs(r.c - nd.cdf(r.x)) < 1e-9 for r in text)
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", st.normal_quantile(F.col("p")).alias("q")).collect()
    assert all(abs(r.q - nd.inv_cdf(r.p)) < 1e-9 for r in got)


def test_scalar_tails():
    assert st.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert st.chi2_sf_scalar(1.2, 2) == pytest.approx(math.exp(-0.6))
    assert st.chi2_sf_scalar(30.0, 3) == pytest.approx(1.38e-6, rel=1e-2)
    brute = sum(math.comb(25, k) for k in range(16, 26)) / 2**25
    assert st.binomial_upper(16, 25) == pytest.approx(brute)


def test_publication_rate_interval(spark):
    df = counted(spark, [(1, True, 47), (1, False, 56)], "direction int, published boolean")
    r = ra.publication_rates(df, ["direction"]).first()
    assert (round(r.rate, 2), round(r.ci_low, 2), round(r.ci_high, 2)) == (45.63, 36.34, 55.23)


def test_primary_probit(spark):
    df = counted(spark, [(0, 1, 28), (0, 0, 32), (1, 1, 106), (1, 0, 125)], "far int, pub int")
    rows = rg.tidy(spark, [rg.fit_probit(df, "pub", ["far"], "s")]).collect()
    assert [(r.coef, r.se, r.n) for r in rows] == [(-0.0837, 0.162, 291), (-0.0196, 0.1819, 291)]
    assert rows[1].p == pytest.approx(0.914, abs=1e-3)


def test_linear_probability_and_wald(spark):
    rows = [(1, 0, 1, 47), (1, 0, 0, 56), (0, 1, 1, 59), (0, 1, 0, 69), (0, 0, 1, 28), (0, 0, 0, 32)]
    df = counted(spark, rows, "pos int, neg int, pub int")
    fit = rg.fit_linear(df, "pub", ["pos", "neg"], "lpm")
    assert [round(b, 4) for b in fit.beta] == [0.4667, -0.0104, -0.0057]
    probit = rg.fit_probit(df, "pub", ["pos", "neg"], "three")
    assert [round(b, 4) for b in probit.beta] == [-0.0837, -0.0261, -0.0144]
    w = rg.wald_equal(spark, probit, "pos", "neg").first()
    assert w.chi2 == pytest.approx((w.diff / w.se) ** 2) and w.mdd_80 == pytest.approx(2.8016 * w.se, rel=1e-3)


def test_separated_outcomes_give_no_fit(spark):
    df = counted(spark, [(0, 0, 40), (1, 1, 40)], "x int, y int")
    assert rg.fit_probit(df, "y", ["x"], "s") is None


def test_caliper_counts(spark):
    df = counted(spark, [(1.7, 611), (2.1, 508)], "z double")
    r = ca.caliper(df, []).first()
    assert (r.below, r.above, round(r.ratio, 3), round(r.chi2, 2), round(r.p, 3)) == (611, 508, 1.203, 9.48, 0.002)
    assert st.binomial_upper(611, 1119) == pytest.approx(0.0011, abs=1e-4)
    assert st.binomial_upper(501, 996) == pytest.approx(0.4371, abs=1e-4)


def test_audit_interval():
    assert st.binomial_quantile(0.025, 200, 0.02) / 200 == 0.005
    assert st.binomial_quantile(0.975, 200, 0.02) / 200 == 0.04


def test_kappa_degenerate_and_plain(spark):
    same = counted(spark, [(1, 1, 5)], "a int, b int")
    assert ag.linear_kappa(same, "a", "b").first().kappa == 1.0
    df = counted(spark, [(-1, -1, 10), (-1, 0, 5), (0, 0, 8), (0, 1, 2), (1, 1, 12), (1, -1, 3)], "a int, b int")
    n, obs = 40, (5 + 2 + 3 * 2) / 40
    pa, pb = {-1: 15, 0: 10, 1: 15}, {-1: 13, 0: 13, 1: 14}
    exp = sum(pa[i] * pb[j] * abs(i - j) for i in pa for j in pb) / n**2
    assert ag.linear_kappa(df, "a", "b").first().kappa == pytest.approx(1 - obs / exp)


def test_bootstrap_equals_plain_resampling(spark):
    papers = spark.range(300).selectExpr("id AS paper", "id % 5 AS nb", "(id * 7) % 4 AS na")
    rows = papers.toPandas()
    w = np.random.default_rng(2).poisson(1.0, (2000, len(rows)))
    plain = (w @ rows["nb"].to_numpy()) / (w @ rows["na"].to_numpy())
    for uniforms in (rs.drawn_uniforms, rs.hash_uniforms):
        found = rs.cluster_bootstrap(papers, [], 2000, 1, uniforms).first()
        assert found.ratio == rows["nb"].sum() / rows["na"].sum()
        assert abs(found.ci_low - np.quantile(plain, 0.025)) < 0.05 and abs(found.ci_high - np.quantile(plain, 0.975)) < 0.05


@pytest.mark.parametrize("m", [1, 7, 400, 100_000])
def test_poisson_follows_its_distribution(m):
    x = rs.poisson(m, (np.arange(50_000) + 0.5) / 50_000)
    assert abs(x.mean() - m) < 0.01 * math.sqrt(m) and abs(x.var() / m - 1) < 0.01


@pytest.mark.parametrize("n", [200, 1500])
def test_relabelling_equals_plain_shuffles(spark, n):
    papers = spark.range(n).selectExpr("id AS paper", f"id % {5 if n < 500 else 31} AS nb", f"1 + id % {3 if n < 500 else 29} AS na", f"id < {2 * n // 5} AS f")
    rows = papers.toPandas()
    draw, size = np.random.default_rng(1), int(rows["f"].sum())
    picks = [draw.permutation(n)[:size] for _ in range(2000)]
    plain = np.array([[rows["nb"].to_numpy()[p].sum(), rows["na"].to_numpy()[p].sum()] for p in picks], float)
    ratio = plain[:, 0] / plain[:, 1]
    seen = rows[rows["f"]]
    for uniforms in (rs.drawn_uniforms, rs.hash_uniforms):
        reps = rs.label_permutation(papers, F.col("f"), 2000, 3, uniforms).toPandas()
        assert len(reps) == 2000 and reps["iter"].is_unique
        found = reps["b"] / reps["a"]
        assert abs(found.mean() - ratio.mean()) < 4 * ratio.std() / 40 and abs(found.std() / ratio.std() - 1) < 0.1
    p = rs.cross_group_p(papers, F.col("f"), 2000, 3).first().p_cross
    assert abs(p - (ratio >= seen["nb"].sum() / seen["na"].sum()).mean()) < 0.05


def test_hypergeometric_follows_its_distribution():
    u = (np.arange(20_000) + 0.5) / 20_000
    x = rs.hypergeometric(7, 13, np.full(len(u), 6), u)
    exact = [math.comb(7, k) * math.comb(13, 6 - k) / math.comb(20, 6) for k in range(7)]
    assert np.abs(np.bincount(x, minlength=7) / len(u) - exact).max() < 1e-3
    assert rs.hypergeometric(5, 5, np.array([0, 10]), np.array([0.5, 0.5])).tolist() == [0, 5]


def test_mann_whitney(spark):
    a, b = [1, 2, 2, 3, 5, 8], [2, 4, 4, 6, 9]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "v int, g boolean")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert ra.mann_whitney(df, "v", F.col("g")).first().u == u


def test_published_kappa(spark):
    cells = [(-1, -1, 20), (0, -1, 9), (0, 0, 5), (0, 1, 6), (1, -1, 2), (1, 1, 18)]
    r = ag.linear_kappa(counted(spark, cells, "a int, b int"), "a", "b").first()
    assert (r.n, round(100 * r.agreement, 1), round(r.kappa, 3)) == (60, 71.7, 0.674)
