"""Group statistics, caliper tests, resampling and agreement (A)."""

from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx
from verdigris.functions import rules as ru
from verdigris.functions import stats as st
from verdigris.functions import text as tx
from verdigris.operators import agreement as ag
from verdigris.operators import caliper as ca
from verdigris.operators import rates as ra
from verdigris.operators import resample as rs
from verdigris.operators.windows import sample_rows
from verdigris.plans.base import (
    PAPERS, RATERS, STATS, papers, r4, raters, rounded, s4, sql_contains_any, sql_hash, sql_in, sql_ncdf,
    sql_t_tails, sql_with, sql_word_count, stats, table,
)
from verdigris.plans.projections import (
    EXPECTED, LOCAL_AMBIGUOUS, LOCAL_PHRASES, TABLE_KIND_SQL, CONTROL_NAMES, internal_consistency,
)
from verdigris.plans.registry import query

Z = st.Z975


def valid(spark, d):
    return ca.valid_z(stats(spark, d))


# ---------------------------------------------------------------- rates and tables
@query("a1_summary_samples", sql_with(PAPERS, f"""
SELECT sample, count(*) AS n, {s4("100.0 * avg(CAST(positive AS INT))")} AS positive_pct, {s4("100.0 * avg(CAST(negative AS INT))")} AS negative_pct,
  {s4("100.0 * avg(CAST(NOT positive AND NOT negative AS INT))")} AS null_pct, {s4("avg(year)")} AS mean_year
FROM (SELECT *, unnest(list_filter(['all', CASE WHEN NOT published THEN 'draft' END, CASE WHEN published THEN 'published' END, journal], lambda x: x IS NOT NULL)) AS sample FROM papers) q
GROUP BY 1"""))
def _(spark, d):
    samples = F.array_compact(
        F.array(
            F.lit("all"), F.when(~F.col("published"), "draft"), F.when(F.col("published"), "published"), F.col("journal")
        )
    )
    p = papers(spark, d).select("positive", "negative", "year", F.explode(samples).alias("sample"))

    def pct(c):
        return r4(100.0 * F.avg(c.cast("int")))

    pos, neg = F.col("positive"), F.col("negative")
    return p.groupBy("sample").agg(
        F.count("*").alias("n"), pct(pos).alias("positive_pct"), pct(neg).alias("negative_pct"),
        pct(~pos & ~neg).alias("null_pct"), r4(F.avg("year")).alias("mean_year"),
    )


def sql_wilson(k, n, sign):
    centre = f"({k} / {n} + {Z * Z!r} / (2 * {n})) / (1 + {Z * Z!r} / {n})"
    half = f"{Z!r} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z * Z!r} / (4 * {n} * {n})) / (1 + {Z * Z!r} / {n})"
    return f"greatest(0.0, {centre} - {half})" if sign < 0 else f"least(1.0, {centre} + {half})"


RATES = f"""n, n_pub, {s4("100.0 * n_pub / n")} AS rate,
  {s4("100.0 * " + sql_wilson("n_pub::DOUBLE", "n::DOUBLE", -1))} AS ci_low, {s4("100.0 * " + sql_wilson("n_pub::DOUBLE", "n::DOUBLE", 1))} AS ci_high"""


@query("a2_publication_rates", sql_with(PAPERS, f"""
SELECT direction, {RATES} FROM (SELECT direction, count(*) AS n, count(*) FILTER (WHERE published) AS n_pub FROM papers
  WHERE direction IS NOT NULL GROUP BY 1) q"""))
def _(spark, d):
    rates = ra.publication_rates(papers(spark, d).filter("direction is not null"), ["direction"])
    return rounded(rates, "rate", "ci_low", "ci_high")


@query("a3_wilson_interval", sql_with(PAPERS, f"""
SELECT source, {RATES} FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE positive) AS n_pub FROM papers GROUP BY 1) q"""))
def _(spark, d):
    return rounded(ra.publication_rates(papers(spark, d), ["source"], "positive"), "rate", "ci_low", "ci_high")


@query("a4_contingency", sql_with(PAPERS, """
SELECT direction, count(*) FILTER (WHERE published) AS published, count(*) FILTER (WHERE NOT published) AS unpublished
FROM papers WHERE direction IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    t = papers(spark, d).filter("direction is not null").groupBy("direction").pivot("published", [True, False]).count()
    return t.select("direction", *[F.coalesce(F.col(o), F.lit(0)).alias(n) for o, n in (("true", "published"), ("false", "unpublished"))])


@query("a4_transition_matrix", sql_with(RATERS, """
SELECT r1, count(*) FILTER (WHERE r2 = -1) AS to_neg, count(*) FILTER (WHERE r2 = 0) AS to_null, count(*) FILTER (WHERE r2 = 1) AS to_pos FROM raters GROUP BY 1"""))
def _(spark, d):
    t = raters(spark, d).groupBy("r1").pivot("r2", [-1, 0, 1]).count().na.fill(0)
    return t.select("r1", F.col("-1").alias("to_neg"), F.col("0").alias("to_null"), F.col("1").alias("to_pos"))


@query("a5_chi_square", sql_with(PAPERS, f"""
, cells AS (SELECT direction AS r, published AS c, count(*) AS o FROM papers WHERE direction IS NOT NULL GROUP BY ALL),
g AS (SELECT rr.r, cc.c, coalesce(o, 0) AS o, rt * ct / (SELECT sum(o) FROM cells) AS e
  FROM (SELECT r, sum(o) AS rt FROM cells GROUP BY 1) rr CROSS JOIN (SELECT c, sum(o) AS ct FROM cells GROUP BY 1) cc LEFT JOIN cells USING (r, c))
SELECT CAST(sum(o) AS BIGINT) AS n, {s4("sum((o - e) * (o - e) / e)")} AS chi2, 2 AS df, {s4("exp(-sum((o - e) * (o - e) / e) / 2)")} AS p FROM g"""))
def _(spark, d):
    c = ra.chi_square(papers(spark, d).filter("direction is not null"), "direction", "published")
    return rounded(c.withColumn("p", st.chi2_p("chi2", F.col("df").cast("double"))), "chi2", "p")


@query("a5_chi_square_two_by_two", sql_with(PAPERS, f"""
, c AS (SELECT count(*) FILTER (WHERE positive AND published) AS a, count(*) FILTER (WHERE positive AND NOT published) AS b,
  count(*) FILTER (WHERE NOT positive AND published) AS cc, count(*) FILTER (WHERE NOT positive AND NOT published) AS dd, count(*) AS n FROM papers)
SELECT n, {s4("n * pow(greatest(abs(a * dd - b * cc) - n / 2, 0), 2) / ((a + b)::DOUBLE * (cc + dd) * (a + cc) * (b + dd))")} AS chi2, 1 AS df FROM c"""))
def _(spark, d):
    return rounded(ra.chi_square(papers(spark, d), "positive", "published"), "chi2")


@query("a6_uniformity", sql_with(PAPERS, f"""
, g AS (SELECT source, count(*) FILTER (WHERE direction IS NULL) AS dropped FROM papers GROUP BY 1)
SELECT {s4("sum(pow(dropped - m, 2) / m)")} AS chi2, count(*) - 1 AS df FROM g, (SELECT avg(dropped) AS m FROM g) a"""))
def _(spark, d):
    g = papers(spark, d).groupBy("source").agg(F.count_if(F.col("direction").isNull()).alias("dropped"))
    return rounded(ra.uniformity(g, "dropped"), "chi2")


# ---------------------------------------------------------------- coverage
NB = "count(*) FILTER (WHERE z >= 1.645 AND z < 1.96)"
NA = "count(*) FILTER (WHERE z >= 1.96 AND z < 2.275)"


@query("a7_counts_per_paper", sql_with(STATS, f"SELECT subset, paper_id, {NB} AS nb, {NA} AS na FROM valid GROUP BY 1, 2"))
def _(spark, d):
    return ca.per_paper(valid(spark, d), ["subset"], "paper_id")


@query("a8_statistics_per_paper", sql_with(STATS + "," + PAPERS, f"""
, c AS (SELECT paper_id, count(*) AS n FROM stats GROUP BY 1), a AS (SELECT p.paper_id, p.published, coalesce(c.n, 0) AS n FROM papers p LEFT JOIN c USING (paper_id))
SELECT published, count(*) AS papers, count(*) FILTER (WHERE n > 0) AS with_stats, {s4("count(*) FILTER (WHERE n > 0) / count(*)")} AS coverage,
  CAST(sum(n) AS BIGINT) AS total, {s4("avg(CASE WHEN n > 0 THEN n END)")} AS mean_n, {s4("median(CASE WHEN n > 0 THEN n END)")} AS median_n FROM a GROUP BY 1"""))
def _(spark, d):
    return coverage(papers(spark, d), stats(spark, d), ["published"])


def coverage(p, s, by):
    """Papers, papers with statistics, and statistics per covered paper; counts join, not rows."""
    c = s.groupBy("paper_id").agg(F.count("*").alias("n"))
    a = p.select("paper_id", *by).join(c, "paper_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = F.when(F.col("n") > 0, F.col("n"))
    return a.groupBy(*by).agg(
        F.count("*").alias("papers"), F.count(some).alias("with_stats"), r4(F.count(some) / F.count("*")).alias("coverage"),
        F.sum("n").alias("total"), r4(F.avg(some)).alias("mean_n"), r4(F.median(some)).alias("median_n"),
    )


@query("a8_zero_statistic_papers", sql_with(STATS + "," + PAPERS, "SELECT paper_id, year, source FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM stats)"))
def _(spark, d):
    covered = stats(spark, d).select("paper_id").distinct()
    return papers(spark, d).join(covered, "paper_id", "left_anti").select("paper_id", "year", "source")


@query("a9_coverage_by_group", sql_with(STATS + "," + PAPERS, f"""
SELECT coalesce(journal, 'none') AS journal, count(*) AS total, count(c.paper_id) AS with_stats, count(*) - count(c.paper_id) AS dropped,
  {s4("100.0 * count(c.paper_id) / count(*)")} AS coverage_pct FROM papers p LEFT JOIN (SELECT DISTINCT paper_id FROM stats) c USING (paper_id) GROUP BY 1"""))
def _(spark, d):
    c = stats(spark, d).select("paper_id").distinct().withColumn("hit", F.lit(1))
    return papers(spark, d).join(c, "paper_id", "left").groupBy(F.coalesce("journal", F.lit("none")).alias("journal")).agg(
        F.count("*").alias("total"), F.count("hit").alias("with_stats"), (F.count("*") - F.count("hit")).alias("dropped"),
        r4(100.0 * F.count("hit") / F.count("*")).alias("coverage_pct"),
    )


@query("a9_institution_coverage", sql_with(PAPERS, f"""
SELECT source, count(*) AS n, count(n_authors) AS affil_found, CAST(sum(top_institution) AS BIGINT) AS top_institution,
  {s4("100.0 * sum(top_institution) / count(*)")} AS top_pct FROM papers GROUP BY 1"""))
def _(spark, d):
    return papers(spark, d).groupBy("source").agg(
        F.count("*").alias("n"), F.count("n_authors").alias("affil_found"), F.sum("top_institution").alias("top_institution"),
        r4(100.0 * F.sum("top_institution") / F.count("*")).alias("top_pct"),
    )


@query("a10_distinct_papers", sql_with(STATS, "SELECT corpus, count(DISTINCT paper_id) AS papers FROM stats GROUP BY 1"))
def _(spark, d):
    return stats(spark, d).groupBy("corpus").agg(F.count_distinct("paper_id").alias("papers"))


@query("a11_value_shares", sql_with(PAPERS, f"""
SELECT published, confidence, count(*) AS n, {s4("count(*) / sum(count(*)) OVER (PARTITION BY published)")} AS share FROM papers GROUP BY 1, 2"""))
def _(spark, d):
    return rounded(ra.share_of(papers(spark, d), ["published"], "confidence"), "share")


@query("a12_spread_of_counts", sql_with(STATS, f"""
SELECT corpus, {s4("avg(n)")} AS mean, {s4("median(n)")} AS median, min(n) AS min, max(n) AS max, count(*) FILTER (WHERE n < 60) AS few
FROM (SELECT corpus, paper_id, count(*) AS n FROM stats GROUP BY 1, 2) q GROUP BY 1"""))
def _(spark, d):
    c = stats(spark, d).groupBy("corpus", "paper_id").agg(F.count("*").alias("n"))
    return c.groupBy("corpus").agg(
        r4(F.avg("n")).alias("mean"), r4(F.median("n")).alias("median"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.count_if(F.col("n") < 60).alias("few"),
    )


@query("a13_counts_with_subtotals", sql_with(PAPERS, f"""
SELECT direction, coalesce(CAST(quasi_exp AS VARCHAR), 'All') AS quasi_exp, count(*) FILTER (WHERE published) AS pub_n,
  count(*) FILTER (WHERE NOT published) AS draft_n, count(*) AS total_n, {s4("avg(CAST(published AS INT))")} AS pub_rate
FROM papers WHERE direction IS NOT NULL GROUP BY GROUPING SETS ((direction, quasi_exp), (direction))"""))
def _(spark, d):
    papers(spark, d).filter("direction is not null").createOrReplaceTempView("vg_papers")
    return rounded(spark.sql("""
        SELECT direction, coalesce(CAST(quasi_exp AS STRING), 'All') AS quasi_exp, count_if(published) AS pub_n,
          count_if(NOT published) AS draft_n, count(*) AS total_n, avg(CAST(published AS INT)) AS pub_rate
        FROM vg_papers GROUP BY GROUPING SETS ((direction, quasi_exp), (direction))"""), "pub_rate")


# ---------------------------------------------------------------- caliper family
def sql_caliper(by, src="valid", lo=1.645, mid=1.96, hi=2.275, open_low=False):
    gt = ">" if open_low else ">="
    b = f"count(*) FILTER (WHERE z {gt} {lo} AND z < {mid})"
    a = f"count(*) FILTER (WHERE z >= {mid} AND z < {hi})"
    return (
        f"SELECT {by}, count(*) AS n, {b} AS below, {a} AS above, count(*) FILTER (WHERE z >= 1.96) AS n_sig, "
        f"{s4(f'{b} / nullif({a}, 0)')} AS ratio, {s4(f'CASE WHEN {a} > 0 THEN ({b} - {a}) * ({b} - {a}) / ({b} + {a}) END')} AS chi2, "
        f"{s4(f'100.0 * count(*) FILTER (WHERE z >= 1.96) / count(*)')} AS pct_sig FROM {src} GROUP BY {by}"
    )


@query("a14_caliper_naive", sql_with(STATS, f"""
, c AS ({sql_caliper("subset")}) SELECT *, CASE WHEN above > 0 THEN {s4("2 * " + sql_ncdf("(-sqrt((below - above) * (below - above) / (below + above)))"))} END AS p FROM c"""))
def _(spark, d):
    return rounded(ca.caliper(valid(spark, d), ["subset"]), "ratio", "chi2", "p", "pct_sig")


@query("a15_caliper_open_bounds", sql_with(STATS, sql_caliper("corpus", open_low=True)))
def _(spark, d):
    return rounded(ca.caliper(valid(spark, d), ["corpus"], open_low=True), "ratio", "chi2", "pct_sig").drop("p")


DISC = "(SELECT {by}, count(*) AS n, count(*) FILTER (WHERE z >= 1.46 AND z < 1.96) AS n_below, count(*) FILTER (WHERE z >= 1.96 AND z < 2.46) AS n_above FROM valid GROUP BY 1)"


@query("a16_density_discontinuity", sql_with(STATS, f"""
, q AS {DISC.format(by="subset")}, w AS (SELECT *, n_below / n AS pb, n_above / n AS pa FROM q),
t AS (SELECT subset, n, n_below, n_above, (pb - pa) / sqrt((pb * (1 - pb) + pa * (1 - pa)) / n) AS z_stat FROM w)
SELECT subset, n, n_below, n_above, {s4("z_stat")} AS z_stat, {s4("2 * " + sql_ncdf("(-abs(z_stat))"))} AS p FROM t"""))
def _(spark, d):
    return rounded(ca.discontinuity(valid(spark, d), ["subset"]), "z_stat", "p")


def sql_bootstrap(seed: str, corpus: str) -> str:
    """The bootstrap by profiles per group of `corpus`: Poisson(m) numbers by inversion of md5 numbers."""
    return sql_with(STATS, f"""
, pp AS (SELECT {corpus} AS grp, paper_id, {NB} AS nb, {NA} AS na FROM valid GROUP BY 1, 2),
pf AS (SELECT grp, nb, na, count(*) AS m FROM pp WHERE nb + na > 0 GROUP BY 1, 2, 3),
pk AS (SELECT m, unnest(range(0, m + CAST(12 * sqrt(m) AS BIGINT) + 40)) AS x FROM (SELECT DISTINCT m FROM pf) q),
pc AS (SELECT m, x, sum(exp(x * ln(m) - m - lgamma(x + 1.0::DOUBLE))) OVER (PARTITION BY m ORDER BY x) AS c FROM pk),
pl AS (SELECT m, list(c ORDER BY x) AS cs FROM pc WHERE c < 1 - 1e-12 GROUP BY 1),
draws AS (SELECT grp, iter, nb, na, len(list_filter(cs, lambda c: c < u)) AS w FROM (
  SELECT grp, iter, nb, na, m, {sql_hash(seed, "iter", "grp", "nb", "na")} / 4294967296.0::DOUBLE AS u FROM pf, range(10000) t(iter)) q JOIN pl USING (m)),
reps AS (SELECT grp, iter, sum(w * nb) AS b, sum(w * na) AS a FROM draws GROUP BY 1, 2),
r AS (SELECT grp, b / a AS r, avg(b / a) OVER (PARTITION BY grp) AS m FROM reps WHERE a > 0),
o AS (SELECT grp, count(*) FILTER (WHERE nb + na > 0) AS n_papers, sum(nb)::BIGINT AS below, sum(na)::BIGINT AS above FROM pp GROUP BY 1)
SELECT grp AS {corpus}, n_papers, below, above, {s4("avg(CASE WHEN r - m + 1.0 >= below / above THEN 1.0 ELSE 0.0 END)")} AS p_boot,
  {s4("quantile_cont(r, 0.025)")} AS ci_low, {s4("quantile_cont(r, 0.975)")} AS ci_high, {s4("below / above")} AS ratio
FROM r JOIN o USING (grp) GROUP BY grp, n_papers, below, above""")


def bootstrap_by(spark, d, group, seed):
    pp = ca.per_paper(valid(spark, d), [group], "paper_id")
    return rounded(rs.cluster_bootstrap(pp, [group], seed=seed, uniforms=rs.hash_uniforms), "p_boot", "ci_low", "ci_high", "ratio")


@query("a17_cluster_bootstrap_draws", sql_bootstrap("b1", "subset"))
def _(spark, d):
    return bootstrap_by(spark, d, "subset", "b1")


@query("a17_cluster_bootstrap", sql_bootstrap("42", "subset"))
def _(spark, d):
    return bootstrap_by(spark, d, "subset", "42")


@query("a18_within_window_permutation", sql_with(STATS, f"""
, o AS (SELECT subset, {NB} AS below, {NA} AS above FROM valid GROUP BY 1),
-- log factorials of every whole number up to the largest window
lf AS (SELECT k, sum(CASE WHEN k = 0 THEN 0 ELSE ln(k) END) OVER (ORDER BY k) AS v FROM range(0, (SELECT max(below + above) + 1 FROM o)) t(k)),
x AS (SELECT subset, below, above, unnest(range(below, below + above + 1)) AS k FROM o)
SELECT subset, below, above, {s4("sum(exp(a.v - b.v - c.v - (below + above) * ln(2)))")} AS p_perm
FROM x JOIN lf a ON a.k = below + above JOIN lf b ON b.k = x.k JOIN lf c ON c.k = below + above - x.k GROUP BY 1, 2, 3"""))
def _(spark, d):
    c = ca.caliper(valid(spark, d), ["subset"]).select("subset", "below", "above")
    p = st.binomial_tail_p(F.col("below").cast("double"), (F.col("below") + F.col("above")).cast("double"))
    return c.withColumn("p_perm", r4(p))


@query("a18_within_window_draws", sql_with(STATS, f"""
, o AS (SELECT subset, {NB}::BIGINT AS below, {NA}::BIGINT AS above, {NB} + {NA} AS n FROM valid GROUP BY 1),
x AS (SELECT subset, n, unnest(range(0, n + 1)) AS k FROM o),
c AS (SELECT subset, k, sum(exp(lgamma(n + 1.0::DOUBLE) - lgamma(k + 1.0::DOUBLE) - lgamma(n - k + 1.0::DOUBLE) - n * ln(2))) OVER (PARTITION BY subset ORDER BY k) AS c FROM x),
l AS (SELECT subset, list(c ORDER BY k) AS cs FROM c GROUP BY 1),
u AS (SELECT subset, below, above, n, {sql_hash("42", "iter", "subset")} / 4294967296.0::DOUBLE AS u FROM o, range(10000) t(iter)),
d AS (SELECT subset, below, above, n, least(n, len(list_filter(cs, lambda v: v < u))) AS k FROM u JOIN l USING (subset))
SELECT subset, below, above, CASE WHEN above > 0 THEN {s4("avg(CASE WHEN k / (n - k) >= below / above THEN 1.0 ELSE 0.0 END)")} END AS p_perm FROM d WHERE k < n GROUP BY 1, 2, 3"""))
def _(spark, d):
    pp = ca.per_paper(valid(spark, d), ["subset"], "paper_id")
    return rounded(rs.within_window_draws(pp, ["subset"], 10_000, 42, rs.hash_uniforms), "p_perm")


@query("a19_per_paper_ratio_t", sql_with(STATS, f"""
, pp AS (SELECT corpus, paper_id, {NB} AS nb, {NA} AS na FROM valid GROUP BY 1, 2)
SELECT corpus, count(*) AS n, {s4("avg(nb / na)")} AS mean_ratio, {s4("(avg(nb / na) - 1) / (stddev_samp(nb / na) / sqrt(count(*)))")} AS t
FROM pp WHERE na > 0 GROUP BY 1 HAVING count(*) >= 3"""))
def _(spark, d):
    return per_paper_t(spark, d).drop("p")


@query("a19_per_paper_ratio_p", sql_with(STATS, f"""
, pp AS (SELECT corpus, paper_id, {NB} AS nb, {NA} AS na FROM valid GROUP BY 1, 2),
q AS (SELECT corpus AS key, count(*) AS n, count(*) - 1 AS df, avg(nb / na) AS m, (avg(nb / na) - 1) / (stddev_samp(nb / na) / sqrt(count(*))) AS t
  FROM pp WHERE na > 0 GROUP BY 1 HAVING count(*) >= 3), {sql_t_tails("q")}
SELECT key AS corpus, n, {s4("m")} AS mean_ratio, {s4("t")} AS t, {s4("p")} AS p FROM q JOIN tails USING (key)"""))
def _(spark, d):
    return per_paper_t(spark, d)


def per_paper_t(spark, d):
    pp = ca.per_paper(valid(spark, d), ["corpus"], "paper_id").filter("na > 0").withColumn("r", F.col("nb") / F.col("na"))
    t = (F.avg("r") - 1) / (F.stddev_samp("r") / F.sqrt(F.count("*")))
    out = pp.groupBy("corpus").agg(F.count("*").alias("n"), F.avg("r").alias("mean_ratio"), t.alias("t")).filter("n >= 3")
    return rounded(out.withColumn("p", st.t_p("t", (F.col("n") - 1).cast("double"))), "mean_ratio", "t", "p")


def sql_label_permutation(seed: str, n_iter: int, top: int = 10) -> str:
    """CTEs reps(iter, b, a) for pp(nb, na, ..) with k(n1): profiles in order as leaves of a tree of 2**top places; each
    level divides a node's draws by inversion of the hypergeometric distribution, with one md5 number per node."""
    ctes = [f"""pf AS (SELECT nb, na, count(*) AS m, row_number() OVER (ORDER BY nb, na) - 1 AS rk FROM pp GROUP BY 1, 2),
h{top} AS (SELECT CAST(it AS BIGINT) AS iter, 0::BIGINT AS i, CAST(n1 AS BIGINT) AS k FROM range({n_iter}) t(it), k)"""]
    comb = lambda n, x: f"(lgamma({n} + 1.0::DOUBLE) - lgamma({x} + 1.0::DOUBLE) - lgamma({n} - {x} + 1.0::DOUBLE))"
    for h in range(top, 0, -1):
        ctes.append(f"""
z{h} AS (SELECT rk >> {h} AS i, coalesce(sum(m) FILTER ((rk >> {h - 1}) % 2 = 0), 0)::BIGINT AS l, coalesce(sum(m) FILTER ((rk >> {h - 1}) % 2 = 1), 0)::BIGINT AS r FROM pf GROUP BY 1),
d{h} AS (SELECT i, k, l, r, unnest(range(greatest(0, k - r), least(l, k) + 1)) AS x FROM (SELECT DISTINCT i, k FROM h{h}) q JOIN z{h} USING (i)),
c{h} AS (SELECT i, k, x, max(x) OVER (PARTITION BY i, k) AS most, sum(exp({comb("l", "x")} + {comb("r", "(k - x)")} - {comb("(l + r)", "k")})) OVER (PARTITION BY i, k ORDER BY x) AS c FROM d{h}),
u{h} AS (SELECT iter, i, k, {sql_hash(seed, "iter", str(h), "i")} / 4294967296.0::DOUBLE AS u FROM h{h}),
x{h} AS (SELECT iter, i, k, least(max(most), min(x) + count(*) FILTER (c < u)) AS x FROM u{h} JOIN c{h} USING (i, k) GROUP BY iter, i, k),
h{h - 1} AS (SELECT iter, 2 * i AS i, x AS k FROM x{h} WHERE x > 0 UNION ALL SELECT iter, 2 * i + 1, k - x FROM x{h} WHERE k > x)""")
    return ",".join([*ctes, "\nreps AS (SELECT iter, sum(k * nb) AS b, sum(k * na) AS a FROM h0 JOIN pf ON rk = i GROUP BY 1)"])


def sql_cross_group(seed: str) -> str:
    return sql_with(STATS, f"""
, pp AS (SELECT corpus, paper_id, {NB} AS nb, {NA} AS na FROM valid GROUP BY 1, 2),
k AS (SELECT count(*) AS n1, sum(nb) / sum(na) AS ratio FROM pp WHERE corpus = 'published'),
{sql_label_permutation(seed, 10_000)}
SELECT {s4("ratio")} AS ratio, count(*) AS n_iter, {s4("avg(CASE WHEN b / a >= ratio THEN 1.0 ELSE 0.0 END)")} AS p_cross FROM reps, k WHERE a > 0 GROUP BY ratio""")


@query("a20_cross_group_permutation_draws", sql_cross_group("x9"))
def _(spark, d):
    pp = ca.per_paper(valid(spark, d), ["corpus"], "paper_id")
    out = rs.cross_group_p(pp, F.col("corpus") == "published", n_iter=10_000, seed="x9", uniforms=rs.hash_uniforms)
    return rounded(out, "ratio", "p_cross")


@query("a20_cross_group_permutation", sql_cross_group("99"))
def _(spark, d):
    pp = ca.per_paper(valid(spark, d), ["corpus"], "paper_id")
    return rounded(rs.cross_group_p(pp, F.col("corpus") == "published", seed=99, uniforms=rs.hash_uniforms), "ratio", "p_cross")


WINDOWS = {"standard": (1.645, 1.96, 2.275), "narrow": (1.70, 1.96, 2.22), "wide": (1.50, 1.96, 2.42), "tight": (1.66, 1.96, 2.26)}


def sql_grid(by, src):
    parts = []
    for name, (lo, mid, hi) in WINDOWS.items():
        b = f"count(*) FILTER (WHERE z >= {lo} AND z < {mid})"
        a = f"count(*) FILTER (WHERE z >= {mid} AND z < {hi})"
        parts.append(
            f"SELECT {by}, '{name}' AS \"window\", count(*) AS n, {b} AS below, {a} AS above, {s4(f'{b} / nullif({a}, 0)')} AS ratio, "
            f"{s4(f'CASE WHEN {a} > 0 THEN ({b} - {a}) * ({b} - {a}) / ({b} + {a}) END')} AS chi2 FROM {src} GROUP BY {by}"
        )
    return " UNION ALL ".join(parts)


@query("a21_caliper_windows", sql_with(STATS, sql_grid("corpus, direction", "valid")))
def _(spark, d):
    return rounded(ca.caliper_grid(valid(spark, d), ["corpus", "direction"], WINDOWS), "ratio", "chi2")


@query("a21_caliper_inclusion", sql_with(STATS, f"""
, long AS (SELECT *, 'all' AS rule FROM valid UNION ALL SELECT *, 'non_control' FROM valid WHERE variable NOT IN {sql_in(CONTROL_NAMES)}),
deep AS (SELECT rule, corpus, z, unnest(['full', CAST(direction AS VARCHAR)]) AS part FROM long)
{sql_caliper("rule, corpus, part", "deep")}"""))
def _(spark, d):
    v = valid(spark, d)
    rule = F.array_compact(F.array(F.lit("all"), F.when(~ru.is_control("variable"), "non_control")))
    part = F.array(F.lit("full"), F.col("direction").cast("string"))
    deep = v.select("corpus", "z", part.alias("part"), F.explode(rule).alias("rule")).withColumn("part", F.explode("part"))
    return rounded(ca.caliper(deep, ["rule", "corpus", "part"]), "ratio", "chi2", "pct_sig").drop("p")


@query("a22_gap_decomposition", sql_with(STATS, f"""
, g AS (SELECT corpus, count(*) FILTER (WHERE row_type = 'z_only') / count(*) AS sh, {NB} / nullif({NA}, 0) AS r,
  count(*) FILTER (WHERE row_type = 'z_only' AND z >= 1.645 AND z < 1.96) / nullif(count(*) FILTER (WHERE row_type = 'z_only' AND z >= 1.96 AND z < 2.275), 0) AS rz,
  count(*) FILTER (WHERE row_type <> 'z_only' AND z >= 1.645 AND z < 1.96) / nullif(count(*) FILTER (WHERE row_type <> 'z_only' AND z >= 1.96 AND z < 2.275), 0) AS rc
  FROM valid GROUP BY 1),
j AS (SELECT a.r AS r1, b.r AS r2, a.sh AS s1, b.sh AS s2, a.rc AS c1, b.rc AS c2, a.rz AS z1, b.rz AS z2,
  (a.rz - b.rz) * b.sh + (a.rc - b.rc) * (1 - b.sh) AS w FROM g a, g b WHERE a.corpus = 'published' AND b.corpus = 'draft')
SELECT component, {s4("value")} AS value FROM (SELECT unnest(['ratio_first', 'ratio_second', 'gap', 'within', 'composition', 'share_first', 'share_second',
  'other_first', 'other_second', 'special_first', 'special_second']) AS component,
  unnest([r1, r2, r1 - r2, w, r1 - r2 - w, s1, s2, c1, c2, z1, z2]) AS value FROM j) q"""))
def _(spark, d):
    out = ca.decomposition(valid(spark, d), "corpus", "row_type", "published", "draft", "z_only")
    return rounded(out, "value")


@query("a22_caliper_by_row_type", sql_with(STATS, sql_caliper("corpus, row_type")))
def _(spark, d):
    return rounded(ca.caliper(valid(spark, d), ["corpus", "row_type"]), "ratio", "chi2", "pct_sig").drop("p")


STD = "stars IN ('', '*', '**', '***')"


@query("a23_star_consistency", sql_with(STATS, f"""
SELECT corpus, row_type, count(*) AS n, count(*) FILTER (WHERE stars = {EXPECTED}) AS exact,
  {s4(f"100.0 * count(*) FILTER (WHERE stars = {EXPECTED}) / count(*)")} AS pct FROM valid WHERE {STD} GROUP BY 1, 2"""))
def _(spark, d):
    v = valid(spark, d).filter(F.col("stars").isin("", "*", "**", "***"))
    hit = F.col("stars") == ru.expected_star("z")
    return v.groupBy("corpus", "row_type").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("exact"), r4(100.0 * F.count_if(hit) / F.count("*")).alias("pct")
    )


@query("a24_stars_by_window", sql_with(STATS, f"""
, w AS (SELECT * FROM (VALUES ('below', 1.645, 1.96), ('above', 1.96, 2.275), ('significant', 1.96, 50.0)) t("window", lo, hi)),
j AS (SELECT corpus, "window", stars FROM valid JOIN w ON z > lo AND z < hi WHERE row_type = 'z_only' AND {STD}),
c AS (SELECT corpus, "window", count(*) AS total, count(*) FILTER (WHERE stars = '') AS s0, count(*) FILTER (WHERE stars = '*') AS s1,
  count(*) FILTER (WHERE stars = '**') AS s2, count(*) FILTER (WHERE stars = '***') AS s3 FROM j GROUP BY 1, 2)
SELECT *, {s4('''100.0 * CASE WHEN "window" = 'below' THEN s1 ELSE s2 + s3 END / total''')} AS consistency_pct FROM c"""))
def _(spark, d):
    v = valid(spark, d).filter((F.col("row_type") == "z_only") & F.col("stars").isin("", "*", "**", "***"))
    z = F.col("z")
    windows = F.array_compact(
        F.array(
            F.when((z > 1.645) & (z < 1.96), "below"), F.when((z > 1.96) & (z < 2.275), "above"),
            F.when((z > 1.96) & (z < 50), "significant"),
        )
    )
    s = F.col("stars")
    c = v.select("corpus", "stars", F.explode(windows).alias("window")).groupBy("corpus", "window").agg(
        F.count("*").alias("total"), *[F.count_if(s == "*" * i).alias(f"s{i}") for i in range(4)]
    )
    good = F.when(F.col("window") == "below", F.col("s1")).otherwise(F.col("s2") + F.col("s3"))
    return c.withColumn("consistency_pct", r4(100.0 * good / F.col("total")))


@query("a25_table_type_breakdown", sql_with(STATS, f"""
SELECT kind, n, in_caliper, {s4("100.0 * n / sum(n) OVER ()")} AS pct_total FROM (SELECT {TABLE_KIND_SQL} AS kind, count(z) AS n,
  count(*) FILTER (WHERE z > 1.645 AND z < 1.96) AS in_caliper FROM stats WHERE row_type = 'z_only' GROUP BY 1) q"""))
def _(spark, d):
    z = F.col("z")
    c = stats(spark, d).filter("row_type = 'z_only'").groupBy(ru.table_kind("tbl").alias("kind")).agg(
        F.count("z").alias("n"), F.count_if((z > 1.645) & (z < 1.96)).alias("in_caliper")
    )
    return c.withColumn("pct_total", r4(100.0 * F.col("n") / c.agg(F.sum("n")).scalar()))


@query("a26_histogram", sql_with(STATS, """
SELECT subset, least(CAST(floor(z / 0.2::DOUBLE + 1e-9) AS INT), 29) AS bin, count(*) AS n FROM stats WHERE z BETWEEN 0 AND 6 GROUP BY 1, 2"""))
def _(spark, d):
    return rs.histogram(stats(spark, d), ["subset"], "z", 0.0, 6.0, 0.2)


def sql_cubic(rows: str) -> str:
    """CTE solved(b0..b3, z0..z3): least-squares cubic of y over the fitted bins of `rows`, and the weights by which
    fitted values add up over the tested ones, by Gauss-Jordan elimination with two right-hand sides."""
    cols = [f"sum(pow(x, {i + j})) FILTER (fitted) AS m{i}_{j}" for i in range(4) for j in range(4)]
    cols += [f"sum(pow(x, {i}) * y) FILTER (fitted) AS m{i}_4, sum(pow(x, {i})) FILTER (tested) AS m{i}_5" for i in range(4)]
    ctes = [f"e0 AS (SELECT {', '.join(cols)} FROM {rows})"]
    for t in range(4):
        step = [f"m{t}_{j} / m{t}_{t} AS m{i}_{j}" if i == t else f"m{i}_{j} - m{i}_{t} * m{t}_{j} / m{t}_{t} AS m{i}_{j}" for i in range(4) for j in range(6)]
        ctes.append(f"e{t + 1} AS (SELECT {', '.join(step)} FROM e{t})")
    return ",\n".join([*ctes, "solved AS (SELECT " + ", ".join(f"m{i}_4 AS b{i}, m{i}_5 AS z{i}" for i in range(4)) + " FROM e4)"])


@query("a27_excess_mass", sql_with(STATS, f"""
, h AS (SELECT least(CAST(floor((z - 0.5) / 0.05 + 1e-9) AS INT), 69) AS bin, count(*) AS n FROM stats WHERE z BETWEEN 0.5 AND 4.0 GROUP BY 1),
g AS (SELECT bin, coalesce(n, 0)::DOUBLE AS y, 0.5::DOUBLE + 0.05::DOUBLE * (bin + 0.5::DOUBLE) AS c FROM (SELECT CAST(b AS INT) AS bin FROM range(70) t(b)) q LEFT JOIN h USING (bin)),
f AS (SELECT *, (c - 1.48::DOUBLE) / 0.3::DOUBLE AS x, c >= 1.0 AND c < 1.96 AS fitted, c >= 1.96 AND c <= 2.576 AS tested FROM g),
{sql_cubic("f")},
r AS (SELECT row_number() OVER (ORDER BY bin) - 1 AS j, base, y - base AS resid, w, count(*) OVER () AS k FROM (
  SELECT bin, y, b0 + b1 * x + b2 * x * x + b3 * x * x * x AS base, z0 + z1 * x + z2 * x * x + z3 * x * x * x AS w FROM f, solved WHERE fitted) q),
s AS (SELECT (SELECT sum(y) FROM f WHERE tested) AS actual, (SELECT sum(b0 + b1 * x + b2 * x * x + b3 * x * x * x) FROM f, solved WHERE tested) AS counterfactual),
d AS (SELECT iter, j, base, w, CAST(floor({sql_hash("42", "iter", "j")} / 4294967296.0::DOUBLE * k) AS BIGINT) AS pick FROM r, range(2000) t(iter)),
b AS (SELECT iter, sum(d.w * (d.base + r.resid)) AS total FROM d JOIN r ON r.j = d.pick GROUP BY 1),
o AS (SELECT actual, counterfactual, stddev_pop(actual - total) AS se, count(*) AS n_boot, actual - counterfactual AS excess FROM b, s GROUP BY 1, 2),
q AS (SELECT *, excess / se AS t FROM o)
SELECT actual, {s4("counterfactual", 3)} AS counterfactual, {s4("se", 3)} AS se, n_boot, {s4("excess", 3)} AS excess, {s4("t", 3)} AS t, {s4("2 * " + sql_ncdf("(-abs(t))"), 3)} AS p FROM q"""))
def _(spark, d):
    h = rs.histogram(stats(spark, d), [], "z", 0.5, 4.0, 0.05)
    out = rs.excess_mass(h, 0.5, 4.0, 0.05, (1.0, 1.96), (1.96, 2.576), uniforms=rs.hash_uniforms)
    t = F.col("excess") / F.col("se")
    return rounded(out.withColumn("t", t).withColumn("p", st.two_sided_p(t)), "counterfactual", "se", "excess", "t", "p", digits=3)


# ---------------------------------------------------------------- small tests
@query("a38_two_sample_t", sql_with(PAPERS, f"""
, m AS (SELECT count(*) FILTER (WHERE positive) AS n1, count(*) FILTER (WHERE NOT positive) AS n0,
  avg(CASE WHEN positive THEN CAST(published AS INT) END) AS mean1, avg(CASE WHEN NOT positive THEN CAST(published AS INT) END) AS mean0,
  var_samp(CASE WHEN positive THEN CAST(published AS INT) END) AS v1, var_samp(CASE WHEN NOT positive THEN CAST(published AS INT) END) AS v0 FROM papers)
SELECT n1, n0, {s4("mean1")} AS mean1, {s4("mean0")} AS mean0, {s4("v1")} AS v1, {s4("v0")} AS v0,
  {s4("(mean1 - mean0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0))")} AS t, CAST(n1 + n0 - 2 AS DOUBLE) AS df FROM m"""))
def _(spark, d):
    from verdigris.operators.matching import two_sample_t

    p = papers(spark, d).withColumn("pub", F.col("published").cast("int"))
    return rounded(two_sample_t(p, F.col("positive"), "pub"), "mean1", "mean0", "v1", "v0", "t")


@query("a44_bonferroni", sql_with(STATS, f"""
, q AS {DISC.format(by="subset")}, t AS (SELECT subset, 2 * {sql_ncdf("(-abs((n_below - n_above) / n / sqrt((n_below / n * (1 - n_below / n) + n_above / n * (1 - n_above / n)) / n)))")} AS p FROM q)
SELECT subset, {s4("p")} AS p, {s4("least(p * count(*) OVER (), 1.0)")} AS p_adjusted FROM t"""))
def _(spark, d):
    t = ca.discontinuity(valid(spark, d), ["subset"]).select("subset", "p")
    tests = t.agg(F.count("*")).scalar()
    return t.select("subset", r4("p").alias("p"), r4(F.least(F.col("p") * tests, F.lit(1.0))).alias("p_adjusted"))


@query("a45_mann_whitney", sql_with(PAPERS, f"""
, r AS (SELECT year, direction IS NOT NULL AS kept, rank() OVER (ORDER BY year) + (count(*) OVER (PARTITION BY year) - 1) / 2.0 AS mid FROM papers),
t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM papers GROUP BY year) q),
s AS (SELECT CAST(count(*) FILTER (WHERE kept) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT kept) AS DOUBLE) AS n0, sum(CASE WHEN kept THEN mid END) AS ranks FROM r),
u AS (SELECT *, ranks - n1 * (n1 + 1) / 2 AS u FROM s, t)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, {s4("u")} AS u,
  {s4("(greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1))))")} AS z FROM u"""))
def _(spark, d):
    return rounded(ra.mann_whitney(papers(spark, d), "year", F.col("direction").isNotNull()), "u", "z")


# ---------------------------------------------------------------- agreement
@query("a46_confusion_matrix", sql_with(RATERS, """
SELECT r1 AS truth, count(*) FILTER (WHERE r2 = -1) AS "-1", count(*) FILTER (WHERE r2 = 0) AS "0", count(*) FILTER (WHERE r2 = 1) AS "1" FROM raters GROUP BY 1"""))
def _(spark, d):
    return ag.confusion_matrix(ag.confusion(raters(spark, d), "r1", "r2"))


def sql_kappa(a, b, src, by="", labels=(-1, 0, 1)):
    g = f"GROUP BY {by}" if by else ""
    pick = f"{by}, " if by else ""
    k = len(labels)
    c = {(i, j): f"count(*) FILTER (WHERE {a} = {labels[i]} AND {b} = {labels[j]})" for i in range(k) for j in range(k)}
    n = "(" + " + ".join(c.values()) + ")"
    rows = ["(" + " + ".join(c[i, j] for j in range(k)) + ")" for i in range(k)]
    cols = ["(" + " + ".join(c[i, j] for i in range(k)) + ")" for j in range(k)]
    seen = "(" + " + ".join(f"{abs(i - j)} * {c[i, j]}" for i in range(k) for j in range(k)) + ")"
    chance = "((" + " + ".join(f"{abs(i - j)} * {rows[i]} * {cols[j]}" for i in range(k) for j in range(k)) + f") / {n}::DOUBLE)"
    agree = "(" + " + ".join(c[i, i] for i in range(k)) + ")"
    return (
        f"SELECT {pick}{n} AS n, {s4(f'{agree} / {n}')} AS agreement, "
        f"{s4(f'CASE WHEN {chance} > 0 THEN 1 - {seen} / {chance} ELSE 1.0 END')} AS kappa FROM {src} {g}"
    )


@query("a47_weighted_kappa", sql_with(RATERS, sql_kappa("r1", "r2", "raters", "lang")))
def _(spark, d):
    return rounded(ag.linear_kappa(raters(spark, d), "r1", "r2", ["lang"]), "agreement", "kappa")


@query("a47_binary_kappa", sql_with(RATERS, ", b AS (SELECT abs(r1) AS b1, abs(r2) AS b2 FROM raters) " + sql_kappa("b1", "b2", "b", labels=(0, 1))))
def _(spark, d):
    b = raters(spark, d).select(F.abs("r1").alias("b1"), F.abs("r2").alias("b2"))
    return rounded(ag.linear_kappa(b, "b1", "b2", labels=(0, 1)), "agreement", "kappa")


@query("a48_consensus", sql_with(RATERS, """
SELECT r2, r3, CASE WHEN r2 = r3 THEN r2 WHEN r2 = 0 THEN r3 WHEN r3 = 0 THEN r2 ELSE 0 END AS consensus, count(*) AS n FROM raters GROUP BY ALL"""))
def _(spark, d):
    return raters(spark, d).groupBy("r2", "r3", ag.consensus("r2", "r3").alias("consensus")).agg(F.count("*").alias("n"))


@query("a49_class_report", sql_with(RATERS, f"""
, l AS (SELECT unnest([-1, 0, 1]) AS label), c AS (SELECT label, (SELECT count(*) FROM raters WHERE r1 = label AND r2 = label) AS tp,
  (SELECT count(*) FROM raters WHERE r2 = label) AS predicted, (SELECT count(*) FROM raters WHERE r1 = label) AS support FROM l)
SELECT label, {s4("coalesce(tp / nullif(predicted, 0), 0)")} AS precision, {s4("coalesce(tp / nullif(support, 0), 0)")} AS recall,
  {s4("coalesce(2 * tp / nullif(predicted + support, 0), 0)")} AS f1, support FROM c"""))
def _(spark, d):
    return rounded(ag.class_report(ag.confusion(raters(spark, d), "r1", "r2")), "precision", "recall", "f1")


@query("a50_agreement_by_variant", sql_with(RATERS, f"""
SELECT variant, category, count(*) AS n, count(*) FILTER (WHERE pred = category) AS agreed, {s4("100.0 * count(*) FILTER (WHERE pred = category) / count(*)")} AS pct
FROM (SELECT r1 AS category, unnest(['second', 'third']) AS variant, unnest([r2, r3]) AS pred FROM raters) q GROUP BY 1, 2"""))
def _(spark, d):
    long = raters(spark, d).select(
        F.col("r1").alias("category"), F.expr("stack(2, 'second', r2, 'third', r3) AS (variant, pred)")
    )
    hit = F.col("pred") == F.col("category")
    return long.groupBy("variant", "category").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("agreed"), r4(100.0 * F.count_if(hit) / F.count("*")).alias("pct")
    )


@query("a51_audit_summary", sql_with(RATERS, f"""
, v AS (SELECT published, CASE WHEN paper_id % 9 <> 0 THEN r2 = r1 END AS ok FROM raters)
SELECT published, count(*) AS n, count(*) FILTER (WHERE coalesce(ok, false)) AS agreed, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS flipped,
  {s4("avg(CASE WHEN coalesce(ok, false) THEN 1.0 ELSE 0.0 END)")} AS agree_rate FROM v GROUP BY 1"""))
def _(spark, d):
    verdict = F.when(F.col("paper_id") % 9 != 0, F.col("r2") == F.col("r1"))
    return rounded(ag.audit_summary(raters(spark, d), ["published"], verdict), "agree_rate")


AUDIT = f"""
, hit AS (SELECT *, lower(abstract) AS t FROM papers),
pool AS (SELECT * FROM hit WHERE {sql_word_count("abstract")} >= 20 AND NOT ({sql_contains_any("t", [p for p in LOCAL_PHRASES if p not in LOCAL_AMBIGUOUS])}
  OR ({" + ".join(f"CAST(contains(t, '{p}') AS INT)" for p in LOCAL_AMBIGUOUS)}) >= 2)),
s AS (SELECT * FROM pool ORDER BY {sql_hash("42", "paper_id")}, paper_id LIMIT 200)"""


@query("a52_false_negative_rate", sql_with(PAPERS, AUDIT + f""",
one AS (SELECT count(direction) AS n, count(*) FILTER (WHERE direction = 1) AS hits, (SELECT count(*) FROM pool) AS pool FROM s),
b AS (SELECT n, hits, pool, hits / n AS rate, unnest(range(0, n + 1)) AS x FROM one),
c AS (SELECT *, sum(CASE WHEN rate IN (0, 1) THEN CAST(x = hits AS INT) ELSE exp(lgamma(n + 1.0::DOUBLE) - lgamma(x + 1.0::DOUBLE) - lgamma(n - x + 1.0::DOUBLE) + x * ln(nullif(rate, 0)) + (n - x) * ln(nullif(1 - rate, 0))) END) OVER (ORDER BY x) AS c FROM b),
q AS (SELECT n, hits, pool, rate, min(x) FILTER (c >= 0.025) / n AS lo, min(x) FILTER (c >= 0.975) / n AS hi FROM c GROUP BY 1, 2, 3, 4)
SELECT n, hits, pool, {s4("rate")} AS rate, {s4("lo")} AS ci_low, {s4("hi")} AS ci_high, {s4("pool * rate", 1)} AS implied, {s4("pool * lo", 1)} AS implied_low, {s4("pool * hi", 1)} AS implied_high FROM q"""))
def _(spark, d):
    p = papers(spark, d)
    pool = p.filter(~ru.topic_hit("abstract", LOCAL_PHRASES, LOCAL_AMBIGUOUS) & ru.usable_abstract("abstract"))
    sample = sample_rows(pool, 200, 42, "paper_id")
    one = sample.agg(F.count("direction").alias("n"), F.count_if(F.col("direction") == 1).alias("hits")).withColumn(
        "pool", pool.agg(F.count("*")).scalar()
    )
    n, rate = F.col("n").cast("double"), F.col("hits") / F.col("n")
    lo, hi = (st.binomial_ppf(F.lit(q), n, rate) / n for q in (0.025, 0.975))
    implied = {"implied": rate, "implied_low": lo, "implied_high": hi}
    return one.select(
        "n", "hits", "pool", r4(rate).alias("rate"), r4(lo).alias("ci_low"), r4(hi).alias("ci_high"),
        *[r4(F.col("pool") * v, 1).alias(name) for name, v in implied.items()],
    )


@query("a52_audit_counts", sql_with(PAPERS, f"""
, hit AS (SELECT *, lower(abstract) AS t FROM papers),
pool AS (SELECT * FROM hit WHERE {sql_word_count("abstract")} >= 20 AND NOT ({sql_contains_any("t", [p for p in LOCAL_PHRASES if p not in LOCAL_AMBIGUOUS])}
  OR ({" + ".join(f"CAST(contains(t, '{p}') AS INT)" for p in LOCAL_AMBIGUOUS)}) >= 2)),
s AS (SELECT * FROM pool ORDER BY {sql_hash("42", "paper_id")}, paper_id LIMIT 200)
SELECT count(direction) AS n, count(*) FILTER (WHERE direction = 1) AS hits, (SELECT count(*) FROM pool) AS pool FROM s"""))
def _(spark, d):
    p = papers(spark, d)
    pool = p.filter(~ru.topic_hit("abstract", LOCAL_PHRASES, LOCAL_AMBIGUOUS) & ru.usable_abstract("abstract"))
    return sample_rows(pool, 200, 42, "paper_id").agg(
        F.count("direction").alias("n"), F.count_if(F.col("direction") == 1).alias("hits")
    ).withColumn("pool", pool.agg(F.count("*")).scalar())


STYLE, NULLS = ["the", "of", "than in", "und", "que"], ["is", "no", "de la"]


def sql_phrase_count(x, phrases):
    return "(" + " + ".join(f"len(regexp_extract_all(regexp_replace(lower({x}), '[^\\x00-\\x7F\\P{{L}}]', 'x', 'g'), '\\b{p}\\b'))" for p in phrases) + ")"


def hedged():
    """Abstracts with words of the method's lists behind them, by turns."""
    words = lx.HEDGE_STYLE + lx.HEDGE_NULL
    turn = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("paper_id") % len(words) + 1).cast("int"))
    return F.concat_ws(" ", "title", F.upper(turn), F.repeat(F.concat(turn, F.lit(", ")), (F.col("paper_id") % 4).cast("int")))


SQL_HEDGED = f"(SELECT *, concat_ws(' ', title, upper(w), repeat(w || ', ', paper_id % 4)) AS said FROM (SELECT *, ({lx.HEDGE_STYLE + lx.HEDGE_NULL})[paper_id % {len(lx.HEDGE_STYLE + lx.HEDGE_NULL)} + 1] AS w FROM papers) h0) h1"


@query("a53_hedge_lists", sql_with(PAPERS, f"""
, c AS (SELECT published, {sql_word_count("said")} AS n_words, {sql_phrase_count("said", lx.HEDGE_STYLE)} AS s, {sql_phrase_count("said", lx.HEDGE_NULL)} AS u FROM {SQL_HEDGED})
SELECT published, count(*) AS n, sum(s)::BIGINT AS style, sum(u)::BIGINT AS nulls, {s4("avg(100.0 * s / nullif(n_words, 0))")} AS style_100 FROM c GROUP BY 1"""))
def _(spark, d):
    p = papers(spark, d).select("published", hedged().alias("said"))
    p = p.select("published", tx.word_count("said").alias("w"), ru.phrase_count("said", lx.HEDGE_STYLE).alias("s"), ru.phrase_count("said", lx.HEDGE_NULL).alias("u"))
    return p.groupBy("published").agg(
        F.count("*").alias("n"), F.sum("s").cast("long").alias("style"), F.sum("u").cast("long").alias("nulls"), r4(F.avg(100.0 * F.col("s") / F.nullif(F.col("w"), F.lit(0)))).alias("style_100")
    )


@query("a53_hedge_phrases", sql_with(PAPERS, f"""
, c AS (SELECT published, {sql_word_count("abstract")} AS w, {sql_phrase_count("abstract", STYLE)} AS s, {sql_phrase_count("abstract", NULLS)} AS u FROM papers)
SELECT published, count(*) AS n, {s4("avg(w)")} AS avg_words, {s4("avg(s)")} AS style, {s4("avg(100.0 * s / nullif(w, 0))")} AS style_100, {s4("avg(u)")} AS nulls, {s4("avg(100.0 * u / nullif(w, 0))")} AS nulls_100 FROM c GROUP BY 1"""))
def _(spark, d):
    p = papers(spark, d).select(
        "published", tx.word_count("abstract").alias("w"), ru.phrase_count("abstract", STYLE).alias("s"), ru.phrase_count("abstract", NULLS).alias("u")
    )
    w = F.nullif(F.col("w"), F.lit(0))
    return p.groupBy("published").agg(
        F.count("*").alias("n"), r4(F.avg("w")).alias("avg_words"), r4(F.avg("s")).alias("style"), r4(F.avg(100.0 * F.col("s") / w)).alias("style_100"),
        r4(F.avg("u")).alias("nulls"), r4(F.avg(100.0 * F.col("u") / w)).alias("nulls_100"),
    )


@query("a54_reclassification_flips", sql_with(RATERS, "SELECT r1 AS old, r2 AS new, r1 <> r2 AS changed, count(*) AS n FROM raters GROUP BY ALL"))
def _(spark, d):
    from verdigris.streaming.incremental import relabel

    r = raters(spark, d)
    _, audit = relabel(
        r.select("paper_id", F.col("r1").alias("label")), r.select("paper_id", F.col("r2").alias("label")), "paper_id", "label"
    )
    return audit


@query("a55_design_by_status", sql_with(PAPERS, f"SELECT published, {s4('avg(quasi_exp)')} AS quasi_exp FROM papers GROUP BY 1"))
def _(spark, d):
    return papers(spark, d).groupBy("published").agg(r4(F.avg("quasi_exp")).alias("quasi_exp"))


@query("a56_two_factor_cells", sql_with(PAPERS, f"""
SELECT top_institution, quasi_exp, count(*) AS n, {s4("avg(CAST(published AS INT))")} AS rate FROM papers GROUP BY CUBE (top_institution, quasi_exp)"""))
def _(spark, d):
    return papers(spark, d).cube("top_institution", "quasi_exp").agg(
        F.count("*").alias("n"), r4(F.avg(F.col("published").cast("int"))).alias("rate")
    )


@query("a56_two_factor_gaps", sql_with(PAPERS, f"""
SELECT top_institution, {s4("avg(CASE WHEN quasi_exp = 1 THEN CAST(published AS INT) END)")} AS with_design, {s4("avg(CASE WHEN quasi_exp = 0 THEN CAST(published AS INT) END)")} AS without,
  {s4("avg(CASE WHEN quasi_exp = 1 THEN CAST(published AS INT) END) - avg(CASE WHEN quasi_exp = 0 THEN CAST(published AS INT) END)")} AS gap FROM papers GROUP BY 1"""))
def _(spark, d):
    t = papers(spark, d).groupBy("top_institution").pivot("quasi_exp", [1, 0]).agg(F.avg(F.col("published").cast("int")))
    return t.select("top_institution", r4("1").alias("with_design"), r4("0").alias("without"), r4(F.col("1") - F.col("0")).alias("gap"))


@query("a57_indicator_correlation", sql_with(PAPERS, f"SELECT {s4('corr(top_institution, quasi_exp)')} AS r FROM papers"))
def _(spark, d):
    return papers(spark, d).agg(r4(F.corr("top_institution", "quasi_exp")).alias("r"))


@query("a60_extraction_rate", sql_with(STATS + "," + PAPERS, f"""
SELECT published, direction, count(*) AS n, count(c.paper_id) AS with_stats, {s4("count(c.paper_id) / count(*)")} AS rate
FROM papers p LEFT JOIN (SELECT DISTINCT paper_id FROM stats) c USING (paper_id) WHERE direction IS NOT NULL GROUP BY ROLLUP (published, direction)"""))
def _(spark, d):
    c = stats(spark, d).select("paper_id").distinct().withColumn("hit", F.lit(1))
    p = papers(spark, d).filter("direction is not null").join(c, "paper_id", "left")
    return p.rollup("published", "direction").agg(
        F.count("*").alias("n"), F.count("hit").alias("with_stats"), r4(F.count("hit") / F.count("*")).alias("rate")
    )


@query("a61_precision_and_recall", sql_with(RATERS, f"""
SELECT count(*) FILTER (WHERE r1 <> 0) AS selected, count(*) FILTER (WHERE r1 <> 0 AND r2 = r1) AS upheld,
  {s4("count(*) FILTER (WHERE r1 <> 0 AND r2 = r1) / count(*) FILTER (WHERE r1 <> 0)")} AS precision,
  {s4("count(*) FILTER (WHERE r1 <> 0 AND r2 = r1) / count(*) FILTER (WHERE r2 <> 0)")} AS recall,
  {s4("(SELECT count(*) FROM papers WHERE direction IS NULL) * count(*) FILTER (WHERE r1 = 0 AND r2 <> 0) / count(*)::DOUBLE")} AS implied_misses FROM raters"""))
def _(spark, d):
    kept = F.col("r1") != 0
    right = kept & (F.col("r2") == F.col("r1"))
    pool = papers(spark, d).filter("direction is null").agg(F.count("*"))
    one = raters(spark, d).agg(
        F.count_if(kept).alias("selected"), F.count_if(right).alias("upheld"), F.count_if(F.col("r2") != 0).alias("relevant"),
        (F.count_if(~kept & (F.col("r2") != 0)) / F.count("*")).alias("miss"),
    )
    return one.select(
        "selected", "upheld", r4(F.col("upheld") / F.col("selected")).alias("precision"), r4(F.col("upheld") / F.col("relevant")).alias("recall"),
        r4(F.col("miss") * pool.scalar()).alias("implied_misses"),
    )


@query("a62_selection_funnel", sql_with(PAPERS, f"""
, h AS (SELECT *, ({sql_contains_any("lower(abstract)", [p for p in LOCAL_PHRASES if p not in LOCAL_AMBIGUOUS])}
  OR ({" + ".join(f"CAST(contains(lower(abstract), '{p}') AS INT)" for p in LOCAL_AMBIGUOUS)}) >= 2) AS hit FROM papers)
SELECT source, count(*) AS documents, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit AND direction IS NOT NULL) AS final FROM h GROUP BY 1"""))
def _(spark, d):
    hit = ru.topic_hit("abstract", LOCAL_PHRASES, LOCAL_AMBIGUOUS)
    return papers(spark, d).withColumn("hit", hit).groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & F.col("direction").isNotNull()).alias("final")
    )
