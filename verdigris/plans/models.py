"""Probit, linear probability and matching studies (A28 to A43, A58, A59, J26)."""

from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx
from verdigris.functions import rules as ru
from verdigris.functions import stats as st
from verdigris.functions import text as tx
from verdigris.operators import matching as ma
from verdigris.operators import rates as ra
from verdigris.operators import regress as re_
from verdigris.plans.base import (
    PAPERS, papers, r4, rounded, s4, sql_hash, sql_ncdf, sql_t_tails, sql_with, sql_word_count, table,
)
from verdigris.plans.projections import (
    LOCAL_NEGATIVE, LOCAL_NULL, LOCAL_POSITIVE, period,
)
from verdigris.plans.registry import query


# ---------------------------------------------------------------- the same fits in SQL
def sql_probit(source: str, y: str, xs: list[str], spec: str, rounds: int = 9, prefix: str = "f") -> tuple[str, str]:
    """CTEs running Newton's method on `source`, unrolled, and a query for (variable, coef, se).

    Linear systems of order k are solved by writing out Gauss-Jordan elimination over columns."""
    k = len(xs) + 1
    x = ["1.0::DOUBLE", *xs]
    p = prefix
    ctes = [f"{p}p AS (SELECT {', '.join(xs)}, count(*)::DOUBLE AS n, sum({y})::DOUBLE AS k FROM {source} WHERE {' AND '.join(c + ' IS NOT NULL' for c in xs)} GROUP BY ALL)"]
    ctes.append(f"{p}b0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))})")
    for r in range(1, rounds + 1):
        prev = f"{p}b{r - 1}"
        xb = " + ".join(f"b{i} * {x[i]}" for i in range(k))
        ctes.append(
            f"{p}e{r} AS (SELECT *, exp(-xb * xb / 2) / sqrt(2 * pi()) AS phi, {sql_ncdf('xb')} AS cu, {sql_ncdf('(-xb)')} AS cd FROM (SELECT p.*, q.*, {xb} AS xb FROM {p}p p, {prev} q) z)"
        )
        lam1, lam0 = "phi / cu", "(-phi / cd)"
        wt = f"(k * {lam1} * ({lam1} + xb) + (n - k) * {lam0} * ({lam0} + xb))"
        sc = f"(k * {lam1} + (n - k) * {lam0})"
        sums = [f"sum({wt} * {x[i]} * {x[j]}) AS m{i}_{j}" for i in range(k) for j in range(k)]
        sums += [f"sum({sc} * {x[i]}) AS m{i}_{k}" for i in range(k)]
        ident = [f"{1.0 if i == j else 0.0}::DOUBLE AS m{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
        keep = [f"any_value(b{i}) AS b{i}" for i in range(k)]
        ctes.append(f"{p}s{r}_0 AS (SELECT {', '.join(sums + ident + keep)} FROM {p}e{r})")
        width = 2 * k + 1
        for t in range(k):
            cols = []
            for i in range(k):
                for j in range(width):
                    piv = f"m{t}_{j} / m{t}_{t}"
                    cols.append(f"{piv} AS m{i}_{j}" if i == t else f"m{i}_{j} - m{i}_{t} * {piv} AS m{i}_{j}")
            cols += [f"b{i}" for i in range(k)]
            ctes.append(f"{p}s{r}_{t + 1} AS (SELECT {', '.join(cols)} FROM {p}s{r}_{t})")
        ctes.append(
            f"{p}b{r} AS (SELECT {', '.join(f'b{i} + m{i}_{k} AS b{i}' for i in range(k))}, {', '.join(f'm{i}_{k + 1 + j} AS c{i}_{j}' for i in range(k) for j in range(k))} FROM {p}s{r}_{k})"
            if r == rounds
            else f"{p}b{r} AS (SELECT {', '.join(f'b{i} + m{i}_{k} AS b{i}' for i in range(k))} FROM {p}s{r}_{k})"
        )
    final = f"{p}b{rounds}"
    rows = [
        f"SELECT '{spec}' AS spec, '{name}' AS variable, {s4(f'b{i}')} AS coef, {s4(f'sqrt(c{i}_{i})')} AS se, (SELECT sum(n)::BIGINT FROM {p}p) AS n FROM {final}"
        for i, name in enumerate(["Intercept", *xs])
    ]
    return ",\n".join(ctes), " UNION ALL ".join(rows)


def sql_probits(base: str, fits: list[tuple]) -> str:
    """One SELECT over several fits; each is (source SQL, y, xs, spec)."""
    ctes, bodies = [base], []
    for i, (src, y, xs, spec) in enumerate(fits):
        ctes.append(f"src{i} AS ({src})")
        c, b = sql_probit(f"src{i}", y, xs, spec, prefix=f"f{i}_")
        ctes.append(c)
        bodies.append(b)
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + " UNION ALL ".join(bodies)


# ---------------------------------------------------------------- design
DESIGN = PAPERS + """,
mean_year AS (SELECT avg(year) AS m FROM papers),
design AS (SELECT p.*, CAST(published AS INT) AS pub, CAST(coalesce(direction <> 0, true) AS INT) AS directional,
  CAST(positive AS INT) AS pos, CAST(negative AS INT) AS neg, year - m AS year_c, year - 2007.0::DOUBLE AS year_07,
  ln(1 + coalesce(n_authors, 0)) AS log_nauth, CASE WHEN year >= 2010 AND year < 2020 THEN 1 ELSE 0 END AS d2010, CASE WHEN year >= 2020 THEN 1 ELSE 0 END AS d2020
  FROM papers p, mean_year)"""


def design(spark, d):
    """Regressors of the main models. An uncoded paper counts as directional, as in the published
    tables; the clean rule is p3's."""
    p = papers(spark, d)
    decade = F.floor(F.col("year") / 10) * 10
    return p.withColumns(
        {
            "pub": F.col("published").cast("int"),
            "directional": F.coalesce(F.col("direction") != 0, F.lit(True)).cast("int"),
            "pos": F.col("positive").cast("int"),
            "neg": F.col("negative").cast("int"),
            "year_c": F.col("year") - p.agg(F.avg("year")).scalar(),
            "year_07": F.col("year") - 2007.0,
            "log_nauth": F.log1p(F.coalesce("n_authors", F.lit(0))),
            "d2010": (decade == 2010).cast("int"),
            "d2020": (decade == 2020).cast("int"),
        }
    )


def coef_table(spark, fits):
    return re_.tidy(spark, fits).select("spec", "variable", r4("coef").alias("coef"), r4("se").alias("se"), "n")


def run(df, y, xs, spec, min_rows=20):
    return re_.fit_probit(df, y, xs, spec, min_rows)


def run_all(df, y, specs, min_rows=20):
    return re_.fit_probits(df, [re_.Spec(s, y, xs) for s, xs in specs], min_rows)


ALL = "SELECT * FROM design"


@query("a28_probit", sql_probits(DESIGN, [(ALL, "pub", ["directional"], "bivariate")]))
def _(spark, d):
    return coef_table(spark, [run(design(spark, d), "pub", ["directional"], "bivariate")])


TIDY_XS = ["pos", "neg", "year_c"]
TIDY_XB = " + ".join(["b0", *[f"b{i} * {x}" for i, x in enumerate(TIDY_XS, 1)]])


@query("a28_probit_tidy", sql_with(DESIGN + ",", sql_probit("design", "pub", TIDY_XS, "tidy")[0], ", raw AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS variable, b{i} AS b, sqrt(c{i}_{i}) AS se FROM fb9" for i, name in enumerate(["Intercept", *TIDY_XS])
) + f"""), z AS (SELECT *, b / se AS z FROM raw), q AS (SELECT *, 2 * {sql_ncdf("(-abs(z))")} AS p FROM z),
e AS (SELECT n, k, {TIDY_XB} AS xb FROM fp, fb9), l AS (SELECT sum(n) AS n, sum(k) AS k, sum(k * ln({sql_ncdf("xb")}) + (n - k) * ln({sql_ncdf("(-xb)")})) AS ll FROM e)
SELECT 'tidy' AS spec, variable, round(b, 4) AS coef, round(se, 4) AS se, round(z, 4) AS z, round(p, 4) AS p, round(b - {st.Z975!r}::DOUBLE * se, 4) AS ci_low, round(b + {st.Z975!r}::DOUBLE * se, 4) AS ci_high,
  CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars, CAST(n AS BIGINT) AS n, round(1 - ll / (k * ln(k / n) + (n - k) * ln(1 - k / n)), 4) AS pseudo_r2 FROM q, l"""))
def _(spark, d):
    return re_.tidy(spark, [run(design(spark, d), "pub", ["pos", "neg", "year_c"], "tidy")])


@query("a28_probit_lineitem", sql_probits(
    "item AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, l_discount, l_tax FROM lineitem)",
    [("SELECT * FROM item", "returned", ["l_discount", "l_tax"], "returns")]))
def _(spark, d):
    item = table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), "l_discount", "l_tax"
    )
    return coef_table(spark, [run(item, "returned", ["l_discount", "l_tax"], "returns")])


NESTED = [
    ("(1)", ["directional"]), ("(2)", ["directional", "year_c"]), ("(3)", ["directional", "year_c", "log_nauth"]),
    ("(4)", ["directional", "year_c", "log_nauth", "quasi_exp"]),
]


@query("a29_primary_probit", sql_probits(DESIGN, [(ALL, "pub", xs, s) for s, xs in NESTED]))
def _(spark, d):
    df = design(spark, d)
    return coef_table(spark, run_all(df, "pub", NESTED))


THREEWAY = [
    ("1", ["pos", "neg"]), ("2", ["pos", "neg", "year_c"]), ("3", ["pos", "neg", "d2010", "d2020"]),
    ("4", ["pos", "neg", "year_c", "log_nauth"]), ("5", ["pos", "neg", "year_c", "log_nauth", "quasi_exp"]),
]


@query("a30_three_way_probit", sql_probits(DESIGN, [(ALL, "pub", xs, s) for s, xs in THREEWAY]))
def _(spark, d):
    df = design(spark, d)
    return coef_table(spark, run_all(df, "pub", THREEWAY))


JOURNALS = ["JF", "RFS", "JFE"]
BY_JOURNAL = ["pos", "neg", "year_c"]


@query("a31_probit_by_journal", sql_probits(DESIGN, [
    (f"SELECT *, CAST(coalesce(journal = '{j}', false) AS INT) AS pub_j FROM design WHERE journal = '{j}' OR NOT published", "pub_j", BY_JOURNAL, j)
    for j in JOURNALS]))
def _(spark, d):
    return coef_table(spark, journal_fits(spark, d))


def journal_fits(spark, d):
    df = design(spark, d)
    own = {f"pub_{j}": F.coalesce(F.col("journal") == j, F.lit(False)).cast("int") for j in JOURNALS}
    return re_.fit_probits(df.withColumns(own), [re_.Spec(j, f"pub_{j}", BY_JOURNAL, f"pub_{j} = 1 or not published") for j in JOURNALS], 20)


JOURNAL_FITS = [(f"SELECT *, CAST(coalesce(journal = '{j}', false) AS INT) AS pub_j FROM design WHERE journal = '{j}' OR NOT published", "pub_j") for j in JOURNALS]
JOURNAL_CTES = ",\n".join(f"src{j} AS ({src}),\n" + sql_probit(f"src{j}", y, BY_JOURNAL, j, prefix=j)[0] for j, (src, y) in zip(JOURNALS, JOURNAL_FITS))
POS = 1 + BY_JOURNAL.index("pos")


@query("a32_coefficient_differences", sql_with(DESIGN + ",", JOURNAL_CTES, ", d AS (" + " UNION ALL ".join(
    f"SELECT '{a} vs {b}' AS spec, x.b{POS} - y.b{POS} AS diff, sqrt(x.c{POS}_{POS} + y.c{POS}_{POS}) AS se FROM {a}b9 x, {b}b9 y" for a, b in (("JF", "RFS"), ("JF", "JFE"), ("RFS", "JFE"))
) + f"), z AS (SELECT *, diff / se AS z FROM d) SELECT spec, {s4('diff')} AS diff, {s4('se')} AS se, {s4('z')} AS z, {s4('2 * ' + sql_ncdf('(-abs(z))'))} AS p FROM z"))
def _(spark, d):
    jf, rfs, jfe = journal_fits(spark, d)
    out = None
    for a, b in ((jf, rfs), (jf, jfe), (rfs, jfe)):
        if a is None or b is None:
            continue
        one = re_.difference(spark, a, b, "pos")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "diff", "se", "z", "p")


@query("a33_wald_symmetry", sql_with(DESIGN + ",", sql_probit("design", "pub", ["pos", "neg"], "symmetry")[0], f"""
, d AS (SELECT b1 - b2 AS diff, sqrt(c1_1 + c2_2 - 2 * c1_2) AS se FROM fb9), z AS (SELECT *, diff / se AS z FROM d)
SELECT 'symmetry' AS spec, {s4("diff")} AS diff, {s4("se")} AS se, {s4("z * z")} AS chi2, {s4("2 * " + sql_ncdf("(-abs(z))"))} AS p, {s4(f"{st.Z975 + st.Z80!r}::DOUBLE * se")} AS mdd_80 FROM z"""))
def _(spark, d):
    fit = run(design(spark, d), "pub", ["pos", "neg"], "symmetry")
    return rounded(re_.wald_equal(spark, fit, "pos", "neg"), "diff", "se", "chi2", "p", "mdd_80")


PERIODS = {"2000-2007": (2000, 2007), "2008-2015": (2008, 2015), "2016-2024": (2016, 2024)}


@query("a34_probit_by_period", sql_probits(DESIGN, [
    (f"SELECT * FROM design WHERE year BETWEEN {lo} AND {hi}", "pub", ["pos", "neg"], s) for s, (lo, hi) in PERIODS.items()]))
def _(spark, d):
    df = design(spark, d)
    return coef_table(spark, re_.fit_probits(df, [re_.Spec(s, "pub", ["pos", "neg"], f"year between {lo} and {hi}") for s, (lo, hi) in PERIODS.items()], 20))


LPM = [("bivariate", ["pos", "neg"]), ("year", ["pos", "neg", "year_c"])]


def sql_lpm(spec, xs, prefix):
    """Least squares and HC3 errors on the covariate patterns, by the same elimination."""
    k, p = len(xs) + 1, prefix
    x = ["1.0::DOUBLE", *xs]
    ctes = [f"{p}p AS (SELECT {', '.join(xs)}, count(*)::DOUBLE AS n, sum(pub)::DOUBLE AS k FROM design GROUP BY ALL)"]
    sums = [f"sum(n * {x[i]} * {x[j]}) AS m{i}_{j}" for i in range(k) for j in range(k)]
    sums += [f"sum(k * {x[i]}) AS m{i}_{k}" for i in range(k)]
    sums += [f"{1.0 if i == j else 0.0}::DOUBLE AS m{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
    ctes.append(f"{p}s0 AS (SELECT {', '.join(sums)} FROM {p}p)")
    for t in range(k):
        cols = []
        for i in range(k):
            for j in range(2 * k + 1):
                piv = f"m{t}_{j} / m{t}_{t}"
                cols.append(f"{piv} AS m{i}_{j}" if i == t else f"m{i}_{j} - m{i}_{t} * {piv} AS m{i}_{j}")
        ctes.append(f"{p}s{t + 1} AS (SELECT {', '.join(cols)} FROM {p}s{t})")
    inv = lambda i, j: f"m{i}_{k + 1 + j}"
    h = " + ".join(f"{inv(i, j)} * {x[i]} * {x[j]}" for i in range(k) for j in range(k))
    fit = " + ".join(f"m{i}_{k} * {x[i]}" for i in range(k))
    rows = []
    for i, name in enumerate(["Intercept", *xs]):
        a = "(" + " + ".join(f"{inv(i, j)} * {x[j]}" for j in range(k)) + ")"
        ctes.append(
            f"{p}v{i} AS (SELECT any_value(m{i}_{k}) AS b, sqrt(sum(pow({a}, 2) * (k * pow(1 - ({fit}), 2) + (n - k) * pow({fit}, 2)) / pow(1 - ({h}), 2))) AS se, sum(n)::BIGINT AS n FROM {p}p, {p}s{k})"
        )
        rows.append(f"SELECT '{spec}' AS spec, '{name}' AS variable, {s4('b')} AS coef, {s4('se')} AS se, n FROM {p}v{i}")
    return ",\n".join(ctes), " UNION ALL ".join(rows)


_L = [sql_lpm(s, xs, f"l{i}_") for i, (s, xs) in enumerate(LPM)]


@query("a35_linear_probability", "WITH " + DESIGN.strip() + ", " + ", ".join(c for c, _ in _L) + " " + " UNION ALL ".join(b for _, b in _L))
def _(spark, d):
    df = design(spark, d)
    return coef_table(spark, [re_.fit_linear(df, "pub", xs, s) for s, xs in LPM])


SUBSETS = [
    ("quasi_only", "quasi_exp = 1", "pub", ["pos", "neg", "year_07"]),
    ("no_monetary", " AND ".join(f"NOT contains(lower(abstract), '{p}')" for p in lx.MONETARY_PHRASES), "pub", ["pos", "neg", "year_07"]),
    ("jf_only", "true", "pub_jf", ["pos", "neg", "year_07"]),
    ("peers_only", "true", "pub_peers", ["pos", "neg", "year_07"]),
    ("high_confidence", "confidence = 'high'", "pub", ["pos", "neg", "year_07"]),
    ("uncensored", "year <= 2020", "pub", ["pos", "neg", "year_07"]),
]
SUB_SQL = "SELECT *, CAST(coalesce(journal = 'JF', false) AS INT) AS pub_jf, CAST(coalesce(journal IN ('RFS', 'JFE'), false) AS INT) AS pub_peers FROM design WHERE {}"


@query("a36_robustness_subsets", sql_probits(DESIGN, [(SUB_SQL.format(w), y, xs, s) for s, w, y, xs in SUBSETS]))
def _(spark, d):
    df = design(spark, d).withColumns(
        {
            "pub_jf": F.coalesce(F.col("journal") == "JF", F.lit(False)).cast("int"),
            "pub_peers": F.coalesce(F.col("journal").isin("RFS", "JFE"), F.lit(False)).cast("int"),
        }
    )
    return coef_table(spark, re_.fit_probits(df, [re_.Spec(s, y, xs, w) for s, w, y, xs in SUBSETS], 20))


@query("a36_length_control", sql_probits(
    DESIGN + ", words AS (SELECT *, ln(1 + " + sql_word_count("abstract") + ") AS log_words FROM design)",
    [("SELECT * FROM words", "pub", ["pos", "neg", "year_07", "log_words"], "length")]))
def _(spark, d):
    df = design(spark, d).withColumn("log_words", F.log1p(tx.word_count("abstract")))
    return coef_table(spark, [run(df, "pub", ["pos", "neg", "year_07", "log_words"], "length")])


@query("a37_matched_rates", sql_with(PAPERS, f"""
SELECT direction, count(*) AS n, {s4("avg(CAST(published AS INT))")} AS rate FROM papers
WHERE match_quality = 'auto' AND direction IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    p = papers(spark, d).filter("match_quality = 'auto' and direction is not null")
    return p.groupBy("direction").agg(F.count("*").alias("n"), r4(F.avg(F.col("published").cast("int"))).alias("rate"))


CONF = DESIGN + """,
conf AS (SELECT *, CAST(direction <> 0 AS INT) AS coded_far, year - (SELECT median(year) FROM papers) AS year_med,
  ln(1 + greatest(len(string_split(coalesce(title, ''), ',')), 1)) AS log_nauth_c FROM design WHERE direction IS NOT NULL)"""
CONF_FITS = [("binary", ["coded_far", "year_med", "log_nauth_c"]), ("three_way", ["pos", "neg", "year_med", "log_nauth_c"])]


@query("a39_conference_baseline", sql_probits(CONF, [("SELECT * FROM conf", "pub", xs, s) for s, xs in CONF_FITS]))
def _(spark, d):
    p = design(spark, d)
    med = papers(spark, d).agg(F.median("year")).scalar()
    conf = p.filter("direction is not null").withColumns(
        {
            "coded_far": (F.col("direction") != 0).cast("int"),
            "year_med": F.col("year") - med,
            "log_nauth_c": F.log1p(tx.author_count_comma("title")),
        }
    )
    return coef_table(spark, run_all(conf, "pub", CONF_FITS))


def _sql_direction(x):
    from verdigris.plans.base import sql_contains_any

    low = f"lower(coalesce({x}, ''))"
    pos, neg = sql_contains_any(low, LOCAL_POSITIVE), sql_contains_any(low, LOCAL_NEGATIVE)
    return (
        f"CASE WHEN {sql_contains_any(low, LOCAL_NULL)} THEN 0 WHEN {pos} AND NOT {neg} THEN 1 "
        f"WHEN {neg} AND NOT {pos} THEN -1 ELSE 0 END"
    )


def _sql_first_words(x, n):
    from verdigris.plans.base import sql_words

    return f"array_to_string({sql_words(x)}[1:{n}], ' ')"


RECODED = DESIGN + f", recoded AS (SELECT *, CAST(({_sql_direction(_sql_first_words('abstract', 100))}) <> 0 AS INT) AS far FROM design)"


@query("a40_truncated_recoding", sql_probits(RECODED, [
    ("SELECT * FROM recoded", "pub", ["far"], "truncated"), ("SELECT * FROM recoded", "pub", ["far", "year_c"], "truncated_year")]))
def _(spark, d):
    """Directions read from the first hundred words against those from the whole text."""
    lists = dict(null=LOCAL_NULL, positive=LOCAL_POSITIVE, negative=LOCAL_NEGATIVE)
    p = design(spark, d).withColumns(
        {
            "full_code": ru.direction_from_abstract("abstract", **lists),
            "short_code": ru.direction_from_abstract(tx.first_words("abstract", 100), **lists),
        }
    )
    df = p.withColumn("far", (F.col("short_code") != 0).cast("int"))
    return coef_table(spark, run_all(df, "pub", [("truncated", ["far"]), ("truncated_year", ["far", "year_c"])]))


@query("a40_truncated_agreement", sql_with(PAPERS, f"""
SELECT full_code, short_code, count(*) AS n FROM (SELECT {_sql_direction("abstract")} AS full_code, {_sql_direction(_sql_first_words("abstract", 100))} AS short_code FROM papers) q GROUP BY 1, 2"""))
def _(spark, d):
    lists = dict(null=LOCAL_NULL, positive=LOCAL_POSITIVE, negative=LOCAL_NEGATIVE)
    return papers(spark, d).groupBy(
        ru.direction_from_abstract("abstract", **lists).alias("full_code"),
        ru.direction_from_abstract(tx.first_words("abstract", 100), **lists).alias("short_code"),
    ).agg(F.count("*").alias("n"))


STACKED = DESIGN + """,
stacked AS (SELECT pos, neg, year_c, 1 AS pub_s FROM design WHERE published UNION ALL SELECT pos, neg, year_c, 0 FROM design WHERE NOT published AND direction IS NOT NULL)"""


@query("a41_stacked_probit", sql_probits(STACKED, [("SELECT * FROM stacked", "pub_s", ["pos", "neg", "year_c"], "stacked")]))
def _(spark, d):
    p = design(spark, d)
    cols = ["pos", "neg", "year_c"]
    up = p.filter("published").select(*cols, F.lit(1).alias("pub_s"))
    down = p.filter("not published and direction is not null").select(*cols, F.lit(0).alias("pub_s"))
    return coef_table(spark, [run(up.unionByName(down), "pub_s", cols, "stacked")])


PAIRED = DESIGN + """,
pairs AS (SELECT direction AS dp, CAST(n_chars % 3 - 1 AS INT) AS dd, year_c FROM design WHERE direction IS NOT NULL),
long AS (SELECT 1 AS pub_s, CAST(dp <> 0 AS INT) AS far, year_c FROM pairs UNION ALL SELECT 0, CAST(dd <> 0 AS INT), year_c FROM pairs)"""


@query("a42_matched_pair_probit", sql_probits(PAIRED, [("SELECT * FROM long", "pub_s", ["far"], "pairs"), ("SELECT * FROM long", "pub_s", ["far", "year_c"], "pairs_year")]))
def _(spark, d):
    long = pair_rows(design(spark, d))
    return coef_table(spark, run_all(long, "pub_s", [("pairs", ["far"]), ("pairs_year", ["far", "year_c"])]))


def pair_rows(p):
    """Draft and published version of each pair as two rows."""
    pairs = p.filter("direction is not null").select(
        "year_c", F.col("direction").alias("dp"), (F.col("n_chars") % 3 - 1).cast("int").alias("dd")
    )
    versions = F.array(
        F.struct(F.lit(1).alias("pub_s"), (F.col("dp") != 0).cast("int").alias("far")),
        F.struct(F.lit(0).alias("pub_s"), (F.col("dd") != 0).cast("int").alias("far")),
    )
    return pairs.select("year_c", F.explode(versions).alias("v")).select("v.*", "year_c")


@query("a43_marginal_effects", sql_with(DESIGN + ",", sql_probit("design", "pub", ["directional", "year_c"], "margins")[0], f"""
, e AS (SELECT b0 + b1 + b2 * year_c AS hi, b0 + b2 * year_c AS lo, b0 + b1 AS bhi, b0 AS blo FROM design, fb9)
SELECT {s4(f"avg({sql_ncdf('hi')} - {sql_ncdf('lo')})")} AS average_effect, {s4(f"avg({sql_ncdf('bhi')} - {sql_ncdf('blo')})")} AS baseline_effect FROM e"""))
def _(spark, d):
    df = design(spark, d)
    fit = run(df, "pub", ["directional", "year_c"], "margins")
    return rounded(re_.average_marginal_effect(df, fit, "directional"), "average_effect", "baseline_effect")


INTER = DESIGN + ", inter AS (SELECT *, pos * quasi_exp AS pos_q, neg * quasi_exp AS neg_q FROM design)"
INTER_XS = ["pos", "neg", "quasi_exp", "pos_q", "neg_q"]


@query("a58_interactions", sql_probits(INTER, [("SELECT * FROM inter", "pub", INTER_XS, "interactions")]))
def _(spark, d):
    df = design(spark, d).withColumns(
        {"pos_q": F.col("pos") * F.col("quasi_exp"), "neg_q": F.col("neg") * F.col("quasi_exp")}
    )
    return coef_table(spark, [run(df, "pub", INTER_XS, "interactions")])


@query("a59_without_linked", sql_probits(DESIGN, [
    ("SELECT * FROM design WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE published AND match_quality = 'auto')", "pub", ["directional"], "unlinked")]))
def _(spark, d):
    linked = papers(spark, d).filter("published and match_quality = 'auto'").select("paper_id")
    return coef_table(spark, [run(design(spark, d).join(linked, "paper_id", "left_anti"), "pub", ["directional"], "unlinked")])


# ---------------------------------------------------------------- J26
def sql_logistic(src: str, rounds: int = 12) -> str:
    """CTEs fit(b0, b1) of a ridge logistic regression of `t` on `x` over src(x, n, t): Newton steps, unrolled."""
    ctes = ["n0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"]
    for r in range(1, rounds + 1):
        ctes.append(f"""
n{r} AS (SELECT b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM (
  SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(t - n * p) AS g0, sum((t - n * p) * x) - any_value(b1) AS g1,
    sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) + 1 AS h11
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM {src}, n{r - 1}) e) z)""")
    return ",\n".join([*ctes, f"fit AS (SELECT * FROM n{rounds})"])


@query("j26_propensity_matching", "WITH RECURSIVE " + PAPERS.strip() + f""",
u AS (SELECT paper_id, positive, CAST(published AS INT) AS pub, (year - avg(year) OVER ()) / stddev_samp(year) OVER () AS x FROM papers),
pt AS (SELECT x, count(*)::DOUBLE AS n, count(*) FILTER (positive)::DOUBLE AS t FROM u GROUP BY 1),
{sql_logistic("pt")},
st AS (SELECT row_number() OVER (ORDER BY 1 / (1 + exp(-(b0 + b1 * x)))) AS i, x, 1 / (1 + exp(-(b0 + b1 * x))) AS score, CAST(t AS BIGINT) AS treated, CAST(n - t AS BIGINT) AS controls FROM pt, fit),
steps AS (SELECT row_number() OVER (ORDER BY a.i, abs(a.score - b.score), b.i) AS k, a.i = lag(a.i) OVER (ORDER BY a.i, abs(a.score - b.score), b.i) AS same, a.treated, b.i AS j FROM st a, st b),
walk AS (
  SELECT 0::BIGINT AS k, (SELECT list(controls ORDER BY i) FROM st) AS free, 0::BIGINT AS need
  UNION ALL
  SELECT w.k + 1, list_transform(free, lambda c, pos: CASE WHEN pos = s.j THEN c - least(c, CASE WHEN s.same THEN need ELSE s.treated END) ELSE c END),
    CASE WHEN s.same THEN need ELSE s.treated END - least(free[s.j], CASE WHEN s.same THEN need ELSE s.treated END)
  FROM walk w JOIN steps s ON s.k = w.k + 1
), done AS (SELECT free FROM walk ORDER BY k DESC LIMIT 1),
kept AS (
  SELECT pub, positive FROM u WHERE positive UNION ALL
  SELECT pub, positive FROM (SELECT u.*, st.i, controls, row_number() OVER (PARTITION BY u.x ORDER BY {sql_hash(42, "paper_id")}, paper_id) AS r FROM u JOIN st ON st.x = u.x WHERE NOT positive) c, done WHERE r <= controls - free[i]
), m AS (
  SELECT count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0, avg(pub) FILTER (positive) AS mean1, avg(pub) FILTER (NOT positive) AS mean0,
    var_samp(pub) FILTER (positive) AS v1, var_samp(pub) FILTER (NOT positive) AS v0 FROM kept
), tt AS (SELECT *, 1 AS key, n1 + n0 - 2 AS df, (mean1 - mean0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) AS t FROM m), {sql_t_tails("tt")}
SELECT n1, n0, {s4("mean1")} AS mean1, {s4("mean0")} AS mean0, {s4("mean1 - mean0")} AS difference, {s4("t")} AS t, {s4("p")} AS p FROM tt JOIN tails USING (key)""")
def _(spark, d):
    p = papers(spark, d)
    mean, sd = p.agg(F.avg("year")).scalar(), p.agg(F.stddev_samp("year")).scalar()
    df = p.select(
        "paper_id", "positive", F.col("published").cast("int").alias("pub"), ((F.col("year") - mean) / sd).alias("year_norm")
    )
    matched = ma.propensity_matched(df, "positive", "year_norm", "paper_id")
    t = ma.two_sample_t(matched, F.col("positive"), "pub")
    out = t.select("n1", "n0", "mean1", "mean0", (F.col("mean1") - F.col("mean0")).alias("difference"), "t", st.t_p("t", "df").alias("p"))
    return rounded(out, "mean1", "mean0", "difference", "t", "p")
