"""Projections (P), filters (F) and column rules."""

from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx
from verdigris.functions import rules as ru
from verdigris.functions import text as tx
from verdigris.operators.windows import best
from verdigris.plans.base import (
    PAPERS, STATS, articles, ARTICLES, papers, r4, s4, sql_contains_any, sql_in, sql_with,
    sql_word_count, sql_words, stats, table,
)
from verdigris.plans.registry import query
from verdigris.sources.tables import select_existing

# Phrases for tables whose invented prose never uses the English lists above: its own frequent
# words, so that the rules have something to find.
LOCAL_PHRASES = ["thatin", "ononst", "inoran", "orantion", "hehely", "rewh", "orre", "the "]
LOCAL_AMBIGUOUS = ["orre", "rewh", "the "]
LOCAL_POSITIVE = ["ering", "ention", "ation", "reau"]
LOCAL_NEGATIVE = ["ingly", "eable", "ness", "ungen"]
LOCAL_NULL = ["thth", "quequ", "erer"]


@query("p1_select_existing", sql_with(PAPERS, """
SELECT paper_id, source, year, CAST(NULL AS INT) AS volume, CAST(NULL AS VARCHAR) AS doi FROM papers"""))
def _(spark, d):
    return select_existing(
        papers(spark, d), {"paper_id": "bigint", "source": "string", "year": "int", "volume": "int", "doi": "string"}
    )


@query("p2_to_numeric", """
SELECT TRY_CAST(string_split(c_name, '#')[2] AS INT) AS num, TRY_CAST(c_name AS DOUBLE) AS bad, count(*) AS n
FROM customer GROUP BY ALL""")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(
        F.get(F.split("c_name", "#"), F.lit(1)).try_cast("int").alias("num"), F.col("c_name").try_cast("double").alias("bad")
    ).agg(F.count("*").alias("n"))


@query("p3_direction_flags", sql_with(PAPERS, """
SELECT direction, positive, negative, coalesce(direction <> 0, false) AS directional,
  coalesce(direction <> 0, true) AS directional_compat, count(*) AS n FROM papers GROUP BY ALL"""))
def _(spark, d):
    # clean rule: an uncoded paper is not directional; compat rule: it counts as directional
    far = F.col("direction") != 0
    return papers(spark, d).groupBy(
        "direction", "positive", "negative",
        F.coalesce(far, F.lit(False)).alias("directional"),
        F.coalesce(far, F.lit(True)).alias("directional_compat"),
    ).agg(F.count("*").alias("n"))


@query("p4_author_count_semicolon", sql_with(ARTICLES, """
SELECT CASE WHEN trim(authors) <> '' THEN len(string_split(authors, ';')) END AS n_authors, count(*) AS n
FROM articles GROUP BY ALL"""))
def _(spark, d):
    return articles(spark, d).groupBy(tx.author_count_semicolon("authors").alias("n_authors")).agg(F.count("*").alias("n"))


@query("p5_author_count_comma", sql_with(ARTICLES, """
SELECT greatest(len(string_split(authors, ',')), 1) AS n_authors, count(*) AS n FROM articles GROUP BY ALL"""))
def _(spark, d):
    return articles(spark, d).groupBy(tx.author_count_comma("authors").alias("n_authors")).agg(F.count("*").alias("n"))


@query("p6_word_count", f"SELECT doc_id, {sql_word_count('text')} AS n_words FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count("text").alias("n_words"))


@query("p7_centred_year", sql_with(PAPERS, f"""
SELECT paper_id, {s4("year - (SELECT avg(year) FROM papers)")} AS c_mean,
  {s4("year - (SELECT median(year) FROM papers)")} AS c_median, year - 2007.0::DOUBLE AS c_fixed FROM papers"""))
def _(spark, d):
    p = papers(spark, d).select("paper_id", "year")
    return p.select(
        "paper_id",
        r4(F.col("year") - p.agg(F.avg("year")).scalar()).alias("c_mean"),
        r4(F.col("year") - p.agg(F.median("year")).scalar()).alias("c_median"),
        (F.col("year") - 2007.0).alias("c_fixed"),
    )


@query("p8_log_imputed", sql_with(PAPERS, f"""
SELECT paper_id, {s4("ln(1 + coalesce(n_authors, 0))")} AS log_authors,
  {s4("ln(1 + coalesce(CASE WHEN paper_id % 13 <> 0 THEN n_chars END, (SELECT median(n_chars) FROM papers WHERE paper_id % 13 <> 0)))")} AS log_len
FROM papers"""))
def _(spark, d):
    p = papers(spark, d).withColumn("len", F.when(F.col("paper_id") % 13 != 0, F.col("n_chars")))
    return p.select(
        "paper_id",
        r4(F.log1p(F.coalesce("n_authors", F.lit(0)))).alias("log_authors"),
        r4(F.log1p(F.coalesce("len", p.agg(F.median("len")).scalar()))).alias("log_len"),
    )


@query("p9_standardised", sql_with(PAPERS, f"""
SELECT paper_id, {s4("(year - (SELECT avg(year) FROM papers)) / (SELECT stddev_samp(year) FROM papers)")} AS year_norm FROM papers"""))
def _(spark, d):
    p = papers(spark, d)
    m, s = p.agg(F.avg("year")).scalar(), p.agg(F.stddev_samp("year")).scalar()
    return p.select("paper_id", r4((F.col("year") - m) / s).alias("year_norm"))


@query("p10_decades", """
SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS decade,
  CASE WHEN floor(year(o_orderdate) / 10) * 10 = 2000 THEN 1 ELSE 0 END AS d2000, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, d):
    decade = (F.floor(F.year("o_orderdate") / 10) * 10).cast("int")
    return table(spark, d, "orders").groupBy(
        decade.alias("decade"), F.when(decade == 2000, 1).otherwise(0).alias("d2000")
    ).agg(F.count("*").alias("n"))


@query("p11_periods", sql_with(PAPERS, """
SELECT CASE WHEN year BETWEEN 2000 AND 2007 THEN '2000-2007' WHEN year BETWEEN 2008 AND 2015 THEN '2008-2015'
  WHEN year BETWEEN 2016 AND 2024 THEN '2016-2024' END AS period, count(*) AS n FROM papers GROUP BY ALL"""))
def _(spark, d):
    return papers(spark, d).groupBy(period("year").alias("period")).agg(F.count("*").alias("n"))


def period(c):
    y = tx.as_col(c)
    return (
        F.when(y.between(2000, 2007), "2000-2007").when(y.between(2008, 2015), "2008-2015").when(y.between(2016, 2024), "2016-2024")
    )


@query("p12_p_stars", """
SELECT stars, count(*) AS n FROM (SELECT CASE WHEN l_discount < 0.01 THEN '***' WHEN l_discount < 0.05 THEN '**'
  WHEN l_discount < 0.10 THEN '*' ELSE '' END AS stars FROM lineitem) q GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(ru.p_stars("l_discount").alias("stars")).agg(F.count("*").alias("n"))


EXPECTED = "CASE WHEN z IS NULL THEN NULL WHEN z >= 2.576 THEN '***' WHEN z >= 1.96 THEN '**' WHEN z >= 1.645 THEN '*' ELSE '' END"


@query("p13_expected_star", sql_with(STATS, f"SELECT {EXPECTED} AS star, count(*) AS n FROM stats GROUP BY 1"))
def _(spark, d):
    return stats(spark, d).groupBy(ru.expected_star("z").alias("star")).agg(F.count("*").alias("n"))


def _sql_kind(x):
    low = f"lower({x})"
    whens = " ".join(f"WHEN {sql_contains_any(low, ws)} THEN '{name}'" for name, ws in lx.TABLE_KIND_WORDS)
    return f"CASE WHEN coalesce(trim({low}), '') = '' THEN 'Unknown/blank' {whens} ELSE 'Other' END"


TABLE_KIND_SQL = _sql_kind("tbl")


@query("p14_table_kind", sql_with(STATS, f"SELECT {TABLE_KIND_SQL} AS kind, count(*) AS n FROM stats GROUP BY 1"))
def _(spark, d):
    return stats(spark, d).groupBy(ru.table_kind("tbl").alias("kind")).agg(F.count("*").alias("n"))


@query("p15_row_type", sql_with(STATS, "SELECT corpus, se IS NULL AS z_only, count(*) AS n FROM stats GROUP BY ALL"))
def _(spark, d):
    return stats(spark, d).groupBy("corpus", F.col("se").isNull().alias("z_only")).agg(F.count("*").alias("n"))


@query("p16_internal_consistency", sql_with(STATS, f"""
SELECT corpus, count(*) AS total_rows, count(*) FILTER (WHERE has_both) AS with_both,
  count(*) FILTER (WHERE has_both AND abs(abs(coef / nullif(se, 0)) - z) < 0.1) AS consistent,
  {s4("100.0 * count(*) FILTER (WHERE has_both AND abs(abs(coef / nullif(se, 0)) - z) < 0.1) / count(*) FILTER (WHERE has_both)")} AS consistency_pct,
  count(z) - count(*) FILTER (WHERE has_both) AS z_only
FROM (SELECT *, coalesce(coef IS NOT NULL AND se > 0 AND z > 0, false) AS has_both FROM stats) q GROUP BY 1"""))
def _(spark, d):
    return internal_consistency(stats(spark, d), ["corpus"])


def internal_consistency(df, by):
    """Rows whose quoted statistic differs by less than 0.1 from coefficient over error."""
    both = F.coalesce(F.col("coef").isNotNull() & (F.col("se") > 0) & (F.col("z") > 0), F.lit(False))
    close = both & (F.abs(F.abs(F.try_divide("coef", "se")) - F.col("z")) < 0.1)
    return df.groupBy(*by).agg(
        F.count("*").alias("total_rows"),
        F.count_if(both).alias("with_both"),
        F.count_if(close).alias("consistent"),
        r4(100.0 * F.count_if(close) / F.count_if(both)).alias("consistency_pct"),
        (F.count("z") - F.count_if(both)).alias("z_only"),
    )


@query("p17_combined_text", sql_with(ARTICLES, """
SELECT paper_id, length(coalesce(title, '') || ' ' || coalesce(authors, '')) AS n, md5(coalesce(title, '') || ' ' || coalesce(authors, '')) AS h FROM articles"""))
def _(spark, d):
    both = F.concat_ws(" ", tx.text_or_empty("title"), tx.text_or_empty("authors"))
    return articles(spark, d).select("paper_id", F.length(both).alias("n"), F.md5(both).alias("h"))


@query("p18_first_words", f"SELECT doc_id, md5(array_to_string({sql_words('text')}[1:100], ' ')) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.first_words("text", 100)).alias("h"))


# ---------------------------------------------------------------- filters
@query("f1_has_title", sql_with(PAPERS, "SELECT source, count(*) AS n FROM papers WHERE title IS NOT NULL AND title <> '' GROUP BY 1"))
def _(spark, d):
    return papers(spark, d).filter("title is not null and title <> ''").groupBy("source").agg(F.count("*").alias("n"))


@query("f2_year_and_source", sql_with(PAPERS, """
SELECT source, year, count(*) AS n FROM papers WHERE year BETWEEN 2005 AND 2020 AND source IN ('src0', 'src1', 'src7') GROUP BY ALL"""))
def _(spark, d):
    return (
        papers(spark, d).filter(F.col("source").isin("src0", "src1", "src7") & F.col("year").between(2005, 2020))
        .groupBy("source", "year").agg(F.count("*").alias("n"))
    )


@query("f3_valid_statistics", sql_with(STATS, f"SELECT subset, count(*) AS n, {s4('max(z)')} AS max_z FROM valid GROUP BY 1"))
def _(spark, d):
    from verdigris.operators.caliper import valid_z

    return valid_z(stats(spark, d)).groupBy("subset").agg(F.count("*").alias("n"), r4(F.max("z")).alias("max_z"))


@query("f4_noise_rows", sql_with(PAPERS, r"""
SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(coalesce(title, ''), '(?i)^(?:The and|In)|\d{4}.*\bthe\b|\s*thing\s*$')) AS noise
FROM papers GROUP BY 1"""))
def _(spark, d):
    pattern = r"(?i)^(?:The and|In)|\d{4}.*\bthe\b|\s*thing\s*$"
    noise = F.coalesce(F.col("title").rlike(pattern), F.lit(False))
    return papers(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(noise).alias("noise"))


NOTICES = ["Session Chair: ", "Finance Group", "AFA Lecture ", "Markets in 2008 seen through ", "finance and economics ", "On ", ""]


@query("f4_noise_titles", sql_with(PAPERS, f"""
SELECT regexp_matches(({NOTICES})[paper_id % {len(NOTICES)} + 1] || CASE WHEN paper_id % 2 = 0 THEN title ELSE '' END, '{lx.NOISE_TITLE_PATTERN}') AS noise, count(*) AS n, sum(paper_id)::BIGINT AS ids FROM papers GROUP BY 1"""))
def _(spark, d):
    i = F.col("paper_id")
    notice = F.element_at(F.array(*[F.lit(v) for v in NOTICES]), (i % len(NOTICES) + 1).cast("int"))
    line = F.concat(notice, F.when(i % 2 == 0, F.col("title")).otherwise(""))
    return papers(spark, d).groupBy(ru.is_noise_title(line).alias("noise")).agg(F.count("*").alias("n"), F.sum(i).alias("ids"))


@query("f5_admin_titles", sql_with(PAPERS, f"""
SELECT upper(line) = '' OR {sql_contains_any("upper(line)", lx.ADMIN_WORDS)} AS admin, count(*) AS n, sum(paper_id)::BIGINT AS ids FROM (
  SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN lower(({lx.ADMIN_WORDS})[paper_id % {len(lx.ADMIN_WORDS)} + 1]) || ' ' || title WHEN paper_id % 7 = 1 THEN '' ELSE title END AS line FROM papers) q GROUP BY 1"""))
def _(spark, d):
    i = F.col("paper_id")
    word = F.lower(F.element_at(F.array(*[F.lit(v) for v in lx.ADMIN_WORDS]), (i % len(lx.ADMIN_WORDS) + 1).cast("int")))
    line = F.when(i % 3 == 0, F.concat(word, F.lit(" "), F.col("title"))).when(i % 7 == 1, F.lit("")).otherwise(F.col("title"))
    return papers(spark, d).groupBy(ru.is_admin_title(line, lx.ADMIN_WORDS).alias("admin")).agg(F.count("*").alias("n"), F.sum(i).alias("ids"))


@query("f5_admin_and_garbage_titles", sql_with(PAPERS, f"""
SELECT upper(title) = '' OR {sql_contains_any("upper(title)", ["THE AND", "ENTION"])} AS admin,
  {sql_word_count("title")} < 3 OR starts_with(lower(title), 'discussant') OR starts_with(lower(title), 'session')
    OR starts_with(lower(title), 'president') OR starts_with(lower(title), 'location:') AS garbage, count(*) AS n
FROM papers GROUP BY ALL"""))
def _(spark, d):
    return papers(spark, d).groupBy(
        ru.is_admin_title("title", ["THE AND", "ENTION"]).alias("admin"), ru.is_garbage_title("title").alias("garbage")
    ).agg(F.count("*").alias("n"))


@query("f6_exclude_phrases", sql_with(PAPERS, f"""
SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT {sql_contains_any("lower(abstract)", lx.MONETARY_PHRASES)}) AS kept FROM papers GROUP BY 1"""))
def _(spark, d):
    hit = ru.contains_any(F.lower("abstract"), lx.MONETARY_PHRASES)
    return papers(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~hit).alias("kept"))


@query("f7_usable_abstract", f"SELECT lang, count(*) FILTER (WHERE {sql_word_count('text')} >= 20) AS usable, count(*) FILTER (WHERE {sql_word_count('text')} >= 10) AS lenient FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count_if(ru.usable_abstract("text")).alias("usable"), F.count_if(ru.usable_abstract("text", 10)).alias("lenient")
    )


CONTROL_NAMES = ["leverage", "log(asset)", "market beta", "ROA", "year 2004", "firm fixed effects"]


@query("f8_control_variables", sql_with(STATS, f"SELECT variable, variable IN {sql_in(CONTROL_NAMES)} AS is_control, count(*) AS n FROM stats GROUP BY ALL"))
def _(spark, d):
    return stats(spark, d).groupBy("variable", ru.is_control("variable").alias("is_control")).agg(F.count("*").alias("n"))


@query("f9_high_coverage_papers", sql_with(STATS, """
SELECT corpus, count(*) AS n, count(DISTINCT paper_id) AS papers FROM stats
WHERE paper_id IN (SELECT paper_id FROM stats GROUP BY 1 HAVING count(*) >= 20) GROUP BY 1"""))
def _(spark, d):
    s = stats(spark, d)
    full = s.groupBy("paper_id").agg(F.count("*").alias("c")).filter("c >= 20")
    # per-paper counts first: the distinct count then runs over papers, not statistics
    kept = s.join(full, "paper_id", "left_semi").groupBy("corpus", "paper_id").agg(F.count("*").alias("c"))
    return kept.groupBy("corpus").agg(F.sum("c").alias("n"), F.count("*").alias("papers"))


@query("f10_right_censoring", sql_with(PAPERS, "SELECT published, count(*) AS n FROM papers WHERE year <= 2020 GROUP BY 1"))
def _(spark, d):
    return papers(spark, d).filter("year <= 2020").groupBy("published").agg(F.count("*").alias("n"))


@query("f11_standard_stars", sql_with(STATS, "SELECT stars, count(*) AS n FROM stats WHERE stars IN ('', '*', '**', '***') GROUP BY 1"))
def _(spark, d):
    return stats(spark, d).filter(F.col("stars").isin("", "*", "**", "***")).groupBy("stars").agg(F.count("*").alias("n"))
