"""The given tables in the roles of the study: papers, statistics, drafts and raters.

Every role exists twice, as a DataFrame and as the SQL that DuckDB runs; the two must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx
from verdigris.functions import text as tx

NL = "\n"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r4(c, digits: int = 4) -> Column:
    """Rounded away from ties and without negative zero, so that both engines print the same."""
    return F.round(tx.as_col(c) + F.lit(1e-9), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: r4(c, digits) for c in cols})


# ---------------------------------------------------------------- papers
def papers(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    i = F.col("doc_id")
    bucket = F.regexp_replace("source", "src", "").cast("int")
    title = F.split_part("text", F.lit(NL), F.lit(1))
    return (
        doc.join(lab, "doc_id", "left")
        .withColumn("bucket", bucket)
        .withColumn("title", title)
        .select(
            i.alias("paper_id"), "source", "lang", "title", F.col("text").alias("abstract"), "n_chars",
            "bucket", (F.lit(2000) + i % 25).cast("int").alias("year"),
            (F.col("bucket") < 5).alias("published"),
            F.when(F.col("bucket") < 2, "JF").when(F.col("bucket") < 4, "RFS").when(F.col("bucket") < 5, "JFE").alias("journal"),
            F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0).alias("direction"),
            F.element_at(F.array(*[F.lit(c) for c in ("high", "medium", "low")]), (i % 3 + 1).cast("int")).alias("confidence"),
            F.when(i % 7 < 3, 1).otherwise(0).alias("quasi_exp"),
            F.when(i % 5 == 0, 1).otherwise(0).alias("top_institution"),
            F.when(i % 11 != 0, (1 + i % 4).cast("int")).alias("n_authors"),
            F.when(i % 4 == 0, "auto").when(i % 4 == 1, "review").otherwise("none").alias("match_quality"),
        )
        .withColumn("positive", F.coalesce(F.col("direction") == 1, F.lit(False)))
        .withColumn("negative", F.coalesce(F.col("direction") == -1, F.lit(False)))
    )


PAPERS = r"""
papers AS (
  SELECT *, coalesce(direction = 1, false) AS positive, coalesce(direction = -1, false) AS negative FROM (
    SELECT d.doc_id AS paper_id, d.source, d.lang, split_part(d.text, chr(10), 1) AS title, d.text AS abstract, d.n_chars,
      CAST(replace(d.source, 'src', '') AS INT) AS bucket, CAST(2000 + d.doc_id % 25 AS INT) AS year,
      CAST(replace(d.source, 'src', '') AS INT) < 5 AS published,
      CASE WHEN CAST(replace(d.source, 'src', '') AS INT) < 2 THEN 'JF' WHEN CAST(replace(d.source, 'src', '') AS INT) < 4 THEN 'RFS'
           WHEN CAST(replace(d.source, 'src', '') AS INT) < 5 THEN 'JFE' END AS journal,
      CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN 0 END AS direction,
      CASE d.doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN d.doc_id % 7 < 3 THEN 1 ELSE 0 END AS quasi_exp,
      CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS top_institution,
      CASE WHEN d.doc_id % 11 <> 0 THEN CAST(1 + d.doc_id % 4 AS INT) END AS n_authors,
      CASE d.doc_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' ELSE 'none' END AS match_quality
    FROM documents d LEFT JOIN labels l USING (doc_id)) q
)"""


def _authors(title: Column, known: Column) -> Column:
    """Author list written from the title's second and third words, unknown for some rows."""
    w = F.split(title, " ")
    second, third = F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.coalesce(F.get(w, F.lit(2)), F.lit(""))
    return F.when(known & (second != ""), F.concat(second, F.lit(", J.; K. "), third)).otherwise(F.lit(""))


_AUTHORS_SQL = (
    "CASE WHEN {known} AND coalesce(string_split(title, ' ')[2], '') <> '' THEN "
    "string_split(title, ' ')[2] || ', J.; K. ' || coalesce(string_split(title, ' ')[3], '') ELSE '' END"
)


def articles(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, title, authors, year) of the document side."""
    p = papers(spark, d).select("paper_id", "title", "abstract", "year", "bucket", "published", "lang")
    return p.withColumn("authors", _authors(F.col("title"), F.col("paper_id") % 5 != 0))


ARTICLES = PAPERS + f""",
articles AS (SELECT paper_id, title, abstract, year, bucket, published, lang,
  {_AUTHORS_SQL.format(known="paper_id % 5 <> 0")} AS authors FROM papers)"""


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """(wp, title, authors, year) of the web-page side; titles come from the markup."""
    g = table(spark, d, "pages")
    title = tx.unescape_html(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    df = g.select(F.col("page_id").alias("wp"), title.alias("title"), (F.lit(2000) + F.col("page_id") % 25).cast("int").alias("year"), "html", "url")
    return df.withColumn("authors", _authors(F.col("title"), F.col("wp") % 5 != 0))


def sql_unescape(x: str) -> str:
    for e, ch in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{e}', {ch})"
    return x


DRAFTS = f"""
drafts AS (SELECT *, {_AUTHORS_SQL.format(known="wp % 5 <> 0")} AS authors FROM (
  SELECT page_id AS wp, {sql_unescape("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title,
    CAST(2000 + page_id % 25 AS INT) AS year, html, url FROM pages) q)"""


# ---------------------------------------------------------------- statistics
VARIABLES = [
    "leverage", "treat x post", "log(asset)", "market beta", "reform dummy", "ROA", "", "year 2004",
    "firm fixed effects", "size * treat",
]
TABLE_NAMES = ["Table 1: summary statistics", "Table 2 main results", "Robustness checks", "Appendix", ""]


def stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id")
    se = F.when(F.col("k") % 3 != 0, (1 + F.col("k") % 5) / F.lit(10.0))
    return (
        e.withColumn("k", k)
        .withColumn("se", se)
        .select(
            "event_id", F.col("value").alias("z"), u.alias("paper_id"), F.col("event_type").alias("subset"), "k", "se",
            F.when(u % 2 == 0, "published").otherwise("draft").alias("corpus"),
            (u % 3 - 1).cast("int").alias("direction"), (F.lit(2000) + u % 25).cast("int").alias("year"),
            F.round(F.col("value") * F.col("se") * F.when(F.col("k") % 7 == 0, -1.2).otherwise(1.0), 6).alias("coef"),
            F.when(F.col("k") % 11 == 0, "a").otherwise(F.repeat(F.lit("*"), (F.col("k") % 4).cast("int"))).alias("stars"),
            F.element_at(F.array(*[F.lit(v) for v in VARIABLES]), (F.col("k") % 10 + 1).cast("int")).alias("variable"),
            F.element_at(F.array(*[F.lit(v) for v in TABLE_NAMES]), (F.col("k") % 5 + 1).cast("int")).alias("tbl"),
            F.when(se.isNull(), "z_only").otherwise("coef_se").alias("row_type"),
        )
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STATS = f"""
stats AS (SELECT event_id, value AS z, user_id AS paper_id, event_type AS subset, k, se,
    CASE WHEN user_id % 2 = 0 THEN 'published' ELSE 'draft' END AS corpus,
    CAST(user_id % 3 - 1 AS INT) AS direction, CAST(2000 + user_id % 25 AS INT) AS year,
    round(value * se * CASE WHEN k % 7 = 0 THEN -1.2::DOUBLE ELSE 1.0::DOUBLE END, 6) AS coef,
    CASE WHEN k % 11 = 0 THEN 'a' ELSE repeat('*', k % 4) END AS stars,
    ({_sql_list(VARIABLES)})[k % 10 + 1] AS variable, ({_sql_list(TABLE_NAMES)})[k % 5 + 1] AS tbl,
    CASE WHEN se IS NULL THEN 'z_only' ELSE 'coef_se' END AS row_type
  FROM (SELECT *, CASE WHEN k % 3 <> 0 THEN (1 + k % 5) / 10.0::DOUBLE END AS se
        FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events) a) b),
valid AS (SELECT * FROM stats WHERE z BETWEEN 0 AND 50)"""


# ---------------------------------------------------------------- raters
def raters(spark: SparkSession, d: str) -> DataFrame:
    """Two codes per labelled paper: the label, and a second reading that differs on a quarter."""
    p = papers(spark, d).filter("direction is not null")
    second = F.when(F.col("paper_id") % 4 == 0, (F.col("n_chars") % 3 - 1).cast("int")).otherwise(F.col("direction"))
    third = F.when(F.col("paper_id") % 3 == 0, (F.col("n_chars") % 3 - 1).cast("int")).otherwise(F.col("direction"))
    return p.select("paper_id", "lang", "source", "published", F.col("direction").alias("r1"), second.alias("r2"), third.alias("r3"))


RATERS = PAPERS + """,
raters AS (SELECT paper_id, lang, source, published, direction AS r1,
  CASE WHEN paper_id % 4 = 0 THEN CAST(n_chars % 3 - 1 AS INT) ELSE direction END AS r2,
  CASE WHEN paper_id % 3 = 0 THEN CAST(n_chars % 3 - 1 AS INT) ELSE direction END AS r3
  FROM papers WHERE direction IS NOT NULL)"""


# ---------------------------------------------------------------- SQL pieces
def sql_with(*parts: str) -> str:
    return "WITH " + "\n".join(p.strip() for p in parts)


def s4(x: str, digits: int = 4) -> str:
    return f"(round({x} + 1e-9::DOUBLE, {digits}) + 0.0::DOUBLE)"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_words(x: str) -> str:
    sq = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    return f"(CASE WHEN {sq} = '' THEN []::VARCHAR[] ELSE string_split({sq}, ' ') END)"


def sql_word_count(x: str) -> str:
    return f"len({sql_words(x)})"


def sql_title_words(x: str, stop=lx.STOP_WORDS) -> str:
    plain = (
        f"regexp_replace(lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')), "
        f"'[^a-z0-9\\s]', ' ', 'g')"
    )
    return f"list_filter({sql_words(plain)}, lambda w: length(w) > 1 AND w NOT IN {sql_in(stop)})"


def sql_norm(x: str, stop=lx.STOP_WORDS) -> str:
    return f"array_to_string({sql_title_words(x, stop)}, ' ')"


def sql_sorted_title(x: str) -> str:
    return f"array_to_string(list_sort({sql_title_words(x)}), ' ')"


def sql_surnames(x: str) -> str:
    last = (
        "regexp_replace(lower(CASE WHEN contains(n, ',') THEN split_part(n, ',', 1) "
        "ELSE string_split(regexp_replace(trim(n), '\\s+', ' ', 'g'), ' ')[-1] END), '[^a-z]', '', 'g')"
    )
    return f"list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({x}, ''), ';'), lambda n: {last}), lambda s: s <> '')))"


def sql_contains_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')".replace("''", "''") for p in phrases) + ")"


def sql_hash(seed, *cols: str) -> str:
    inner = " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]])
    return f"('0x' || substr(md5({inner}), 1, 8))::BIGINT"


def sql_ncdf(x: str) -> str:
    """Normal distribution as text, with the tables of verdigris.functions.stats."""
    from verdigris.functions.stats import HART_DEN, HART_NUM

    def poly(coefs):
        out = f"{coefs[0]!r}::DOUBLE"
        for k in coefs[1:]:
            out = f"({out} * abs({x}) + {k!r}::DOUBLE)"
        return out

    tail = f"(exp(-({x}) * ({x}) / 2) * {poly(HART_NUM)} / {poly(HART_DEN)})"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def sql_lcs(short: str, long: str) -> str:
    """Common-subsequence length by position masks; the first argument at most 62 characters."""
    masks = (
        f"list_transform(range(1, length({long}) + 1), lambda j: list_reduce(list_prepend(0::BIGINT, "
        f"list_transform(range(1, length({short}) + 1), lambda i: CASE WHEN substr({short}, i, 1) = substr({long}, j, 1) "
        f"THEN (1::BIGINT << (i - 1)) ELSE 0::BIGINT END)), lambda a, b: a + b))"
    )
    full = f"((1::BIGINT << length({short})) - 1)"
    return (
        f"(length({short}) - bit_count(list_reduce(list_prepend({full}, {masks}), "
        f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"
    )


def sql_token_set(src: str, out: str, carry: str) -> str:
    """CTEs that add `score`, the token_set score of two lists of distinct words wa and wb, to the columns `carry` of
    src; the words of wa that wb lacks take at most 62 characters."""
    rest = lambda x: f"array_to_string(list_sort(list_filter({x}, lambda v: NOT list_contains(common, v))), ' ')"
    lcs = f"CASE WHEN ra = '' OR rb = '' THEN 0 ELSE {sql_lcs('ra', 'rb')} END"
    return f"""
{out}_1 AS (SELECT {carry}, wa, wb, list_intersect(wa, wb) AS common FROM {src}),
{out}_2 AS (SELECT {carry}, len(common) AS k, len(wa) AS na, len(wb) AS nb, length(array_to_string(common, ' ')) AS base, {rest("wa")} AS ra, {rest("wb")} AS rb FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN k > 0 THEN base + 1 ELSE 0 END + length(ra) AS la, CASE WHEN k > 0 THEN base + 1 ELSE 0 END + length(rb) AS lb FROM {out}_2),
{out} AS (SELECT {carry}, CASE WHEN na = 0 OR nb = 0 THEN 0.0 WHEN k > 0 AND (k = na OR k = nb) THEN 100.0
  ELSE greatest(100.0::DOUBLE - 100.0::DOUBLE * (length(ra) + length(rb) - 2 * ({lcs})) / (la + lb),
    CASE WHEN k > 0 THEN 200.0::DOUBLE * base / (base + la) ELSE 0 END, CASE WHEN k > 0 THEN 200.0::DOUBLE * base / (base + lb) ELSE 0 END) END AS score FROM {out}_3)"""


def sql_partial(src: str, out: str, carry: str) -> str:
    """CTEs that add `partial`, the best ratio of the shorter of the texts a and b (at most 62 characters) against all
    windows of the longer one, to the columns `carry` of src."""
    return f"""
{out}_1 AS (SELECT {carry}, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM {src}),
{out}_2 AS (SELECT {carry}, s, t, unnest(range(1 - length(s), length(t))) AS i FROM {out}_1),
{out}_3 AS (SELECT {carry}, s, substr(t, greatest(i, 0) + 1, least(i + length(s), length(t)) - greatest(i, 0)) AS w FROM {out}_2),
{out}_4 AS (SELECT {carry}, s, w, 200.0::DOUBLE * {sql_lcs("s", "w")} / (length(s) + length(w)) AS p FROM (SELECT DISTINCT * FROM {out}_3) q),
{out} AS (SELECT {carry}, max(p) AS partial FROM {out}_4 GROUP BY ALL)"""


def sql_strip_page(x: str) -> str:
    """Visible text of a piece of markup: tags out, entities back, spaces squeezed."""
    plain = f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace({sql_unescape(plain)}, '\\s+', ' ', 'g'))"


def sql_t_tails(src: str) -> str:
    """CTE tails(key, p) for rows (key, t, df) of src: two-sided p of Student's t by the finite series in the
    angle atan(t / sqrt(df)), one for even and one for odd degrees of freedom."""
    return f"""
logs AS (SELECT j, sum(CASE WHEN j = 0 THEN 0 ELSE ln((2 * j - 1) / (2.0 * j)) END) OVER (ORDER BY j) AS even,
  sum(CASE WHEN j = 0 THEN 0 ELSE ln(2 * j / (2 * j + 1.0)) END) OVER (ORDER BY j) AS odd FROM range(0, (SELECT max(df)::BIGINT // 2 + 1 FROM {src})) r(j)),
angles AS (SELECT key, df::BIGINT AS df, atan(abs(t) / sqrt(df)) AS th FROM {src}),
series AS (SELECT key, df, th, sum(CASE WHEN df % 2 = 0 THEN exp(even + 2 * j * ln(cos(th))) ELSE exp(odd + (2 * j + 1) * ln(cos(th))) END)
  FILTER (WHERE 2 * j <= CASE WHEN df % 2 = 0 THEN df - 2 ELSE df - 3 END) AS s FROM angles, logs GROUP BY 1, 2, 3),
tails AS (SELECT key, 1 - CASE WHEN df % 2 = 0 THEN sin(th) * s ELSE 2 / pi() * (th + sin(th) * coalesce(s, 0)) END AS p FROM series)"""
