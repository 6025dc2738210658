"""Sources and sinks (S)."""

from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx
from verdigris.functions import rules as ru
from verdigris.functions import text as tx
from verdigris.operators.windows import best
from verdigris.plans.base import PAPERS, papers, r4, s4, sql_in, sql_strip_page, sql_with, sql_word_count, stats, STATS, table
from verdigris.plans.registry import query
from verdigris.session import scratch_path
from verdigris.sources import pages as pg
from verdigris.sources import records as rec
from verdigris.sources import tables as ta


@query("s1_pruned_scan", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    return ta.read_table(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


@query("s2_export_csv", """
SELECT s_name AS title, 'A; B' AS authors, CAST(2000 + s_nationkey AS INT) AS year, CAST(s_suppkey AS INT) AS citations, 'SO' AS journal, '' AS volume, '' AS openalex_id FROM supplier WHERE 2000 + s_nationkey BETWEEN 2003 AND 2020""")
def _(spark, d):
    path = scratch_path(spark, "export")
    table(spark, d, "supplier").select(
        F.col("s_name").alias("TI"), F.lit("A; B").alias("AU"), (F.lit(2000) + F.col("s_nationkey")).cast("string").alias("PY"),
        F.col("s_suppkey").alias("TC"), F.col("s_acctbal").alias("ZZ"),
    ).write.csv(path, header=True)
    return ta.read_export_csv(spark, path, "SO", (2003, 2020)).select("title", "authors", "year", "citations", "journal", "volume", "openalex_id")


@query("s3_statistics_json", sql_with(STATS, f"""
SELECT paper_id, 'Paper ' || paper_id AS paper_title, 2000 + paper_id % 25 AS year, count(*) AS n, {s4("sum(z)", 2)} AS total, count(*) FILTER (WHERE stars = '') AS blank
FROM (SELECT paper_id, z, CASE WHEN k % 2 = 0 THEN stars ELSE '' END AS stars FROM stats) q GROUP BY 1"""))
def _(spark, d):
    # objects leave out title and year
    s = stats(spark, d).select("paper_id", F.col("tbl").alias("table"), "variable", F.col("z").alias("z_abs"), F.when(F.col("k") % 2 == 0, F.col("stars")).otherwise("None").alias("stars"))
    path = scratch_path(spark, "json")
    ta.write_statistics_json(s, path, "paper_id")
    p = s.select("paper_id").distinct().select(
        "paper_id", F.concat(F.lit("Paper "), F.col("paper_id").cast("string")).alias("paper_title"), (F.lit(2000) + F.col("paper_id") % 25).cast("int").alias("year")
    )
    full = ta.read_statistics_json(spark, path, p, "paper_id", "bigint")
    return full.groupBy("paper_id", "paper_title", "year").agg(
        F.count("*").alias("n"), r4(F.sum("z_abs"), 2).alias("total"), F.count_if(F.col("stars") == "").alias("blank")
    )


@query("s4_view_or_stub", "SELECT count(*) AS docs, 0 AS missing FROM documents")
def _(spark, d):
    ta.view_or_stub(spark, "vg_docs", f"{d}/documents.parquet", "doc_id bigint, lang string")
    ta.view_or_stub(spark, "vg_absent", f"{d}/absent.parquet", ta.SCHEMAS["inscope_papers"])
    return spark.sql("SELECT (SELECT count(*) FROM vg_docs) AS docs, (SELECT CAST(count(*) AS INT) FROM vg_absent) AS missing")


@query("s5_rate_function", sql_with(PAPERS, f"SELECT {s4('avg(CAST(published AS INT))')} AS pub_rate, count(*) AS n FROM papers WHERE direction = 0"))
def _(spark, d):
    papers(spark, d).createOrReplaceTempView("vg_rate_base")
    ta.rate_by_direction_function(spark, "vg_rate_base", "vg_rate")
    return spark.sql("SELECT round(pub_rate + 1e-9D, 4) AS pub_rate, n FROM vg_rate(0)")


@query("s6_union_sources", """
SELECT 'doc' AS source, CAST(doc_id AS VARCHAR) AS paper_id, lang AS kind FROM documents UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), NULL FROM pages
UNION ALL SELECT 'bench', CAST(item_id AS VARCHAR), NULL FROM benchmark""")
def _(spark, d):
    def side(name, id_col, **more):
        df = table(spark, d, name)
        return df.select(F.col(id_col).cast("string").alias("paper_id"), *[F.col(v).alias(k) for k, v in more.items()])

    ids = {"paper_id": "paper_id"}
    return ta.union_sources([
        ("doc", side("documents", "doc_id", kind="lang"), {**ids, "kind": "kind"}), ("page", side("pages", "page_id"), ids),
        ("missing", None, ids), ("bench", side("benchmark", "item_id"), ids),
    ])


@query("s7_parquet_round_trip", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "parquet")
    ta.write_table(table(spark, d, "documents"), path, ["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s8_result_csv", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "csv")
    ta.write_result_csv(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), path)
    return spark.read.schema("lang string, n bigint").csv(path, header=True)


@query("s9_append_log", "SELECT source, count(*) * 2 AS n FROM documents GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "log")
    rows = table(spark, d, "documents").select("doc_id", "source")
    ta.append_log(rows, path)
    ta.append_log(rows, path)
    return spark.read.schema("doc_id bigint, source string").csv(path, header=True).groupBy("source").agg(F.count("*").alias("n"))


@query("s10_draft_records", """
SELECT 'w' || page_id AS wp_number, 'T ' || page_id AS title, 'Ann B; Cy D' AS authors, 2000 + page_id % 25 AS year, 3 AS month, 'An abstract' AS abstract, 'https://www.nber.org/papers/w' || page_id AS url FROM pages WHERE page_id % 4 <> 0""")
def _(spark, d):
    i = F.col("page_id").cast("string")
    obj = F.struct(
        F.concat(F.lit("/papers/w"), i).alias("url"), F.concat(F.lit(" T "), i, F.lit(" ")).alias("title"),
        F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("March "), (F.lit(2000) + F.col("page_id") % 25).cast("string"))).otherwise("undated").alias("displaydate"),
        F.array(F.lit("<a href='x'>Ann B</a>"), F.lit("Cy <b>D</b>")).alias("authors"), F.lit("<p>An  abstract</p>").alias("abstract"),
    )
    landed = table(spark, d, "pages").select(F.to_json(obj).alias("json"))
    return rec.draft_rows(landed).select("wp_number", "title", "authors", "year", "month", "abstract", "url")


@query("s11_article_records", f"""
SELECT '10.1/' || doc_id AS doi, 'Doc ' || doc_id AS title, 'Ann; Bo' AS authors, 'U1; U2' AS affiliations, 2000 + doc_id % 25 AS year, '7' AS volume,
  array_to_string(string_split(lang || ' ' || source, ' '), ' ') AS abstract, 'C1; C2' AS jel_codes, CAST(doc_id % 9 AS INT) AS citations FROM documents""")
def _(spark, d):
    i = F.col("doc_id")
    name = lambda n: F.struct(F.lit(n).alias("display_name"))
    obj = F.struct(
        F.concat(F.lit("https://doi.org/10.1/"), i.cast("string")).alias("doi"), F.concat(F.lit("Doc "), i.cast("string")).alias("display_name"),
        (F.lit(2000) + i % 25).cast("int").alias("publication_year"), (i % 9).cast("int").alias("cited_by_count"),
        F.struct(F.lit("7").alias("volume")).alias("biblio"),
        F.array(F.struct(name("Ann").alias("author"), F.array(name("U1"), name("U2")).alias("institutions")), F.struct(name("Bo").alias("author"), F.array(name("U2")).alias("institutions"))).alias("authorships"),
        F.create_map(F.col("source"), F.array(F.lit(1)), F.col("lang"), F.array(F.lit(0))).alias("abstract_inverted_index"),
        F.array(name("C1"), name("C2")).alias("concepts"),
    )
    landed = table(spark, d, "documents").select(F.to_json(obj).alias("json"))
    return rec.article_rows(landed, "J").select("doi", "title", "authors", "affiliations", "year", "volume", "abstract", "jel_codes", "citations")


@query("s12_heading_layout", f"""
WITH t AS (SELECT page_id, {sql_strip_page("regexp_extract(html, '(?is)<title>(.*?)<', 1)")} AS session, {sql_strip_page("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS title,
  {sql_strip_page("regexp_extract(html, '(?is)</h1>\\s*<p>(.*?)(?:<p>|</p>|</article>)', 1)")} AS authors FROM pages)
SELECT page_id, session, title, authors FROM t WHERE length(title) >= 5 AND authors <> '' AND NOT starts_with(lower(authors), 'president')""")
def _(spark, d):
    rows = pg.heading_layout(table(spark, d, "pages"), "page_id", "html", ["title"], "h1")
    return rows.filter("authors <> ''").select("page_id", "session", "title", "authors")


def _as_programme(spark, d):
    """Pages in programme markup: headings one level down, and a session line before each title."""
    html = F.regexp_replace(F.regexp_replace("html", "<h1>", "<h5>Morning session</h5><h6>"), "</h1>", "</h6>")
    return table(spark, d, "pages").select("page_id", (F.lit(2006) + F.col("page_id") % 19).cast("int").alias("year"), "html", html.alias("new_html"))


@query("s13_sub_heading_layout", f"""
WITH t AS (SELECT page_id, 'Morning session' AS session, {sql_strip_page("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS title FROM pages)
SELECT page_id, session, title FROM t WHERE length(title) >= 5""")
def _(spark, d):
    return pg.heading_layout(_as_programme(spark, d), "page_id", "new_html", ["h5"], "h6").select("page_id", "session", "title")


# ---------------------------------------------------------------- the same layouts in SQL
def sql_stream(src: str, out: str, tags: list[str]) -> str:
    """CTE out(page_id, i, tag, text): the block tags of src(page_id, html) in page order, by splitting at marks."""
    plain = "html"
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
        plain = f"regexp_replace({plain}, '{pattern}', ' ', 'g')"
    cut = f"regexp_replace({plain}, '(?i)<(/?(?:{'|'.join(tags)}|article|footer|div|body))\\b[^>]*>', chr(1) || '\\1' || chr(2), 'g')"
    return f"""
{out}_p AS (SELECT page_id, unnest(string_split({cut}, chr(1))) AS part, generate_subscripts(string_split({cut}, chr(1)), 1) AS i FROM {src}),
{out} AS (SELECT page_id, i, tag, {sql_strip_page("raw")} AS text FROM (SELECT page_id, i, lower(split_part(part, chr(2), 1)) AS tag, split_part(part, chr(2), 2) AS raw FROM {out}_p WHERE i > 1) q WHERE tag IN {sql_in(tags)})"""


#: Letters beyond ASCII as x, so that word borders are the same in both engines.
PLAIN_LETTERS = "regexp_replace({}, '[^\\x00-\\x7F\\P{{L}}]', 'x', 'g')"
SQL_SKIPPED = "(" + " OR ".join(f"starts_with(lower(trim(text)), '{v}')" for v in lx.SKIP_LINE_PREFIXES) + ")"


def sql_dashed(src: str, out: str, dash: str) -> str:
    return f"""{sql_stream(src, out + "_s", ["h1", "p"])},
{out}_t AS (SELECT page_id, i, tag, text, coalesce(last_value(CASE WHEN tag = 'h1' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i), '') AS session, string_split_regex(text, '{dash}') AS parts FROM {out}_s WHERE text <> ''),
{out}_u AS (SELECT page_id, session, trim(parts[-1]) AS title, array_to_string(parts[1 : len(parts) - 1], ' – ') AS authors FROM {out}_t WHERE tag = 'p' AND len(parts) > 1 AND NOT {SQL_SKIPPED}),
{out} AS (SELECT * FROM {out}_u WHERE {sql_word_count("title")} >= 2 AND NOT regexp_matches({PLAIN_LETTERS.format("title")}, '{lx.INSTITUTION_PATTERN}') AND length(title) > 8)"""


def sql_paragraphs(src: str, out: str, institution: str) -> str:
    return f"""{sql_stream(src, out + "_s", ["p"])},
{out}_h AS (SELECT *, lead(text) OVER (PARTITION BY page_id ORDER BY i) AS next, regexp_matches(text, '(?i)^(session\\s*:|01/|0[1-9]/|\\d{{1,2}}/\\d{{1,2}}/20)') AS head FROM {out}_s),
{out}_c AS (SELECT *, coalesce(text <> '' AND NOT {SQL_SKIPPED} AND NOT head AND {sql_word_count("text")} >= 3 AND regexp_matches({PLAIN_LETTERS.format("coalesce(next, '')")}, '{institution}'), false) AS can FROM {out}_h),
{out}_b AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER w AS brk, coalesce(last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER w, '') AS session FROM {out}_c WINDOW w AS (PARTITION BY page_id ORDER BY i)),
{out}_k AS (SELECT *, sum(CAST(can AS INT)) OVER (PARTITION BY page_id, brk ORDER BY i) AS k FROM {out}_b),
{out} AS (SELECT page_id, session, text AS title, next AS authors FROM {out}_k WHERE can AND k % 2 = 1 AND length(text) > 8)"""


def sql_headings(src: str, out: str, head: str, title: str) -> str:
    """Pages with one title heading behind one session heading."""
    return f"""{sql_stream(src, out + "_s", [head, title, "p"])},
{out}_t AS (SELECT page_id, i, text AS title, coalesce((SELECT arg_max(h.text, h.i) FROM {out}_s h WHERE h.page_id = t.page_id AND h.tag = '{head}' AND h.text <> '' AND h.i < t.i), '') AS session FROM {out}_s t WHERE tag = '{title}' AND length(text) >= 5),
{out}_a AS (SELECT t.page_id, t.i, arg_min(p.text, p.i) AS text FROM {out}_t t JOIN {out}_s p ON p.page_id = t.page_id AND p.i > t.i AND p.tag = 'p' AND p.text <> '' GROUP BY 1, 2),
{out} AS (SELECT page_id, session, title, CASE WHEN text IS NULL OR {SQL_SKIPPED} THEN '' ELSE text END AS authors FROM {out}_t LEFT JOIN {out}_a USING (page_id, i))"""


LINE_WORDS = r"(?i)\b(the|que|und)\b"


@query("s14_dashed_layout", sql_with(sql_dashed("pages", "d", r"\s*[–—,]\s*"), "SELECT page_id, session, title, authors FROM d"))
def _(spark, d):
    return pg.dashed_layout(table(spark, d, "pages"), "page_id", "html", ["h1"], dash=r"\s*[–—,]\s*").select("page_id", "session", "title", "authors")


@query("s15_paragraph_layout", sql_with(sql_paragraphs("pages", "d", LINE_WORDS), "SELECT page_id, session, title, authors FROM d"))
def _(spark, d):
    line = lambda c: ru.looks_like_institution(c, LINE_WORDS)
    return pg.paragraph_layout(table(spark, d, "pages"), "page_id", "html", institution=line).select("page_id", "session", "title", "authors")


@query("s15_inline_title_layout", f"""
WITH t AS (SELECT page_id, {sql_strip_page("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS title FROM pages)
SELECT page_id, 'Session: morning' AS session, title, 'A. Author; Univ' AS authors FROM t
WHERE {sql_word_count("title")} >= 3 AND NOT regexp_matches(lower(title), '^(discussant|session|president|location:)')""")
def _(spark, d):
    html = F.regexp_replace(F.regexp_replace("html", "<h1>", "<p><strong>Session: morning</strong></p><p><i>"), "</h1>", "</i>, A. Author; Univ</p>")
    p = table(spark, d, "pages").select("page_id", html.alias("html"))
    # session lines start with "Session:", so only the tag decides here
    return pg.inline_title_layout(p, "page_id", "html", "i").select("page_id", "session", "title", "authors")


@query("s16_session_filtered_layout", """
SELECT page_id, 'Morning' AS session, 'Paper ' || page_id AS title, 'Ann (U1), Bo (U2)' AS authors FROM pages WHERE page_id % 2 = 0""")
def _(spark, d):
    i = F.col("page_id")
    block = F.concat(
        F.lit('<div class="session"><font class="sessionSource">'), F.when(i % 2 == 0, "The Finance Association").otherwise("Others"),
        F.lit('</font><div class="sessionTitle">Morning</div><div class="paper"><font class="paperTitle">Paper '), i.cast("string"),
        F.lit('</font><div class="author_prelim"><font class="name">Ann</font> <font class="affiliation">(U1)</font></div>'
              '<div class="author_prelim"><font class="name">Bo</font><font class="affiliation">(U2)</font></div></div></div>'),
        F.col("html"),
    )
    p = table(spark, d, "pages").select("page_id", block.alias("html"))
    return pg.session_filtered_layout(p, "page_id", "html", "Finance Association").select("page_id", "session", "title", "authors")


@query("s16_session_page_layout", f"""
SELECT page_id, 'Talk ' || page_id AS title, trim('What we do & find ' || {sql_strip_page("regexp_extract(html, '(?is)<title>(.*?)<', 1)")}) AS abstract FROM pages""")
def _(spark, d):
    block = F.concat(
        F.lit('<article class="paper"><h3 class="paper-title">Talk '), F.col("page_id").cast("string"),
        F.lit('</h3><section class="abstract"><h4>Abstract</h4><p>What we do &amp; find '), F.regexp_extract("html", "(?is)<title>(.*?)<", 1), F.lit("</p></section></article>"), F.regexp_replace("html", "</?article>", " "),
    )
    p = table(spark, d, "pages").select("page_id", block.alias("html"))
    return pg.session_page_layout(p, "page_id", "html").select("page_id", "title", "abstract")


@query("s17_layout_by_year", sql_with(f"""
pr AS (SELECT page_id, CAST(2006 + page_id % 19 AS INT) AS year, html, replace(replace(html, '<h1>', '<h5>Morning session</h5><h6>'), '</h1>', '</h6>') AS new_html FROM pages),
y1 AS (SELECT page_id, html FROM pr WHERE year <= 2012), y2 AS (SELECT page_id, html FROM pr WHERE year BETWEEN 2013 AND 2016),
y3 AS (SELECT page_id, html FROM pr WHERE year BETWEEN 2017 AND 2023), y4 AS (SELECT page_id, new_html AS html FROM pr WHERE year >= 2024),
""" + sql_dashed("y1", "d", r"\s*[–—]\s*") + ", y5 AS (SELECT * FROM y1 WHERE page_id NOT IN (SELECT page_id FROM d)), " + sql_paragraphs("y5", "f", LINE_WORDS) + ", "
    + sql_paragraphs("y2", "g", LINE_WORDS) + ", " + sql_headings("y3", "h", "title", "h1") + ", " + sql_headings("y4", "k", "h5", "h6") + """,
u AS (SELECT * FROM d UNION ALL SELECT * FROM f UNION ALL SELECT * FROM g UNION ALL SELECT * FROM h UNION ALL SELECT * FROM k),
v AS (SELECT page_id, year, session, title, authors, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS slug FROM u JOIN pr USING (page_id))
SELECT 'afa_' || year || '_' || substr(slug, 1, 40) AS paper_id, year, session, title, authors FROM v
QUALIFY row_number() OVER (PARTITION BY year, slug ORDER BY page_id, session, title, authors) = 1"""))
def _(spark, d):
    p = _as_programme(spark, d)
    dashed = lambda x: pg.dashed_layout(x, "page_id", "html", ["h1"])
    paired = lambda x: pg.paragraph_layout(x, "page_id", "html", institution=lambda c: ru.looks_like_institution(c, LINE_WORDS))
    heads = lambda x: pg.heading_layout(x, "page_id", "html", ["title"], "h1")
    subs = lambda x: pg.heading_layout(x, "page_id", "new_html", ["h5"], "h6")
    rows = pg.by_year(p, "page_id", "year", [(2006, 2012, dashed, paired), (2013, 2016, paired, None), (2017, 2023, heads, None), (2024, 2099, subs, None)])
    return pg.programme_rows(rows, "year").select("paper_id", "year", "session", "title", "authors")


@query("s18_whole_text_files", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "texts")
    docs = table(spark, d, "documents")
    # a mark ends every document of a file
    docs.select("lang", F.concat("text", F.lit("\u0001")).alias("value")).write.partitionBy("lang").text(path)
    pieces = ta.read_text_pieces(spark, path, 20_000)
    marks = F.regexp_count("text", F.lit("\u0001"))
    lang = F.regexp_extract("file", "lang=([^/]+)/", 1)
    # a mark and a line feed follow each text
    return pieces.groupBy(lang.alias("lang")).agg(F.sum(marks).cast("long").alias("n"), (F.sum(F.length("text")) - 2 * F.sum(marks)).cast("long").alias("chars"))
