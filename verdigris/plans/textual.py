"""Scalar functions (X) and function forms (D)."""

from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from verdigris.functions import lexicon as lx
from verdigris.functions import postings as ix
from verdigris.functions import replies as rp
from verdigris.functions import rules as ru
from verdigris.functions import scoring as sc
from verdigris.functions import stats as st
from verdigris.functions import text as tx
from verdigris.plans.base import (
    ARTICLES, DRAFTS, PAPERS, STATS, articles, drafts, papers, r4, s4, sql_contains_any, sql_in, sql_lcs,
    sql_ncdf, sql_norm, sql_partial, sql_sorted_title, sql_surnames, sql_t_tails, sql_title_words, sql_token_set,
    sql_unescape, sql_with,
    sql_word_count, sql_words, stats, table,
)
from verdigris.plans.models import _sql_direction
from verdigris.plans.projections import LOCAL_AMBIGUOUS, LOCAL_NEGATIVE, LOCAL_NULL, LOCAL_PHRASES, LOCAL_POSITIVE
from verdigris.plans.registry import query


@query("x1_normalise_title", sql_with(PAPERS, f"SELECT paper_id, {sql_norm('title')} AS long_list, {sql_norm('title', lx.STOP_WORDS_SHORT)} AS short_list, {sql_sorted_title('title')} AS sorted FROM papers"))
def _(spark, d):
    return papers(spark, d).select(
        "paper_id", tx.normalise_title("title").alias("long_list"),
        tx.normalise_title("title", lx.STOP_WORDS_SHORT).alias("short_list"), tx.sorted_title("title").alias("sorted"),
    )


@query("x2_normalise_unicode", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.normalise_unicode("text")).alias("h"))


def sql_strip(x):
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("x3_strip_tags", f"SELECT page_id, md5({sql_strip('html')}) AS h, length({sql_strip('html')}) AS n FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.strip_tags("html")).alias("h"), F.length(tx.strip_tags("html")).alias("n"))


@query("x3_clean_abstract", f"SELECT doc_id, md5(regexp_replace({sql_strip('t')}, '(?i)^abstract\\s*[:.]?\\s*', '')) AS h FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Abstract: <b>' ELSE '' END || text AS t FROM documents) q")
def _(spark, d):
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, "Abstract: <b>").otherwise(""), "text")
    return table(spark, d, "documents").select("doc_id", F.md5(tx.clean_abstract(t)).alias("h"))


@query("x4_surnames", sql_with(ARTICLES, f"SELECT paper_id, array_to_string({sql_surnames('authors')}, ' ') AS names FROM articles"))
def _(spark, d):
    return articles(spark, d).select("paper_id", F.array_join(F.array_sort(tx.surnames("authors")), " ").alias("names"))


def sql_programme_surnames(x: str) -> str:
    for pattern, to in lx.PROGRAMME_CLEANUP:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    parts = f"list_transform(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ','), lambda v: string_split(trim(v), ' '))"
    last = "regexp_replace(w[-1], '\\.+$', '')"
    ok = f"len(w) <= 4 AND w[1] <> '' AND w[1] NOT IN {sql_in(lx.AFFILIATION_WORDS)} AND {last} NOT IN {sql_in(lx.AFFILIATION_WORDS)} AND length({last}) >= 2 AND NOT regexp_matches({last}, '[()]') AND NOT regexp_matches({last}, '{lx.ROMAN_OR_NUMBER}')"
    return f"list_transform(list_filter({parts}, lambda w: {ok}), lambda w: {last})[1:3]"


@query("x5_programme_surnames", f"""
SELECT c_custkey, array_to_string({sql_programme_surnames("line")}, '|') AS names FROM (
  SELECT c_custkey, upper(c_name[1]) || lower(c_name[2:]) || ' Smith, University of X and Ann ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' (Duke); Bo Li; IV' AS line FROM customer) q""")
def _(spark, d):
    line = F.concat(F.initcap("c_name"), F.lit(" Smith, University of X and Ann "), F.initcap("c_mktsegment"), F.lit(" (Duke); Bo Li; IV"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(tx.programme_surnames(line), "|").alias("names"))


@query("x6_surnames_any_separator", sql_with(ARTICLES, r"""
SELECT paper_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(authors, '[;,]'), lambda p: trim(p)), lambda p: p <> ''),
  lambda p: regexp_replace(lower(string_split(p, ' ')[-1]), '\.+$', '')))), ' ') AS names,
  coalesce(string_split(trim(split_part(authors, ',', 1)), ' ')[-1], '') AS first_last FROM articles"""))
def _(spark, d):
    return articles(spark, d).select(
        "paper_id", F.array_join(F.array_sort(tx.surnames_any_separator("authors")), " ").alias("names"),
        tx.first_lastname("authors").alias("first_last"),
    )


@query("x7_author_mentioned", sql_with(ARTICLES, f"""
SELECT paper_id, len({sql_surnames("authors")}) = 0 OR len(list_filter({sql_surnames("authors")}, lambda s: contains(lower(abstract), s))) > 0 AS hit FROM articles"""))
def _(spark, d):
    return articles(spark, d).select("paper_id", tx.mentions_any(tx.surnames("authors"), "abstract").alias("hit"))


@query("x8_identifiers", r"""
SELECT page_id, nullif(lower(regexp_extract(u, '(?i)(?:nber\.org/papers?/|10\.3386/)([hw]\d+)', 1)), '') AS wp, TRY_CAST(regexp_replace(u, '[^0-9]', '', 'g') AS BIGINT) AS digits,
  coalesce(nullif(regexp_extract(u, '/papers/(w\d+)', 1), ''), string_split(u, '/')[-1]) AS tail
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.nber.org/papers/W' || page_id ELSE url END AS u FROM pages) q""")
def _(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.nber.org/papers/W"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", tx.paper_id_from_text(u).alias("wp"), tx.id_digits(u).alias("digits"), tx.paper_id_from_url(u).alias("tail")
    )


@query("x9_dois", r"""
SELECT page_id, regexp_replace(u, '^https://doi\.org/', '') AS doi, nullif(regexp_replace(regexp_extract(u, '(10\.\d{4,}/[^\s"''<>]+)', 1), '[.,)]+$', ''), '') AS found,
  nullif(regexp_extract(regexp_replace(u, '^https://doi\.org/', ''), '(?i)^10\.2139/ssrn\.(\d+)', 1), '') AS preprint
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://doi.org/10.2139/ssrn.' || page_id WHEN 1 THEN url || '/10.1016/x' || page_id || '.),' ELSE url END AS u FROM pages) q""")
def _(spark, d):
    i = F.col("page_id")
    u = (
        F.when(i % 3 == 0, F.concat(F.lit("https://doi.org/10.2139/ssrn."), i.cast("string")))
        .when(i % 3 == 1, F.concat(F.col("url"), F.lit("/10.1016/x"), i.cast("string"), F.lit(".),")))
        .otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select(
        "page_id", tx.doi_clean(u).alias("doi"), tx.doi_in_text(u).alias("found"), tx.preprint_id_from_doi(tx.doi_clean(u)).alias("preprint")
    )


@query("x10_display_dates", """
SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, d):
    shown = F.date_format("o_orderdate", "MMMM yyyy")
    return table(spark, d, "orders").groupBy(tx.display_year(shown).alias("year"), tx.display_month(shown).alias("month")).agg(F.count("*").alias("n"))


@query("x11_slug_ids", sql_with(PAPERS, """
SELECT paper_id, 'afa_' || year || '_' || substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 40) AS slug, md5(source || title) AS h FROM papers"""))
def _(spark, d):
    return papers(spark, d).select("paper_id", tx.slug_id("afa", "year", "title").alias("slug"), F.md5(F.concat("source", "title")).alias("h"))


@query("x12_ratio", f"""
SELECT p_partkey, {s4("200.0 * lcs / (length(a) + length(b))")} AS ratio FROM (
  SELECT p_partkey, a, b, {sql_lcs("a", "b")} AS lcs FROM (SELECT p_partkey, p_name AS a, p_brand || ' ' || lower(p_type) AS b FROM part) q) r""")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", r4(sc.ratio_udf("p_name", F.concat_ws(" ", "p_brand", F.lower("p_type")))).alias("ratio"))


@query("x12_ratio_native", f"""
SELECT a, b, {s4(f"200.0 * {sql_lcs('a', 'b')} / (length(a) + length(b))")} AS ratio FROM (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part) q""")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return p.select("a", "b", r4(sc.ratio_expression(F.col("a"), F.col("b"))).alias("ratio"))


SQL_WORD_LIST = "list_filter(string_split({x}, ' '), lambda v: v <> '')"


@query("x12_score_variants", f"""WITH p AS (SELECT DISTINCT p_name AS a, lower(p_type) || ' ' || p_name || ' ' || lower(p_brand) AS b FROM part),
w AS (SELECT a, b, {SQL_WORD_LIST.format(x="a")} AS la, {SQL_WORD_LIST.format(x="b")} AS lb FROM p),
o AS (SELECT a, b, array_to_string(list_sort(la), ' ') AS sa, array_to_string(list_sort(lb), ' ') AS sb FROM w),
t AS (SELECT a, b, 200.0::DOUBLE * {sql_lcs("sa", "sb")} / (length(sa) + length(sb)) AS token_sort FROM o),
d AS (SELECT a, b, list_distinct(la) AS wa, list_distinct(lb) AS wb FROM w), {sql_token_set("d", "ts", "a, b")},
x AS (SELECT a AS a0, b AS b0, a, b FROM p), {sql_partial("x", "pr", "a0, b0")}
SELECT t.a, t.b, {s4("token_sort")} AS token_sort, {s4("score")} AS token_set, {s4("partial")} AS partial FROM t JOIN ts USING (a, b) JOIN pr ON a0 = t.a AND b0 = t.b""")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("a"), F.concat_ws(" ", F.lower("p_type"), "p_name", F.lower("p_brand")).alias("b")).distinct()
    return p.select(
        "a", "b", r4(sc.token_sort_udf("a", "b")).alias("token_sort"), r4(sc.token_set_udf("a", "b")).alias("token_set"),
        r4(sc.partial_udf("a", "b")).alias("partial"),
    )


@query("x13_inverted_index", f"SELECT doc_id, md5(array_to_string(list_filter({sql_words('text')}, lambda w: w <> ''), ' ')) AS h FROM documents")
def _(spark, d):
    # word -> positions, then back; an index belongs to one document, so no row leaves its task
    index = table(spark, d, "documents").select("doc_id", ix.word_positions(tx.words("text")).alias("index"))
    return index.select("doc_id", F.md5(tx.inverted_index_text("index")).alias("h"))


AUTHORSHIPS = "array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>,raw_affiliation_string:string>>"


@query("x14_names_and_affiliations", """
SELECT s_suppkey, s_name || '; ' || 'B. ' || s_nationkey AS names, 'Univ ' || s_nationkey || '; ' || 'Inst ' || s_suppkey % 3 AS affiliations, 'Univ ' || s_nationkey AS first FROM supplier""")
def _(spark, d):
    s = table(spark, d, "supplier")
    n = F.col("s_nationkey").cast("string")
    univ = F.struct(F.concat(F.lit("Univ "), n).alias("display_name"))
    inst = F.struct(F.concat(F.lit("Inst "), (F.col("s_suppkey") % 3).cast("string")).alias("display_name"))
    a = F.array(
        F.struct(F.struct(F.col("s_name").alias("display_name")).alias("author"), F.array(univ, univ).alias("institutions"), F.lit("").alias("raw_affiliation_string")),
        F.struct(F.struct(F.concat(F.lit("B. "), n).alias("display_name")).alias("author"), F.array(inst, univ).alias("institutions"), F.lit("").alias("raw_affiliation_string")),
    ).cast(AUTHORSHIPS)
    return s.withColumn("a", a).select(
        "s_suppkey", tx.author_names("a").alias("names"), tx.affiliation_names("a").alias("affiliations"), tx.first_affiliation("a").alias("first")
    )


SQL_TOPIC = (
    "(" + sql_contains_any("t", [p for p in LOCAL_PHRASES if p not in LOCAL_AMBIGUOUS])
    + " OR (" + " + ".join(f"CAST(contains(t, '{p}') AS INT)" for p in LOCAL_AMBIGUOUS) + ") >= 2)"
)


@query("x15_topic_hit", f"SELECT doc_id, {SQL_TOPIC} AS hit, {sql_contains_any('t', lx.TOPIC_PHRASES + lx.TOPIC_TITLE_EXTRA)} AS title_hit FROM (SELECT doc_id, lower(text) AS t FROM documents) q")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", ru.topic_hit("text", LOCAL_PHRASES, LOCAL_AMBIGUOUS).alias("hit"), ru.topic_hit_title("text").alias("title_hit")
    )


def _sql_title_direction(x):
    pos, neg = sql_contains_any(f"lower({x})", LOCAL_POSITIVE), sql_contains_any(f"lower({x})", LOCAL_NEGATIVE)
    return f"CASE WHEN {pos} AND NOT {neg} THEN 1 WHEN {neg} AND NOT {pos} THEN -1 ELSE 0 END"


@query("x16_direction_rules", sql_with(PAPERS, f"""
SELECT paper_id, {_sql_title_direction("title")} AS by_title, {_sql_direction("abstract")} AS by_abstract,
  CASE WHEN {sql_word_count("abstract")} >= 20 THEN {_sql_direction("abstract")} ELSE {_sql_title_direction("title")} END AS best FROM papers"""))
def _(spark, d):
    a = dict(null=LOCAL_NULL, positive=LOCAL_POSITIVE, negative=LOCAL_NEGATIVE)
    t = dict(positive=LOCAL_POSITIVE, negative=LOCAL_NEGATIVE)
    lists = {**{f"abstract_{k}": v for k, v in a.items()}, **{f"title_{k}": v for k, v in t.items()}}
    return papers(spark, d).select(
        "paper_id", ru.direction_from_title("title", **t).alias("by_title"), ru.direction_from_abstract("abstract", **a).alias("by_abstract"),
        ru.direction_best("title", "abstract", **lists).alias("best"),
    )


P_QUANTILES = "CASE " + " ".join(
    f"WHEN p = 0.0{k} THEN {-NormalDist().inv_cdf(k / 200):.4f}" for k in range(1, 10)
) + " END"


@query("x17_quoted_statistics", sql_with(STATS, f"""
, q AS (SELECT event_id, event_id % 6 AS kind, CAST(CAST(z AS DECIMAL(12, 2)) AS DOUBLE) AS v, CAST('0.0' || (k % 9 + 1) AS DOUBLE) AS p FROM stats)
SELECT event_id, CASE kind WHEN 0 THEN CASE WHEN v BETWEEN 0.5 AND 20 THEN {s4("v")} END WHEN 1 THEN CASE WHEN v > 0 AND v <= 400 THEN {s4("sqrt(v)")} END
  WHEN 2 THEN CASE WHEN v > 0 AND v <= 400 THEN {s4("sqrt(v)")} END WHEN 3 THEN {P_QUANTILES} WHEN 4 THEN {s4("1.96")} END AS stat FROM q"""))
def _(spark, d):
    kind = F.col("event_id") % 6
    v = F.col("z").cast("decimal(12,2)").cast("string")
    t = (
        F.when(kind == 0, F.concat(F.lit("we find t-stat = "), v, F.lit(" here")))
        .when(kind == 1, F.concat(F.lit("with F = "), v))
        .when(kind == 2, F.concat(F.lit("with chi2(1) = "), v))
        .when(kind == 3, F.concat(F.lit("with p < 0.0"), (F.col("k") % 9 + 1).cast("string")))
        .when(kind == 4, F.lit("significant at the 5 level"))
        .otherwise(F.lit("no figure"))
    )
    return stats(spark, d).select("event_id", r4(ru.quoted_statistic(t)).alias("stat"))


@query("x17_quoted_p_values", sql_with(STATS, f"""
SELECT CAST({P_QUANTILES} AS DOUBLE) AS stat, count(*) AS n FROM (SELECT CAST('0.0' || (k % 9 + 1) AS DOUBLE) AS p FROM stats) q GROUP BY 1"""))
def _(spark, d):
    t = F.concat(F.lit("with p < 0.0"), (F.col("k") % 9 + 1).cast("string"))
    return stats(spark, d).groupBy(r4(ru.quoted_statistic(t)).alias("stat")).agg(F.count("*").alias("n"))


def reply_text():
    """Stored replies built from conversation turns: bare, fenced, wrapped in prose, or no JSON."""
    i = F.col("conv_id")
    obj = F.to_json(
        F.struct(
            (F.length("text") % 3 - 1).alias("direction"),
            F.when(F.col("turn") % 2 == 0, "high").otherwise("low").alias("confidence"),
            F.col("text").alias("rationale"),
        )
    )
    return (
        F.when(i % 4 == 0, obj)
        .when(i % 4 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(i % 4 == 2, F.concat(F.lit("Sure, here it is: "), obj, F.lit(" Hope it helps.")))
        .otherwise(F.lit("I cannot tell."))
    )


@query("x18_parse_replies", """
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE length(text) % 3 - 1 END AS direction,
  CASE WHEN conv_id % 4 = 3 THEN 'low' WHEN turn % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN conv_id % 4 <> 3 THEN md5(text) END AS rationale FROM conversations""")
def _(spark, d):
    default = F.struct(F.lit(0).alias("direction"), F.lit("low").alias("confidence"), F.lit(None).cast("string").alias("rationale"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", rp.parse_reply(reply_text(), "struct<direction:int,confidence:string,rationale:string>", default).alias("r")
    ).select(
        "conv_id", "turn", F.col("r.direction").alias("direction"), rp.checked_label(F.col("r.confidence"), ["high", "medium", "low"]).alias("confidence"),
        F.md5("r.rationale").alias("rationale"),
    )


@query("x18_checked_labels", """
SELECT CASE event_type WHEN 'view' THEN 'quasi' WHEN 'click' THEN 'quasi' WHEN 'error' THEN 'ols' END AS label, count(*) AS n FROM events GROUP BY 1""")
def _(spark, d):
    raw = F.col("event_type")
    label = rp.checked_label(raw, ["quasi", "ols"], {"view": "quasi", "click": "quasi", "error": "ols"})
    return table(spark, d, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("x19_repair_arrays", """
SELECT conv_id, len(list(turn)) - CASE WHEN conv_id % 2 = 1 THEN 1 ELSE 0 END AS objects,
  CAST(sum(length(text)) - CASE WHEN conv_id % 2 = 1 THEN arg_max(length(text), turn) ELSE 0 END AS BIGINT) AS total FROM conversations GROUP BY conv_id""")
def _(spark, d):
    # one array per conversation, its last object cut off for every second one
    whole = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("z")))), lambda s: s))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(whole.alias("j"))
    cut = F.regexp_replace("j", r'"z":\d+\}\]$', '"z":')
    reply = F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("Rows: "), cut)).otherwise(F.col("j"))
    parsed = c.select("conv_id", rp.parse_reply_array(reply, "struct<turn:bigint,z:bigint>").alias("a"))
    return parsed.select(
        "conv_id", F.size("a").cast("bigint").alias("objects"),
        F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x["z"]).alias("total"),
    )


MIRROR_SQL = "len(regexp_extract_all(substr(t, 1, 3000), 'elbaT|noisserg|tneicifeoC|lavretni')) > len(regexp_extract_all(substr(t, 1, 3000), 'Table|regress|Coefficient|interval'))"


@query("x20_mirrored_text", f"""
SELECT doc_id, m AS mirrored, md5(CASE WHEN m THEN array_to_string(list_transform(string_split(t, chr(10)), lambda l: reverse(l)), chr(10)) ELSE t END) AS h
FROM (SELECT doc_id, t, {MIRROR_SQL} AS m FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1 elbaT' || chr(10) || text ELSE text END AS t FROM documents) a) q""")
def _(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1 elbaT\n"), F.col("text"))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", tx.is_mirrored("t").alias("mirrored"), F.md5(tx.unmirror("t")).alias("h"))


def page_text():
    """Document text with numbers in parentheses after some words, as regression pages have."""
    return F.replace(F.replace("text", F.lit(" e"), F.lit(" (0.12)")), F.lit("s "), F.lit("[1.96] * "))


SQL_PAGE = "replace(replace(text, ' e', ' (0.12)'), 's ', '[1.96] * ')"


@query("x21_page_score", f"""
SELECT doc_id, CAST(coalesce(sum(CASE WHEN p >= 2 THEN 4 * p ELSE p END), 0) + any_value(s) AS BIGINT) AS score FROM (
  SELECT doc_id, len(regexp_extract_all(line, '\\(\\s*[-−]?\\d+\\.\\d{{1,4}}\\s*\\)')) AS p, s FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line, len(regexp_extract_all(t, '[∗\\*†]{{1,3}}')) AS s FROM (SELECT doc_id, {SQL_PAGE} AS t FROM documents) a) b) c GROUP BY 1""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.table_score(page_text()).cast("bigint").alias("score"))


@query("x22_bracket_targets", f"""
SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all({SQL_PAGE}, '\\[\\s*[-−]?\\d+\\.\\d{{1,4}}\\s*\\]')) AS n FROM documents) q WHERE n >= 10""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.bracket_count(page_text()).cast("bigint").alias("n")).filter("n >= 10")


ABSTRACT_TEXT = "trim(regexp_replace('A title Abstract: ' || text || CASE doc_id % 3 WHEN 0 THEN ' Keywords: x' WHEN 1 THEN ' Introduction We' ELSE '' END, '\\s+', ' ', 'g'))"
# the other engine tells word borders by ASCII letters alone, so letters beyond them become x on both sides
ASCII_ONLY = r"[^\x00-\x7F]"


@query("x23_abstract_block", f"""
WITH t AS (SELECT doc_id, regexp_replace({ABSTRACT_TEXT}, '{ASCII_ONLY}', 'x', 'g') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract(t, '{lx.ABSTRACT_START}(.{{80,}}?){lx.ABSTRACT_SECTION_END}', 1) AS a, regexp_extract(t, '{lx.ABSTRACT_START}(.{{80,}}?){lx.ABSTRACT_KEYWORD_END}', 1) AS b FROM t)
SELECT doc_id, length(CASE WHEN trim(a) <> '' THEN trim(a) ELSE trim(b) END) AS n, md5(CASE WHEN trim(a) <> '' THEN trim(a) ELSE trim(b) END) AS h FROM m""")
def _(spark, d):
    docs = table(spark, d, "documents")
    turn = F.col("doc_id") % 3
    tail = F.when(turn == 0, " Keywords: x").when(turn == 1, " Introduction We").otherwise("")
    t = F.regexp_replace(tx.squeeze(F.concat(F.lit("A title Abstract: "), F.col("text"), tail)), ASCII_ONLY, "x")
    found = docs.select("doc_id", tx.abstract_block(t).alias("t"))
    return found.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


INSTITUTIONS = ["nation_1", "nation_7", "brand#2", "insead"]


@query("x24_top_institution", f"""
SELECT n_name, {sql_contains_any("lower(n_name)", INSTITUTIONS)} AS top, {sql_contains_any("lower('Wharton, ' || n_name)", lx.TOP_INSTITUTIONS)} AS named, count(*) AS n
FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    j = table(spark, d, "nation").join(c, "n_nationkey")
    return j.select(
        "n_name", ru.is_top_institution("n_name", INSTITUTIONS).alias("top"),
        ru.is_top_institution(F.concat(F.lit("Wharton, "), "n_name")).alias("named"), "n",
    )


@query("x25_search_key", sql_with(ARTICLES, f"""
SELECT paper_id, concat_ws(' ', nullif(array_to_string(list_filter({sql_title_words("title", lx.STOP_WORDS_SHORT)}, lambda w: length(w) > 2)[1:8], ' '), ''),
  string_split(nullif(trim(regexp_replace(split_part(authors, ',', 1), '\\s+', ' ', 'g')), ''), ' ')[-1]) AS k FROM articles"""))
def _(spark, d):
    return articles(spark, d).select("paper_id", tx.search_key("title", "authors").alias("k"))


@query("x26_blank_words", sql_with(STATS, """
SELECT CASE WHEN s IS NULL OR s IN ('None', 'nan') THEN '' ELSE s END AS stars, count(*) AS n
FROM (SELECT CASE k % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'nan' WHEN 2 THEN NULL ELSE stars END AS s FROM stats) q GROUP BY 1"""))
def _(spark, d):
    from verdigris.sources.tables import blank_words

    m = F.col("k") % 5
    s = F.when(m == 0, "None").when(m == 1, "nan").when(m > 2, F.col("stars"))
    return stats(spark, d).groupBy(blank_words(s).alias("stars")).agg(F.count("*").alias("n"))


@query("x27_institution_text", r"""
SELECT regexp_matches(t, '(?i)\b(university|school|college|institute|faculty|department|business|insead|nber|stern|booth|sloan|fuqua|tuck|haas|gsb|hbs)\b') AS inst, count(*) AS n
FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'University of ' || c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name || ', Booth' ELSE c_name END AS t FROM customer) q GROUP BY 1""")
def _(spark, d):
    i = F.col("c_custkey") % 3
    t = F.when(i == 0, F.concat(F.lit("University of "), "c_mktsegment")).when(i == 1, F.concat("c_name", F.lit(", Booth"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").groupBy(ru.looks_like_institution(t).alias("inst")).agg(F.count("*").alias("n"))


@query("x28_normal_distribution", f"SELECT event_id, {s4(sql_ncdf('(value / 100 - 1)'), 6)} AS cdf, {s4('exp(-pow(value / 100 - 1, 2) / 2) / sqrt(2 * pi())', 6)} AS pdf FROM events")
def _(spark, d):
    x = F.col("value") / 100 - 1
    return table(spark, d, "events").select(
        "event_id", r4(st.normal_cdf(x), 6).alias("cdf"), r4(st.normal_pdf(x), 6).alias("pdf")
    )


@query("x28_quantile_round_trip", f"SELECT event_id, {s4('(event_id % 999 + 1) / 1000.0', 6)} AS p FROM events")
def _(spark, d):
    p = (F.col("event_id") % 999 + 1) / F.lit(1000.0)
    q = table(spark, d, "events").select("event_id", st.normal_quantile(p).alias("q"))
    return q.select("event_id", r4(st.normal_cdf(F.col("q")), 6).alias("p"))


@query("x28_other_tails", sql_with(STATS, f"""
, q AS (SELECT subset AS key, count(*) AS n, avg(z) AS m, avg(z) / 10 AS t, count(*) - 1 AS df FROM stats GROUP BY 1), {sql_t_tails("q")},
lf AS (SELECT k, sum(CASE WHEN k = 0 THEN 0 ELSE ln(k) END) OVER (ORDER BY k) AS v FROM range(0, (SELECT max(n) + 1 FROM q)) t(k)),
x AS (SELECT key, n, unnest(range(n // 2, n + 1)) AS k FROM q),
b AS (SELECT key, sum(exp(a.v - b.v - c.v - n * ln(2))) AS p FROM x JOIN lf a ON a.k = n JOIN lf b ON b.k = x.k JOIN lf c ON c.k = n - x.k GROUP BY 1)
SELECT key AS subset, {s4("tails.p", 6)} AS t_p, {s4("2 * " + sql_ncdf("(-sqrt(m))") + " + sqrt(2 * m / pi()) * exp(-m / 2)", 6)} AS chi2_p,
  {s4("b.p", 6)} AS binomial_p FROM q JOIN tails USING (key) JOIN b USING (key)"""))
def _(spark, d):
    t = stats(spark, d).groupBy("subset").agg(F.count("*").cast("double").alias("n"), F.avg("z").alias("m"))
    return t.select(
        "subset", r4(st.t_p(F.col("m") / 10, F.col("n") - 1), 6).alias("t_p"), r4(st.chi2_p(F.col("m"), F.lit(3.0)), 6).alias("chi2_p"),
        r4(st.binomial_tail_p(F.floor(F.col("n") / 2).cast("double"), F.col("n")), 6).alias("binomial_p"),
    )


# ---------------------------------------------------------------- function forms
@query("d1_scalar_function", sql_with(PAPERS, f"SELECT lang, count(*) FILTER (WHERE {sql_word_count('title')} > 8) AS long_titles FROM papers GROUP BY 1"))
def _(spark, d):
    return papers(spark, d).groupBy("lang").agg(F.count_if(tx.word_count("title") > 8).alias("long_titles"))


@query("d2_row_function", sql_with(PAPERS, "SELECT paper_id, CASE WHEN direction IS NULL THEN title ELSE source || ':' || direction END AS label FROM papers"))
def _(spark, d):
    return papers(spark, d).select(
        "paper_id", F.when(F.col("direction").isNull(), F.col("title")).otherwise(F.concat_ws(":", "source", F.col("direction").cast("string"))).alias("label")
    )


@query("d3_aggregate_function", sql_with(STATS, f"SELECT subset, {s4('sum(z * k) / sum(k)', 3)} AS weighted FROM valid GROUP BY 1"))
def _(spark, d):
    from verdigris.operators.caliper import valid_z

    return valid_z(stats(spark, d)).groupBy("subset").agg(r4(F.sum(F.col("z") * F.col("k")) / F.sum("k"), 3).alias("weighted"))


@query("d4_group_function", sql_with(STATS, """
SELECT subset, paper_id, max(z) - min(z) AS spread FROM stats GROUP BY 1, 2"""))
def _(spark, d):
    # the group function sees one paper's per-table extremes, combined before the shuffle
    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"subset": [pdf["subset"].iloc[0]], "paper_id": [pdf["paper_id"].iloc[0]], "spread": [pdf["hi"].max() - pdf["lo"].min()]}
        )

    small = stats(spark, d).groupBy("subset", "paper_id", "tbl").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return small.groupBy("subset", "paper_id").applyInPandas(spread, "subset string, paper_id bigint, spread double")


@query("d5_table_function", sql_with(PAPERS, f"SELECT 1 AS direction, {s4('avg(CAST(published AS INT))')} AS pub_rate, count(*) AS n FROM papers WHERE direction = 1 UNION ALL SELECT -1, {s4('avg(CAST(published AS INT))')}, count(*) FROM papers WHERE direction = -1"))
def _(spark, d):
    from verdigris.sources.tables import rate_by_direction_function

    papers(spark, d).createOrReplaceTempView("vg_rate_papers")
    rate_by_direction_function(spark, "vg_rate_papers")
    return spark.sql(
        "SELECT 1 AS direction, round(pub_rate + 1e-9D, 4) AS pub_rate, n FROM pub_rate_by_direction(1) "
        "UNION ALL SELECT -1, round(pub_rate + 1e-9D, 4), n FROM pub_rate_by_direction(-1)"
    )
