"""Joins (J) and the choice of best candidates (W1, W2)."""

from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx
from verdigris.functions import rules as ru
from verdigris.functions import scoring as sc
from verdigris.functions import text as tx
from verdigris.operators import matching as ma
from verdigris.operators import similarity as si
from verdigris.operators import tfidf as tf
from verdigris.operators import updates as up
from verdigris.operators.windows import best, top_k
from verdigris.plans.base import (
    ARTICLES, DRAFTS, PAPERS, RATERS, STATS, articles, drafts, papers, r4, raters, rounded, s4, sql_hash,
    sql_in, sql_lcs, sql_norm, sql_partial, sql_sorted_title, sql_surnames, sql_title_words, sql_token_set, sql_with, sql_word_count, stats, table,
)
from verdigris.plans.models import _sql_direction
from verdigris.plans.projections import LOCAL_NEGATIVE, LOCAL_NULL, LOCAL_POSITIVE
from verdigris.plans.registry import query
from verdigris.plans.textual import _sql_title_direction
from verdigris.session import cut_lineage

BOTH = ARTICLES + "," + DRAFTS
KEYS = BOTH + f""",
a AS (SELECT paper_id AS id, {sql_sorted_title("title")} AS key, {sql_surnames("authors")} AS names, year FROM articles),
w AS (SELECT wp AS id, {sql_sorted_title("title")} AS key, {sql_surnames("authors")} AS names, year FROM drafts)"""


def article_keys(spark, d):
    return articles(spark, d).select(
        F.col("paper_id").alias("id"), tx.sorted_title("title").alias("key"), tx.surnames("authors").alias("names"), "year"
    )


def draft_keys(spark, d):
    return drafts(spark, d).select(
        F.col("wp").alias("id"), tx.sorted_title("title").alias("key"), tx.surnames("authors").alias("names"), "year"
    )


# ---------------------------------------------------------------- plain joins
@query("j1_left_labels", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query("j2_two_raters", sql_with(RATERS, "SELECT paper_id, a.r1, b.r2 FROM raters a JOIN raters b USING (paper_id)"))
def _(spark, d):
    r = raters(spark, d)
    return r.select("paper_id", "r1").join(r.select("paper_id", "r2"), "paper_id")


TITLE_JOIN = ARTICLES + """,
t AS (SELECT title, min(paper_id) AS paper_id FROM articles GROUP BY 1)"""


@query("j3_title_join_with_fallback", sql_with(TITLE_JOIN + "," + DRAFTS, """
SELECT wp, coalesce(CAST(t.paper_id AS VARCHAR), d.title) AS paper FROM drafts d LEFT JOIN t ON t.title = d.title"""))
def _(spark, d):
    one = articles(spark, d).groupBy("title").agg(F.min("paper_id").alias("paper_id"))
    j = drafts(spark, d).select("wp", "title").join(one, "title", "left")
    return j.select("wp", F.coalesce(F.col("paper_id").cast("string"), "title").alias("paper"))


@query("j3_unmatched_titles", sql_with(TITLE_JOIN + "," + DRAFTS, "SELECT count(*) AS misses FROM drafts WHERE title NOT IN (SELECT title FROM t)"))
def _(spark, d):
    return drafts(spark, d).select("title").join(articles(spark, d).select("title").distinct(), "title", "left_anti").agg(F.count("*").alias("misses"))


@query("j4_not_yet_coded", sql_with(PAPERS, "SELECT paper_id, source FROM papers WHERE paper_id NOT IN (SELECT doc_id FROM labels)"))
def _(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"))
    return papers(spark, d).select("paper_id", "source").join(done, "paper_id", "left_anti")


@query("j5_high_confidence", sql_with(PAPERS, "SELECT paper_id, published FROM papers WHERE paper_id IN (SELECT paper_id FROM papers WHERE confidence = 'high')"))
def _(spark, d):
    p = papers(spark, d)
    return p.select("paper_id", "published").join(p.filter("confidence = 'high'").select("paper_id"), "paper_id", "left_semi")


# ---------------------------------------------------------------- fuzzy title joins
def sql_pairs(l, r, cut, short="r"):
    """Scored pairs of distinct keys; the masks go over the side whose keys are short."""
    lcs = sql_lcs("rk", "lk") if short == "r" else sql_lcs("lk", "rk")
    return f"""
len AS (SELECT x.key AS lk, y.key AS rk FROM (SELECT DISTINCT key FROM {l} WHERE key <> '') x JOIN (SELECT DISTINCT key FROM {r} WHERE key <> '') y
  ON 200.0 * least(length(x.key), length(y.key)) >= {cut} * (length(x.key) + length(y.key))),
sc AS (SELECT * FROM (SELECT lk, rk, 200.0::DOUBLE * {lcs} / (length(lk) + length(rk)) AS score FROM len) q WHERE score >= {cut})"""


GATE = "(len(l.names) = 0 OR len(r.names) = 0 OR list_has_any(l.names, r.names))"


def sql_fuzzy(l, r, cut, auto=90, gate=GATE, limit=None, short="r"):
    if limit:
        rows = f"""
rr AS (SELECT lk, r.id, score, row_number() OVER (PARTITION BY lk ORDER BY score DESC, r.id) AS rk_no FROM sc JOIN {r} r ON r.key = sc.rk),
c AS (SELECT l.id AS l_id, r.id AS r_id, rr.score FROM {l} l JOIN rr ON rr.lk = l.key AND rk_no <= {limit} JOIN {r} r ON r.id = rr.id WHERE {gate})"""
    else:
        rows = f"""
c AS (SELECT l.id AS l_id, r.id AS r_id, sc.score FROM {l} l JOIN sc ON sc.lk = l.key JOIN {r} r ON r.key = sc.rk WHERE {gate})"""
    return f"""{sql_pairs(l, r, cut, short)},{rows},
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) = 1)
SELECT l.id, b.r_id AS match_id, {s4("coalesce(b.score, 0)")} AS score, CASE WHEN b.score IS NULL THEN 'none' WHEN b.score >= {auto} THEN 'auto' ELSE 'review' END AS quality
FROM {l} l LEFT JOIN b ON b.l_id = l.id"""


@query("j6_fuzzy_title_join", sql_with(KEYS + ",", sql_fuzzy("a", "w", 75)))
def _(spark, d):
    return rounded(si.fuzzy_best(article_keys(spark, d), draft_keys(spark, d), 75.0), "score")


@query("j6_fuzzy_title_join_top20", sql_with(KEYS + ",", sql_fuzzy("a", "w", 75, limit=20)))
def _(spark, d):
    return rounded(si.fuzzy_best(article_keys(spark, d), draft_keys(spark, d), 75.0, limit=20), "score")


@query("j7_fuzzy_year_window", sql_with(KEYS + ",", sql_fuzzy("w", "a", 85, gate="r.year - l.year BETWEEN -1 AND 4", short="l")))
def _(spark, d):
    none = F.array().cast("array<string>")
    l, r = (k(spark, d).withColumn("names", none) for k in (draft_keys, article_keys))
    return rounded(si.fuzzy_best(l, r, 85.0, years=(-1, 4)), "score")


@query("j8_year_guard", sql_with(KEYS + ",", sql_fuzzy("a", "w", 80, gate=GATE + " AND abs(r.year - l.year) <= 3")))
def _(spark, d):
    return rounded(si.fuzzy_best(article_keys(spark, d), draft_keys(spark, d), 80.0, years=(-3, 3)), "score")


@query("j9_author_gate", sql_with(KEYS, f"SELECT l.id, {GATE} AS pass FROM a l JOIN w r USING (id)"))
def _(spark, d):
    l = article_keys(spark, d).select("id", F.col("names").alias("ln"))
    r = draft_keys(spark, d).select("id", F.col("names").alias("rn"))
    return l.join(r, "id").select("id", tx.shares_surname("ln", "rn").alias("pass"))


@query("j10_half_author_gate", sql_with(KEYS, """
SELECT l.id, CASE WHEN len(l.names) = 0 THEN true WHEN len(r.names) = 0 THEN false
  ELSE len(list_intersect(l.names, r.names)) / least(len(l.names), len(r.names)) >= 0.5 END AS pass FROM a l JOIN w r USING (id)"""))
def _(spark, d):
    l = article_keys(spark, d).select("id", F.col("names").alias("ln"))
    r = draft_keys(spark, d).select("id", F.col("names").alias("rn"))
    return l.join(r, "id").select("id", tx.shares_half_surnames("ln", "rn").alias("pass"))


# ---------------------------------------------------------------- weighted-term joins
def sql_terms(src, out, bigrams=True, stop=()):
    found = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}')"
    if stop:
        found = f"list_filter({found}, lambda v: v NOT IN {sql_in(stop)})"
    two = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))" if bigrams else "t"
    return f"""{out} AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({two}) AS term FROM
  (SELECT id, {found} AS t FROM {src}) x) y GROUP BY 1, 2)"""


def sql_vectors(counts, vocab, out):
    return f"""{out} AS (SELECT id, term, (1 + ln(tf)) * idf / sqrt(sum(pow((1 + ln(tf)) * idf, 2)) OVER (PARTITION BY id)) AS w FROM {counts} JOIN {vocab} USING (term))"""


def sql_vocab(counts, n, out, min_df=2, most=None):
    limit = f" ORDER BY sum(tf) DESC, term LIMIT {most}" if most else ""
    return f"{out} AS (SELECT term, ln((1 + ({n})) / (1 + count(*))) + 1 AS idf FROM {counts} GROUP BY 1 HAVING count(*) >= {min_df}{limit})"


@query("j11_tfidf_join", sql_with(BOTH + f""",
l AS (SELECT wp AS id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, {sql_sorted_title("title")} AS key, {sql_surnames("authors")} AS names FROM drafts),
r AS (SELECT paper_id AS id, abstract AS text, {sql_sorted_title("title")} AS key, {sql_surnames("authors")} AS names FROM articles),
u AS (SELECT 'l' || id AS id, text FROM l UNION ALL SELECT 'r' || id, text FROM r),
{sql_terms("u", "tc")}, {sql_vocab("tc", "SELECT count(*) FROM u", "vo")}, {sql_vectors("tc", "vo", "ve")},
pr AS (SELECT CAST(substr(x.id, 2) AS BIGINT) AS lid, CAST(substr(y.id, 2) AS BIGINT) AS rid, sum(x.w * y.w) AS cosine FROM ve x JOIN ve y USING (term) WHERE x.id LIKE 'l%' AND y.id LIKE 'r%' GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.55),
tp AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY lid ORDER BY round(cosine, 12) DESC, rid) <= 50),
g AS (SELECT lid, rid, cosine, l.key AS lk, r.key AS rk FROM tp JOIN l ON l.id = lid JOIN r ON r.id = rid WHERE {GATE}),
h AS (SELECT * FROM g WHERE 200.0 * {sql_lcs("lk", "rk")} / (length(lk) + length(rk)) >= 50)""", f"""
SELECT lid AS id, rid AS match_id, {s4("cosine")} AS cosine FROM h QUALIFY row_number() OVER (PARTITION BY lid ORDER BY round(cosine, 12) DESC, rid) = 1"""))
def _(spark, d):
    l = drafts(spark, d).select(
        F.col("wp").alias("id"), tx.strip_tags("html").alias("text"), tx.sorted_title("title").alias("key"), F.array_sort(tx.surnames("authors")).alias("names")
    )
    r = articles(spark, d).select(
        F.col("paper_id").alias("id"), F.col("abstract").alias("text"), tx.sorted_title("title").alias("key"), F.array_sort(tx.surnames("authors")).alias("names")
    )
    accept = lambda: tx.shares_surname("l_names", "r_names") & (sc.ratio_udf("l_key", "r_key") >= 50)
    return rounded(tf.tfidf_best(l, r, 0.55, ["key", "names"], accept, top=50), "cosine")


@query("j12_tfidf_candidates", f"""WITH q AS (SELECT item_id AS id, text FROM benchmark), p AS (SELECT doc_id AS id, text FROM documents),
{sql_terms("q", "qc")}, {sql_terms("p", "pc")}, {sql_vocab("pc", "SELECT count(*) FROM p", "vo")}, {sql_vectors("qc", "vo", "qv")}, {sql_vectors("pc", "vo", "pv")},
pr AS (SELECT x.id, y.id AS match_id, sum(x.w * y.w) AS cosine FROM qv x JOIN pv y USING (term) GROUP BY 1, 2 HAVING sum(x.w * y.w) > 0.05)
SELECT id, match_id, {s4("cosine")} AS cosine, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, match_id) AS rank FROM pr QUALIFY rank <= 40""")
def _(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    p = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rounded(tf.tfidf_candidates(q, p, top=40, above=0.05), "cosine")


# ---------------------------------------------------------------- word-set joins
def sql_uwords(x):
    return f"list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda v: v <> '')))"


SETS = BOTH + f""",
l AS (SELECT wp AS id, {sql_uwords("title")} AS t FROM drafts), r AS (SELECT paper_id AS id, {sql_uwords("title")} AS t FROM articles),
m AS (SELECT l.id, r.id AS match_id, len(list_intersect(l.t, r.t)) AS s, len(l.t) AS ln, len(r.t) AS rn FROM l, r WHERE len(l.t) > 0)"""


def _token_side(df, id_col):
    words = F.filter(F.split(tx.normalise_unicode("title"), " "), lambda v: v != "")
    return df.select(F.col(id_col).alias("id"), words.alias("tokens"))


@query("j13_word_containment", sql_with(SETS, f"""
, b AS (SELECT * FROM m WHERE s / ln >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s / ln DESC, match_id) = 1)
SELECT id, match_id, {s4("s / ln")} AS share FROM b QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY id) = 1"""))
def _(spark, d):
    c = si.containment_best(_token_side(drafts(spark, d), "wp"), _token_side(articles(spark, d), "paper_id"), 0.5)
    return rounded(best(c, ["match_id"], [F.col("id")]), "share")


@query("j14_jaccard_titles", sql_with(SETS, f"""
, b AS (SELECT * FROM m WHERE s / (ln + rn - s) >= 0.4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s / (ln + rn - s) DESC, match_id) = 1)
SELECT id, match_id, {s4("s / (ln + rn - s)")} AS jaccard FROM b"""))
def _(spark, d):
    c = si.jaccard_best(_token_side(drafts(spark, d), "wp"), _token_side(articles(spark, d), "paper_id"), 0.4)
    return rounded(c, "jaccard")


def title_sides(spark, d):
    l = drafts(spark, d).select(F.col("wp").alias("id"), tx.normalise_title("title").alias("title"), F.array_sort(tx.surnames("authors")).alias("names"))
    r = articles(spark, d).select(F.col("paper_id").alias("id"), tx.normalise_title("title").alias("title"), "authors")
    return l, r


MENTION = "(len(names) = 0 OR len(list_filter(names, lambda v: contains(lower({text}), v))) > 0)"


@query("j15_token_set_join", sql_with(BOTH + f""",
l AS (SELECT {sql_norm("title")} AS q, {sql_surnames("authors")} AS names, min(wp) AS l_rec FROM drafts GROUP BY 1, 2),
r AS (SELECT {sql_norm("title")} AS c, authors, min(paper_id) AS cand FROM articles GROUP BY 1, 2),
g AS (SELECT l_rec, q, names, cand, c FROM l JOIN r ON q <> '' AND c <> '' AND (authors = '' OR {MENTION.format(text="c || ' ' || authors")})),
tp AS (SELECT DISTINCT q, c, list_distinct(string_split(q, ' ')) AS wa, list_distinct(string_split(c, ' ')) AS wb FROM g),
tl AS (SELECT * FROM (SELECT *, length(array_to_string(wa, ' ')) AS x, length(array_to_string(wb, ' ')) AS y, len(list_intersect(wa, wb)) AS k FROM tp) q1 WHERE k > 0 OR 200 * least(x, y) >= 75 * (x + y)),
{sql_token_set("tl", "ts", "q, c")},
sc AS (SELECT q, c, score, 200.0::DOUBLE * {sql_lcs("q", "c")} / (length(q) + length(c)) AS exact FROM ts WHERE score >= 75),
b AS (SELECT q, names, cand, score, exact FROM g JOIN sc USING (q, c) QUALIFY row_number() OVER (PARTITION BY l_rec ORDER BY round(score * 1000 + exact, 9) DESC, cand) = 1)
SELECT wp AS id, cand AS match_id, {s4("score")} AS score, {s4("exact")} AS exact FROM drafts JOIN b ON b.q = {sql_norm("title")} AND b.names = {sql_surnames("authors")}"""))
def _(spark, d):
    return rounded(si.token_set_best(*title_sides(spark, d), 75.0), "score", "exact")


@query("j16_partial_ratio_check", sql_with(BOTH + f""",
j AS (SELECT wp AS id, {sql_norm("d.title")} AS a, {sql_surnames("d.authors")} AS names, a.title || ' ' || a.authors AS context FROM drafts d JOIN articles a ON a.paper_id = d.wp),
k AS (SELECT id, a, {sql_norm("context")} AS b FROM j WHERE {MENTION.format(text="context")}),
kk AS (SELECT id, a, b FROM k WHERE a <> '' AND b <> ''),
{sql_partial("kk", "pr", "id")}
SELECT id, {s4("coalesce(partial, CASE WHEN a = b THEN 100 ELSE 0 END)")} AS score FROM k LEFT JOIN pr USING (id)"""))
def _(spark, d):
    q = drafts(spark, d).select(F.col("wp").alias("id"), tx.normalise_title("title").alias("q"), tx.surnames("authors").alias("names"))
    c = articles(spark, d).select(F.col("paper_id").alias("id"), F.concat_ws(" ", "title", "authors").alias("context"))
    j = q.join(c, "id")
    score = sc.partial_udf("q", tx.normalise_title("context"))
    return rounded(j.filter(tx.mentions_any("names", "context")).select("id", score.alias("score")), "score")


@query("j17_one_to_one", "WITH RECURSIVE " + KEYS.strip() + f""",
pr AS (SELECT DISTINCT w.key AS lk, a.key AS rk FROM w JOIN a ON w.year = a.year AND w.key <> '' AND a.key <> '' AND 200.0 * least(length(w.key), length(a.key)) >= 75 * (length(w.key) + length(a.key))),
sc AS (SELECT * FROM (SELECT lk, rk, 200.0::DOUBLE * {sql_lcs("lk", "rk")} / (length(lk) + length(rk)) AS score FROM pr) q WHERE score >= 75),
cand AS (SELECT w.id AS l, list(a.id ORDER BY score DESC, a.id) AS c, list(score ORDER BY score DESC, a.id) AS s FROM w JOIN sc ON sc.lk = w.key JOIN a ON a.key = sc.rk AND a.year = w.year GROUP BY 1),
turn AS (SELECT *, row_number() OVER (ORDER BY l) AS k FROM cand),
walk AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS id, NULL::BIGINT AS match_id, NULL::DOUBLE AS score
  UNION ALL
  SELECT k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, l, p, s[list_position(c, p)]
  FROM (SELECT t.k, t.l, t.c, t.s, w.used, list_filter(t.c, lambda v: NOT list_contains(w.used, v))[1] AS p FROM walk w JOIN turn t ON t.k = w.k + 1) z
)
SELECT id, match_id, {s4("score")} AS score FROM walk WHERE match_id IS NOT NULL""")
def _(spark, d):
    """Drafts fill articles of the same year, one to one, in draft order."""

    def keyed(df):
        return df.filter("key <> ''").select(
            "id", F.concat_ws("|", F.col("year").cast("string"), "key").alias("k"), "key", F.array(F.col("year").cast("string")).alias("blocks")
        )

    l, r = keyed(draft_keys(spark, d)), keyed(article_keys(spark, d))
    lg = l.groupBy("k", "key", "blocks").agg(F.min("id").alias("rec"))
    rg = r.groupBy("k", "key", "blocks").agg(F.min("id").alias("rec"))
    e = si.edit_pairs(lg.select("rec", "key", "blocks"), rg.select("rec", "key", "blocks"), 75.0)
    e = e.join(lg.select(F.col("rec").alias("l_rec"), F.col("k").alias("l_key")), "l_rec").join(
        rg.select(F.col("rec").alias("r_rec"), F.col("k").alias("r_key")), "r_rec"
    )
    out = ma.ordered_one_to_one(
        l.select("id", F.col("k").alias("l_key")), r.select("id", F.col("k").alias("r_key")), e.select("l_key", "r_key", "score")
    )
    return rounded(out, "score")


@query("j18_fill_from_best_match", sql_with(KEYS + ",", sql_fuzzy("w", "a", 80, gate="true", short="l").replace("SELECT l.id, b.r_id AS match_id", "SELECT l.id, b.r_id AS m").rsplit("SELECT l.id", 1)[0] + f"""
SELECT l.id, CASE WHEN {sql_word_count("abstract")} >= 20 THEN md5(abstract) END AS h FROM w l LEFT JOIN b ON b.l_id = l.id LEFT JOIN articles ON paper_id = b.r_id"""))
def _(spark, d):
    none = F.array().cast("array<string>")
    l, r = (k(spark, d).withColumn("names", none).withColumn("year", F.lit(None).cast("int")) for k in (draft_keys, article_keys))
    m = si.fuzzy_best(l, r, 80.0)
    a = articles(spark, d).select(F.col("paper_id").alias("match_id"), "abstract")
    return m.join(a, "match_id", "left").select("id", F.when(ru.usable_abstract("abstract"), F.md5("abstract")).alias("h"))


def landed_records(spark, d):
    """Landed look-up results: a record per document, by turns of the three article shapes (one in eight names
    nothing), and one per page in the two draft shapes. Documents point at page doc_id // 2, pages at document
    5 * page_id; other links in a record lead nowhere."""
    none = F.lit(None).cast("string")
    doc = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("word"))
    turn, n = F.col("doc_id") % 8, F.floor(F.col("doc_id") / 2).cast("string")
    url = F.concat(F.lit("https://www.nber.org/papers/w"), n)
    place = lambda a, b, c, names=("url", "pdf_url", "landing_page_url"): F.struct(*[v.alias(k) for v, k in zip((a, b, c), names)])
    other = F.concat(F.lit("https://a.org/"), F.coalesce("word", F.lit("")))
    article = F.to_json(F.struct(
        place(other, F.when(turn == 0, url), none).alias("best_oa_location"),
        F.array(place(other, none, none), place(none, F.when(turn == 1, F.concat(F.lit("https://doi.org/10.3386/W"), n)), none)).alias("locations"),
        F.struct(F.when(turn == 2, url).alias("oa_url")).alias("open_access"),
    ))
    names = ("url", "url_for_pdf", "url_for_landing_page")
    open_ = F.to_json(F.struct(
        F.array(place(other, none, none, names), place(none, F.when(turn == 3, url), none, names)).alias("oa_locations"),
        place(none, none, F.when(turn == 4, url), names).alias("best_oa_location"),
    ))
    item = lambda kind, v: F.struct(F.lit(kind).alias("id-type"), v.alias("id"))
    decoys = F.transform(F.sequence(F.lit(1), F.when(F.col("doc_id") % 16 == 14, 30).otherwise(29)), lambda k: F.struct(F.concat(F.lit("10.1/"), k.cast("string")).alias("DOI")))
    draft_doi = F.concat(F.lit("10.3386/w"), n)
    relation = F.to_json(F.struct(
        F.create_map(F.lit("has-preprint"), F.array(item("uri", F.lit("10.3386/w1")), item("doi", F.when(turn == 5, draft_doi).otherwise(F.lit("10.2/x"))))).alias("relation"),
        F.concat(decoys, F.array(F.struct(F.when(turn == 6, draft_doi).alias("DOI")))).alias("reference"),
    ))
    shape = F.when(turn < 3, "article").when(turn < 5, "open").when(turn < 8, "relation")
    json = F.when(turn < 3, article).when(turn < 5, open_).otherwise(relation)
    of_documents = doc.select(shape.alias("shape"), F.concat(F.lit("10.1111/jf."), F.col("doc_id").cast("string")).alias("key"), json.alias("json"))
    page = table(spark, d, "pages").select("page_id", "url")
    side = F.col("page_id") % 4
    doi = F.concat(F.lit("10.1111/jf."), (F.col("page_id") * 5).cast("string"))
    back = F.to_json(F.struct(F.create_map(F.lit("is-version-of"), F.array(item("doi", F.lit("10.9/none")), item("doi", F.upper(doi)))).alias("relation")))
    spot = lambda a, b, c: F.struct(a.alias("doi"), b.alias("url"), c.alias("landing_page_url"))
    versions = F.to_json(F.struct(
        F.array(spot(F.lit("https://doi.org/10.9/none"), F.col("url"), none), spot(F.when(side == 1, F.concat(F.lit("https://doi.org/"), doi)), none, F.when(side == 2, F.concat(F.lit("https://b.org/"), doi, F.lit("."))))).alias("locations"),
        F.when(side == 3, F.concat(F.lit("https://doi.org/"), doi)).alias("doi"),
    ))
    of_pages = page.select(F.when(side == 0, "draft relation").otherwise("draft versions").alias("shape"), F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("key"), F.when(side == 0, back).otherwise(versions).alias("json"))
    return of_documents.unionByName(of_pages)


def location_links(spark, d):
    """(paper_id, wp, shape) from landed records of all shapes."""
    from verdigris.sources.records import location_edges

    a = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("10.1111/jf."), F.col("doc_id").cast("string")).alias("doi"))
    w = table(spark, d, "pages").select(F.col("page_id").alias("wp"), F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("wp_number"))
    return location_edges(landed_records(spark, d), a, w).join(a, "doi").join(w, "wp_number").select("paper_id", "wp", "shape")


LOCATION_EDGES = """
edges AS (
  SELECT doc_id AS paper_id, page_id AS wp, CASE WHEN doc_id % 8 < 3 THEN 'article' WHEN doc_id % 8 < 5 THEN 'open' ELSE 'relation' END AS shape
  FROM documents JOIN pages ON page_id = doc_id // 2 WHERE doc_id % 8 < 7 AND doc_id % 16 <> 14
  UNION ALL SELECT doc_id, page_id, CASE WHEN page_id % 4 = 0 THEN 'draft relation' ELSE 'draft versions' END FROM pages JOIN documents ON doc_id = 5 * page_id)"""


@query("j19_location_links", sql_with(LOCATION_EDGES, "SELECT * FROM edges"))
def _(spark, d):
    return location_links(spark, d)


@query("j20_file_name_links", sql_with(PAPERS, """
SELECT CASE journal WHEN 'RFS' THEN 'HHA' || paper_id ELSE '1-s2.0-S0304405X' || lpad(CAST(paper_id AS VARCHAR), 8, '0') || '-main' END AS file,
  CASE journal WHEN 'RFS' THEN '10.1093/rfs/hha' || paper_id ELSE '10.1016/s0304-405x(' || substr(lpad(CAST(paper_id AS VARCHAR), 8, '0'), 1, 2) || ')' || substr(lpad(CAST(paper_id AS VARCHAR), 8, '0'), 3) END AS paper_id,
  CASE journal WHEN 'RFS' THEN 'suffix' ELSE 'number' END AS how FROM papers WHERE journal IN ('RFS', 'JFE')"""))
def _(spark, d):
    p = papers(spark, d).filter("published")
    n = F.lpad(F.col("paper_id").cast("string"), 8, "0")
    i = F.col("paper_id").cast("string")
    doi = F.when(F.col("journal") == "RFS", F.concat(F.lit("10.1093/rfs/hha"), i)).otherwise(
        F.concat(F.lit("10.1016/s0304-405x("), F.substring(n, 1, 2), F.lit(")"), F.substring(n, 3, 6))
    )
    file = F.when(F.col("journal") == "RFS", F.concat(F.lit("HHA"), i)).otherwise(F.concat(F.lit("1-s2.0-S0304405X"), n, F.lit("-main")))
    named = p.select(doi.alias("paper_id"), "journal", file.alias("file"))
    return up.link_by_file_name(named.select("file"), named.select("paper_id", "journal"))


# ---------------------------------------------------------------- updates and cascades
GAPS = ARTICLES + """,
old AS (SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN '  ' WHEN paper_id % 3 = 1 THEN NULL ELSE abstract END AS abstract FROM articles),
new AS (SELECT page_id AS paper_id, url AS abstract FROM pages)"""


def _gaps(spark, d):
    i = F.col("paper_id")
    old = articles(spark, d).select("paper_id", F.when(i % 3 == 0, "  ").when(i % 3 == 2, F.col("abstract")).alias("abstract"))
    new = table(spark, d, "pages").select(F.col("page_id").alias("paper_id"), F.col("url").alias("abstract"))
    return old, new


@query("j21_fill_missing", sql_with(GAPS, """
SELECT paper_id, md5(CASE WHEN trim(coalesce(o.abstract, '')) = '' AND n.abstract IS NOT NULL THEN n.abstract ELSE o.abstract END) AS h FROM old o LEFT JOIN new n USING (paper_id)"""))
def _(spark, d):
    old, new = _gaps(spark, d)
    return up.fill_missing(old, new, "paper_id", "abstract").select("paper_id", F.md5("abstract").alias("h"))


@query("j21_keep_longer", sql_with(GAPS, """
SELECT paper_id, md5(CASE WHEN length(coalesce(n.abstract, '')) > length(coalesce(o.abstract, '')) THEN n.abstract ELSE o.abstract END) AS h FROM old o LEFT JOIN new n USING (paper_id)"""))
def _(spark, d):
    old, new = _gaps(spark, d)
    return up.keep_longer(old, new, "paper_id", "abstract").select("paper_id", F.md5("abstract").alias("h"))


CASCADE_SHAPES = ["article", "relation", "open"]


@query("j22_strategy_cascade", sql_with(KEYS + "," + LOCATION_EDGES + ", fz AS (WITH " + sql_fuzzy("a", "w", 75).lstrip() + f"""),
u AS (
  SELECT id AS paper_id, match_id AS wp, score, quality, 'fuzzy' AS source, 0 AS priority FROM fz WHERE match_id IS NOT NULL
  UNION ALL SELECT paper_id, wp, 0.0, 'api', shape, list_position({CASCADE_SHAPES}, shape) FROM edges WHERE shape IN {sql_in(CASCADE_SHAPES)}
), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY priority, wp) = 1)
SELECT a.id AS paper_id, wp, coalesce(score, 0.0) AS score, coalesce(quality, 'none') AS quality, coalesce(source, 'none') AS source FROM a LEFT JOIN b ON b.paper_id = a.id"""))
def _(spark, d):
    keys = article_keys(spark, d)
    fuzzy = rounded(si.fuzzy_best(keys, draft_keys(spark, d), 75.0), "score").filter("match_id is not null")
    found = [fuzzy.select(F.col("id").alias("paper_id"), F.col("match_id").alias("wp"), "score", "quality", F.lit("fuzzy").alias("source"))]
    links = cut_lineage(location_links(spark, d))
    for shape in CASCADE_SHAPES:
        found.append(links.filter(F.col("shape") == shape).select("paper_id", "wp", F.lit(0.0).alias("score"), F.lit("api").alias("quality"), F.col("shape").alias("source")))
    first = up.first_source_wins(found, "paper_id", [F.col("wp")]).drop("priority")
    none = F.lit("none")
    return keys.select(F.col("id").alias("paper_id")).join(first, "paper_id", "left").select(
        "paper_id", "wp", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("quality", none).alias("quality"), F.coalesce("source", none).alias("source")
    )


@query("j23_label_cascade", sql_with(PAPERS, f"""
SELECT paper_id, coalesce(direction, CASE WHEN {sql_word_count("abstract")} >= 20 THEN {_sql_direction("abstract")} ELSE {_sql_title_direction("title")} END) AS direction,
  CASE WHEN direction IS NOT NULL THEN 'linked' WHEN {sql_word_count("abstract")} >= 20 THEN 'abstract' ELSE 'title' END AS how FROM papers"""))
def _(spark, d):
    rules = ru.direction_best(
        "title", "abstract", abstract_null=LOCAL_NULL, abstract_positive=LOCAL_POSITIVE, abstract_negative=LOCAL_NEGATIVE,
        title_positive=LOCAL_POSITIVE, title_negative=LOCAL_NEGATIVE,
    )
    how = F.when(F.col("direction").isNotNull(), "linked").when(ru.usable_abstract("abstract"), "abstract").otherwise("title")
    return papers(spark, d).select("paper_id", F.coalesce("direction", rules).alias("direction"), how.alias("how"))


@query("j24_abstract_sources", sql_with(BOTH, f"""
SELECT paper_id, priority, md5(t) AS h FROM (SELECT paper_id, 0 AS priority, title AS t FROM articles UNION ALL SELECT wp, 1, title FROM drafts UNION ALL SELECT paper_id, 2, abstract FROM articles) u
WHERE {sql_word_count("t")} >= 20 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY priority) = 1"""))
def _(spark, d):
    a, w = articles(spark, d), drafts(spark, d)
    found = [
        a.select("paper_id", F.col("title").alias("t")), w.select(F.col("wp").alias("paper_id"), F.col("title").alias("t")), a.select("paper_id", F.col("abstract").alias("t"))
    ]
    good = [c.filter(ru.usable_abstract("t")) for c in found]
    return up.first_source_wins(good, "paper_id", []).select("paper_id", "priority", F.md5("t").alias("h"))


@query("j25_mark_linked", sql_with(BOTH, "SELECT wp, wp IN (SELECT paper_id // 3 FROM articles WHERE paper_id % 2 = 0) AS linked FROM drafts"))
def _(spark, d):
    links = articles(spark, d).filter("paper_id % 2 = 0").select(F.floor(F.col("paper_id") / 3).alias("wp"))
    return up.mark_linked(drafts(spark, d).select("wp"), links, "wp", "linked")


PAIRS = RATERS + """,
pairs AS (SELECT paper_id, r1 AS direction_pub, r2 AS direction_draft, r1 = r2 AS stable, r1 <> r2 AS shifted, r2 = 0 AND r1 <> 0 AS null_to_directional FROM raters)"""


def _pairs(spark, d):
    r = raters(spark, d)
    pub = r.select("paper_id", F.col("r1").alias("direction_pub"))
    draft = r.select("paper_id", F.col("r2").alias("direction_draft"))
    p, q = F.col("direction_pub"), F.col("direction_draft")
    return pub.join(draft, "paper_id").select(
        "paper_id", "direction_pub", "direction_draft", (p == q).alias("stable"), (p != q).alias("shifted"), ((q == 0) & (p != 0)).alias("null_to_directional")
    )


@query("j27_version_pairs", sql_with(PAIRS, "SELECT * FROM pairs"))
def _(spark, d):
    return _pairs(spark, d)


@query("j28_stacked_pairs", sql_with(PAIRS, "SELECT paper_id, 1 AS pub, direction_pub AS direction FROM pairs UNION ALL SELECT paper_id, 0, direction_draft FROM pairs"))
def _(spark, d):
    rows = F.array(
        F.struct(F.lit(1).alias("pub"), F.col("direction_pub").alias("direction")),
        F.struct(F.lit(0).alias("pub"), F.col("direction_draft").alias("direction")),
    )
    return _pairs(spark, d).select("paper_id", F.inline(rows))


@query("j29_content_gate", sql_with(BOTH, f"""
SELECT wp, len(list_filter(list_distinct({sql_title_words("d.title", lx.STOP_WORDS_SHORT)}), lambda v: length(v) >= 4 AND contains({sql_norm("a.abstract", lx.STOP_WORDS_SHORT)}, v))) >= 2 AS pass
FROM drafts d JOIN articles a ON a.paper_id = d.wp"""))
def _(spark, d):
    j = drafts(spark, d).select("wp", "title").join(articles(spark, d).select(F.col("paper_id").alias("wp"), "abstract"), "wp")
    return j.select("wp", ru.supports_title("title", "abstract").alias("pass"))


# ---------------------------------------------------------------- candidates per key
@query("w1_best_candidate", sql_with(STATS, "SELECT subset, paper_id, event_id, z FROM stats QUALIFY row_number() OVER (PARTITION BY subset, paper_id ORDER BY z DESC, event_id) = 1"))
def _(spark, d):
    s = stats(spark, d).select("subset", "paper_id", "event_id", "z")
    return best(s, ["subset", "paper_id"], [F.desc("z"), F.col("event_id")])


@query("w2_top_candidates", sql_with(STATS, "SELECT subset, event_id, z, row_number() OVER (PARTITION BY subset ORDER BY z DESC, event_id) AS rank FROM stats QUALIFY rank <= 20"))
def _(spark, d):
    s = stats(spark, d).select("subset", "event_id", "z")
    return top_k(s, ["subset"], [F.desc("z"), F.col("event_id")], 20, "rank")
