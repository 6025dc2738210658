"""Windows (W), ordering (O), set operations (U) and incremental work (T)."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.functions import rules as ru
from verdigris.functions import text as tx
from verdigris.operators import windows as wi
from verdigris.plans.base import (
    ARTICLES, DRAFTS, PAPERS, STATS, articles, drafts, papers, r4, s4, sql_hash, sql_title_words, sql_with, stats, table,
)
from verdigris.plans.projections import LOCAL_AMBIGUOUS, LOCAL_PHRASES
from verdigris.plans.registry import query
from verdigris.plans.textual import SQL_TOPIC
from verdigris.session import scratch_path
from verdigris.sources.tables import replace_partitions
from verdigris.streaming import incremental as inc


@query("w3_keep_first_and_last", sql_with(PAPERS, """
SELECT title, min(paper_id) AS first_id, max(paper_id) AS last_id FROM papers GROUP BY 1"""))
def _(spark, d):
    p = papers(spark, d).select("title", "paper_id")
    first = wi.best(p, ["title"], [F.asc("paper_id")]).withColumnRenamed("paper_id", "first_id")
    last = wi.best(p, ["title"], [F.desc("paper_id")]).withColumnRenamed("paper_id", "last_id")
    return first.join(last, "title")


@query("w4_dedupe_normalised", sql_with(PAPERS, """
SELECT min(paper_id) AS paper_id, year || '|' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM papers GROUP BY 2"""))
def _(spark, d):
    p = papers(spark, d).select("paper_id", tx.dedupe_key("year", "title").alias("k"))
    return wi.best(p, ["k"], [F.asc("paper_id")])


@query("w5_dedupe_statistics", sql_with(STATS, "SELECT tbl, variable, round(coalesce(z, 0) + 1e-9::DOUBLE, 2) AS z2, min(event_id) AS event_id FROM stats GROUP BY 1, 2, 3"))
def _(spark, d):
    s = stats(spark, d).select("tbl", "variable", r4(F.coalesce("z", F.lit(0.0)), 2).alias("z2"), "event_id")
    return wi.best(s, ["tbl", "variable", "z2"], [F.asc("event_id")])


# a document's lines stand for its pages
LINES = """
lines AS (SELECT doc_id, page - 1 AS page, pages[page] AS text FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents) a) b),
scored AS (SELECT *, len(regexp_extract_all(text, ',')) AS score FROM lines)"""


def _pages(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return p.withColumn("score", F.regexp_count("text", F.lit(",")))


def page_window(pages, doc, page, score, before=4, after=8, block=8, margin=2):
    """Pages around the best-scoring one; where none scores, around the best block of pages.

    The best page is an ordered maximum per document, so it combines before the shuffle."""
    top = pages.groupBy(doc).agg(
        F.max(F.struct(F.col(score), (-F.col(page)).alias("neg"))).alias("m"), F.max(page).alias("last")
    )
    # without any score every block ties, and the first one is taken
    start = F.when(F.col("m")[score] > 0, F.greatest(-F.col("m.neg") - before, F.lit(0))).otherwise(F.lit(0))
    end = F.when(F.col("m")[score] > 0, -F.col("m.neg") + after).otherwise(F.lit(block + margin))
    spans = top.select(doc, start.alias("lo"), end.alias("hi"))
    return pages.join(spans, doc).filter((F.col(page) >= F.col("lo")) & (F.col(page) < F.col("hi"))).drop("lo", "hi")


@query("w6_page_window", sql_with(LINES, """
, top AS (SELECT doc_id, arg_max(page, score * 1000000 - page) AS best, max(score) AS m FROM scored GROUP BY 1)
SELECT doc_id, page FROM scored JOIN top USING (doc_id) WHERE page >= CASE WHEN m > 0 THEN greatest(best - 4, 0) ELSE 0 END AND page < CASE WHEN m > 0 THEN best + 8 ELSE 10 END"""))
def _(spark, d):
    return page_window(_pages(spark, d), "doc_id", "page", "score").select("doc_id", "page")


@query("w7_text_chunks", """
SELECT doc_id, CAST(s / 1800 AS INT) AS chunk_no, md5(substr(text, s + 1, 2000)) AS h FROM (
  SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200 - 1, 0) + 1, 1800)) AS s FROM documents) q""")
def _(spark, d):
    c = tx.chunk_table(table(spark, d, "documents").select("doc_id", "text"), "text", 2000, 200)
    return c.select("doc_id", "chunk_no", F.md5("chunk").alias("h"))


@query("w8_next_sibling", sql_with(LINES, """
SELECT doc_id, page, md5(lead(text) OVER (PARTITION BY doc_id ORDER BY page)) AS next_h, last_value(CASE WHEN length(text) < 60 THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS heading FROM lines"""))
def _(spark, d):
    # a document's lines come from one row, so its group is bounded by that row
    w = Window.partitionBy("doc_id").orderBy("page")
    p = _pages(spark, d)
    return p.select(
        "doc_id", "page", F.md5(F.lead("text").over(w)).alias("next_h"),
        F.last(F.when(F.length("text") < 60, F.col("page")), True).over(w).alias("heading"),
    )


def accumulate(limit: int):
    """Group numbers of scores gathered until their sum passes a limit, when a new group begins: one running
    sum along each document's own array."""

    @F.pandas_udf("array<int>")
    def groups(scores: pd.Series) -> pd.Series:
        out = []
        for own in scores:
            total, group, found = 0, 0, []
            for s in own:
                total, group = (s, group + 1) if total > limit else (total + s, group)
                found.append(group)
            out.append(found)
        return pd.Series(out)

    return groups


@query("w9_score_batches", sql_with(LINES, """
, p AS (SELECT doc_id, page, score, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM scored WHERE score > 0),
g AS (SELECT doc_id, page, score, r, score AS total, 0 AS batch FROM p WHERE r = 1 UNION ALL
  SELECT p.doc_id, p.page, p.score, p.r, CASE WHEN g.total > 30 THEN p.score ELSE g.total + p.score END, g.batch + CASE WHEN g.total > 30 THEN 1 ELSE 0 END
  FROM g JOIN p ON p.doc_id = g.doc_id AND p.r = g.r + 1)
SELECT doc_id, batch, min(page) AS first_page, max(page) AS last_page, sum(score) AS score FROM g GROUP BY 1, 2""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    # pages without score are in no batch
    score = lambda t: F.regexp_count(t, F.lit(","))
    pages = F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("page"), score(t).alias("score"))), lambda x: x["score"] > 0)
    docs = table(spark, d, "documents").select("doc_id", pages.alias("p")).withColumn("g", accumulate(30)(F.col("p.score")))
    rows = docs.select("doc_id", F.explode(F.arrays_zip("p", "g")).alias("x"))
    return rows.groupBy("doc_id", F.col("x.g").alias("batch")).agg(
        F.min("x.p.page").alias("first_page"), F.max("x.p.page").alias("last_page"), F.sum("x.p.score").alias("score")
    )


@query("w10_sample_per_stratum", sql_with(PAPERS, f"""
SELECT paper_id, source, direction FROM papers QUALIFY row_number() OVER (PARTITION BY source, direction ORDER BY {sql_hash("42", "paper_id")}, paper_id) <= 5"""))
def _(spark, d):
    return wi.sample_per_stratum(papers(spark, d), ["source", "direction"], 5, 42, "paper_id").select("paper_id", "source", "direction")


@query("w11_two_stratum_sample", sql_with(PAPERS, f"""
, r AS (SELECT paper_id, negative, row_number() OVER (PARTITION BY negative ORDER BY {sql_hash("7", "paper_id")}, paper_id) AS rk FROM papers),
q AS (SELECT least(count(*), 30) AS taken FROM r WHERE negative),
k AS (SELECT paper_id FROM r, q WHERE (negative AND rk <= 30) OR (NOT negative AND rk <= 60 - taken))
SELECT paper_id, row_number() OVER (ORDER BY {sql_hash("7-shuffle", "paper_id")}, paper_id) AS position FROM k"""))
def _(spark, d):
    p = papers(spark, d).select("paper_id", "negative")
    return wi.sample_two_strata(p, F.col("negative"), 60, 7, "paper_id").select("paper_id", "position")


# ---------------------------------------------------------------- ordering
@query("o1_sorted", sql_with(PAPERS, "SELECT year, paper_id FROM papers ORDER BY year, paper_id"))
def _(spark, d):
    return papers(spark, d).select("year", "paper_id").orderBy("year", "paper_id")


@query("o2_limited", sql_with(PAPERS, "SELECT year, paper_id FROM papers ORDER BY year DESC, paper_id LIMIT 25"))
def _(spark, d):
    return papers(spark, d).select("year", "paper_id").orderBy(F.desc("year"), "paper_id").limit(25)


@query("o3_random_sample", sql_with(PAPERS, f"SELECT paper_id FROM papers ORDER BY {sql_hash('42', 'paper_id')}, paper_id LIMIT 100"))
def _(spark, d):
    return wi.sample_rows(papers(spark, d).select("paper_id"), 100, 42, "paper_id")


@query("o4_longest_words", sql_with(PAPERS, f"""
SELECT paper_id, array_to_string(list_transform(list_sort(list_transform(list_distinct({sql_title_words("title")}), lambda w: lpad(CAST(100000 - length(w) AS VARCHAR), 6, '0') || w))[1:4], lambda s: substr(s, 7)), ' ') AS k FROM papers"""))
def _(spark, d):
    return papers(spark, d).select("paper_id", F.array_join(tx.longest_words("title"), " ").alias("k"))


@query("o5_cut_before_rank", sql_with(STATS, "SELECT paper_id, event_id, z FROM stats WHERE z >= 30 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY z DESC, event_id) = 1"))
def _(spark, d):
    s = stats(spark, d).filter("z >= 30").select("paper_id", "event_id", "z")
    return wi.best(s, ["paper_id"], [F.desc("z"), F.col("event_id")])


@query("o6_sorted_frequencies", sql_with(PAPERS, "SELECT direction, count(*) AS n FROM papers GROUP BY 1 ORDER BY 1"))
def _(spark, d):
    return papers(spark, d).groupBy("direction").agg(F.count("*").alias("n")).orderBy("direction")


# ---------------------------------------------------------------- set operations
@query("u1_union_by_name", "SELECT doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def _(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return a.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("u2_distinct_ids", sql_with(STATS, "SELECT DISTINCT paper_id FROM stats"))
def _(spark, d):
    return stats(spark, d).select("paper_id").distinct()


@query("u3_intersection", "SELECT doc_id AS id FROM documents INTERSECT SELECT page_id FROM pages")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).intersect(table(spark, d, "pages").select("page_id"))


@query("u4_difference", "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).subtract(table(spark, d, "labels").select("doc_id"))


# ---------------------------------------------------------------- incremental work
@query("t1_resume_last_write", """
SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).scalar()
    old = wi.best(e.filter(F.col("event_id") <= half), ["user_id"], [F.desc("event_id")])
    return inc.last_write_wins(old, e.filter(F.col("event_id") > half), "user_id", "event_id")


@query("t1_streamed_upsert", """
SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def _(spark, d):
    landing, target, ckpt = (scratch_path(spark, n) for n in ("landing", "upserted", "offsets"))
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    # four files that share users, one to a micro-batch: all but the first merge with what is there
    e.repartition(4).write.parquet(landing)
    inc.stream_upsert(spark, landing, e.schema, "user_id", "event_id", target, ckpt, files_per_batch=1).awaitTermination()
    return inc.read_upserted(spark, target).select("user_id", "event_type", "event_id")


@query("t2_new_hits", f"SELECT doc_id FROM (SELECT doc_id, lower(text) AS t FROM documents) q WHERE {SQL_TOPIC} AND doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    docs = table(spark, d, "documents")
    return inc.new_hits(docs, ru.topic_hit("text", LOCAL_PHRASES, LOCAL_AMBIGUOUS), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("t3_replace_years", sql_with(PAPERS, "SELECT year, CASE WHEN year >= 2020 THEN 'new' ELSE 'old' END AS v, count(*) AS n FROM papers GROUP BY ALL"))
def _(spark, d):
    path = scratch_path(spark, "years")
    p = papers(spark, d).select("paper_id", "year")
    replace_partitions(p.withColumn("v", F.lit("old")), path, "year")
    replace_partitions(p.filter("year >= 2020").withColumn("v", F.lit("new")), path, "year")
    return spark.read.parquet(path).groupBy("year", "v").agg(F.count("*").alias("n"))


@query("t4_relabel", sql_with(PAPERS, "SELECT paper_id, CASE WHEN paper_id % 6 = 0 THEN 0 ELSE direction END AS direction FROM papers WHERE direction IS NOT NULL"))
def _(spark, d):
    p = papers(spark, d).filter("direction is not null").select("paper_id", "direction")
    updated, _ = inc.relabel(p, p.filter("paper_id % 6 = 0").withColumn("direction", F.lit(0)), "paper_id", "direction")
    return updated


@query("t5_negative_cache", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END AS value, doc_id % 3 = 2 AS fetch, doc_id % 3 <> 1 AS retry FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    m = F.col("doc_id") % 3
    cache = docs.filter(m != 2).select("doc_id", F.when(m == 0, "").otherwise(F.col("source")).alias("value"))
    fetch = inc.to_look_up(docs, cache, "doc_id", "value").select("doc_id", F.lit(True).alias("fetch"))
    retry = inc.to_look_up(docs, cache, "doc_id", "value", retry_misses=True).select("doc_id", F.lit(True).alias("retry"))
    full = inc.cached_value(docs, cache, "doc_id", "value").join(fetch, "doc_id", "left").join(retry, "doc_id", "left")
    return full.select("doc_id", "value", F.coalesce("fetch", F.lit(False)).alias("fetch"), F.coalesce("retry", F.lit(False)).alias("retry"))
