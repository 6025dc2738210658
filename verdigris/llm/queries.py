"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import weak_labels
from verdigris.llm.collocations import collocations
from verdigris.llm.common import table
from verdigris.llm.decontamination import find_leaks
from verdigris.llm.filter_audit import audit
from verdigris.llm.jaccard_join import link
from verdigris.llm.language_id import fit, predict
from verdigris.llm.line_runs import drop_shared_lines
from verdigris.llm.packing import pack
from verdigris.llm.pivot_index import search
from verdigris.llm.quotations import conversations
from verdigris.llm.recompression import digest_repeats
from verdigris.llm.token_counts import count_tokens
from verdigris.llm.warc import archive_folder, read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every fiftieth vector by whole-number inner product."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op8_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their 5-word shingles; tests compare all pairs."""
    return link(table(spark, sf_dir, "documents"), shingle=5, percent=75)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; SQL cannot express merges, tests compare with the library."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of them; tests check held-out accuracy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(2)) == 2
    model = fit(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    found = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, in reply order; tests check links and order on small conversations."""
    return conversations(table(spark, sf_dir, "conversations"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with score and place; tests align every pair of a small corpus."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "last_word")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad quality and toxicity of every document by weak labels; tests check held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = weak_labels.fit(docs, table(spark, sf_dir, "labels"))
    return weak_labels.score(docs, model).select("doc_id", "bad_quality", "toxic", "kept")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that a document of smaller id has; tests compare with all windows."""
    found = digest_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; SQL cannot read archives, tests check the round trip."""
    pages = table(spark, sf_dir, "pages")
    found = read_archives(write_archives(pages, archive_folder(pages)), keep_payload=False)
    return found.drop("url", "html")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; tests check ids, cuts and places."""
    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three documents share, but where the largest id holds them."""
    found = drop_shared_lines(table(spark, sf_dir, "documents"), least_docs=3, least_chars=20)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words in every language."""
    return collocations(table(spark, sf_dir, "documents"), least=30, longest=4, covered=80, top=2000)


ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
t AS (SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT lang, ws, row_number() OVER () AS piece FROM w) q),
s AS (SELECT lang, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d FROM t WINDOW o AS (PARTITION BY piece ORDER BY i)),
g AS (
  SELECT lang, 1 AS k, a AS phrase FROM s UNION ALL SELECT lang, 2, a || ' ' || b FROM s WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM s WHERE c IS NOT NULL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM s WHERE d IS NOT NULL
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, l.f AS l, r.f AS r, h AS cut, CAST(CAST(2000000 AS HUGEINT) * c.f // (l.f + r.f) AS BIGINT) AS score
  FROM f c JOIN range(1, 4) x(h) ON h < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:h], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[h + 1 :], ' ')
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, f AS whole, array_to_string(string_split(phrase, ' ')[CAST(s AS INTEGER) : CAST(s + m - 1 AS INTEGER)], ' ') AS phrase
  FROM f, range(2, 4) y(m), range(1, 4) z(s) WHERE m < k AND s + m - 1 <= k
), covered AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN inner_parts t ON t.lang = f.lang AND t.phrase = f.phrase WHERE 100 * t.whole >= 80 * f.f)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM lowest ANTI JOIN covered USING (lang, phrase) JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five document filters remove under every order, for every language."""
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
first AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY 1),
marks AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT w.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(w.doc_id > first_id, false)} AS fails
  FROM w JOIN first USING (text) LEFT JOIN marks USING (doc_id)
), x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, CAST(s AS INTEGER) AS step, substr(o, CAST(s AS INTEGER), 1) AS this, substr(o, 1, CAST(s AS INTEGER) - 1) AS before FROM orders, range(1, 6) r(s)),
sets AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
told AS (
  SELECT part, o AS filter_order, step, this, n, good, toxic, fails[this] AS bad,
    len(list_filter(string_split(before, ''), lambda v: v <> '' AND fails[v])) > 0 AS gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda v: fails[v])) AS bad_count
  FROM sets, steps
), tally AS (
  SELECT part, filter_order, step, this, sum(n) FILTER (NOT bad AND NOT gone) AS kept, sum(n) FILTER (bad AND NOT gone) AS removed,
    sum(n) FILTER (bad AND gone) AS redundant, sum(n) FILTER (bad AND bad_count = 1) AS unique_fails,
    sum(n) FILTER (bad AND NOT gone AND good) AS good_lost, sum(n) FILTER (bad AND NOT gone AND toxic) AS toxic_lost
  FROM told GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, this), 0) AS BIGINT) AS shapley
FROM tally
"""
