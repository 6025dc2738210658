"""Landed API records to flat rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as tx

DRAFT_RECORD = (
    "url string, title string, displaydate string, authors array<string>, abstract string"
)
ARTICLE_RECORD = (
    "id string, doi string, display_name string, publication_year int, publication_date string, "
    "cited_by_count int, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, "
    "authorships array<struct<author:struct<display_name:string>,"
    "institutions:array<struct<display_name:string>>,raw_affiliation_string:string>>, "
    "abstract_inverted_index map<string,array<int>>, concepts array<struct<display_name:string>>"
)
LOCATION_RECORD = (
    "best_oa_location struct<url:string,pdf_url:string,landing_page_url:string>, "
    "locations array<struct<url:string,pdf_url:string,landing_page_url:string>>, "
    "open_access struct<oa_url:string>, "
    "primary_location struct<pdf_url:string,landing_page_url:string>"
)
RELATION_RECORD = "relation map<string,array<struct<`id-type`:string,id:string>>>, reference array<struct<DOI:string>>"
OPEN_RECORD = (
    "oa_locations array<struct<url:string,url_for_pdf:string,url_for_landing_page:string>>, "
    "best_oa_location struct<url:string,url_for_pdf:string,url_for_landing_page:string>"
)
VERSION_RECORD = "doi string, locations array<struct<doi:string,url:string,landing_page_url:string>>"
#: Relations that lead from an article to its draft, and from a draft to its article.
TO_DRAFT = ["has-preprint", "is-expression-of", "is-based-on"]
TO_ARTICLE = ["is-preprint-of", "has-expression-in", "is-version-of"]


def draft_rows(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Working-paper search records; those without a year drop out."""
    r = df.select(F.from_json(json_col, DRAFT_RECORD).alias("r")).select("r.*")
    url = tx.text_or_empty("url")
    return r.select(
        tx.paper_id_from_url("url").alias("wp_number"),
        F.trim(tx.text_or_empty("title")).alias("title"),
        F.array_join(F.transform("authors", tx.strip_tags), "; ").alias("authors"),
        tx.display_year("displaydate").alias("year"),
        tx.display_month("displaydate").alias("month"),
        tx.strip_tags("abstract").alias("abstract"),
        F.lit("").alias("programs"),
        F.when(url.startswith("/"), F.concat(F.lit("https://www.nber.org"), url)).otherwise(url).alias("url"),
    ).filter(F.col("year").isNotNull())


def article_rows(df: DataFrame, journal: str, json_col: str = "json") -> DataFrame:
    """Journal-article records: nested authors, institutions, concepts and inverted abstracts."""
    r = df.select(F.from_json(json_col, ARTICLE_RECORD).alias("r")).select("r.*")
    concepts = F.filter(
        F.transform(F.slice("concepts", 1, 8), lambda c: c["display_name"]),
        lambda n: n.isNotNull() & (n != ""),
    )
    return r.select(
        tx.doi_clean("doi").alias("doi"),
        F.trim(tx.text_or_empty("display_name")).alias("title"),
        F.coalesce(tx.author_names("authorships"), F.lit("")).alias("authors"),
        F.coalesce(tx.affiliation_names("authorships"), F.lit("")).alias("affiliations"),
        F.col("publication_year").alias("year"),
        tx.text_or_empty("publication_date").alias("pub_date"),
        tx.text_or_empty("biblio.volume").alias("volume"),
        tx.text_or_empty("biblio.issue").alias("issue"),
        tx.inverted_index_text("abstract_inverted_index").alias("abstract"),
        F.coalesce(F.array_join(concepts, "; "), F.lit("")).alias("jel_codes"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"),
        F.lit(journal).alias("journal"),
        F.coalesce(tx.first_affiliation("authorships"), F.lit("")).alias("first_affiliation"),
        tx.text_or_empty("id").alias("openalex_id"),
    )


def _present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _all_of(items: Column, fields) -> Column:
    """The fields of every item in order; none where the list is missing."""
    return F.coalesce(F.flatten(F.transform(items, fields)), F.array().cast("array<string>"))


def article_location_ids(rec: Column) -> Column:
    """Working-paper ids of an article record in order: best open location, every location, the open-access URL, the
    primary location."""
    fields = lambda loc: F.array(loc["url"], loc["pdf_url"], loc["landing_page_url"])
    primary = rec["primary_location"]
    last = F.array(rec["open_access"]["oa_url"], F.coalesce(F.nullif(primary["pdf_url"], F.lit("")), primary["landing_page_url"]))
    return _present(F.transform(F.concat(fields(rec["best_oa_location"]), _all_of(rec["locations"], fields), last), tx.paper_id_from_text))


def open_location_ids(rec: Column) -> Column:
    """Working-paper ids of an open-access record: every location, then the best one."""
    fields = lambda loc: F.array(loc["url"], loc["url_for_pdf"], loc["url_for_landing_page"])
    return _present(F.transform(F.concat(_all_of(rec["oa_locations"], fields), fields(rec["best_oa_location"])), tx.paper_id_from_text))


def related_dois(rec: Column, kinds: list[str]) -> Column:
    """DOIs that the relations of the given kinds name, in that order."""
    lists = [F.coalesce(rec["relation"][k], F.array().cast("array<struct<`id-type`:string,id:string>>")) for k in kinds]
    return F.transform(F.filter(F.concat(*lists), lambda x: x["id-type"] == "doi"), lambda x: x["id"])


def relation_draft_ids(rec: Column, references: int = 30) -> Column:
    """Working-paper ids of a relation record: its relations, then its first `references` references with a draft's
    DOI prefix."""
    cited = F.transform(F.slice(F.coalesce(rec["reference"], F.array().cast("array<struct<DOI:string>>")), 1, references), lambda x: x["DOI"])
    drafts = F.filter(cited, lambda x: x.contains("10.3386"))
    return _present(F.transform(F.concat(related_dois(rec, TO_DRAFT), drafts), tx.paper_id_from_text))


def _journal_doi(value: Column) -> Column:
    clean = F.trim(F.lower(tx.doi_clean(value)))
    return F.when((clean != "") & ~clean.contains("nber.org"), clean)


def relation_article_dois(rec: Column) -> Column:
    return F.transform(related_dois(rec, TO_ARTICLE), lambda x: F.trim(F.lower(x)))


def version_article_dois(rec: Column) -> Column:
    """Article DOIs of a draft's version record: per location its DOI, then those inside its URLs; the record's own
    DOI last."""
    fields = lambda loc: F.array(_journal_doi(loc["doi"]), tx.doi_in_text(loc["url"]), tx.doi_in_text(loc["landing_page_url"]))
    return _present(F.concat(_all_of(rec["locations"], fields), F.array(_journal_doi(rec["doi"]))))


#: Record shapes: schema, the ids a record names in order, and whether it belongs to an article.
SHAPES = {
    "article": (LOCATION_RECORD, article_location_ids, True),
    "relation": (RELATION_RECORD, relation_draft_ids, True),
    "open": (OPEN_RECORD, open_location_ids, True),
    "draft relation": (RELATION_RECORD, relation_article_dois, False),
    "draft versions": (VERSION_RECORD, version_article_dois, False),
}


def location_edges(records: DataFrame, articles: DataFrame, drafts: DataFrame) -> DataFrame:
    """(doi, wp_number, shape): links between articles(doi) and drafts(wp_number) that landed records(shape, key,
    json) name, all from article to draft.

    An article's record, keyed by its DOI, leads to the first working paper it names, if that is among the drafts. A
    draft's record, keyed by its number, is looked up in reverse: it leads to the first DOI it names that is among the
    articles."""
    forward, backward = [], []
    for shape, (schema, named, of_article) in SHAPES.items():
        rec = F.from_json("json", schema)
        rows = records.filter(F.col("shape") == shape).select("key", "shape", rec.alias("r")).select("key", "shape", named(F.col("r")).alias("ids"))
        if of_article:
            forward.append(rows.select(F.col("key").alias("doi"), F.get("ids", F.lit(0)).alias("wp_number"), "shape").filter("wp_number is not null"))
        else:
            backward.append(rows.select(F.col("key").alias("wp_number"), "shape", F.posexplode("ids").alias("at", "doi")))
    there = reduce(DataFrame.unionByName, forward).join(articles.select("doi").distinct(), "doi", "left_semi").join(drafts.select("wp_number").distinct(), "wp_number", "left_semi")
    back = reduce(DataFrame.unionByName, backward).join(articles.select("doi").distinct(), "doi", "left_semi").join(drafts.select("wp_number").distinct(), "wp_number", "left_semi")
    first = back.groupBy("wp_number", "shape").agg(F.min_by("doi", "at").alias("doi"))
    return there.unionByName(first.select("doi", "wp_number", "shape")).select("doi", "wp_number", "shape")
