"""Update rules, cascades and identifier links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as tx
from verdigris.operators.windows import best


def fill_missing(df: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """New text where the old one is null or blank."""
    fresh = new.select(key, F.col(col).alias("__new"))
    missing = F.trim(tx.text_or_empty(col)) == ""
    return df.join(fresh, key, "left").withColumn(
        col, F.when(missing & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col(col))
    ).drop("__new")


def keep_longer(df: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """New text where it is longer than the old one."""
    fresh = new.select(key, F.col(col).alias("__new"))
    longer = F.length(tx.text_or_empty("__new")) > F.length(tx.text_or_empty(col))
    return df.join(fresh, key, "left").withColumn(
        col, F.when(longer, F.col("__new")).otherwise(F.col(col))
    ).drop("__new")


def first_source_wins(candidates: list[DataFrame], key: str, tie: list[Column]) -> DataFrame:
    """One row per key from the first table holding it; table order is priority."""
    out = None
    for i, c in enumerate(candidates):
        one = c.withColumn("priority", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return best(out, [key], [F.col("priority"), *tie])


def mark_linked(df: DataFrame, links: DataFrame, key: str, flag: str) -> DataFrame:
    """True where the key occurs among the links."""
    ids = links.select(F.col(links.columns[0]).alias(key)).dropna().distinct().withColumn("__hit", F.lit(True))
    return df.join(ids, key, "left").withColumn(flag, F.col("__hit").isNotNull()).drop("__hit")


def doi_suffix(c) -> Column:
    return F.lower(F.element_at(F.split(tx.text_or_empty(c), "/"), -1))


def link_by_file_name(files: DataFrame, papers: DataFrame) -> DataFrame:
    """files(file), papers(paper_id, journal): file stems that are a DOI suffix, or hold the
    article number of a DOI without its punctuation."""
    stem = F.lower("file")
    by_suffix = files.filter(stem.rlike(r"^hh[a-z0-9]+$")).withColumn("k", stem).join(
        papers.filter("journal = 'RFS'").select(doi_suffix("paper_id").alias("k"), "paper_id"), "k"
    ).select("file", "paper_id", F.lit("suffix").alias("how"))
    # a DOI ends with the article number, so equality of the digits after the issue-number prefix
    # stands for the substring test
    number = F.regexp_extract(stem, r"s0304405x([0-9a-z]+)", 1)
    bare = F.regexp_replace(F.lower("paper_id"), r"[-()]", "")
    by_number = files.withColumn("k", number).filter("k != ''").join(
        papers.filter("journal = 'JFE'").select(
            F.regexp_extract(bare, r"s0304405x([0-9a-z]+)", 1).alias("k"), "paper_id"
        ), "k"
    ).select("file", "paper_id", F.lit("number").alias("how"))
    return first_source_wins([by_suffix, by_number], "file", [F.col("paper_id")]).drop("priority")
