"""Scans, typed views and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: logical schemas ------------------------------------------------------
SCHEMAS = {
    "raw_drafts": "wp_number string, title string, authors string, year int, month int, abstract string, programs string, url string",
    "raw_articles": "doi string, title string, authors string, affiliations string, year int, pub_date string, volume string, issue string, first_page string, last_page string, abstract string, jel_codes string, citations int, journal string, openalex_id string",
    "inscope_papers": "paper_id string, source string, year int, title string, abstract string, in_scope boolean, scope_conf string, scope_reason string, keyword_hit boolean",
    "coded_direction": "paper_id string, direction tinyint, confidence string, rationale string, human_code tinyint, agreed boolean",
    "analysis_dataset": "paper_id string, source string, published_top3 boolean, journal string, year int, title string, abstract string, direction tinyint, positive boolean, negative boolean, nber_wp_number string, match_score double, match_quality string, match_source string, id_strategy string, quasi_exp int, top_institution int, n_authors smallint, abstract_len int, primary_tstat double",
    "tstats": "table string, variable string, coef double, se double, z_abs double, stars string, spec string, paper_title string, journal string, year int, direction int, positive boolean, negative boolean, note string, estimated boolean",
}
# ---- fixed values: column codes of citation-index exports --------------------------------
EXPORT_COLUMNS = {
    "TI": "title", "AU": "authors", "PY": "year", "VL": "volume", "IS": "issue",
    "AB": "abstract", "ID": "jel_codes", "TC": "citations", "DI": "doi", "SO": "journal",
}
EXPORT_DEFAULTS = (
    "doi affiliations pub_date volume issue first_page last_page jel_codes openalex_id"
).split()


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def view_or_stub(spark: SparkSession, name: str, path: str, schema: str) -> DataFrame:
    """Named view over a parquet path, or an empty typed one where nothing is there yet."""
    df = (
        spark.read.schema(schema).parquet(path)
        if path_exists(spark, path)
        else spark.createDataFrame([], schema)
    )
    df.createOrReplaceTempView(name)
    return df


def rate_by_direction_function(spark: SparkSession, view: str, name: str = "pub_rate_by_direction") -> None:
    """Registers a SQL table function: rate and count of one direction code."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(v INT)
        RETURNS TABLE (pub_rate DOUBLE, n BIGINT)
        RETURN SELECT avg(CAST(published AS INT)), count(*) FROM {view} WHERE direction = v"""
    )


def select_existing(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Wanted columns in order, missing ones as typed nulls."""
    return df.select(
        *[
            F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)
            for c, t in wanted.items()
        ]
    )


def read_export_csv(spark: SparkSession, path: str, journal: str, years: tuple[int, int]) -> DataFrame:
    """Citation-index export: known columns renamed, numbers coerced, years kept in range."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", nullValue="\u0000")
    present = {c: n for c, n in EXPORT_COLUMNS.items() if c in raw.columns}
    df = raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in present.items()])
    for c in ("year", "citations"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).try_cast("int"))
    if "journal" not in df.columns:
        df = df.withColumn("journal", F.lit(journal))
    df = df.withColumns({c: F.lit("") for c in EXPORT_DEFAULTS if c not in df.columns})
    return df.filter(F.col("year").between(*years))


def write_statistics_json(df: DataFrame, path: str, key: str, most: int = 500) -> None:
    """Statistics as JSON lines {key, items}: many papers to a file, a paper of many statistics on several lines of
    about `most` each, so that neither a line nor a group grows with a paper."""
    fields = [c for c in df.columns if c != key]
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / most).alias("__parts"))
    dealt = df.join(sizes, key).withColumn("__part", F.pmod(F.xxhash64(*fields), F.col("__parts")))
    lines = dealt.groupBy(key, "__part").agg(F.collect_list(F.struct(*fields)).alias("items"))
    lines.select(F.to_json(F.struct(key, "items")).alias("value")).write.text(path)


def read_statistics_json(spark: SparkSession, path: str, papers: DataFrame, key: str, key_type: str = "string") -> DataFrame:
    """One row per statistic of the lines that write_statistics_json leaves; fields missing in an object come from
    the paper."""
    inside = ", ".join(f"{c.strip().replace(' ', ':', 1)}" for c in SCHEMAS["tstats"].split(","))
    lines = spark.read.schema(f"{key} {key_type}, items array<struct<{inside}>>").json(path)
    return with_paper_defaults(lines.select(key, F.inline("items")), papers, key)


def read_landed_statistics(spark: SparkSession, path: str, papers: DataFrame, key: str) -> DataFrame:
    """The same from one JSON array per paper, in a file named by its id, as extraction leaves them."""
    raw = spark.read.schema(SCHEMAS["tstats"]).json(path, multiLine=True)
    return with_paper_defaults(raw.withColumn(key, F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)), papers, key)


def with_paper_defaults(raw: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    known = [c for c in ("paper_title", "journal", "year", "direction", "positive", "negative") if c in papers.columns]
    out = raw.join(papers.select(key, *[F.col(c).alias("__p_" + c) for c in known]), key, "left")
    filled = {c: F.coalesce(F.col(c), F.col("__p_" + c)) for c in known}
    return out.withColumns(filled | {"stars": blank_words(F.col("stars"))}).drop(*["__p_" + c for c in known])


def blank_words(c):
    """'None', 'nan' and missing become the empty text."""
    return F.when(c.isNull() | c.isin("None", "nan"), F.lit("")).otherwise(c)


def read_text_pieces(spark: SparkSession, path: str, size: int = 1_000_000) -> DataFrame:
    """(file, piece, text): text files in pieces of at most about 2 * size characters, numbered from 0 in file order.

    Every line keeps its line feed, and a line longer than `size` is cut, so the pieces of a file joined are the file.
    Lines are read by splits; within a split their order is the order of reading, and splits are ordered by where
    they begin, so no task holds a whole file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.concat("value", F.lit("\n")).alias("value")
    )
    starts = F.sequence(F.lit(0), F.floor((F.length("value") - 1) / size).cast("int"))
    bits = lines.select("file", "block", "line", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("value"), i * size + 1, F.lit(size)))).alias("bit", "value"))
    upto = Window.partitionBy("file", "block").orderBy("line", "bit").rowsBetween(Window.unboundedPreceding, -1)
    placed = bits.withColumn("part", F.floor(F.coalesce(F.sum(F.length("value")).over(upto), F.lit(0)) / size))
    joined = placed.groupBy("file", "block", "part").agg(F.sort_array(F.collect_list(F.struct("line", "bit", "value"))).alias("bits"))
    numbered = joined.withColumn("piece", F.row_number().over(Window.partitionBy("file").orderBy("block", "part")) - 1)
    return numbered.select("file", "piece", F.array_join(F.transform("bits", lambda x: x["value"]), "").alias("text"))


def union_sources(sources: list[tuple[str, DataFrame | None, dict[str, str]]]) -> DataFrame:
    """Sources brought to one shape; each is (label, table or None, {target: source column})."""
    out = None
    for label, df, names in sources:
        if df is None:
            continue
        one = df.select(F.lit(label).alias("source"), *[F.col(s).alias(t) for t, s in names.items()])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_result_csv(df: DataFrame, path: str) -> bool:
    """Result tables are small, so they become one file; nothing is written for an empty one."""
    if df.isEmpty():
        return False
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return True


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions present in df."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
