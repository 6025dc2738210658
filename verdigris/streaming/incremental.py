"""Resumable work: only new records are processed, and the last write per id wins.

The batch forms are plain joins. The streaming forms read a landing folder with readStream and
upsert each micro-batch; a re-run of a batch rewrites the same rows, so retries are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.windows import best


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def last_write_wins(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version per key; of equal versions the one with the greater hash of its values."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return best(rows, [key], [F.desc(version), F.desc(F.xxhash64(*sorted(rows.columns)))])


def new_hits(papers: DataFrame, hit: Column, labelled: DataFrame, key: str) -> DataFrame:
    """Papers that satisfy a rule now and were not labelled before."""
    return unprocessed(papers.filter(hit), labelled, key)


def relabel(old: DataFrame, new: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Table with replaced labels, and an audit of old against new label."""
    fresh = new.select(key, F.col(label).alias("__new"))
    joined = old.join(fresh, key, "left")
    updated = joined.withColumn(label, F.coalesce("__new", label)).drop("__new")
    audit = (
        joined.filter(F.col("__new").isNotNull())
        .groupBy(F.col(label).alias("old"), F.col("__new").alias("new"))
        .agg(F.count("*").alias("n"))
        .withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))
    )
    return updated, audit


def to_look_up(df: DataFrame, cache: DataFrame, key: str, value: str, retry_misses: bool = False) -> DataFrame:
    """Keys not in the cache. An empty value is a known miss: it is skipped unless retried."""
    known = cache.filter(F.col(value) != "") if retry_misses else cache
    return unprocessed(df, known, key)


def cached_value(df: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Cached values beside their keys: null not looked up, '' looked up and not found."""
    return df.join(cache.select(key, value), key, "left")


def stream_upsert(
    spark: SparkSession, landing: str, schema, key: str, version: str, target: str, checkpoint: str,
    transform=None, buckets: int = 16, files_per_batch: int | None = None,
):
    """Starts a query that upserts every landed file into a bucketed parquet table; buckets should grow with the
    table, and files_per_batch bounds a micro-batch.

    Rows are spread over hash buckets of the key; a micro-batch rewrites only buckets it touches,
    each into a new generation folder, and the table is the newest generation of every bucket."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        fresh = (transform(batch) if transform else batch).withColumn(
            "bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        )
        touched = fresh.select("bucket").distinct()
        try:
            old = read_upserted(batch.sparkSession, target, before=batch_id)
        except FileNotFoundError:
            old = None
        merged = last_write_wins(fresh.limit(0), fresh, key, version)
        if old is not None:
            merged = last_write_wins(old.join(touched, "bucket", "left_semi"), fresh, key, version)
        merged.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{target}/generation={batch_id}"
        )

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(landing)
        .writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_upserted(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """Newest generation of every bucket of an upserted table."""
    from verdigris.sources.tables import path_exists

    if not path_exists(spark, target):
        raise FileNotFoundError(target)
    all_rows = spark.read.option("basePath", target).parquet(target)
    if before is not None:
        all_rows = all_rows.filter(F.col("generation") < before)
    newest = all_rows.groupBy("bucket").agg(F.max("generation").alias("generation"))
    return all_rows.join(newest, ["bucket", "generation"], "left_semi").drop("generation")
