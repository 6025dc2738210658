"""Drops lines that many documents share, by levelled sorted runs of line hashes.

A line's key is the line without the six ASCII blanks at both ends and with A-Z lower-cased; its 128-bit hash stands
for it. Documents are taken in batches of falling doc_id. A batch is summed to one row per key (documents, largest
doc_id). Keys that a run already knows to be frequent need nothing more, since the document that keeps them came
before: a merge anti-join with every run takes them out, and what is left becomes the batch's own run. Runs are
bucketed and sorted by hash, so that these joins and the merges below read them in order without a shuffle. A level
that holds `fanout` runs is compacted into one run of the next level. In the end all runs are compacted, and documents
look up which of their lines they lose.

Sums run before any shuffle, so a line that every document has is one row per task; the last look-up is a join whose
hot keys Spark splits. Null and empty texts are one empty line. Rows without doc_id belong to no document: they keep
all lines and are not counted. Rows of one doc_id are one document, whose lines all stay where it is the keeper.
Repeats of a line in one document count once and are dropped or kept together. Extra columns are not looked at. No
documents give no rows. A long text is a row like any other; its own distinct lines are the largest group built.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import saved, slices
from verdigris.session import checkpoint_root

BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def line_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, line): the distinct hashes of a row's keys of at least that many code points."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cut in slices(batch["text"]):
                ids, found = [], []
                for doc_id, text in zip(batch["doc_id"].iloc[cut], batch["text"].iloc[cut]):
                    own = {line_hash(k) for k in map(line_key, lines_of(text)) if long_enough(k, least_chars)}
                    found += own
                    ids += [doc_id] * len(own)
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "line": found})

    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(hashes, "doc_id long, line binary")


class LevelledRuns:
    """Sorted runs (line, n, keeper), a few per level. `least` documents make a line frequent."""

    def __init__(self, spark: SparkSession, least: int = 3, fanout: int = 4):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_run = rows.select("line", "n", "keeper").write.format("parquet").option("path", f"{checkpoint_root(self.spark)}/llm/{name}")
        sorted_run.bucketBy(self.buckets, "line").sortBy("line").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """All rows of some runs, summed per key, by merging them pairwise in key order."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.withColumnsRenamed({"n": "n_a", "keeper": "keeper_a"}).join(b.withColumnsRenamed({"n": "n_b", "keeper": "keeper_b"}), "line", "full_outer")
            n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
            return both.select("line", n.alias("n"), F.greatest("keeper_a", "keeper_b").alias("keeper"))

        return reduce(merge, [self.spark.table(x) for x in names])

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, summed: DataFrame) -> None:
        """A batch's (line, n, keeper), whose documents all have smaller ids than those of earlier batches."""
        runs = [self.spark.table(x) for level in self.levels for x in level]
        open_keys = reduce(lambda new, run: new.join(run.where(F.col("n") >= self.least).select("line"), "line", "left_anti"), runs, summed)
        self._write(open_keys, 0)
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                self.levels[level] = []
                self._write(self._merged(names), level + 1)
                self._forget(names)

    def frequent(self) -> DataFrame:
        """(line, keeper) of all frequent lines, written out; the runs are given up."""
        names = [x for level in self.levels for x in level]
        if not names:
            return self.spark.createDataFrame([], "line binary, keeper long")
        found = saved(self._merged(names).where(F.col("n") >= self.least).select("line", "keeper"), "frequent-lines")
        self._forget(names)
        self.levels = [[]]
        return found


def in_batches(lines: DataFrame, docs: DataFrame, batches: int) -> tuple[DataFrame, list[int]]:
    """lines written once with a batch number, batch 0 with the largest ids. Only the bounds, approximate quantiles
    of doc_id, reach the driver; they decide the batches' sizes and nothing else."""
    at = [k / batches for k in range(1, batches)]
    bounds = sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), at, 10_000).alias("q")).first()["q"] or []), reverse=True) if at else []
    number = reduce(lambda total, bound: total + (F.col("doc_id") <= bound).cast("int"), bounds, F.lit(0))
    return saved(lines.withColumn("batch", number), "lines", by="batch"), list(range(len(bounds) + 1))


def summed(lines: DataFrame, once: bool) -> DataFrame:
    """(line, n, keeper); `once` says that no pair of document and line is repeated."""
    rows = lines if once else lines.select("doc_id", "line").distinct()
    return rows.groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))


def drop_shared_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, batches: int = 8, fanout: int = 4) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) per row of docs(doc_id, text).

    Lines whose key has at least `least_chars` code points and stands in at least `least_docs` documents stay only in
    the document of largest id that holds it."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    lines, numbers = in_batches(hashed_lines(docs, least_chars), docs, batches)
    once = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    runs = LevelledRuns(spark, least_docs, fanout)
    for number in numbers:
        runs.add(summed(lines.where(F.col("batch") == number), once))
    lost = lines.join(runs.frequent(), "line").where("doc_id < keeper").groupBy("doc_id").agg(F.collect_set("line").alias("lost"))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cut in slices(frame["text"]):
                rows, counts, dropped, kept = frame.iloc[cut], [], [], []
                for text, gone in zip(rows["text"], rows["lost"]):
                    own = lines_of(text)
                    gone = set(gone) if gone is not None else ()
                    stay = [x for x in own if line_hash(line_key(x)) not in gone] if gone else own
                    counts.append(len(own))
                    dropped.append(len(own) - len(stay))
                    kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_lines": counts, "n_dropped": dropped, "kept_text": kept})

    matched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(lost, "doc_id", "left")
    return matched.mapInPandas(keep, "doc_id long, n_lines long, n_dropped long, kept_text string")
