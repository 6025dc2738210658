"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from verdigris.session import checkpoint_root

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written once to the shared folder, in a subfolder per value of `by`, and read back: later steps neither
    recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs of characters other than space and 09 to 0D, in UTF-8; none for null.

    Splitting bytes cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(texts: pd.Series, most: int = 2_000_000) -> Iterator[slice]:
    """Consecutive slices of a batch of at most `most` characters each, or one text if that is longer."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list, seed: str = "verdigris-words!") -> np.ndarray:
    """64-bit hash of every word; equal words get equal hashes in every task."""
    if not words:
        return np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array([*words, None], dtype=object)[:-1])
    return pd.util.hash_array(distinct, hash_key=seed, categorize=False)[codes]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every n consecutive entries; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out
