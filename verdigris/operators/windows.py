"""Per-key choice, ranking and sampling that stay balanced when one key holds most rows.

`row_number() <= k` filters compile to a partial limit before the shuffle, so a hot key sends at
most k rows per map task. Full ranks of a hot key are built from hash buckets instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import as_col
from verdigris.session import cut_lineage


def top_k(df: DataFrame, keys: list, order: list[Column], k: int, rank_col: str | None = None) -> DataFrame:
    """The first k rows of every key in the given total order."""
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(rn) <= k
    )
    return out if rank_col else out.drop(rn)


def best(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def hash_number(seed, *cols) -> Column:
    """Seeded 32-bit number per row: the same draw in any engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *cols) -> Column:
    return hash_number(seed, *cols) / F.lit(4294967296.0)


def hashed_rank(df: DataFrame, keys: list[str], number: str, tie: str, rank_col: str, bits: int = 10) -> DataFrame:
    """Row number per key in the order of a 32-bit hash number.

    The top bits split every key into 2**bits even buckets; bucket offsets come from counts, so no
    task ever sorts a whole key."""
    d = df.withColumn("__b", F.shiftright(F.col(number), 32 - bits))
    counts = d.groupBy(*keys, "__b").count()
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(number, tie)
    return (
        d.withColumn("__rn", F.row_number().over(inside))
        .join(offsets, [*keys, "__b"])
        .withColumn(rank_col, F.col("__off") + F.col("__rn"))
        .drop("__b", "__off", "__rn")
    )


def range_rank(df: DataFrame, keys: list[str], order: str, rank_col: str) -> DataFrame:
    """Row number per key in the order of a distinct whole number, built from even value ranges in
    the manner of hashed_rank."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    scaled = F.floor((F.col(order) - lo) / (hi - lo + 1) * F.lit(4294967296.0))
    d = df.withColumn("__n", scaled.cast("bigint"))
    return hashed_rank(d, keys, "__n", order, rank_col).drop("__n")


def running_totals(df: DataFrame, order: str, sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Sum of each column over all earlier rows of a table with distinct order values.

    Range partitions are summed on their own and shifted by the totals of those before them."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(
        df.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id())
    )
    totals = parts.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__p", *[F.coalesce(F.sum(f"__t_{o}").over(earlier), F.lit(0)).alias(f"__o_{o}") for o in sums]
    )
    inside = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(offsets, "__p")
    for o, c in sums.items():
        out = out.withColumn(o, F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__o_{o}"))
    return out.drop("__p", *[f"__o_{o}" for o in sums])


# ---------------------------------------------------------------- sampling
def sample_rows(df: DataFrame, n: int, seed, id_col: str) -> DataFrame:
    """Simple random sample of n rows, fixed by seed and id."""
    return (
        df.withColumn("__h", hash_number(seed, id_col)).orderBy("__h", id_col).limit(n).drop("__h")
    )


def sample_per_stratum(df: DataFrame, strata: list[str], n: int, seed, id_col: str) -> DataFrame:
    h = df.withColumn("__h", hash_number(seed, id_col))
    return top_k(h, strata, [F.col("__h"), F.col(id_col)], n).drop("__h")


def sample_two_strata(df: DataFrame, flag: Column, n: int, seed, id_col: str) -> DataFrame:
    """Half from the flagged rows, the rest from the others; a short first stratum is topped up.

    The result carries its shuffled position."""
    half = n // 2
    ranked = top_k(
        df.withColumn("__f", flag).withColumn("__h", hash_number(seed, id_col)),
        ["__f"], [F.col("__h"), F.col(id_col)], n, "__r",
    )
    taken = ranked.filter(F.col("__f") & (F.col("__r") <= half)).agg(F.count("*").alias("c"))
    quota = F.when(F.col("__f"), F.lit(half)).otherwise(F.lit(n) - taken.scalar())
    kept = ranked.filter(F.col("__r") <= quota)
    order = Window.orderBy(hash_number(f"{seed}-shuffle", id_col), id_col)
    return kept.withColumn("position", F.row_number().over(order)).drop("__f", "__h", "__r")
