"""Rates, contingency tables and group tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.stats import wilson
from verdigris.operators.windows import running_totals


def publication_rates(df: DataFrame, by: list, published: str = "published") -> DataFrame:
    """n, published count, rate and Wilson interval in percent per group."""
    d = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(published)).alias("n_pub"))
    low, high = wilson(F.col("n_pub"), F.col("n"))
    return d.select(
        *by, "n", "n_pub",
        (100.0 * F.col("n_pub") / F.col("n")).alias("rate"),
        (100.0 * low).alias("ci_low"), (100.0 * high).alias("ci_high"),
    )


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Homogeneity test of a contingency table from its cells; Yates-corrected for 2 x 2."""
    cells = df.groupBy(row, col).agg(F.count("*").alias("o"))
    rows = cells.groupBy(row).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(col).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o"))
    n_rows, n_cols = rows.agg(F.count("*")), cols.agg(F.count("*"))
    # sum over all cells of (o - e)^2 / e equals n * (sum o^2 / (r c) - 1): empty cells add nothing
    joined = cells.join(rows, row).join(cols, col)
    base = joined.agg(
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"),
        F.min(F.struct("o", "r", "c")).alias("any_cell"),
    )
    n = F.col("total")
    d = base.withColumns(
        {"total": total.scalar(), "n_rows": n_rows.scalar(), "n_cols": n_cols.scalar()}
    )
    plain = n * (F.col("s") - 1)
    # every cell of a 2 x 2 table deviates from its expectation by the same amount
    e = F.col("any_cell.r") * F.col("any_cell.c") / n
    gap = F.abs(F.col("any_cell.o") - e)
    shrunk = F.when(gap > 0, F.pow((gap - F.least(F.lit(0.5), gap)) / gap, 2)).otherwise(F.lit(1.0))
    two_by_two = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    return d.select(
        n.alias("n"),
        F.when(two_by_two, plain * shrunk).otherwise(plain).alias("chi2"),
        ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("df"),
    )


def uniformity(df: DataFrame, group_count: str) -> DataFrame:
    """Chi-square of group counts against an even spread."""
    c = F.col(group_count)
    d = df.agg(
        F.count("*").alias("k"), F.sum(c).alias("s"), F.sum(c * c).alias("ss")
    )
    mean = F.col("s") / F.col("k")
    return d.select(((F.col("ss") / mean) - F.col("s")).alias("chi2"), (F.col("k") - 1).alias("df"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """U of the first group with mid-ranks, tie-corrected normal deviate with continuity correction.

    Counts per distinct value come first; ranks are running totals over the distinct values."""
    d = (
        df.select(F.col(value).alias("v"), first.alias("f"))
        .dropna()
        .groupBy("v")
        .agg(F.count_if("f").alias("n1"), F.count_if(~F.col("f")).alias("n0"))
        .withColumn("t", F.col("n1") + F.col("n0"))
    )
    r = running_totals(d, "v", {"before": "t"})
    mid = F.col("before") + (F.col("t") + 1) / 2
    s = r.agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"),
        F.sum(F.col("n1") * mid).alias("ranks"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("ranks") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    top = F.greatest(u, n1 * n0 - u)
    return s.select("n1", "n0", u.alias("u"), ((top - n1 * n0 / 2 - 0.5) / sd).alias("z"))


def share_of(df: DataFrame, by: list, value: str) -> DataFrame:
    """Counts of each value and its share of the group, from pre-aggregated counts."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    if not by:
        return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__t"))
    return counts.join(totals, by).withColumn("share", F.col("n") / F.col("__t")).drop("__t")
