"""Counts of test statistics around a significance threshold, and tests built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx
from verdigris.functions.stats import chi2_1_sf, two_sided_p
from verdigris.functions.text import as_col


def valid_z(df: DataFrame, z: str = "z", high: float = 50.0) -> DataFrame:
    """Absolute numeric statistics between 0 and 50."""
    return df.withColumn(z, F.abs(F.col(z).try_cast("double"))).filter(F.col(z).between(0.0, high))


def in_window(z, lo: float, mid: float, hi: float, open_low: bool = False) -> tuple[Column, Column]:
    z = as_col(z)
    below = ((z > lo) if open_low else (z >= lo)) & (z < mid)
    return below, (z >= mid) & (z < hi)


def ratio_and_chi2(df: DataFrame) -> DataFrame:
    """Adds ratio and the one-degree chi-square of below against above; null without any above."""
    b, a = F.col("below"), F.col("above")
    return df.withColumn("ratio", F.when(a > 0, b / a)).withColumn(
        "chi2", F.when(a > 0, (b - a) * (b - a) / (b + a))
    )


def caliper(df: DataFrame, by: list, window=lx.CALIPER, z: str = "z", open_low: bool = False) -> DataFrame:
    """One pass: n, below, above, ratio, chi2, p and share significant per group."""
    below, above = in_window(z, *window, open_low=open_low)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(below).alias("below"),
        F.count_if(above).alias("above"),
        F.count_if(F.col(z) >= lx.Z05).alias("n_sig"),
    )
    return (
        ratio_and_chi2(counts)
        .withColumn("p", chi2_1_sf(F.col("chi2")))
        .withColumn("pct_sig", 100.0 * F.col("n_sig") / F.col("n"))
    )


def caliper_grid(df: DataFrame, by: list, windows: dict, z: str = "z") -> DataFrame:
    """Several windows in one pass over the data: conditional counts, unpivoted afterwards."""
    aggs = [F.count("*").alias("n")]
    for i, (lo, mid, hi) in enumerate(windows.values()):
        below, above = in_window(z, lo, mid, hi)
        aggs += [F.count_if(below).alias(f"b{i}"), F.count_if(above).alias(f"a{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("window"), F.col(f"b{i}").alias("below"), F.col(f"a{i}").alias("above"))
            for i, name in enumerate(windows)
        ]
    )
    wide = df.groupBy(*by).agg(*aggs).select(*by, "n", F.explode(rows).alias("w"))
    return ratio_and_chi2(wide.select(*by, "n", "w.*"))


def per_paper(df: DataFrame, by: list, paper: str, window=lx.CALIPER, z: str = "z") -> DataFrame:
    """Below and above counts per paper."""
    below, above = in_window(z, *window)
    return df.groupBy(*by, paper).agg(F.count_if(below).alias("nb"), F.count_if(above).alias("na"))


def discontinuity(df: DataFrame, by: list, threshold: float = lx.Z05, width: float = 0.5, z: str = "z") -> DataFrame:
    """Difference of the shares just below and just above a threshold, in standard errors."""
    zc = F.col(z)
    d = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if((zc >= threshold - width) & (zc < threshold)).alias("n_below"),
        F.count_if((zc >= threshold) & (zc < threshold + width)).alias("n_above"),
    )
    pb, pa = F.col("n_below") / F.col("n"), F.col("n_above") / F.col("n")
    se = F.sqrt((pb * (1 - pb) + pa * (1 - pa)) / F.col("n"))
    some = F.col("n_below") + F.col("n_above") > 0
    stat = F.when(some, F.when(se > 0, (pb - pa) / se).otherwise(F.lit(0.0)))
    return d.withColumn("z_stat", stat).withColumn("p", two_sided_p(stat))


def decomposition(df: DataFrame, corpus: str, kind: str, first: str, second: str, special: str) -> DataFrame:
    """Split the gap between two corpora's ratios into a part within row kinds, at the second
    corpus's composition, and a part due to different composition. One pass plus arithmetic."""
    below, above = in_window("z", *lx.CALIPER)
    aggs = []
    for c in (first, second):
        own = F.col(corpus) == c
        for tag, mask in (
            ("all", own), ("sp", own & (F.col(kind) == special)), ("ot", own & (F.col(kind) != special)),
        ):
            aggs += [
                F.count_if(mask).alias(f"{c}_{tag}_n"),
                (F.count_if(mask & below) / F.nullif(F.count_if(mask & above), F.lit(0))).alias(f"{c}_{tag}_r"),
            ]
    one = df.agg(*aggs)
    col = F.col
    share = {c: col(f"{c}_sp_n") / col(f"{c}_all_n") for c in (first, second)}
    gap = col(f"{first}_all_r") - col(f"{second}_all_r")
    within = (col(f"{first}_sp_r") - col(f"{second}_sp_r")) * share[second] + (
        col(f"{first}_ot_r") - col(f"{second}_ot_r")
    ) * (1 - share[second])
    parts = [
        ("ratio_first", col(f"{first}_all_r")), ("ratio_second", col(f"{second}_all_r")),
        ("gap", gap), ("within", within), ("composition", gap - within),
        ("share_first", share[first]), ("share_second", share[second]),
        ("other_first", col(f"{first}_ot_r")), ("other_second", col(f"{second}_ot_r")),
        ("special_first", col(f"{first}_sp_r")), ("special_second", col(f"{second}_sp_r")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("component"), v.alias("value")) for n, v in parts])
    return one.select(F.explode(rows).alias("r")).select("r.*")
