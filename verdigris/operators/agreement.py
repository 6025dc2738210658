"""Inter-rater agreement from confusion counts: one grouped pass, then arithmetic on nine cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = (-1, 0, 1)


def confusion(df: DataFrame, truth: str, pred: str, by: list = (), labels=LABELS) -> DataFrame:
    """(by, truth, pred, n) on the full label grid, zero cells included."""
    cells = [
        F.struct(
            F.lit(t).alias("truth"), F.lit(p).alias("pred"),
            F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias("n"),
        )
        for t in labels for p in labels
    ]
    return df.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.explode("c").alias("c")).select(*by, "c.*")


def confusion_matrix(cells: DataFrame, by: list = (), labels=LABELS) -> DataFrame:
    return cells.groupBy(*by, "truth").pivot("pred", list(labels)).agg(F.sum("n"))


def _total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def linear_kappa(df: DataFrame, a: str, b: str, by: list = (), labels=LABELS) -> DataFrame:
    """Percent agreement and linearly weighted kappa; kappa is 1 where no disagreement is expected."""
    k = len(labels)
    counts = [
        F.count_if((F.col(a) == labels[i]) & (F.col(b) == labels[j])).alias(f"c{i}{j}")
        for i in range(k) for j in range(k)
    ]
    c = {(i, j): F.col(f"c{i}{j}") for i in range(k) for j in range(k)}
    n = _total(c.values())
    rows = [_total(c[i, j] for j in range(k)) for i in range(k)]
    cols = [_total(c[i, j] for i in range(k)) for j in range(k)]
    seen = _total(c[i, j] * abs(i - j) for i in range(k) for j in range(k))
    chance = _total(rows[i] * cols[j] * abs(i - j) for i in range(k) for j in range(k)) / n
    return df.groupBy(*by).agg(*counts).select(
        *by,
        n.alias("n"),
        (_total(c[i, i] for i in range(k)) / n).alias("agreement"),
        F.when(chance > 0, 1 - seen / chance).otherwise(F.lit(1.0)).alias("kappa"),
    )


def consensus(a: str, b: str) -> Column:
    """Equal codes stand; of two codes the non-zero one counts; opposite codes give 0."""
    x, y = F.col(a), F.col(b)
    return F.when(x == y, x).when(x == 0, y).when(y == 0, x).otherwise(F.lit(0))


def class_report(cells: DataFrame, labels=LABELS) -> DataFrame:
    """Precision, recall, F1 and support per label from confusion cells."""
    parts = [
        F.struct(
            F.lit(l).alias("label"),
            F.sum(F.when((F.col("truth") == l) & (F.col("pred") == l), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("pred") == l, F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(F.col("truth") == l, F.col("n")).otherwise(0)).alias("support"),
        )
        for l in labels
    ]
    d = cells.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return d.select(
        "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def audit_summary(df: DataFrame, by: list, agreed: Column) -> DataFrame:
    """Audited, agreed and flipped counts; a missing verdict counts as flipped."""
    ok = F.coalesce(agreed, F.lit(False))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("agreed"), F.count_if(~ok).alias("flipped"),
        F.avg(ok.cast("double")).alias("agree_rate"),
    )
