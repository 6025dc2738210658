import math
import random

from pyspark.sql import functions as F

from verdigris.llm.pivot_index import search
from verdigris.llm.queries import QUERIES

COLUMNS = ["query_id", "rank", "vec_id", "score"]


def brute(rows, is_query, k, scale=256):
    fine = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in fine if is_query(i)}:
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op8_top_k"](spark, sf).select(*COLUMNS).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


def test_small_blocks_ties_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.5]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + rows[:3]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in search(df, F.col("vec_id") % 7 == 0, k=4, n_pivots=9, sample=50, block=8).select(*COLUMNS).collect())
    assert got == brute(rows, lambda i: i % 7 == 0, 4)


def test_nulls_clashing_names_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, None), (2, [0.5, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [0.1]), (None, [1.0, 1.0]), (7, []), (8, [0.5, -0.5]), (50, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in search(df, F.col("vec_id") % 50 == 0).select(*COLUMNS).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)
    assert search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = df.where("vec_id = 0")
    assert search(one, F.col("vec_id") % 50 == 0).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(0, [3.0e13, 1.0]), (1, [2.0e-3, 5.0]), (2, [2.0e-3, 6.0]), (3, [-1.0, 1.0e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in search(df, F.col("vec_id") == 0, k=2).select(*COLUMNS).collect())
    assert got == brute(rows, lambda i: i == 0, 2)
