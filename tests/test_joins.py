"""Similarity joins, assignments and ranks against brute force on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.functions import scoring as sc
from verdigris.operators import matching as ma
from verdigris.operators import similarity as si
from verdigris.operators import tfidf as tf
from verdigris.operators import windows as wi


def titles(seed, n):
    rng = random.Random(seed)
    words = ["bank", "bonk", "capital", "capitol", "rule", "rules", "tax", "a", "market", "markets"]
    out = [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(n - 6)]
    return out + ["x", "xy", "yx", "xyz", "capital rule", "capital rule"]


def test_scores():
    assert sc.common_length("kitten", "sitting") == 4
    assert sc.ratio("kitten", "sitting") == pytest.approx(800 / 13)
    assert sc.token_sort("bank rule", "rule bank") == 100.0
    assert sc.token_set("rule bank reform", "bank rule") == 100.0
    assert sc.token_set("", "a") == 0.0
    assert sc.partial("abcd", "xxabcdyy") == 100.0


@pytest.mark.parametrize("cut", [50.0, 75.0, 85.0, 90.0])
def test_edit_pairs_match_brute_force(spark, cut):
    left, right = titles(1, 60), titles(2, 60)

    def side(ts):
        return spark.createDataFrame(list(enumerate(ts)), "rec long, key string").withColumn("blocks", F.array(F.lit("#")))

    got = {(r.l_rec, r.r_rec) for r in si.edit_pairs(side(left), side(right), cut).collect()}
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if sc.ratio(a, b) >= cut}
    assert got == want


def test_hot_tokens_are_split_without_loss(spark, monkeypatch):
    left, right = titles(3, 50), titles(4, 50)
    monkeypatch.setattr(si, "CELL_ROWS", 5)
    monkeypatch.setattr(si, "KEY_CELL", 5)
    monkeypatch.setattr(si, "PAIR_CHUNK", 7)

    def side(ts):
        return spark.createDataFrame(list(enumerate(ts)), "rec long, key string").withColumn("blocks", F.array(F.lit("#")))

    got = {(r.l_rec, r.r_rec) for r in si.edit_pairs(side(left), side(right), 75.0).collect()}
    assert got == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if sc.ratio(a, b) >= 75.0}


def test_set_joins_match_brute_force(spark):
    l, r = [t.split() for t in titles(5, 50)], [t.split() for t in titles(6, 50)]
    ld, rd = (spark.createDataFrame(list(enumerate(x)), "id long, tokens array<string>") for x in (l, r))
    cont, jac = {}, {}
    for i, a in enumerate(l):
        c = sorted(((-len(set(a) & set(b)) / len(set(a)), j) for j, b in enumerate(r)))
        if -c[0][0] >= 0.5:
            cont[i] = -c[0][0]
        c = sorted(((-len(set(a) & set(b)) / len(set(a) | set(b)), j) for j, b in enumerate(r)))
        if -c[0][0] >= 0.4:
            jac[i] = -c[0][0]
    assert {x.id: x.share for x in si.containment_best(ld, rd, 0.5).collect()} == pytest.approx(cont)
    assert {x.id: x.jaccard for x in si.jaccard_best(ld, rd, 0.4).collect()} == pytest.approx(jac)


def test_cosine_prefix_loses_nothing(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    far = tf.tfidf_candidates(df, df, top=100, above=0.6).count()
    near = tf.tfidf_candidates(df, df, top=100, above=0.01).filter("cosine > 0.6").count()
    assert far == near > 40


@pytest.mark.parametrize("levels", [12, 3, 1])
def test_ordered_assignment_is_the_sequential_one(spark, levels):
    rng = random.Random(levels)
    lk, rk = [rng.choice("abcde") for _ in range(60)], [rng.choice("vwxyz") for _ in range(45)]
    pairs = rng.sample([(a, b) for a in "abcde" for b in "vwxyz"], 14)
    score = {p: float(s % levels) for s, p in enumerate(pairs)}
    free, want = set(range(len(rk))), set()
    for i, a in enumerate(lk):
        options = [(-score[a, rk[j]], j) for j in free if (a, rk[j]) in score]
        if options:
            s, j = min(options)
            free.discard(j)
            want.add((i, j))
    left = spark.createDataFrame(list(enumerate(lk)), "id long, l_key string")
    right = spark.createDataFrame(list(enumerate(rk)), "id long, r_key string")
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "l_key string, r_key string, score double")
    got = {(r.id, r.match_id) for r in ma.ordered_one_to_one(left, right, edges).collect()}
    assert got == want


def test_ordered_assignment_without_edges(spark):
    one = spark.createDataFrame([(1, "a")], "id long, l_key string")
    none = spark.createDataFrame([], "l_key string, r_key string, score double")
    assert ma.ordered_one_to_one(one, one.withColumnRenamed("l_key", "r_key"), none).collect() == []


def test_propensity_pairs_are_one_to_one(spark):
    df = spark.range(400).selectExpr("id", "id % 4 = 0 AS treat", "CAST(id % 10 AS DOUBLE) AS x")
    scores = spark.createDataFrame([(float(i), i / 20.0) for i in range(10)], "x double, score double")
    out = ma.propensity_pairs(df, "treat", "x", "id", scores)
    counts = {r.treat: r["count"] for r in out.groupBy("treat").count().collect()}
    assert counts == {True: 100, False: 100} and out.select("id").distinct().count() == 200


@pytest.mark.parametrize("seed", range(4))
def test_controls_used_equal_one_by_one_matching(spark, seed):
    rng = random.Random(seed)
    scores = sorted({round(rng.random(), rng.choice([1, 2, 3])) for _ in range(60)})
    strata = [(s, rng.choice([0, 0, 1, 2, 5]), rng.choice([0, 1, 2, 3, 6 if seed else 1])) for s in scores]
    free, want = {s: c for s, _, c in strata}, dict.fromkeys(scores, 0)
    for s, treated, _ in strata:
        for _ in range(treated):
            open_ = [(abs(s - o), o) for o, c in free.items() if c]
            if open_:
                o = min(open_)[1]
                free[o] -= 1
                want[o] += 1
    df = spark.createDataFrame(strata, "score double, treated long, controls long")
    assert {r.score: r.used for r in ma.controls_used(df).collect()} == want


def test_ranks_equal_row_numbers(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS k", "(id * 7919) % 4294967291 AS h")
    w = Window.partitionBy("k").orderBy("h", "id")
    got = wi.hashed_rank(df, ["k"], "h", "id", "r").withColumn("want", F.row_number().over(w))
    assert got.filter("r <> want").count() == 0
    w = Window.partitionBy("k").orderBy("id")
    got = wi.range_rank(df, ["k"], "id", "r").withColumn("want", F.row_number().over(w))
    assert got.filter("r <> want").count() == 0
    sums = wi.running_totals(df.select("id", "h"), "id", {"before": "h"})
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    assert sums.withColumn("want", F.coalesce(F.sum("h").over(w), F.lit(0))).filter("before <> want").count() == 0


def test_top_k_limits_before_the_shuffle(spark):
    df = wi.top_k(spark.range(1000).selectExpr("id % 2 AS k", "id"), ["k"], [F.asc("id")], 3)
    plan = df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_token_set_pairs_match_brute_force(spark):
    left, right = titles(11, 50), titles(12, 70)
    keys = lambda ts: [" ".join(sorted(set(t.split()))) for t in ts]
    blocks = lambda i: [f"n{i % 3}", "x"][: 1 + i % 2]

    def side(ts):
        return spark.createDataFrame([(i, k, blocks(i)) for i, k in enumerate(keys(ts))], "rec long, key string, blocks array<string>")

    for cut in (60.0, 75.0, 90.0):
        got = {(r.l_rec, r.r_rec): r.score for r in si.token_set_pairs(side(left), side(right), cut).collect()}
        want = {(i, j): sc.token_set(a, b) for i, a in enumerate(left) for j, b in enumerate(right) if set(blocks(i)) & set(blocks(j))}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= cut})


def test_names_inside_texts(spark):
    names = spark.createDataFrame([("lee",), ("x",), ("ng",), ("smith",), ("",)], "name string")
    texts = spark.createDataFrame([(1, "Sleeping NG"), (2, "smithson-x"), (3, ""), (4, None)], "rec long, text string")
    got = {r.rec: set(r.found) for r in si.contained_names(names, texts).collect()}
    assert got == {1: {"lee", "ng"}, 2: {"smith", "x"}}


def test_partial_sees_every_window():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(n))) for n in (12, 30))
        a, b = sorted((a, b), key=len)
        m, n = len(a), len(b)
        every = [200.0 * sc.common_length(a, b[max(s, 0) : s + m]) / (m + min(s + m, n) - max(s, 0)) for s in range(1 - m, n)] if a else [0.0 if b else 100.0]
        assert sc.partial(a, b) == pytest.approx(max(every))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "äöüß漢字"])
def test_lanes_equal_single_pairs(letters):
    rng = random.Random(8)
    pairs = [tuple("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 128, 129, 256, 257, 300]))) for _ in "ab") for _ in range(300)]
    assert sc.common_lengths(*zip(*pairs)).tolist() == [sc.common_length(a, b) for a, b in pairs]


@pytest.mark.parametrize("gain", [1, 150, 10**9])
def test_block_products_equal_full_products(monkeypatch, gain):
    monkeypatch.setattr(tf, "DENSE_GAIN", gain)
    draw = np.random.default_rng(3)

    def block(n):
        ids = [np.unique(draw.geometric(0.02, draw.integers(5, 80))).tolist() for _ in range(n)]
        return pa.table({"rec": range(n), "ids": pa.array(ids, pa.list_(pa.int64())), "ws": [[1 + draw.random() for _ in x] for x in ids]})

    def full(t):
        out = np.zeros((t.num_rows, 2_000))
        for i, (ids, ws) in enumerate(zip(t["ids"].to_pylist(), t["ws"].to_pylist())):
            out[i, ids] = ws
        return out / np.linalg.norm(out, axis=1)[:, None]

    a, b = block(60), block(90)
    want = full(a) @ full(b).T
    for cut in (0.01, 0.3, 0.6):
        i, j, c = tf.block_product(a, b, cut)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want >= cut))))
        assert np.allclose(c, want[i, j])
