"""Findings of the fourth round: small cases that failed before."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import scoring as sc
from verdigris.llm import pivot_index as pi
from verdigris.operators import similarity as si
from verdigris.operators import tfidf as tf


def test_top_k_moves_vectors_not_blocks(spark, monkeypatch):
    """A row of half a megabyte is too much for readers that take thousands of rows at a time."""
    kept = []
    monkeypatch.setattr(pi, "saved", lambda df, name, save=pi.saved: kept.append(save(df, name)) or kept[-1])
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))]
    found = pi.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3)
    assert found.count() == 18 * 3
    for df in kept:
        for name, kind in df.dtypes:
            assert kind != "binary" or df.agg(F.max(F.octet_length(name))).first()[0] <= 8 * 8


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{k}" for k in rng.integers(0, 25, rng.integers(0, 9)))) for i in range(n)]


def cosines(left, right, fitted):
    """Cosines of logarithmic counts of words and pairs of words, of terms that two fitted texts hold."""
    count = lambda t: Counter([*t.split(), *map(" ".join, zip(t.split(), t.split()[1:]))])
    df = Counter(x for _, t in fitted for x in count(t))

    def unit(t):
        w = {x: (1 + math.log(c)) * (math.log((1 + len(fitted)) / (1 + df[x])) + 1) for x, c in count(t).items() if df[x] >= 2}
        n = math.sqrt(sum(v * v for v in w.values())) or 1.0
        return {x: v / n for x, v in w.items()}

    l, r = ([(i, unit(t)) for i, t in side] for side in (left, right))
    return {i: sorted((-round(sum(v * b.get(x, 0.0) for x, v in a.items()), 9), j) for j, b in r) for i, a in l}


@pytest.fixture
def whole_records(monkeypatch):
    """Small blocks; no table has a row per record and term."""
    monkeypatch.setattr(tf, "BLOCK_TERMS", 40, raising=False)
    monkeypatch.setattr(tf, "term_counts", None)


def test_tfidf_join_moves_no_single_terms(spark, whole_records):
    left, right = words(1, 70), words(2, 90)
    side = lambda rows: spark.createDataFrame(rows, "id long, text string").withColumn("g", F.lit(1))
    got = {r.id: (-round(r.cosine, 9), r.match_id) for r in tf.tfidf_best(side(left), side(right), 0.55, ["g"], lambda: F.lit(True)).collect()}
    assert got == {i: c[0] for i, c in cosines(left, right, left + right).items() if c[0][0] <= -0.55}


def test_tfidf_candidates_move_no_single_terms(spark, whole_records):
    left, right = words(3, 40), words(4, 90)
    side = lambda rows: spark.createDataFrame(rows, "id long, text string")
    got = {}
    for r in tf.tfidf_candidates(side(left), side(right), top=6, above=0.05).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((-round(r.cosine, 9), r.match_id))
    want = {i: [x for x in c[:6] if x[0] < -0.05] for i, c in cosines(left, right, right).items()}
    assert got == {i: c for i, c in want.items() if c}


@pytest.mark.parametrize("cut", [60.0, 75.0, 95.0])
def test_token_set_join_keeps_pairs_in_their_tasks(spark, monkeypatch, cut):
    """Neither names in texts nor pairs become tables; many small blocks give what comparing all pairs does."""
    for name, value in (("contained_names", None), ("token_set_pairs", None), ("SET_ROWS", 20), ("SET_LETTERS", 400), ("SET_CELLS", 50), ("MEETS", 7)):
        monkeypatch.setattr(si, name, value, raising=False)
    rng = np.random.default_rng(5)
    word = lambda: rng.choice(["an", "the", "bank", "banks", "risk", "oak", "é漢", "tax", "taxes", "of"])
    title = lambda: " ".join(word() for _ in range(rng.integers(0, 7)))
    left = [(i, title(), sorted({word() for _ in range(rng.integers(0, 3))})) for i in range(60)]
    right = [(i, title(), rng.choice(["", "Oak, J.; K. Of", "Risk, A."])) for i in range(70)]
    got = {r.id: (-round(r.score * 1000 + r.exact, 9), r.match_id) for r in si.token_set_best(
        spark.createDataFrame(left, "id long, title string, names array<string>"), spark.createDataFrame(right, "id long, title string, authors string"), cut).collect()}
    want = {}
    for i, a, names in left:
        may = [(j, b) for j, b, authors in right if a and b and (not names or not authors or any(x in f"{b} {authors}".lower() for x in names))]
        ranks = [(-round(sc.token_set(a, b) * 1000 + sc.ratio(a, b), 9), j) for j, b in may if sc.token_set(a, b) >= cut]
        want |= {i: min(ranks)} if ranks else {}
    assert got == want


def titles(seed, n):
    """Titles of few words, some of them near copies of titles of any seed."""
    rng, same = np.random.default_rng(seed), np.random.default_rng(0)
    word = lambda r: "".join(r.choice(list("eetaoinshrd"), r.integers(2, 8)))
    kept = [" ".join(sorted(word(same) for _ in range(6))) for _ in range(30)]
    return [kept[rng.integers(30)][: rng.integers(12, 40)] + word(rng) if rng.random() < 0.7 else " ".join(word(rng) for _ in range(5)) for _ in range(n)]


@pytest.mark.parametrize("keep", [1, 4])
def test_best_edit_pairs_equal_brute_force(spark, monkeypatch, keep):
    for name, value in (("KEY_CELL", 20), ("BIG_CELL", 30), ("LEAD", 5)):
        monkeypatch.setattr(si, name, value, raising=False)
    left, right = titles(1, 90) + ["", "ab"], titles(2, 110)
    side = lambda rows: spark.createDataFrame(list(enumerate(rows)), "rec long, key string").withColumn("blocks", F.array(F.lit("#"), F.concat(F.lit("b"), F.col("rec") % 2)))
    got = {}
    for r in si.edit_pairs(side(left), side(right), 60.0, keep=keep).collect():
        got.setdefault(r.l_rec, []).append((-round(r.score, 9), r.r_rec))
    want = {i: sorted((-round(sc.ratio(a, b), 9), j) for j, b in enumerate(right) if sc.ratio(a, b) >= 60.0) for i, a in enumerate(left) if a}
    assert {i: sorted(x)[:keep] for i, x in got.items()} == {i: x[:keep] for i, x in want.items() if x}


@pytest.mark.parametrize("limit", [None, 3])
def test_fuzzy_join_hands_on_the_best_pairs_only(spark, monkeypatch, limit):
    """What was found raises the cut for what comes after, and pairs that are not among the best leave no task."""
    pairs, edit = [], si.edit_pairs
    monkeypatch.setattr(si, "edit_pairs", lambda *a, **k: pairs.append(edit(*a, **k).cache()) or pairs[-1])
    monkeypatch.setattr(si, "LEAD", 20, raising=False)
    monkeypatch.setattr(si, "BIG_CELL", 1)
    none = F.array().cast("array<string>")
    side = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, key string").withColumns({"names": none, "year": F.lit(2000)})
    left, right = sorted({*titles(3, 120)}), sorted({*titles(4, 400)})
    found = {r.id: (r.match_id, round(r.score, 9)) for r in si.fuzzy_best(side(left), side(right), 60.0, limit=limit).collect()}
    ranked = {i: sorted((-sc.ratio(a, b), j) for j, b in enumerate(right)) for i, a in enumerate(left)}
    assert found == {i: (x[0][1], round(-x[0][0], 9)) if x[0][0] <= -60.0 else (None, 0.0) for i, x in ranked.items()}
    reach = sum(-s >= 60.0 for x in ranked.values() for s, _ in x)
    assert pairs[0].count() <= (limit or 1) * len(left) < reach
