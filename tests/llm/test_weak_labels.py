import numpy as np
from pyspark.sql import functions as F

from verdigris.llm.queries import QUERIES
from verdigris.llm.weak_labels import ABSTAIN, NO, YES, WordFeatures, estimate, fit, quality_votes, score, shape_of, toxic_votes, train


def test_votes():
    assert quality_votes(None) == quality_votes(" \n") == (ABSTAIN,) * 5
    assert quality_votes("Some plain words, and a sentence.") == (NO,) * 5
    assert quality_votes("THE!! DOG!! RUNS!!")[1:3] == (YES, YES)
    assert quality_votes("a### b$$$ c***")[0] == YES and quality_votes("a | b | c |")[3] == YES and quality_votes("x " * 50)[4] == YES
    assert toxic_votes("You Moron!", set(), set()) == (YES, NO, NO) and toxic_votes("abcdefg", {"x"}, {"abcd"}) == (NO, YES, NO)
    assert toxic_votes("12 3", set(), set()) == (NO, NO, NO) and toxic_votes("", set(), set()) == (ABSTAIN,) * 3


def test_shapes():
    assert [shape_of(w) for w in ("Word.", "THE!!", "ab***", "12", "|")] == ["Aa.", "A!", "a*", "0", "|"]


def test_shapes_cover_whole_words():
    assert shape_of("a" * 64 + "1#") == "a0#"


def test_a_worker_keeps_a_bounded_number_of_words():
    kept, texts = WordFeatures(), [" ".join(f"w{i}x{j}" for j in range(50_000)) for i in range(8)]
    for text in texts:
        own = kept.of([text, text[:9]])
        assert len(kept.index) <= 300_000
        assert all((a == b).all() for a, b in zip(own, WordFeatures().of([text, text[:9]]), strict=True))


def test_em_finds_the_accuracies_of_planted_labellers():
    rng = np.random.default_rng(3)
    truth = rng.random(40_000) < 0.3
    right, cast = [0.95, 0.85, 0.75, 0.9], [1.0, 0.9, 0.8, 0.5]
    votes = np.stack([np.where(rng.random(len(truth)) < c, np.where(rng.random(len(truth)) < r, truth, ~truth).astype(int), ABSTAIN) for r, c in zip(right, cast, strict=True)], axis=1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    q, rate = estimate(patterns, counts.astype(float))
    for k, (r, c) in enumerate(zip(right, cast, strict=True)):
        assert abs(rate[k, 1, 2] / (rate[k, 1, 1] + rate[k, 1, 2]) - r) < 0.03
        assert abs(rate[k, 0, 1] / (rate[k, 0, 1] + rate[k, 0, 2]) - r) < 0.03
        assert abs(rate[k, 0, 0] - (1 - c)) < 0.02
    assert ((q[where.ravel()] > 0.5) == truth).mean() > 0.94


def test_scorer_learns_soft_labels():
    rng = np.random.default_rng(1)
    x = rng.random((600, 30)) < 0.3
    y = x[:, 3] | x[:, 7]
    d, f = np.nonzero(x)
    w, bias = train(d, f, np.ones(len(d)), np.where(y, 0.9, 0.05))
    assert (((x @ w[:30] + bias) > 0) == y).mean() > 0.99


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where("doc_id % 3 > 0"))
    rows = score(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "bad"), "doc_id").collect()
    assert np.mean([(r.bad_quality > 0.5) == (r.quality == 0) for r in rows]) > 0.97
    clean = [r.kept for r in rows if r.quality == 1 and r.bad == 0]
    assert np.mean(clean) > 0.98
    found = QUERIES["op4_quality"](spark, sf)
    assert found.count() == docs.count() and found.columns == ["doc_id", "bad_quality", "toxic", "kept"]


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(1, "plain words here", 1), (None, None, 1), (2, "", 1), (2, "", 1), (3, "x " * 60, 1), (4, "more plain words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1, 0, 5), (1, 1, None, 5), (3, 0, 0, 5), (4, 1, 0, 5), (None, 0, 1, 5), (99, None, 1, 5)], "doc_id long, quality int, toxic int, text int")
    for own in (labels, labels.limit(0)):
        got = score(docs, fit(docs, own)).collect()
        assert [r.doc_id for r in got] == [1, None, 2, 2, 3, 4]
        assert all(r.kept is True and r.bad_quality == 0.0 for r in got[1:4]) and got[0].kept
    assert score(docs.limit(0), fit(docs.limit(0), labels)).select(F.col("kept")).count() == 0
