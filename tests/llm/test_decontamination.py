import random

import numpy as np

from verdigris.llm.common import word_hashes
from verdigris.llm.decontamination import GAP, MATCH, MISMATCH, align, find_leaks, norm_words, without_leaks
from verdigris.llm.queries import QUERIES


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if x == y else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
    return max(map(max, h))


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(1, 15))], [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]) for _ in range(200)]
    got, end = align([word_hashes(a) for a, _ in pairs], [word_hashes(b) for _, b in pairs])
    assert got.tolist() == [smith_waterman(a, b) for a, b in pairs]
    assert all(g == smith_waterman(a, b[:e]) for (a, b), g, e in zip(pairs, got, end, strict=True))


def corpus(rng):
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 80
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(14, 50)))) for i in range(25)]
    docs = []
    for d in range(200):
        t = rng.choices(words, k=rng.randrange(0, 300))
        if rng.random() < 0.4:
            copy = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, len(copy) // 6 + 1)):
                k, kind = rng.randrange(len(copy)), rng.random()
                copy[k : k + 1] = [] if kind < 0.3 else [rng.choice(words)] if kind < 0.7 else [copy[k], rng.choice(words)]
            k = rng.randrange(len(t) + 1)
            t[k:k] = copy
        docs.append((d, " ".join(w.upper() + "," if rng.random() < 0.1 else w for w in t)))
    return docs, items


def test_finds_what_aligning_every_pair_finds(spark):
    docs, items = corpus(random.Random(11))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.score for r in found}
    want = {}
    for i, t in items:
        a = norm_words(t)
        scores, _ = align([word_hashes(a)] * len(docs), [word_hashes(norm_words(x)) for _, x in docs])
        want |= {(d, i): s / (MATCH * len(a)) for (d, _), s in zip(docs, scores, strict=True) if s >= 0.5 * MATCH * len(a)}
    assert set(got) <= set(want) and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert {k for k, s in want.items() if s >= 0.6} <= set(got)


def test_finds_copies_with_an_edit_every_few_words_down_to_the_limit(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=14 + i))) for i in range(30)]
    docs = []
    for i, t in items:
        for every in (4, 5, 6):
            for kind in range(3):
                copy = t.split()
                for k in reversed(range(every - 1, len(copy), every)):
                    copy[k : k + 1] = [[], ["new"], [copy[k], "new"]][kind]
                while smith_waterman(t.split(), copy[:-1]) >= 0.5 * MATCH * len(t.split()):
                    copy.pop()
                docs += [copy, copy[:-1]]
    docs = [(d, " ".join([*rng.choices(words, k=40), *copy, *rng.choices(words, k=40)])) for d, copy in enumerate(docs)]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, t in items:
        scores, _ = align([word_hashes(t.split())] * len(docs), [word_hashes(x.split()) for _, x in docs])
        want |= {(d, i): s / (MATCH * len(t.split())) for (d, _), s in zip(docs, scores, strict=True) if s >= 0.5 * MATCH * len(t.split())}
    assert len(want) >= 270 and min(want.values()) == 0.5
    assert {(r.doc_id, r.item_id): r.score for r in found} == want


def test_query_finds_every_verbatim_item(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: " ".join(norm_words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " ".join(norm_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op3_decontamination"](spark, sf).collect()}
    assert want and all(got[k] == 1.0 for k in want)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    item = "one two three four five six seven eight"
    rows = [(1, item), (None, item), (2, "x " + item), (2, "x " + item), (2, "clean"), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, "a b"), (9, None), (None, item), (7, item)], "item_id long, text string")
    found = sorted((tuple(r)[:1] + tuple(r)[2:] for r in find_leaks(docs, items).collect()), key=repr)
    assert found == sorted([(1, 7, 1.0, 0, 7), (None, 7, 1.0, 0, 7), (2, 7, 1.0, 1, 8)], key=repr)
    assert sorted(((r.doc_id, r.text) for r in without_leaks(docs, items).collect()), key=repr) == sorted([(2, "clean"), (3, None), (4, "")], key=repr)
    assert find_leaks(docs.limit(0), items).count() == 0 == find_leaks(docs, items.limit(0)).count()
    assert np.array_equal(sorted(without_leaks(docs, items.limit(0)).columns), sorted(docs.columns))


def test_documents_of_a_batch_share_a_frame(spark, monkeypatch):
    item = "some words that stand in an item of the benchmark"
    docs = spark.createDataFrame([(d, f"{item} {d}" if d % 10 == 0 else f"{d} some words that {d} stand alone") for d in range(100)], "doc_id long, text string")
    frames, plain = [], type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda df, fn, schema: frames.append((df, fn, schema)) or plain(df, fn, schema))
    found = find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 100, 10))
    texts, score, _ = next(x for x in frames if "last_word" in x[2])
    out = list(score(iter([texts.toPandas()])))
    assert len(out) == 1 and len(out[0]) == 10
    assert list(score(iter([texts.where("doc_id % 10 > 0").toPandas()]))) == []
