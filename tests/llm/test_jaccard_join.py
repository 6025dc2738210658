import random
import re

import numpy as np
import pytest

from verdigris.llm import jaccard_join
from verdigris.llm.graph import components
from verdigris.llm.jaccard_join import SKETCH, Threshold, differing_bits, link, met, parity_map, share_prefixes, token_sets
from verdigris.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n=5, percent=75):
    sets = [(d, shingles(t, n)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            e, t = sets[j]
            both = len(s & t)
            if None not in (d, e) and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=repr)


def got(df, **kw):
    return sorted((tuple(r) for r in link(df, **kw).collect()), key=repr)


def test_prefixes_hold_a_common_token_of_every_similar_pair():
    rng, t, classes = np.random.default_rng(1), Threshold(75), np.zeros(SKETCH, np.uint64)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        similar = 100 * both >= 75 * (len(x) + len(y) - both)
        assert similar == (both >= t.overlap(len(x), len(y)))
        if similar and len(y):
            assert share_prefixes(x, y, t, classes, 4)
            assert differing_bits(parity_map(x), parity_map(y)) <= len(x) + len(y) - 2 * both


def test_maps_of_different_sizes_compare():
    x = np.arange(1, 3000, dtype=np.uint64)
    assert differing_bits(parity_map(x), parity_map(x[:60])) <= 3000 - 61
    assert differing_bits(parity_map(x), parity_map(x)) == 0


def test_token_sets():
    tokens, sizes = token_sets(["A b c d e f", None, "a B C D e F a b c d e f", "a b", "A\x1cb", "", " a  b "], 5)
    assert sizes.tolist() == [2, 0, 6, 1, 1, 0, 1]
    assert set(tokens[:2]) <= set(tokens[2:8]) and tokens[8] == tokens[-1] != tokens[9]


def test_met_keeps_groups_over_batches():
    import pandas as pd

    tokens = [1, 2, 2, 2, 3, 4, 4, 5, 6, 6]
    for size in (1, 2, 3, 10):
        batches = [pd.DataFrame({"token": tokens[i : i + size]}) for i in range(0, 10, size)]
        assert [t for b in met(iter(batches)) for t in b["token"]] == [2, 2, 2, 4, 4, 6, 6]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(40)] + [(5, 5), (7777, 7777)]
    import itertools

    up = {n: n for n in itertools.chain(*links)}
    for _ in range(400):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == up
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [75, 40])
def test_equals_all_pairs(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randrange(2, 120))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(25)]
    rows = []
    for d in range(260):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.4:
            t = [rng.choice(words) for _ in range(rng.randrange(0, 60))] + passage
        rows.append((d * 7 % 263, " ".join(w.upper() if rng.random() < 0.1 else w for w in t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, percent=percent) == brute(rows, percent=percent)


def test_query_equals_all_pairs_of_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op9_jaccard_join"](spark, sf).collect()), key=repr) == brute(rows)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    text = "a b c d e f g h i j k"
    rows = [(4, text), (None, text), (2, text.upper()), (2, text.upper()), (2, "x y"), (9, "x y"), (3, None), (5, ""), (6, "x  Y\n"), (7, "z")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, rep string")
    assert got(df) == brute(rows)
    assert link(df.limit(0)).count() == 0


def test_families_of_half_alike_texts_do_not_meet_pair_by_pair(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    bodies = [some(60) for _ in range(20)]
    rows = [(d, " ".join(bodies[d % 20] + some(45))) for d in range(220)]
    # in one family, two links of a member that comes late
    rows += [(300 + d, " ".join(rows[200 + d][1].split()[:100] + some(5))) for d in range(2)]
    met = []
    monkeypatch.setattr(jaccard_join, "alike", lambda sizes, pairs, at_least, alike=jaccard_join.alike: (met.append(pairs.count()), alike(sizes, pairs, at_least))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)
    assert len(met) == 2 and met[1] < 100
