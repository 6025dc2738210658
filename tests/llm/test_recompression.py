import hashlib
import random
import re

import numpy as np
import pytest

from verdigris.llm.common import word_hashes
from verdigris.llm.queries import QUERIES
from verdigris.llm.recompression import Sums, digest_repeats, drop_repeats, recompress, stretches

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    words = [(d, BLANK.findall(t or "")) for d, t in rows]
    for d, ws in words:
        for i in range(len(ws) - window + 1) if d is not None else ():
            key = tuple(ws[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - window + 1) if d is not None else ():
            if first[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, window, rounds=3):
    return sorted((tuple(r) for r in digest_repeats(df, window=window, rounds=rounds).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_symbols_depend_on_their_context_only():
    rng = random.Random(4)
    for _ in range(200):
        core = [rng.choice("abcde") for _ in range(40)]
        parses = []
        for _ in range(2):
            around = [[rng.choice("abcdef") for _ in range(rng.randrange(0, 9))] for _ in (0, 1)]
            text = around[0] + core + around[1]
            s = recompress(word_hashes(text), np.zeros(len(text), int), 3)
            a = len(around[0])
            assert (np.diff(s.left) >= 0).all() and (np.diff(s.right) >= 0).all()
            inside = (s.left >= a) & (s.right <= a + 40)
            parses.append([(n, x - a, y - a, u - a, v - a) for n, x, y, u, v in zip(s.name[inside], s.start[inside], s.end[inside], s.left[inside], s.right[inside], strict=True)])
        assert parses[0] == parses[1]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    docs = [[rng.choice("abc") for _ in range(rng.randrange(0, 60))] for _ in range(60)] + [["x"] * 70, ["x"] * 40, ["x", "y"] * 30, ["y"] + ["x", "y"] * 25]
    docs += [d[3:40] + ["q"] + d[:30] for d in docs[:20]]
    f = stretches(word_hashes([w for d in docs for w in d]), np.array([len(d) for d in docs]), 12, 3)
    seen, windows = {}, 0
    for d, i, n, key in zip(f["doc"], f["first"], f["n"], f["key"], strict=True):
        for j in range(i, i + n):
            windows += 1
            assert seen.setdefault(tuple(docs[d][j : j + 12]), key) == key
    assert windows == sum(max(0, len(d) - 11) for d in docs)


def test_stretch_hashes_do_not_depend_on_the_place():
    w = word_hashes(list("abcabcabc"))
    h = Sums(w).stretch(np.array([0, 3, 1]), np.array([6, 9, 7]))
    assert h[0] == h[1] != h[2]


@pytest.mark.parametrize("window", [4, 9])
def test_equals_all_windows(spark, window):
    rng = random.Random(window)
    base = [[rng.choice("abcdefgh") for _ in range(80)] for _ in range(6)]
    rows = []
    for d in range(150):
        kind, t = rng.random(), list(rng.choice(base))
        if kind < 0.5:
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice("abcdefghij")
        elif kind < 0.8:
            i = rng.randrange(60)
            t = [rng.choice("klmnop") for _ in range(rng.randrange(30))] + t[i : i + rng.randrange(40)] + [rng.choice("klm")] * rng.randrange(30)
        rows.append((d * 3 % 151, rng.choice([" ", "\n", "\t "]).join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, window) == brute(rows, window)


def test_query_equals_all_windows_of_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op5_substring_dedup"](spark, sf).collect()), key=repr) == brute(rows, 50)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (None, text), (2, text), (2, text), (2, "x " + text), (3, None), (4, ""), (0, "a\x1cb c\x85d e")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_words string")
    assert got(df, 5) == brute(rows, 5)
    kept = sorted(((r.doc_id, r.kept_text) for r in drop_repeats(df, window=5).collect()), key=repr)
    assert kept == sorted([(1, text), (None, text), (2, ""), (2, ""), (2, "x"), (3, None), (4, ""), (0, "a\x1cb c\x85d e")], key=repr)
    assert drop_repeats(df.limit(0)).count() == 0
