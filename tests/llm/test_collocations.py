"""Phrases beside a plain count of all word sequences."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from verdigris.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, phrase string, f int"


def plain(rows, least, covered=80, top=2000):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        count, n = Counter(), 0
        for _, text, own, *_ in rows:
            if (own or "und") != lang:
                continue
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
                ws = [w for w in re.split("[ \t]+", piece) if w]
                n += len(ws)
                for k in range(1, 5):
                    count.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        live = {p: f for p, f in count.items() if f >= least}
        scored = []
        for p, a in live.items():
            if len(p) > 1:
                score, _, l, r = min((2_000_000 * a // (live[p[:h]] + live[p[h:]]), h, live[p[:h]], live[p[h:]]) for h in range(1, len(p)))
                hidden = any(len(q) > len(p) and 100 * f >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in live.items())
                if not hidden:
                    scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    stock = ["New York stock", "per se", "in the end of", "Ärger mit der", "a a a a", "ÉTAT civil", "x y z"]
    rows = []
    for i in range(size):
        words = [rng.choice(stock) if rng.random() < 0.5 else f"w{rng.randrange(12)}" for _ in range(rng.randrange(12))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " -"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"]), "p", 1))
    return rows


def run(spark, rows, **kw):
    return sorted(tuple(r) for r in col.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_plain_count(spark, monkeypatch, seed):
    rows = corpus(seed, 250)
    assert run(spark, rows, least=5) == plain(rows, 5)
    assert run(spark, rows, least=5, top=3) == plain(rows, 5, top=3)


def test_nulls_long_texts_and_repeats(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, None), (2, "over and over " * 30_000, "en", None, None)]
    rows += [(3, "said once. said once", "de", None, None)] * 20
    assert run(spark, rows, least=30) == plain(rows, 30)
    assert run(spark, rows[:2], least=1) == []
    assert run(spark, [], least=1) == []


def test_tiles_count_every_pair():
    rng = np.random.default_rng(3)
    known = np.sort(rng.choice(5_000, 1_500, replace=False))
    tiles, joints, parts = col.Tiles(), [], []
    for _ in range(3):
        places = np.minimum(rng.geometric(0.004, 60_000), len(known)) - 1
        joint = places[:-1] * len(known) + places[1:]
        joints.append(joint)
        parts += tiles.count("en", known, joint)
    assert tiles.dense
    parts += tiles.rest()
    found = Counter()
    for _, a, b, c in parts:
        for x, y, z in zip(a.tolist(), b.tolist(), c.tolist()):
            found[x, y] += z
    joint = np.concatenate(joints)
    assert found == Counter(zip(known[joint // len(known)].tolist(), known[joint % len(known)].tolist()))


def test_dense_tiles_make_room(monkeypatch):
    monkeypatch.setattr(col, "DENSE_FROM", 1)
    monkeypatch.setattr(col, "MOST_DENSE", 2)
    known, tiles = np.arange(0, 4_000, 400), col.Tiles()
    joint = np.arange(len(known) ** 2)
    parts = [*tiles.count("x", known, joint), *tiles.rest()]
    assert sum(int(c.sum()) for *_, c in parts) == len(joint)


def test_longer_phrases_are_counted_without_a_join(spark, monkeypatch):
    rows, joins = corpus(5, 250), []
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain_join = type(df).join
    monkeypatch.setattr(type(df), "join", lambda l, r, *on, **kw: joins.append(l.columns) or plain_join(l, r, *on, **kw))
    assert sorted(tuple(r) for r in col.collocations(df, least=5).collect()) == plain(rows, 5)
    assert sum("chunk" in columns for columns in joins) == 1  # words only, pairs and threes of chunks meet nothing


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(6, 250)
    monkeypatch.setattr(col, "phrase_filter", lambda phrases, k: np.full(col.FILTER_BITS // 8, 255, np.uint8))
    assert run(spark, rows, least=5) == plain(rows, 5)


def test_stretches_without_numbers_are_one_place():
    ids, codes = col.packed(np.array([-1, -1, 7, 3, -1, -1, -1, 7, -1]))
    assert ids.tolist() == [3, 7]
    assert codes.tolist() == [1, 0, -1, 1, -1]


@pytest.mark.parametrize("values", [[], [-1], [0, 254, -1], [70_000, 255, 256], [2**40, -1, 5]])
def test_blobs_give_back_their_numbers(values):
    assert col.large(col.small(np.array(values, np.int64))).tolist() == values
