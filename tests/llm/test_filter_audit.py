"""Every order replayed document by document, beside the diagrams."""

import itertools
import random

import pytest

from verdigris.llm.filter_audit import Diagram, audit, neighbour_swaps, text_mask

DOCS = "doc_id long, text string, lang string, source string, quality int"
LABELS = "doc_id long, quality int, toxic int, text string"


def failures(rows):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and first[text] < i,
        }
        yield i, lang or "", {k for k, v in fails.items() if v}


def replay(rows, labels):
    judged = list(failures(rows))
    good = {i for i, q, _, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    out = []
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        share = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                share[x] += len(gone)
                redundant = sum(x in f for _, f in mine) - len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), redundant, sum(f == {x} for _, f in mine),
                              sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*s, share[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [" ".join(rng.choice([f"w{rng.randrange(400)}", "Same", "UPPER", "of"]) for _ in range(rng.choice([3, 90, 100, 140, 300]))) for _ in range(40)]
    texts += ["", None, "a|b", "É x " * 120, "\x0b\t", " ".join(f"word{k}" for k in range(20_000)), "50 %", "x" * 300_000]
    out = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""]), "s", 7) for i in range(300)]
    return out + [(7, "twice", "en", "s", 7)] * 2 + [(None, "twice", "en", "s", 7), (None, None, None, None, None), (900, "twice", "en", "s", 7)]


def test_audit_equals_replay(spark, rows):
    rng = random.Random(6)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 320, 2)] + [(4, 1, 0, "x"), (4, 1, 0, "x"), (None, 1, 1, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = sorted(tuple(r) for r in audit(docs, spark.createDataFrame(labels, LABELS)).collect())
    assert found == replay(rows, labels)
    assert len(found) == 600 * len({r[0] for r in found})


def test_no_documents_no_labels(spark, rows):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(docs, labels).collect() == []
    few = rows[:20]
    assert sorted(tuple(r) for r in audit(spark.createDataFrame(few, DOCS), labels).collect()) == replay(few, [])


def test_swaps_pass_by_every_order():
    order, seen = list(range(5)), {tuple(range(5))}
    for level in neighbour_swaps(5):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.add(tuple(order))
    assert len(seen) == 120


def test_diagram_shares_equal_parts():
    diagram = Diagram({0: (5, 0, 0)}, 5)
    assert len(diagram.nodes) <= 2 + 2 * 5
    assert diagram.weight[diagram.root] == (5, 0, 0)


def test_masks_at_the_bounds():
    hundred = " ".join(f"v{k}" for k in range(100))
    assert text_mask(hundred.encode(), len(hundred)) == 0
    assert text_mask(" ".join(hundred.split()[:99]).encode(), 300) & 1
    dull = " ".join([f"v{k}" for k in range(80)] + ["v1"] * 20)
    assert text_mask(dull.encode(), len(dull)) == 0
    assert text_mask(("A" + "b" * 9).encode(), 10) == 1 and text_mask(("AA" + "b" * 9).encode(), 11) == 5
