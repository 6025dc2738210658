"""Dropped lines beside a plain count over all documents."""

import random

from verdigris.llm.line_runs import LevelledRuns, drop_shared_lines, line_key

SCHEMA = "doc_id long, text string, line string, n int, keeper string"


def plain(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    pool = [f"{'ÄßÉ'[k % 3]} line number {k:04d} " + "x" * (k % 9) for k in range(60)] + ["short", "", " \t", "nineteen characters", "Twenty characters ok", "é" * 20, "é" * 19]
    rows = []
    for i in range(size):
        lines = [rng.choice(pool) for _ in range(rng.randrange(6))]
        lines = [rng.choice([x, x.upper() if x.isascii() else x, f" {x}\r", f"\x0b{x}"]) for x in lines]
        rows.append((i * 7 % size, "\n".join(lines), "a", 1, "b"))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in drop_shared_lines(df, **kw).collect()), key=repr)


def test_drops_equal_plain_count(spark):
    rows = corpus(1, 160)
    assert run(spark, rows, batches=5, fanout=2) == plain(rows)


def test_nulls_repeats_and_long_texts(spark):
    hot = "the line that every document holds"
    rows = [(i, f"{hot}\nown line of document {i}", None, None, None) for i in range(30)]
    rows += [(None, hot, None, None, None), (None, None, None, None, None), (40, None, None, None, None), (41, "", None, None, None)]
    rows += [(50, "held twice by one document\nheld twice by one document", None, None, None)] * 2 + [(51, "held twice by one document", None, None, None)]
    rows += [(60 + k, "\n".join(f"long text, line number {j:07d}" for j in range(20_000)) + "\n" + hot, None, None, None) for k in range(3)]
    assert run(spark, rows, batches=3, fanout=2) == plain(rows)


def test_one_document_no_documents(spark):
    rows = [(1, "a line of more than twenty characters", "x", 1, "y")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_levels_are_compacted(spark):
    runs = LevelledRuns(spark, least=2, fanout=2)
    for k in range(4):
        runs.add(spark.createDataFrame([(b"a", 1, 10 - k), (bytes([k]), 1, 10 - k)], "line binary, n long, keeper long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(b"a", 10)]


def test_key_lowers_ascii_only():
    assert line_key("\x0b ÀB c\r".encode()) == "Àb c".encode()
