"""Exact Jaccard join of word shingles by prefixes under several token orders.

Two sets that are similar enough share a token among the first few of each, under any order of all tokens.
The first order finds the candidates: Spark brings equal prefix tokens together. A candidate must then share
prefix tokens under the other orders too, before the sets are compared. All orders put frequent tokens last,
as far as a count sketch of fixed size knows them, and differ in how they mix the others. Sets that still meet many
others meet under one more order, by how many of just these sets hold a token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import gram_hashes, mix, saved, slices, word_hashes, words_of
from verdigris.llm.graph import components

#: Cells of the count sketch, and cells in one row of it.
SKETCH, SKETCH_ROW = 1 << 18, 1 << 12

#: Classes of a token from which on it is hot, hundredths of its prefix that a crowded set meets others in, marks of
#: token frequency among crowded sets and in one row of them. They decide effort, never the result.
HOT, CROWDED = 8, 40
MARKS, MARKS_ROW = 1 << 20, 1 << 12

#: Bits of a set's parity map: a power of two near its size, between these.
LEAST_BITS, MOST_BITS = 64, 1 << 16

SALTS = [np.uint64(s) for s in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def token_sets(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens (64-bit hashes of shingles of lower-cased words) of many texts, and how many each text
    has. Tokens of a text are sorted. A text of fewer words is one token; one without words has none."""
    split = [words_of(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if t else [] for t in texts]
    lengths = np.array([len(ws) for ws in split], np.int64)
    h = word_hashes([w for ws in split for w in ws])
    doc = np.repeat(np.arange(len(texts)), lengths)
    end = np.cumsum(lengths)
    grams = gram_hashes(h, shingle)
    whole = np.flatnonzero(np.arange(len(grams)) + shingle <= end[doc[: len(grams)]])
    short = np.flatnonzero((lengths > 0) & (lengths < shingle))
    alone = [gram_hashes(h[end[d] - lengths[d] : end[d]], int(lengths[d])) for d in short]
    tokens, owner = np.concatenate([grams[whole], *alone]), np.concatenate([doc[whole], short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])[: len(tokens)]
    return tokens[new], np.bincount(owner[new], minlength=len(texts))


def parity_map(tokens: np.ndarray) -> bytes:
    """Each token flips one bit. Maps of a half size are the two halves' difference, so that sets of
    different sizes compare; bits that differ are at most tokens that differ."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(1, len(tokens)))))))
    flips = np.bincount((mix(tokens ^ SALTS[3]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """A row per document (doc_id, n, two hashes of its set, parity map) and rows of the count sketch."""

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in slices(batch["t"]):
                tokens, sizes = token_sets(list(batch["t"].iloc[part]), shingle)
                sketch += np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([[np.zeros(2, np.uint64)], np.cumsum(np.stack([mix(tokens ^ SALTS[0]), mix(tokens ^ SALTS[1])], axis=1), axis=0, dtype=np.uint64)])
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    keys = (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)
                yield pd.DataFrame({
                    "doc_id": batch["d"].iloc[part].to_numpy(), "n": sizes, "k1": keys[:, 0], "k2": keys[:, 1],
                    "map": [parity_map(tokens[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)],
                    "row": -1, "cells": None,
                })
        for row, cells in enumerate(sketch.reshape(-1, SKETCH_ROW)):
            yield pd.DataFrame({"doc_id": [None], "n": [0], "k1": [0], "k2": [0], "map": [None], "row": [row], "cells": [cells]})

    ids = docs.select(F.col("doc_id").cast("string").alias("d"), "t")
    found = ids.mapInPandas(facts, "doc_id string, n long, k1 long, k2 long, map binary, row int, cells array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def frequency_classes(facts: DataFrame) -> np.ndarray:
    """For every sketch cell 0, or more the farther its count lies above what mixing alone explains.

    SKETCH numbers reach the driver, however large the corpus."""
    cells = facts.where("row >= 0").select("row", F.posexplode("cells").alias("at", "n"))
    rows = cells.groupBy("row", "at").agg(F.sum("n").alias("n")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("c")).select("row", F.col("c.n").alias("n")).collect()
    total = np.zeros(SKETCH)
    for r in rows:
        total[r.row * SKETCH_ROW : (r.row + 1) * SKETCH_ROW] = r.n
    usual = np.median(total)
    above = (total - usual) / (4 * np.sqrt(usual + 1) + 8)
    return np.where(above >= 1, 1 + np.floor(np.log2(np.maximum(above, 1))), 0).astype(np.uint64)


def ranks(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Place of every token in one of the global orders."""
    mixed = mix(tokens ^ SALTS[order])
    return (classes[(tokens & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mixed >> np.uint64(6))


class Threshold:
    """Similarity of at least `percent` hundredths, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n):
        """Tokens of which a similar set must share one, whatever its size."""
        most = self.percent * n + 99
        return n - (F.floor(most / 100) if isinstance(n, Column) else most // 100) + 1

    def overlap(self, a, b):
        """Common tokens that sets of sizes a and b need."""
        total = self.percent * (a + b) + 99 + self.percent
        return F.floor(total / (100 + self.percent)) if isinstance(total, Column) else total // (100 + self.percent)


def postings(docs: DataFrame, shingle: int, at_least: Threshold, classes) -> DataFrame:
    """token, doc_id, n, pos: the prefix of every set under the first order of these classes."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["t"]):
                tokens, sizes = token_sets(list(batch["t"].iloc[part]), shingle)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((ranks(tokens, classes.value, 0), owner))
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                kept = pos < at_least.prefix(sizes)[owner]
                yield pd.DataFrame({"token": tokens[order][kept].view(np.int64), "doc_id": batch["d"].iloc[part].to_numpy()[owner[kept]], "n": sizes[owner[kept]], "pos": pos[kept]})

    chosen = docs.where("doc_id IS NOT NULL AND t IS NOT NULL").select(F.col("doc_id").alias("d"), "t")
    return chosen.mapInPandas(emit, "token long, doc_id long, n long, pos int")


def shared_classes(docs: DataFrame, shingle: int) -> np.ndarray:
    """For every mark 0, or more the more of these texts hold a token with that mark.

    Every token is counted. Tokens in under 4 texts get no mark, nor do the next more frequent ones while more than a
    quarter of the marks would be in use. MARKS numbers reach the driver, however many texts there are."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["t"]):
                yield pd.DataFrame({"token": token_sets(list(batch["t"].iloc[part]), shingle)[0].view(np.int64)})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(MARKS_ROW, np.uint8)
        out[rows["at"]] = rows["class"]
        return pd.DataFrame({"row": rows["row"].iloc[:1], "marks": [out.tobytes()]})

    counted = docs.select("t").mapInPandas(emit, "token long").groupBy("token").count().where("count >= 4")
    frequent = saved(counted.select("token", F.least(F.lit(63), F.floor(2 * F.log2("count"))).cast("int").alias("class")), "frequent")
    least, total = 64, 0
    for r in sorted(frequent.groupBy("class").count().collect(), reverse=True):
        total += r["count"]
        if total > MARKS // 4 and least < 64:
            break
        least = r["class"]
    mark = F.col("token").bitwiseAND(MARKS - 1)
    marks = frequent.where(F.col("class") >= least).groupBy(mark.alias("mark")).agg(F.max("class").alias("class"))
    rows = marks.select(F.floor(F.col("mark") / MARKS_ROW).cast("int").alias("row"), F.col("mark").bitwiseAND(MARKS_ROW - 1).cast("int").alias("at"), "class")
    out = np.zeros(MARKS, np.uint8)
    for r in rows.groupBy("row").applyInPandas(packed, "row int, marks binary").collect():
        out[r.row * MARKS_ROW : (r.row + 1) * MARKS_ROW] = np.frombuffer(r.marks, np.uint8)
    return out


def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by token, those whose token the row before or behind has too."""
    last, again = None, False
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
        token = rows["token"].to_numpy()
        same = token[1:] == token[:-1]
        kept = np.concatenate([[again], same[:-1]]) | same if len(same) else np.zeros(0, bool)
        yield rows.iloc[:-1][kept]
        last, again = rows.iloc[-1:], bool(same[-1]) if len(same) else again
    if last is not None and again:
        yield last


def alike(sizes: DataFrame, pairs: DataFrame, at_least: Threshold) -> DataFrame:
    """Pairs a, b whose sizes and parity maps allow the similarity."""

    @F.pandas_udf("boolean")
    def near(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        most = n + m - 2 * at_least.overlap(n, m)
        return pd.Series([differing_bits(x, y) <= d for x, y, d in zip(a, b, most, strict=True)], dtype=bool)

    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("map").alias(f"map_{side}")), side)
    fits = at_least.overlap(F.col("n_a"), F.col("n_b")) <= F.least("n_a", "n_b")
    return pairs.where(fits).where(near("n_a", "n_b", "map_a", "map_b")).select("a", "b").distinct()


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, at_least: Threshold, classes, orders: int) -> DataFrame:
    """Pairs that share prefix tokens under all further orders and whose sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["t_a"] + batch["t_b"]):
                own = batch.iloc[part]
                linked = []
                tokens, sizes = token_sets([*own["t_a"], *own["t_b"]], shingle)
                sets = np.split(tokens, np.cumsum(sizes)[:-1])
                for x, y in zip(sets[: len(own)], sets[len(own) :], strict=True):
                    need = at_least.overlap(len(x), len(y))
                    linked.append(min(len(x), len(y)) >= need and share_prefixes(x, y, at_least, classes.value, orders) and len(np.intersect1d(x, y, assume_unique=True)) >= need)
                yield own[["a", "b"]][linked]

    for side in ("a", "b"):
        pairs = pairs.join(docs.select(F.col("doc_id").alias(side), F.col("t").alias(f"t_{side}")), side)
    return pairs.where("t_a IS NOT NULL AND t_b IS NOT NULL").mapInPandas(check, "a long, b long")


def share_prefixes(x: np.ndarray, y: np.ndarray, at_least: Threshold, classes: np.ndarray, orders: int) -> bool:
    """Whether two sets share a prefix token under each of the orders after the first."""
    for order in range(1, orders):
        first = []
        for s in (x, y):
            r = ranks(s, classes, order)
            first.append(s[np.argsort(r, kind="stable")[: at_least.prefix(len(s))]])
        if not np.isin(*first).any():
            return False
    return True


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 75, orders: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: its set's size, and the smallest id reachable by links.

    Sets hold the distinct shingles of `shingle` words of the lower-cased (A-Z) text, or the whole text
    as one if it has fewer words. Two texts link when their sets' similarity is at least `percent`
    hundredths; a text that is null or has no words has size 0 and links with nothing. Rows of one id are
    one document: what either links to, both reach. A null id is no document: its component is null, and it
    links nothing. Repeated rows stay repeated; other columns are not read; an empty table gives no rows.

    Equal sets are one class. Candidates come in two turns, and no pair is left out: first each class meets
    the first class of each of its prefix tokens, which joins copies of one text without comparing all of
    them; then classes that share a prefix token and are still in different components meet each other. There, a
    hot token brings no two crowded classes together: crowded ones, whose prefix others share to a large part, are
    few, so that their tokens can be counted and put in an order in which they meet late or not at all.
    Sizes, places in the prefix and parity maps of the sets discard candidates before texts are read."""
    spark, at_least = docs.sparkSession, Threshold(percent)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    facts = saved(describe(own, shingle), "sets")
    classes = spark.sparkContext.broadcast(frequency_classes(facts))
    sets = facts.where("row < 0").select("doc_id", "n", "k1", "k2", "map")
    named = sets.where("doc_id IS NOT NULL AND n > 0")
    # written before it is joined, so that a hot class can be split
    least = saved(named.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    labels = saved(named.select("doc_id", "n", "k1", "k2").join(least, ["n", "k1", "k2"]).select("doc_id", "rep", "n").distinct(), "labels")
    models = least.withColumnRenamed("rep", "doc_id")
    sizes = named.join(models, ["doc_id", "n", "k1", "k2"]).select(F.col("doc_id").alias("rep"), "n", "map").dropDuplicates(["rep", "n"])
    sizes = saved(sizes, "sizes")

    posted = postings(own, shingle, at_least, classes).drop("n").repartition("token").sortWithinPartitions("token", "doc_id")
    common = saved(posted.mapInPandas(met, "token long, doc_id long, pos int"), "common")
    members = common.join(labels, "doc_id").groupBy("token", "rep", "n").agg(F.min("pos").alias("pos"))
    firsts = members.groupBy("token").agg(F.min(F.struct("rep", "n", "pos")).alias("f"), F.max("rep").alias("last")).where("f.rep < last")
    members = saved(members.join(firsts.select("token", "f"), "token"), "members")

    def possible(n, pos, m, at):
        """Whether the tokens from these places on can still be enough."""
        return at_least.overlap(F.col(n), F.col(m)) <= F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))

    star = members.where("rep > f.rep").where(possible("n", "pos", "f.n", "f.pos")).select(F.col("f.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = saved(verified(own, alike(sizes, star, at_least), shingle, at_least, classes, orders), "links")
    twice = labels.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    links = links.unionByName(twice)
    reached = components(links)

    now = members.join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = now.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("k")).where("c0 < c1")
    meeting = members.groupBy("rep").agg(F.countDistinct("token").alias("common"))
    rest = F.col("n") - at_least.prefix(F.col("n"))
    crowded = (F.col("k") > HOT) & (100 * F.col("common") >= CROWDED * (F.col("n") - F.col("rest")))
    open_members = now.join(mixed.select("token", "k"), "token").where("rep > f.rep").join(meeting, "rep")
    open_members = saved(open_members.withColumn("rest", rest).withColumn("crowded", crowded).select("token", "rep", "n", "pos", "c", "rest", "common", "crowded"), "open")
    # of a pair, the prefix that ends first holds no more shared tokens than it has common ones, and the rest follows
    enough = at_least.overlap(F.col("x.n"), F.col("y.n")) <= F.greatest("x.rest", "y.rest") + F.least("x.common", "y.common")

    def crossing(members: DataFrame, also: Column) -> DataFrame:
        x, y = members.alias("x"), members.alias("y")
        meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.c") < F.col("y.c")) & possible("x.n", "x.pos", "y.n", "y.pos") & also
        return x.join(y, meets).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))

    crowd = saved(open_members.where("crowded").select(F.col("rep").alias("doc_id"), "c").distinct(), "crowd")
    few = saved(own.join(crowd, "doc_id"), "crowded")
    counted = spark.sparkContext.broadcast(shared_classes(few, shingle))
    again = saved(postings(few, shingle, at_least, counted).withColumnRenamed("doc_id", "rep").join(crowd.withColumnRenamed("doc_id", "rep"), "rep"), "again")
    cross = crossing(open_members, enough & ~(F.col("x.crowded") & F.col("y.crowded"))).unionByName(crossing(again, F.lit(True))).distinct()
    more = saved(verified(own, alike(sizes, cross, at_least), shingle, at_least, classes, orders), "more")
    reached = components(links.unionByName(more))

    ends = labels.join(reached.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(ends, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
