"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram that a document and an item share is a seed: which n-grams of an item edits leave intact is known
only from the document. Around the seeds both are aligned word by word; the score tells how much of the item an
edited copy still holds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import gram_hashes, saved, slices, word_hashes

WORD = re.compile(r"[^\W_]+")

#: Bits of the filter of item n-grams that every task holds: a fixed size; what passes it is joined exactly.
FILTER_BITS = 1 << 22

#: Width of the diagonal bands in which seeds share a window of the document.
BAND = 32

#: Item texts whose words a worker keeps at most, between batches.
CACHE_ITEMS = 10_000

#: Alignment: a common word, a differing word, a word that only one side has.
MATCH, MISMATCH, GAP = 2, -1, -1


def norm_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def item_grams(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """item_id, length, pos, gram of every n-gram of every item."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, t in zip(batch["i"], batch["t"], strict=True):
                words = norm_words(t)
                grams = gram_hashes(word_hashes(words), n)
                yield pd.DataFrame({"item_id": i, "length": len(words), "pos": np.arange(len(grams)), "gram": grams.view(np.int64)})

    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").dropDuplicates()
    return chosen.mapInPandas(cut, "item_id long, length int, pos int, gram long")


def bit_filter(grams: DataFrame) -> np.ndarray:
    """Which of FILTER_BITS cells hold an n-gram; at most as many numbers reach the driver as bytes."""
    cell = grams.select(F.pmod("gram", F.lit(FILTER_BITS)).cast("int").alias("cell"))
    octets = cell.groupBy((F.col("cell") / 8).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, cell % 8))").alias("bits"))
    rows = octets.toPandas()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"]
    return np.unpackbits(out, bitorder="little").astype(bool)


def hits(docs: DataFrame, present, n: int) -> DataFrame:
    """doc_id, mark, at, gram: places of n-grams of documents that the filter lets through."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["t"]):
                own = batch.iloc[part]
                split = [norm_words(t) for t in own["t"]]
                lengths = np.array([len(ws) for ws in split], np.int64)
                begin = np.cumsum(lengths) - lengths
                doc = np.repeat(np.arange(len(split)), lengths)
                grams = gram_hashes(word_hashes([w for ws in split for w in ws]), n)
                at = np.arange(len(grams))
                doc = doc[: len(grams)]
                kept = (at + n <= (begin + lengths)[doc]) & present.value[grams & np.uint64(FILTER_BITS - 1)]
                d = doc[kept]
                ids = own["d"].to_numpy()[d]
                yield pd.DataFrame({"doc_id": ids, "mark": own["mark"].to_numpy()[d], "at": at[kept] - begin[d], "gram": grams[kept].view(np.int64)})

    texts = docs.where("t IS NOT NULL").select(F.col("doc_id").cast("string").alias("d"), "mark", "t")
    return texts.mapInPandas(find, "doc_id string, mark int, at long, gram long").withColumn("doc_id", F.col("doc_id").cast("long"))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word sequences, and where in the passage each best alignment ends.

    All pairs advance together by item word. Gaps along the passage cost the same per word, so their best start
    is a running maximum."""
    m, n = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), m), np.uint64), np.zeros((len(items), n), np.uint64)
    on_a, on_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)], on_a[k, : len(x)] = x, True
        b[k, : len(y)], on_b[k, : len(y)] = y, True
    ramp = -GAP * np.arange(n + 1)
    row, best, end = np.zeros((len(items), n + 1), np.int64), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(m):
        same = (b == a[:, i : i + 1]) & on_b & on_a[:, i : i + 1]
        new = np.maximum(row + GAP, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(same, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        top = row.argmax(axis=1)
        value = row[np.arange(len(row)), top]
        end, best = np.where(value > best, top, end), np.maximum(best, value)
    return best, end


def find_leaks(
    docs: DataFrame, items: DataFrame, least: float = 0.5, n: int = 3, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, mark, item_id, score, first_word, last_word: items of which a document holds a copy, edited or
    not, with the best place of it.

    score is the alignment score over that of a perfect copy; `least` of it is a leak. Words are runs of
    letters and digits in lower case. Items with a null id or of fewer than n words have no seeds and match
    nothing; items that share an id count as one with several texts. A document with a null id is searched
    like others. mark tells rows of one id apart by their text; repeated rows answer once. Ties go to the first
    place. Empty tables give no rows; other columns are not read.

    One shared n-gram makes a candidate, and the window around it holds whatever can still reach `least`: at most
    2 * (1 - least) words per item word can stand between a copy's words. So every copy is found, unless its best
    alignment has no n matching words in a row. Windows that hold too few of an item's words are not aligned.

    One pass over the texts emits the n-grams that a fixed-size filter of item n-grams lets through; candidates
    are joined from these few. Only documents with candidates meet their text again."""
    spark = docs.sparkSession
    t = F.col(text)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark_of(t).alias("mark"), t.alias("t"))
    grams = saved(item_grams(items, item_id, item_text, n), "grams")
    present = spark.sparkContext.broadcast(bit_filter(grams))
    found = saved(hits(own, present, n), "hits")

    # a seed on both sides names a diagonal; seeds of one band share a window
    pairs = found.join(grams, "gram").withColumn("diagonal", F.col("at") - F.col("pos"))
    close = pairs.groupBy("doc_id", "mark", "item_id", F.floor(F.col("diagonal") / BAND).alias("band")).agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high")
    )
    words = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item")).dropDuplicates()
    wanted = close.join(words, "item_id").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("item_id", "item", "low", "high")).alias("wanted"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[list[str], set[str]]] = {}
        for batch in batches:
            if len(known) > CACHE_ITEMS:
                known.clear()
            out = []
            for d, mark, t, rows in zip(batch["doc_id"], batch["mark"], batch["t"], batch["wanted"], strict=True):
                words_of_text = norm_words(t)
                rows = sorted(rows, key=lambda r: (r["item_id"], r["item"], r["low"]))
                for k in range(0, len(rows), 256):
                    part = []
                    for r in rows[k : k + 256]:
                        if r["item"] not in known:
                            known[r["item"]] = (own_words := norm_words(r["item"])), set(own_words)
                        x, names = known[r["item"]]
                        slack = int(MATCH * (1 - least) * len(x) / -GAP) + 1
                        begin = max(0, r["low"] - slack)
                        y = words_of_text[begin : max(0, r["high"] + len(x) + slack)]
                        absent = names.difference(y)
                        if sum(w not in absent for w in x) >= least * len(x):
                            part.append((r["item_id"], word_hashes(x), begin, word_hashes(y)))
                    if not part:
                        continue
                    value, end = align([x for _, x, _, _ in part], [y for _, _, _, y in part])
                    for (item, x, i, _), v, e in zip(part, value, end, strict=True):
                        if v >= least * MATCH * len(x):
                            out.append((d, mark, item, v / (MATCH * len(x)), int(i + e - min(len(x), e)), int(i + e - 1)))
            if out:  # most documents have none, so a frame of each would cost more than their search
                yield pd.DataFrame(out, columns=["doc_id", "mark", "item_id", "score", "first_word", "last_word"])

    texts = own.join(
        wanted.withColumnsRenamed({"doc_id": "w", "mark": "m"}), F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("mark") == F.col("m"))
    ).select(F.col("doc_id").cast("string").alias("doc_id"), "mark", "t", "wanted")
    scored = texts.mapInPandas(score, "doc_id string, mark int, item_id long, score double, first_word long, last_word long")
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("b")
    return scored.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "mark", "item_id").agg(best).select("doc_id", "mark", "item_id", "b.*")


def mark_of(text: Column) -> Column:
    return (F.xxhash64(text) % 2147483647).cast("int")


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows in which find_leaks finds an item; all others stay as they are."""
    leaks = find_leaks(docs, items, doc_id=doc_id, text=text, **options).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m")).distinct()
    return docs.join(leaks, F.col(doc_id).cast("long").eqNullSafe(F.col("__d")) & (mark_of(F.col(text)) == F.col("__m")), "left_anti")
