"""Collocations: phrases of two to four words that occur together more often than their parts apart.

Texts are cut into chunks of bounded size, one language each. Words with enough occurrences are numbered by falling
frequency within their language. Neighbouring numbers form pairs, and the square of all pairs is cut into tiles of
TILE x TILE numbers: a tile that much of a chunk falls into (the corner of frequent words) is counted by direct
address, one dense bincount that a task carries from chunk to chunk; the rest are sorted (a, b, count) triples of
their chunk. Spark sums both. A phrase of three words is a pair of overlapping pairs, one of four a pair of
overlapping threes, and is known by the numbers of its words. A phrase that is frequent has frequent parts, so a
chunk counts only those whose parts pass a fixed number of filter bits (FILTER_BITS); infrequent ones that pass too
cost effort, their counts stay below the limit.

Numbers of words reach a chunk by a join on its own distinct words, never by a broadcast; phrases meet no table but
the counts. The commonest word is one row per chunk and one cell of a dense tile.

Null texts count as empty and hold no phrase; a null language is `und` and one group with a language of that name.
Repeated rows count as often as they occur, ids and extra columns are not looked at. No documents, or no phrase that
is frequent enough, give no rows. A text longer than a chunk is a chunk of its own. Ties in the result are ordered by
the phrase, so ranks are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import mix, saved

CHUNK_BYTES, HELD_BYTES = 2_000_000, 16_000_000
TILE, DENSE_FROM, MOST_DENSE = 512, 8_192, 16
FILTER_BITS = 1 << 24
#: A word's number in the id of a phrase.
NUMBER, NUMBER_BYTES = ">u4", 4
ENDS = b".,;:!?\n\x0b\x0c\r"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = bytes.maketrans(ENDS + CAPITALS, b"\n" * len(ENDS) + CAPITALS.lower())
#: Stands between pieces; no text in UTF-8 holds this byte.
BORDER = b"\xff"


def words_and_borders(data: bytes) -> list[bytes]:
    """Words of a text in UTF-8, lower-cased in A-Z, with BORDER wherever a piece ends."""
    return data.translate(PLAIN).replace(b"\n", b" " + BORDER + b" ").split()


def small(values: np.ndarray) -> bytes:
    """Whole numbers from -1 on as one byte of width and their compressed bytes, high bytes apart from low ones."""
    shifted = (values + 1).astype(np.min_scalar_type(int(values.max(initial=-1)) + 1))
    width = shifted.dtype.itemsize
    planes = shifted.view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def large(blob) -> np.ndarray:
    """The numbers that small() packed."""
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}").astype(np.int64) - 1


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, lang, words, counts, codes): texts of one language, cut into words. codes holds the place of each
    word in `words`, -1 between pieces."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def emit(lang: str) -> pd.DataFrame:
            nonlocal number
            words = words_and_borders(b"\n".join(held.pop(lang)))
            del size[lang]
            codes, distinct = pd.factorize(np.array([BORDER, *words, None], dtype=object)[:-1])
            counts = np.bincount(codes, minlength=len(distinct))[1:]
            number += 1
            texts = [w.decode("utf-8", "surrogatepass") for w in distinct[1:]]
            return pd.DataFrame({"chunk": [number], "lang": [lang], "words": [texts], "counts": [counts], "codes": [small(codes[1:] - 1)]})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                data = text.encode("utf-8", "surrogatepass")
                held.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data) + 1
                if size[lang] >= CHUNK_BYTES:
                    yield emit(lang)
                elif len(size) > 1 and sum(size.values()) >= HELD_BYTES:
                    yield emit(max(size, key=size.get))
        for lang in list(held):
            yield emit(lang)

    rows = docs.where("text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInPandas(build, "chunk long, lang string, words array<string>, counts array<long>, codes binary")


def numbered(units: DataFrame, names: list[str], name: str) -> DataFrame:
    """units(lang, *names, f) with `id`: its place from 0 by falling f within the language. Range partitions are
    numbered on their own and shifted by the sizes of those before them."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("f"), *map(F.col, names)]
    parts = saved(units.repartitionByRange(n, "lang", *order).withColumn("part", F.spark_partition_id()), name)
    sizes = parts.groupBy("lang", "part").count()
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("lang", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = parts.withColumn("row", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    return inside.join(shifts, ["lang", "part"]).select("lang", *names, "f", (F.col("row") - 1 + F.col("shift")).alias("id"))


def frequent_words(cut: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id)."""
    rows = cut.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("c"))))
    return numbered(rows.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least), ["word"], "words")


def packed(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers of a sequence, and for each place which of them it holds (-1: none); stretches
    without any are one place."""
    held = seq >= 0
    keep = held.copy()
    keep[1:] |= held[:-1]
    seq, held = seq[keep], held[keep]
    codes = np.full(len(seq), -1, np.int64)
    ids, codes[held] = np.unique(seq[held], return_inverse=True)
    return ids, codes


LEVEL = "chunk long, lang string, ids binary, codes binary"


def level_row(chunk: int, lang: str, seq: np.ndarray) -> pa.Table:
    ids, codes = packed(seq)
    return pa.table({"chunk": pa.array([chunk], pa.int64()), "lang": pa.array([lang], pa.string()), "ids": pa.array([small(ids)], pa.binary()), "codes": pa.array([small(codes)], pa.binary())})


def ordered(hits: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's words (or pairs) that have a number, in order, and their numbers."""
    keys, ids = hits.column(key).to_numpy(), hits.column("id").to_numpy()
    order = np.argsort(keys, kind="stable")
    return keys[order], ids[order]


def first_level(cut: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(chunk, lang, ids, codes): the chunks in numbers of frequent words."""
    slots = cut.select("chunk", "lang", F.posexplode("words").alias("slot", "word"))
    hits = slots.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), "slot", "id")

    def rename(own: pa.Table, known: pa.Table) -> pa.Table:
        codes = large(own.column("codes")[0].as_py())
        slots, ids = ordered(known, "slot")
        table = np.full(max(codes.max(initial=-1), slots.max(initial=-1)) + 2, -1, np.int64)  # the last cell serves code -1
        table[slots] = ids
        return level_row(own.column("chunk")[0].as_py(), own.column("lang")[0].as_py(), table[codes])

    return cut.select("chunk", "lang", "codes").groupBy("chunk").cogroup(hits.groupBy("of")).applyInArrow(rename, LEVEL)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """chunk, lang, ids and codes of a level, row by row."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("chunk", "lang", "ids", "codes")]
        for chunk, lang, ids, codes in zip(*columns):
            yield chunk.as_py(), lang.as_py(), large(ids.as_py()), large(codes.as_py())


def joint_codes(known: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One code for each pair of neighbouring places, -1 where a place is empty."""
    a, b = places[:-1], places[1:]
    return np.where((a >= 0) & (b >= 0), a * max(len(known), 1) + b, -1)


class Tiles:
    """Dense counts of the tiles that much falls into, kept over the chunks of one task."""

    def __init__(self):
        self.dense: dict[tuple[str, int, int], np.ndarray] = {}

    def count(self, lang: str, known: np.ndarray, joint: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """Adds pairs to their dense tiles and yields the (lang, a, b, counts) of all others."""
        if not len(joint):
            return
        a, b = known[joint // len(known)], known[joint % len(known)]
        rows, columns = a // TILE, b // TILE
        width = int(columns.max()) + 1
        tile = rows * width + columns
        keys, inverse, sizes = np.unique(tile, return_inverse=True, return_counts=True)
        wanted = np.array([n >= DENSE_FROM or (lang, int(k // width), int(k % width)) in self.dense for k, n in zip(keys, sizes)])
        spare = np.ones(len(joint), bool)
        if wanted.any():
            places = np.argsort(inverse, kind="stable")
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(wanted):
                at = places[ends[k] - sizes[k] : ends[k]]
                cell = (a[at] % TILE) * TILE + b[at] % TILE
                key = (lang, int(keys[k] // width), int(keys[k] % width))
                if key not in self.dense:
                    if len(self.dense) >= MOST_DENSE:
                        yield self.release(next(iter(self.dense)))
                    self.dense[key] = np.zeros(TILE * TILE, np.int64)
                self.dense[key] += np.bincount(cell, minlength=TILE * TILE)
                spare[at] = False
        codes, counts = np.unique(joint[spare], return_counts=True)
        yield lang, known[codes // len(known)], known[codes % len(known)], counts

    def release(self, key: tuple[str, int, int]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        lang, row, column = key
        counts = self.dense.pop(key)
        cells = np.flatnonzero(counts)
        return lang, row * TILE + cells // TILE, column * TILE + cells % TILE, counts[cells]

    def rest(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        for key in list(self.dense):
            yield self.release(key)


def pair_counts(level: DataFrame) -> DataFrame:
    """(lang, a, b, f): how often number b follows number a, over all chunks of a level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()

        def frame(part) -> pa.RecordBatch:
            lang, a, b, c = part
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(a), np.int32)), pa.array([lang], pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(a), pa.array(b), pa.array(c)], ["lang", "a", "b", "c"])

        for _, lang, known, codes in rows_of(batches):
            joint = joint_codes(known, codes)
            yield from map(frame, tiles.count(lang, known, joint[joint >= 0]))
        yield from map(frame, tiles.rest())

    return level.mapInArrow(count, "lang string, a long, b long, c long").groupBy("lang", "a", "b").agg(F.sum("c").alias("f"))


def cells_of(lang: str, phrases: np.ndarray) -> np.ndarray:
    """Filter bit of each phrase."""
    seed = np.uint64(int.from_bytes(lang.encode("utf-8", "surrogatepass")[:8].ljust(8, b"\0"), "little"))
    h = np.full(len(phrases), seed)
    with np.errstate(over="ignore"):
        for number in phrases.T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64))
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def phrase_filter(phrases: DataFrame, k: int) -> np.ndarray:
    """Which filter bits phrases(lang, id) of k words have set; never more than FILTER_BITS / 8 rows of two small
    numbers reach the driver."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                numbers = np.frombuffer(b"".join(rows["id"]), NUMBER).reshape(-1, k)
                yield pd.DataFrame({"cell": cells_of(lang, numbers)})

    octets = phrases.select("lang", "id").mapInPandas(cells, "cell long").groupBy((F.col("cell") / 8).cast("int").alias("at"))
    rows = octets.agg(F.expr("bit_or(shiftleft(1, int(cell % 8)))").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"]
    return out


def grown(phrases: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbouring places as phrases of one word more, their counts, and which of them starts at
    each place (-1: none). Phrases are rows of word numbers."""
    joint = joint_codes(phrases, places)
    held = np.flatnonzero(joint >= 0)
    pairs, at, counts = np.unique(joint[held], return_inverse=True, return_counts=True)
    a, b = pairs // max(len(phrases), 1), pairs % max(len(phrases), 1)
    out = np.full(len(joint), -1, np.int64)
    out[held] = at
    return np.hstack([phrases[a], phrases[b, -1:]]), counts, out


def phrase_counts(level: DataFrame, bits: list[Broadcast]) -> DataFrame:
    """(lang, id, f) of the phrases whose parts pass bits, the filters of frequent phrases of two, three, ... words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lang, known, places in rows_of(batches):
            phrases = known[:, None]
            for shared in bits:
                phrases, _, places = grown(phrases, places)
                cell = cells_of(lang, phrases)
                kept = (shared.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                phrases, places = phrases[kept], np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)[places]
            phrases, counts, _ = grown(phrases, places)
            n, width = len(phrases), NUMBER_BYTES * phrases.shape[1]
            ids = pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(phrases.astype(NUMBER).tobytes())]).cast(pa.binary())
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([lang], pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, ids, pa.array(counts)], ["lang", "id", "c"])

    return level.mapInArrow(count, "lang string, id binary, c long").groupBy("lang", "id").agg(F.sum("c").alias("f"))


def packed_number(name: str) -> Column:
    """A word's number in the bytes that ids of phrases are made of."""
    return F.unhex(F.lpad(F.hex(name), 2 * NUMBER_BYTES, "0"))


def named(longer: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """longer(lang, id, a, b, f) of k words with its `phrase`, f of its first words (`l1` to l of k - 1) and of its
    last ones (`r1` ...), read from its two overlapping parts."""
    keep = lambda side, part: shorter.select("lang", F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in part])
    heads, tails = [f"l{i}" for i in range(1, k - 1)], [f"r{i}" for i in range(1, k - 1)]
    both = longer.join(keep("a", ["phrase", "f", *heads]), ["lang", "a"]).join(keep("b", ["phrase", "f", *tails]), ["lang", "b"])
    last = F.substring_index("b_phrase", " ", -1)
    return both.select(
        "lang", "id", "a", "b", "f", F.concat_ws(" ", "a_phrase", last).alias("phrase"),
        *[F.col(f"a_l{i}").alias(f"l{i}") for i in range(1, k - 1)], F.col("a_f").alias(f"l{k - 1}"),
        *[F.col(f"b_r{i}").alias(f"r{i}") for i in range(1, k - 1)], F.col("b_f").alias(f"r{k - 1}"),
    )


def scored(phrases: DataFrame, k: int) -> DataFrame:
    """(lang, id, phrase, a, l, r, score) by the lowest-scoring cut, the first of equals."""

    def cut(i: int):
        left, right = F.col(f"l{i}"), F.col(f"r{k - i}")
        whole = F.expr(f"CAST(2000000 AS DECIMAL(38, 0)) * f div (l{i} + r{k - i})")
        return F.struct(whole.cast("long").alias("score"), F.lit(i).alias("cut"), left.alias("l"), right.alias("r"))

    cuts = [cut(i) for i in range(1, k)]
    least = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return phrases.select("lang", "id", "phrase", F.col("f").alias("a"), least.alias("c")).select("lang", "id", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of docs(text, lang) in each language.

    Phrases with at least `least` occurrences count; one whose occurrences lie to `covered` per cent or more in one
    longer phrase that counts gives way to it. That phrase need only be looked for one word longer, since what lies
    between two such phrases occurs at least as often as the longer."""
    cut = saved(chunks(docs), "chunks")
    total = cut.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n"))
    words = saved(frequent_words(cut, least), "words-numbered")
    level = saved(first_level(cut, words), "level-1")
    named_before, listed, bits = words.select("lang", packed_number("id").alias("id"), F.col("word").alias("phrase"), "f"), [], []
    for k in range(2, longest + 1):
        if k == 2:
            counted = pair_counts(level).where(F.col("f") >= least).select("lang", F.concat(packed_number("a"), packed_number("b")).alias("id"), "f")
        else:
            counted = phrase_counts(level, bits).where(F.col("f") >= least)
        counted = saved(counted, f"frequent-{k}")
        width = NUMBER_BYTES * (k - 1)
        halves = counted.select("lang", "id", F.substring("id", 1, width).alias("a"), F.substring("id", NUMBER_BYTES + 1, width).alias("b"), "f")
        phrases = saved(named(halves, named_before, k), f"phrases-{k}")
        if listed:  # parts of these phrases that occur seldom without them
            part = lambda side: phrases.join(named_before.select("lang", F.col("id").alias(side), F.col("f").alias("part_f")), ["lang", side]).where(
                F.expr(f"CAST(100 AS DECIMAL(38, 0)) * f >= CAST({covered} AS DECIMAL(38, 0)) * part_f")
            ).select("lang", F.col(side).alias("id"))
            listed[-1] = listed[-1].join(part("a").union(part("b")).distinct(), ["lang", "id"], "left_anti")
        listed.append(scored(phrases, k))
        named_before = phrases
        if k < longest:
            bits.append(docs.sparkSession.sparkContext.broadcast(phrase_filter(counted, k)))
    found = listed[0]
    for other in listed[1:]:
        found = found.unionByName(other)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
