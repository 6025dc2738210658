"""Best-fit packing of token pieces with a swap-based local search.

Pieces of equal length are interchangeable, so the packing is solved on the histogram of lengths (at
most `capacity` numbers, whatever the table) and every kind of bin carries a count of bins. Spark cuts
the documents, counts the lengths, ranks the pieces of each length and gives every rank its place."""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import saved, slices

#: Distinct words kept per worker and rows ranked by one task at a time; both bound memory only.
CACHE_WORDS = 1_500_000
RANKED_AT_ONCE = 2_000

#: The mark of pieces that end a word, and words of letters that are encoded as one text.
END, JOINED = "</w>", 1_000

#: Signs that are one token each and end many words, and the first letter behind which that is not sure, as
#: lower-casing gives it a mark.
SIGNS, PLAIN = ".,", "\u0130"

#: More than the pieces of any one length, so that (length, rank) can be one whole number.
RANKS = 1 << 44


class WordIds:
    """Token ids of texts, word by word: the vocabulary cuts at every blank, so a word's ids do not
    depend on its neighbours. Ids of the distinct words lie in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(END)]] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, words: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, flat])

    def gather(self, at: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places one after the other, each with room for `more` ids, and all ends."""
        lengths = self.lengths[at] + more
        ends = np.cumsum(lengths)
        place = np.arange(lengths.sum()) - np.repeat(ends - lengths - self.starts[at], lengths)
        return self.pool[np.minimum(place, len(self.pool) - 1)] if len(place) else self.pool[:0], ends

    def learn(self, words: set[str]) -> None:
        """A sign behind a letter is a token of its own, so such words are their stem's ids and the sign's."""
        signed = [w for w in words if len(w) > 1 and w[-1] in SIGNS and w[-2] < PLAIN and w[-2].isalpha()]
        own = (words.difference(signed) | {w[:-1] for w in signed} | {w[-1] for w in signed}).difference(self.index)
        letters = [w for w in own if w.isalpha()]
        for i in range(0, len(letters), JOINED):
            self.encode_joined(letters[i : i + JOINED])
        self.encode_alone(list(own.difference(letters)))
        at = np.fromiter((self.index[w[:-1]] for w in signed), np.int64, len(signed))
        signs = np.fromiter((self.index[w[-1]] for w in signed), np.int64, len(signed))
        flat, ends = self.gather(at, more=1)
        flat[ends - 1] = self.pool[self.starts[signs]]
        self.add(signed, self.lengths[at] + 1, flat)

    def encode_alone(self, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.add(words, lengths, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))

    def encode_joined(self, words: list[str]) -> None:
        """Words of letters as one text, cut after the pieces that end a word; alone, if lower-casing or composing
        made more or fewer words of them."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or len(ids) != cuts[-1]:
            return self.encode_alone(words)
        self.add(words, np.diff(cuts, prepend=0), ids)

    @staticmethod
    def words(text: str | None) -> list[str]:
        """Words that can be encoded alone; a text with separators that only str.split() knows stays whole."""
        if not text:
            return []
        return [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self.forget()
        split = [self.words(t) for t in texts]
        self.learn(set(chain.from_iterable(split)).difference(self.index))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        flat, ends = self.gather(at)
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids and end_id, cut only where longer
    than capacity."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = word_ids(path), np.array([end_id], "<u4")
        for batch in batches:
            texts = batch["t"]
            for part in slices(texts):
                rows = []
                for d, ids in zip(batch["d"].iloc[part], encoder.ids(list(texts.iloc[part])), strict=True):
                    ids = np.concatenate([ids.astype("<u4"), end])
                    for k in range(0, len(ids), capacity):
                        piece = ids[k : k + capacity]
                        rows.append((d, k // capacity, k, len(piece), zlib.crc32(piece.tobytes())))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = pd.array([None if d is None else int(d) for d in out["doc_id"]], dtype="Int64")
                yield out

    chosen = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    # a nullable id must not turn into a float on its way through pandas
    keyed = chosen.select(F.col("d").cast("string").alias("d"), "t")
    return keyed.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on a histogram: {lengths in one bin, longest first: number of such bins}.

    The next piece goes to the bin with least room that takes it; pieces of one length fill such a bin
    before the next is opened, so whole groups of equal bins are filled at once."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in by_room if r >= length):
            if not left:
                break
            for bins, m in list(by_room[room].items()):
                left = _fill(by_room, room, bins, m, length, left)
                if not left:
                    break
        if left:
            each = capacity // length
            by_room[capacity][()] = math.ceil(left / each)
            _fill(by_room, capacity, (), math.ceil(left / each), length, left)
    return sum((c for c in by_room.values()), Counter())


def _fill(by_room: dict[int, Counter], room: int, bins: tuple, m: int, length: int, left: int) -> int:
    """Puts `left` pieces into m equal bins, as many as fit into each; gives the number that remains."""
    each = room // length
    full = min(m, left // each)
    rest = min(left - full * each, each - 1) if full < m else 0
    for n, k in ((full, each), (1, rest)):
        if n and k:
            by_room[room][bins] -= n
            by_room[room - k * length][bins + (length,) * k] += n
    by_room[room] = +by_room[room]
    return left - full * each - rest


def local_search(bins: Counter, capacity: int, steps: int = 5_000) -> Counter:
    """Moves pieces between underfull bins so that squared fill grows, until a bin is empty and again.

    The emptiest kind of bin gives: a piece moves over, one piece is exchanged for a smaller one, two
    for one, or one for two. Equal bins act together. It ends at the least possible number of
    sequences, or where no such step is left, or after `steps` steps, which bounds effort, not the result's
    validity."""
    least = math.ceil(sum(sum(b) * m for b, m in bins.items()) / capacity)
    number = sum(bins.values())
    full = Counter({b: m for b, m in bins.items() if sum(b) == capacity})
    under = dict(+bins - full)
    line = sorted((sum(b), b) for b in under)

    def add(kind: tuple, m: int) -> None:
        nonlocal number
        number += m if kind else 0
        if not kind or sum(kind) == capacity:
            full[kind] += m if kind else 0
            return
        if kind not in under:
            insort(line, (sum(kind), kind))
        under[kind] = under.get(kind, 0) + m
        if not under[kind]:
            del under[kind]
            line.pop(bisect_left(line, (sum(kind), kind)))

    for _ in range(steps):
        pairs = ((g, t, e) for _, g in line for _, t in reversed(line) if (t != g or under[g] > 1) and (sum(t), t) >= (sum(g), g) and (e := exchange(g, t, capacity)))
        step = next(pairs, None) if number > least else None
        if step is None:
            break
        giver, taker, (left, filled) = step
        m = under[giver] // 2 if taker == giver else min(under[giver], under[taker])
        for kind, n in ((giver, -m), (taker, -m), (left, m), (filled, m)):
            add(kind, n)
    return +(full + Counter(under))


@lru_cache(maxsize=1 << 17)
def exchange(giver: tuple, taker: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """Both bins after the step that fills the taker most; the taker is at least as full as the giver."""
    room = capacity - sum(taker)
    out_one, out_two = _choices(giver)
    in_one, in_two = _choices(taker)
    best = None
    for outs, backs in ((out_one, [(0, ())]), (out_one, in_one), (out_two, in_one), (out_one, in_two)):
        for size, out in outs:
            i = bisect_left(backs, size - room, key=lambda c: c[0])
            if i < len(backs) and 0 < (gain := size - backs[i][0]) and (best is None or gain > best[0]):
                best = (gain, out, backs[i][1])
    if best is None:
        return None
    _, out, back = best
    left, filled = Counter(giver) - Counter(out) + Counter(back), Counter(taker) - Counter(back) + Counter(out)
    left, filled = (tuple(sorted(x.elements(), reverse=True)) for x in (left, filled))
    return left, filled


@lru_cache(maxsize=50_000)
def _choices(kind: tuple) -> tuple[list, list]:
    """Distinct single pieces and pairs of pieces of a bin as (total, pieces), sorted by total."""
    have = sorted(Counter(kind).items())
    one = [(x, (x,)) for x, _ in have]
    two = sorted((x + y, (x, y)) for i, (x, n) in enumerate(have) for y, _ in have[i + (n < 2) :])
    return one, two


def places(bins: Counter) -> dict[str, np.ndarray]:
    """For every length, in order: the rank from which a kind of bin takes its pieces, the first of these
    bins, the pieces of that length in each, and the offset of the first."""
    rows, used, first = [], Counter(), 0
    for kind, m in sorted(bins.items()):
        offset = 0
        for length, k in sorted(Counter(kind).items(), reverse=True):
            rows.append((length, used[length], first, k, offset))
            used[length] += m * k
            offset += length * k
        first += m
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), table.T.copy(), strict=True))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the
    end id alone. Rows with a null or repeated id are documents of their own. Only documents longer than
    capacity are cut. An empty table gives no rows; other columns of docs are not read.

    Two shuffles of a few numbers per piece; texts are never shuffled. Only the histogram (at most
    capacity rows) reaches the driver. A length with many pieces is ranked in hashed parts."""
    pieces = saved(cut_pieces(docs, path, capacity, end_id, doc_id, text), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    at = places(local_search(best_fit(counts, capacity), capacity))
    n_parts = [(length, math.ceil(n / RANKED_AT_ONCE)) for length, n in counts.items()]
    histogram = docs.sparkSession.createDataFrame(n_parts, "length long, parts long")

    parts = pieces.join(F.broadcast(histogram), "length").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier")
    )
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.join(offsets, ["length", "part"]).withColumn("rank", F.col("earlier") + F.row_number().over(inside) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(at["length"] * RANKS + at["rank"], length * RANKS + rank, side="right") - 1
        nth, copy = np.divmod(rank - at["rank"][i], at["each"][i])
        return pd.DataFrame({"sequence_id": at["bin"][i] + nth, "offset": at["offset"][i] + copy * length})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
