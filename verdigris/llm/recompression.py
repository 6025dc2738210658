"""Removal of repeated word windows by recompression.

Rounds rename maximal runs of a symbol, then pairs of a left and a right symbol, where a symbol's side is a
bit of its name. A name is a hash of what it stands for, so every task gives equal parts the same name and
no exchange is needed to agree on it. How a symbol was formed depends on a few words around it, its context: where a
repeat contains the context, it contains the symbol. A window of words is therefore known by the least of the
symbols whose context it contains, its anchor. Spark joins anchors across the corpus, keeps those that
several documents share, and verifies what stands around them: first whole stretches of windows with one
anchor, then, where stretches differ, single windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import mix, saved, slices, word_hashes, words_of

FAR = 1 << 40
STEP = np.uint64(0x9E3779B97F4A7C15)
RUN, PAIR, SIDE, ALONE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
BASE = 0xD6E8FEB86659FD93  # odd, so that its powers can be inverted


class Sums:
    """Hashes of any stretch of words from prefix sums of word x power, modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        self.powers, self.inverse = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * self.powers[:-1], dtype=np.uint64)])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Symbols:
    """A sequence of symbols over the words of several documents: name, document, the words [start, end) it
    stands for and the words [left, right) on which its forming depends."""

    def __init__(self, name, doc, start, end, left, right):
        self.name, self.doc, self.start, self.end, self.left, self.right = name, doc, start, end, left, right

    @classmethod
    def of_words(cls, words: np.ndarray, doc: np.ndarray) -> Symbols:
        at = np.arange(len(words))
        return cls(words, doc, at, at + 1, at, at + 1)

    def before(self, i: np.ndarray) -> np.ndarray:
        """Left ends of the contexts of the symbols before; far away where there is none in the document."""
        j = np.maximum(i - 1, 0)
        return np.where((i > 0) & (self.doc[j] == self.doc[i]), self.left[j], -FAR)

    def behind(self, i: np.ndarray) -> np.ndarray:
        j = np.minimum(i + 1, len(self.name) - 1)
        return np.where((j > i) & (self.doc[j] == self.doc[i]), self.right[j], FAR)

    def runs(self) -> Symbols:
        """Maximal runs of one symbol under one name; what is no run keeps its name."""
        n = len(self.name)
        first = np.flatnonzero(np.concatenate([[True], (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])]))
        last = np.append(first[1:], n) - 1
        times = (last - first + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            name = np.where(times > 1, mix(mix(self.name[first] ^ RUN) + times * STEP), self.name[first])
        return Symbols(name, self.doc[first], self.start[first], self.end[last], self.before(first), self.behind(last))

    def pairs(self, turn: int) -> Symbols:
        """Every left symbol followed by a right one under one name; the sides are drawn anew each round."""
        with np.errstate(over="ignore"):
            side = mix(self.name ^ (SIDE + np.uint64(turn) * STEP)) & np.uint64(1)
        joins = np.append((side[:-1] == 0) & (side[1:] == 1) & (self.doc[1:] == self.doc[:-1]), False)
        keep = np.flatnonzero(~np.concatenate([[False], joins[:-1]]))
        joined, other = joins[keep], np.minimum(keep + 1, len(joins) - 1)
        with np.errstate(over="ignore"):
            name = np.where(joined, mix(mix(self.name[keep] ^ PAIR) * STEP + self.name[other]), self.name[keep])
        alone_left, alone_right = ~joined & (side[keep] == 0), ~joined & (side[keep] == 1)
        left = np.where(alone_right, self.before(keep), self.left[keep])
        right = np.where(joined, self.right[other], np.where(alone_left, self.behind(keep), self.right[keep]))
        return Symbols(name, self.doc[keep], self.start[keep], np.where(joined, self.end[other], self.end[keep]), left, right)


def recompress(words: np.ndarray, doc: np.ndarray, rounds: int) -> Symbols:
    s = Symbols.of_words(words, doc)
    for turn in range(rounds):
        s = s.runs().pairs(turn)
    return s


def least_in_ranges(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the leftmost least rank in every range [first, last]."""
    level = np.frexp(last - first + 1)[1] - 1  # floor of the binary logarithm
    out, best, k = np.zeros(len(first), np.int64), np.arange(len(rank)), 0
    while True:
        here = np.flatnonzero(level == k)
        a, b = best[first[here]], best[last[here] - (1 << k) + 1]
        out[here] = np.where(rank[a] <= rank[b], a, b)
        if k >= level.max(initial=0):
            return out
        a, b = best[: -(1 << k)], best[1 << k :]
        best, k = np.where(rank[a] <= rank[b], a, b), k + 1


def stretches(words: np.ndarray, lengths: np.ndarray, window: int, rounds: int) -> dict[str, np.ndarray]:
    """Stretches of consecutive windows with one anchor: doc (place in lengths), first (window within the
    document), n (windows), key (the anchor) and content (all words of the stretch and where the anchor is).

    A window without an anchor, which a long run can fill, is its own key and content."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    end = begin + lengths
    at = np.flatnonzero(np.arange(len(words)) + window <= end[doc]) if len(words) else np.zeros(0, np.int64)
    if not len(at):
        return {c: np.zeros(0, np.int64) for c in ("doc", "first", "n", "key", "content")}
    sums, s = Sums(words), recompress(words, doc, rounds)
    fine = np.flatnonzero((s.left > -FAR) & (s.right < FAR) & (s.right - s.left <= window))
    left, right = s.left[fine], s.right[fine]
    with np.errstate(over="ignore"):
        key = mix(s.name[fine] + STEP * sums.stretch(left, right) + (s.start[fine] - left).astype(np.uint64))
    first, last = np.searchsorted(left, at), np.searchsorted(right, at + window, side="right") - 1
    has = first <= last
    anchor = np.full(len(at), -1)
    anchor[has] = least_in_ranges(mix(key), first[has], last[has])
    own = np.where(has, np.uint64(0), mix(sums.stretch(at, at + window) ^ ALONE))
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0) | (own[1:] != own[:-1]) | (doc[at[1:]] != doc[at[:-1]])]))
    n = np.diff(np.append(starts, len(at)))
    lo, j = at[starts], anchor[starts]
    anchored = j >= 0
    whole = sums.stretch(lo, lo + n + window - 1)
    with np.errstate(over="ignore"):
        offset = np.where(anchored, left[j] - lo, 0).astype(np.uint64) if len(left) else np.zeros(len(lo), np.uint64)
        content = np.where(anchored, mix(whole + STEP * (offset * np.uint64(64) + n.astype(np.uint64))), own[starts])
    keys = np.where(anchored, key[j], own[starts]) if len(left) else own[starts]
    return {"doc": doc[lo], "first": lo - begin[doc[lo]], "n": n, "key": keys.view(np.int64), "content": content.view(np.int64)}


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    at = np.arange(max(0, len(words) - window + 1))
    return Sums(words).stretch(at, at + window).view(np.int64)


def anchors(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """doc_id, mark, first, n, key, content of every stretch of every text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["t"]):
                own = batch.iloc[part]
                split = [words_of(t) for t in own["t"]]
                found = stretches(word_hashes([w for ws in split for w in ws]), np.array([len(ws) for ws in split]), window, rounds)
                d = found.pop("doc")
                yield pd.DataFrame({"doc_id": own["d"].to_numpy()[d], "mark": own["mark"].to_numpy()[d], **found})

    chosen = docs.where("doc_id IS NOT NULL AND t IS NOT NULL").select(F.col("doc_id").alias("d"), "mark", "t")
    return chosen.mapInPandas(find, "doc_id long, mark int, first long, n int, key long, content long")


def repeated_windows(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """doc_id, mark, first, n: windows whose words also start in a document of smaller id.

    docs has doc_id, mark and t. Equal windows have equal anchors, so a window is judged among the
    stretches of its anchor. Of stretches with equal content the smallest document's is the model: the others
    are repeats as a whole, the model's windows are compared one by one with other models of the anchor."""
    found = saved(anchors(docs, window, rounds), "anchors")
    by_key = found.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # sums are written before they are joined, so that a join reads both sides from a shuffle of its own and a
    # hot key can be split
    keys = saved(by_key.where("least < most").select("key"), "keys")
    shared = saved(found.join(keys, "key"), "shared")

    place = F.struct("doc_id", "mark", "first", "n")
    models = saved(shared.groupBy("key", "content").agg(F.min(place).alias("model")), "models")
    with_model = shared.join(models.select("key", "content", F.col("model.doc_id").alias("model_doc")), ["key", "content"])
    whole = with_model.where("doc_id > model_doc").select("doc_id", "mark", "first", "n")

    several = saved(models.groupBy("key").count().where("count > 1").select("key"), "several")
    open_models = models.join(several, "key").select("key", "content", "model.*")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, rows, d in zip(batch["t"], batch["rows"], batch["doc_id"], strict=True):
                hashes, out = window_hashes(word_hashes(words_of(t)), window), []
                for r in rows:
                    out.append(pd.DataFrame({"key": r["key"], "content": r["content"], "doc_id": d, "nth": np.arange(r["n"]), "words": hashes[r["first"] : r["first"] + r["n"]]}))
                yield pd.concat(out)

    wanted = open_models.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "content", "first", "n")).alias("rows"))
    texts = docs.select("doc_id", "mark", "t").join(wanted, ["doc_id", "mark"])
    windows = saved(texts.select("doc_id", "t", "rows").mapInPandas(expand, "key long, content long, doc_id long, nth int, words long"), "windows")
    earliest = windows.groupBy("key", "words").agg(F.min("doc_id").alias("earliest"))
    late = windows.join(earliest, ["key", "words"]).where("earliest < doc_id").groupBy("key", "content").agg(F.collect_list("nth").alias("late"))
    partly = (
        with_model.where("doc_id = model_doc").join(late, ["key", "content"])
        .select("doc_id", "mark", "first", F.explode("late").alias("nth")).select("doc_id", "mark", (F.col("first") + F.col("nth")).alias("first"), F.lit(1).alias("n"))
    )
    return whole.unionByName(partly)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, rounds: int = 3) -> DataFrame:
    """docs with kept_text, n_words and n_removed: words covered by a window of `window` consecutive words
    whose sequence also starts in a document with a smaller id are taken out; windows are judged on the
    input.

    Words are runs of characters other than space and 09 to 0D; kept words are joined by one space. A null
    text has no words and stays null in kept_text. A text shorter than a window loses nothing. Rows with a
    null id neither lose words nor take them from others. Rows of one id are not smaller than each other
    and are judged one by one; repeated rows stay repeated. Columns named kept_text, n_words or n_removed are replaced. An
    empty table gives an empty one.

    Texts are shuffled by id twice, to expand the few stretches that differ around a shared anchor and to
    apply the result; everything else moves anchors, about one for a third of a window."""
    return _apply(docs, doc_id, text, window, rounds, lambda words: b" ".join(words).decode("utf-8", "surrogatepass"), "kept_text string")


def digest_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, rounds: int = 3) -> DataFrame:
    """As drop_repeats, with the SHA-256 of the kept text in place of the text; null counts as empty."""
    return _apply(docs, doc_id, text, window, rounds, lambda words: hashlib.sha256(b" ".join(words)).hexdigest(), "kept_sha256 string")


def _apply(docs: DataFrame, doc_id: str, text: str, window: int, rounds: int, result, column: str) -> DataFrame:
    t = F.col(text)
    # rows of one id are told apart by a hash of the text
    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.xxhash64(t) % 2147483647).cast("int").alias("mark"), t.alias("t"))
    spans = repeated_windows(marked, window, rounds).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    name = column.split()[0]

    @F.pandas_udf(f"n_words long, n_removed long, {column}")
    def apply(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, cuts in zip(texts, spans, strict=True):
            words = words_of(t)
            kept, n = words, len(words)
            if cuts is not None and len(cuts):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [c["first"] for c in cuts], 1)
                np.add.at(edge, [c["first"] + c["n"] + window - 1 for c in cuts], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            out.append((n, n - len(kept), result(kept)))
        return pd.DataFrame(out, columns=["n_words", "n_removed", name])

    keyed = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__mark": (F.xxhash64(t) % 2147483647).cast("int")})
    joined = keyed.join(spans.select(F.col("doc_id").alias("__i"), F.col("mark").alias("__m"), "spans"), (F.col("__id") == F.col("__i")) & (F.col("__mark") == F.col("__m")), "left")
    found = joined.withColumn("__found", apply(t, F.col("spans")))
    fields = {c: F.col(f"__found.{c}") for c in ("n_words", "n_removed", name)}
    if name == "kept_text":
        fields[name] = F.when(t.isNotNull(), fields[name])
    return found.select(*docs.columns, "__found").withColumns(fields).drop("__found")
