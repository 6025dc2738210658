"""Language identification by unigram pieces with all segmentations summed.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is
the sum over every way to cut it into pieces (forward algorithm); training counts pieces by their
expectation over the same cuts (forward-backward), in rounds over the distinct words of all texts."""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import saved, slices

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
NONE = "und"

#: A letter that is no piece stands as a piece of its block of 128 characters; blocks share this many numbers.
BLOCKS = 1024
BLOCK_SIZE = 128

#: Distinct words whose scores a worker keeps, and letters x words of one lattice; both bound memory only.
CACHE_WORDS = 1_200_000
LATTICE = 200_000

#: Bits of the hash that the filter of pieces of one length looks at, and the hash's multiplier.
PRESENT = 18
STEP = 0x9E3779B97F4A7C15


def code_points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row per place."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(flat.reshape(len(words), -1).T)


def letter_hashes(points: np.ndarray) -> list[np.ndarray]:
    """Hash of the first k letters of each word, for all k."""
    out = [np.zeros(points.shape[1], np.uint64)]
    for row in points:
        out.append(out[-1] * np.uint64(STEP) + row + np.uint64(1))
    return out


class Pieces:
    """The vocabulary in lower case: piece -> number, for pieces made of letters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i))
        self.names = list(dict.fromkeys(p for p in names if p.removeprefix(START).isalpha() or p == START))
        self.index = {p: i for i, p in enumerate(self.names)}
        self.longest = max(map(len, self.names))
        self.size = len(self.names) + BLOCKS

        # single letters by code point; longer pieces by hash, with a filter before the look-up
        self.powers = [np.uint64(pow(STEP, k, 1 << 64)) for k in range(self.longest + 1)]
        self.single = len(self.names) + np.arange(0x110000) // BLOCK_SIZE % BLOCKS
        self.by_hash: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in range(1, self.longest + 1):
            own = [p for p in self.names if len(p) == k]
            if own and k == 1:
                self.single[[ord(p) for p in own]] = [self.index[p] for p in own]
            elif own:
                hashes = letter_hashes(code_points(own))[k]
                order = np.argsort(hashes)
                present = np.zeros(1 << PRESENT, bool)
                present[hashes >> np.uint64(64 - PRESENT)] = True
                self.by_hash[k] = present, hashes[order], np.array([self.index[p] for p in own])[order]

    def ending(self, words: list[str], end: int, k: int) -> np.ndarray:
        """Numbers of the pieces of k letters that end at `end` in each word; `size` where there is none."""
        at, found = Lattice(self, words).ending(end, k)
        out = np.full(len(words), self.size)
        out[at] = found
        return out


class Lattice:
    """Which pieces stand where in words of one length. A piece is known by the 64-bit hash of its letters."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces, self.points = pieces, code_points(words)
        self.upto = letter_hashes(self.points)

    def ending(self, end: int, k: int) -> tuple[slice | np.ndarray, np.ndarray]:
        """Words with a piece of k letters that ends at `end`, and its number; a letter is always one."""
        if k == 1:
            return slice(None), self.pieces.single[self.points[end - 1]]
        if k not in self.pieces.by_hash:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        present, hashes, names = self.pieces.by_hash[k]
        h = self.upto[end] - self.upto[end - k] * self.pieces.powers[k]
        at = np.flatnonzero(present[h >> np.uint64(64 - PRESENT)])
        place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
        same = hashes[place] == h[at]
        return at[same], names[place[same]]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def log_sum(first: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logarithm of the sum of `first` and of terms that only some rows have, as (rows, terms)."""
    top = first.copy()
    for at, term in others:
        top[at] = np.maximum(top[at], term)
    total = np.exp(first - top)
    for at, term in others:
        total[at] += np.exp(term - top[at])
    return top + np.log(total)


def forward(pieces: Pieces, words: list[str], logp: np.ndarray) -> np.ndarray:
    """Log-probability of words of one length under every column of logp (pieces x languages)."""
    lattice = Lattice(pieces, words)
    last = deque([np.zeros((len(words), logp.shape[1]))], maxlen=pieces.longest)
    for end in range(1, len(words[0]) + 1):
        first, *others = [(at, last[-k][at] + logp[piece]) for k in range(1, min(end, pieces.longest) + 1) for at, piece in [lattice.ending(end, k)] if len(piece)]
        last.append(log_sum(first[1], others))
    return last[-1]


def expected(pieces: Pieces, words: list[str], n: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected number of uses of every piece in words of one length that occur n times each."""
    length, lattice = len(words[0]), Lattice(pieces, words)
    found = {end: [(k, at, piece) for k in range(1, min(end, pieces.longest) + 1) for at, piece in [lattice.ending(end, k)] if len(piece)] for end in range(1, length + 1)}
    ahead = [np.zeros(len(words))]
    for end in range(1, length + 1):
        first, *others = [(at, ahead[end - k][at] + logp[piece]) for k, at, piece in found[end]]
        ahead.append(log_sum(first[1], others))
    back = [np.full(len(words), -np.inf) for _ in range(length)] + [np.zeros(len(words))]
    uses = np.zeros(pieces.size + 1)
    for end in range(length, 0, -1):
        for k, at, piece in found[end]:
            after = logp[piece] + back[end][at]
            uses += np.bincount(piece, n[at] * np.exp(ahead[end - k][at] + after - ahead[length][at]), len(uses))
            back[end - k][at] = np.logaddexp(back[end - k][at], after)
    return uses[:-1]


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of equal length, in groups of bounded lattice size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, LATTICE // max(1, lengths[group[0]])) if len(group) else 1
        for i in range(0, len(group), step):
            yield group[i : i + step]


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


@dataclass
class Model:
    path: str
    languages: list[str]
    logp: np.ndarray  # (pieces + 1) x languages; the last row is minus infinity


def first_guess(pieces: Pieces) -> np.ndarray:
    weight = np.array([3.0 ** -len(p) for p in pieces.names] + [1e-6] * BLOCKS)
    return np.append(np.log(weight / weight.sum()), -np.inf)


def word_counts(docs: DataFrame, text: str, language: str) -> DataFrame:
    """lang, word, n over all texts with a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang", sort=False):
                for part in slices(group["t"], 8_000_000):
                    found = [w for t in group["t"].iloc[part] if t for w in WORD.findall(t.lower())]
                    codes, words = pd.factorize(np.array(found, dtype=object))
                    yield pd.DataFrame({"lang": lang, "word": words, "n": np.bincount(codes, minlength=len(words))})

    chosen = docs.select(F.col(language).cast("string").alias("lang"), F.col(text).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    return chosen.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str, text: str = "text", language: str = "lang", rounds: int = 2, smoothing: float = 0.05) -> Model:
    """Piece probabilities of every language of docs, from all its texts.

    Rows without text or language teach nothing; without any such row the model has no language. The
    distinct words are counted once, by language and word with sums before the shuffle; each round sums
    expected pieces. Only pieces x languages numbers reach the driver, whatever the table's size."""
    pieces = pieces_of(path)
    counts = saved(word_counts(docs, text, language), "words")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    logp = np.repeat(first_guess(pieces)[:, None], max(1, len(languages)), axis=1)
    spark = docs.sparkSession
    for _ in range(rounds if languages else 0):
        now = spark.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            known, uses = pieces_of(path), {}
            for batch in batches:
                for lang, group in batch.groupby("lang", sort=False):
                    kept = [(START + w, n) for w, n in zip(map(letters, group["word"]), group["n"], strict=True) if w]
                    words, n = [w for w, _ in kept], np.array([c for _, c in kept], float)
                    column = now.value[:, languages.index(lang)]
                    for at in by_length(words):
                        found = expected(known, [words[i] for i in at], n[at], column)
                        uses[lang] = uses.get(lang, 0.0) + found
            for lang, found in uses.items():
                used = np.flatnonzero(found)
                yield pd.DataFrame({"lang": lang, "piece": used, "uses": found[used]})

        sums = counts.mapInPandas(expect, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full((pieces.size, len(languages)), smoothing)
        uses[sums["piece"], sums["lang"].map({x: i for i, x in enumerate(languages)})] += sums["uses"]
        logp = np.vstack([np.log(uses / uses.sum(axis=0)), np.full(len(languages), -np.inf)])
    return Model(path, languages, logp)


class Scorer:
    """Scores of texts under every language, with the scores of recent words kept."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.path)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, np.int64)

    def learn(self, words: set[str]) -> None:
        new = list(words)
        own = [letters(w) for w in new]
        scores = np.zeros((len(new), len(self.model.languages)))
        marked = [START + w for w in own]
        for at in by_length(marked):
            if len(marked[at[0]]) > 1:
                scores[at] = forward(self.pieces, [marked[i] for i in at], self.model.logp)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.scores = np.vstack([self.scores, scores])
        self.letters = np.concatenate([self.letters, np.fromiter(map(len, own), np.int64, len(own))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self.forget()
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(found)).difference(self.index))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        doc = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
        n = np.bincount(doc, self.letters[at], len(found))
        total = np.stack([np.bincount(doc, self.scores[at, j], len(found)) for j in range(self.scores.shape[1])], axis=1)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.model.languages[b] if k else NONE for b, k in zip(best, n, strict=True)]
        return names, np.where(n > 0, share, 0.0)


_scorers: dict[str, Scorer] = {}


def scorer(name: str, model) -> Scorer:
    """The worker's scorer of a broadcast model; one model is kept at a time."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model.value)
    return _scorers[name]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the share of the predicted language in all languages' probability.

    A text that is null or has no letter, and any text under a model without languages, is `und` with
    score 0. Equal scores go to the first language by name. Rows are independent: order, number, ids and
    other columns stay, but columns named lang_pred or score are replaced. No shuffle."""
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit(NONE), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = scorer(name, shared)
        for batch in batches:
            parts = [own.predict(list(batch.iloc[part])) for part in slices(batch)]
            yield pd.DataFrame({
                "lang_pred": np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, object),
                "score": np.concatenate([p[1] for p in parts]) if parts else np.zeros(0),
            })

    found = docs.withColumn("__found", scored(F.col(text)))
    return found.withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")
