"""Quality and toxicity from weak labels.

Overlapping heuristic labellers vote on every text or abstain. Expectation-maximisation over the counts of
vote patterns estimates how often each labeller votes what under either class, and so the posterior class
of each pattern. The posteriors of a bounded sample train a linear scorer on hashed features, which then
scores all texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import saved, slices

#: Plain insults of English.
INSULTS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]

#: Hashed features per task, letters of a stem.
FEATURES = 1 << 18
STEM = 4

#: Standard errors by which the texts with a stem or word must deviate, for it to take part in the toxicity score.
STRENGTH = 5.0

#: Distinct words whose features a worker keeps, and characters of texts that are looked at together; both bound
#: memory only.
CACHE_WORDS = 200_000
SLICE = 500_000

ABSTAIN, NO, YES = -1, 0, 1
QUALITY = ("q_symbols", "q_shouting", "q_cries", "q_bars", "q_repeats", "q_label")
TOXIC = ("t_insults", "t_stems", "t_words", "t_label")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*+<=>@\\^_`{}~", np.uint8))
CAPITALS = (np.arange(256) >= 65) & (np.arange(256) <= 90)
SMALL = (np.arange(256) >= 97) & (np.arange(256) <= 122)


def vote(value: float, no: float, yes: float) -> int:
    return YES if value > yes else NO if value < no else ABSTAIN


def quality_votes(text: str | None) -> tuple[int, ...]:
    """Votes for bad quality, from shares of bytes and words; a text without words has only abstentions."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return (ABSTAIN,) * 5
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    capitals, letters = int(count[CAPITALS].sum()), int(count[CAPITALS | SMALL].sum())
    repeats = sum(map(eq, words, words[1:])) / n
    return (
        vote(count[SYMBOLS].sum() / n, 0.05, 0.6), vote(capitals / max(1, letters), 0.2, 0.5) if letters else ABSTAIN,
        vote(count[33] / n, 0.1, 0.6), vote(count[124] / n, 0.02, 0.2), vote(repeats, 0.05, 0.3) if n > 1 else ABSTAIN,
    )


def toxic_votes(text: str | None, words: set[str], stems: set[str]) -> tuple[int, ...]:
    """Votes for toxicity: an insult, a stem or a word of the lexicon; a text without words abstains."""
    own = set(map(word_of, set(text.split()))) if text else set()
    if not own:
        return (ABSTAIN,) * 3
    return int(any(w in own for w in INSULTS)), int(any(w[:STEM] in stems for w in own if len(w) >= STEM)), int(not own.isdisjoint(words))


def word_of(word: str) -> str:
    return "".join(filter(str.isalpha, word)).lower()


def shape_of(word: str) -> str:
    """The word with runs of capitals, small letters, digits and equal signs as one sign each."""
    out = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def hashed(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind}:{name}".encode("utf-8", "surrogatepass")) % FEATURES


class WordFeatures:
    """Numbers of the shape, stem and word feature of words; recent words are kept."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, 3), np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of all words, the text of each word, and whether it repeats the word before."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        split = [t.split() if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.index))
        rows = np.array([(hashed("shape", shape_of(w)), hashed("stem", (x := word_of(w))[:STEM]), hashed("word", x)) for w in new], np.int64).reshape(-1, 3)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.table = np.vstack([self.table, rows])
        doc = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, len(doc))
        again = np.concatenate([[False], (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])])[: len(at)]
        return self.table[at], doc, again


REPEAT = hashed("repeat", "")
_features = WordFeatures()


def quality_parts(words: np.ndarray, doc: np.ndarray, again: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature, value: the share of words of each shape, and of repeats."""
    size = np.maximum(np.bincount(doc, minlength=n), 1)
    key, count = np.unique(doc * FEATURES + words[:, 0], return_counts=True)
    d, f = np.divmod(key, FEATURES)
    return np.append(d, np.arange(n)), np.append(f, np.full(n, REPEAT)), np.append(count / size[d], np.bincount(doc, again, n) / size) * 4


def toxic_parts(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature, 1: which stems and words occur at all."""
    d, f = np.divmod(np.unique(np.concatenate([doc * FEATURES + words[:, 1], doc * FEATURES + words[:, 2]])), FEATURES)
    return d, f, np.ones(len(d))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """EM: the posterior of YES per vote pattern, and P(vote | class) per labeller as [labeller, class, vote].

    The start takes labellers as mostly right; a labeller's share of abstentions may depend on the class."""
    votes = np.stack([patterns == v for v in (ABSTAIN, NO, YES)], axis=2).astype(float)  # pattern, labeller, vote
    yes, cast = (patterns == YES).any(axis=1), (patterns != ABSTAIN).any(axis=1)
    q = np.where(yes, 0.9, np.where(cast, 0.05, prior))
    rate = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        w = np.stack([(1 - q) * counts, q * counts])
        rate = np.einsum("cp,plv->lcv", w, votes) + np.array([[[0.1, 2.0, 0.02], [0.1, 0.1, 0.5]]])
        rate /= rate.sum(axis=2, keepdims=True)
        share = (w.sum(axis=1) + 1) / (counts.sum() + 2)
        log = np.log(share)[:, None] + np.einsum("plv,lcv->cp", votes, np.log(rate))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - q).max(initial=0) < 1e-7:
            break
        q = new
    return q, rate


def train(d: np.ndarray, f: np.ndarray, x: np.ndarray, q: np.ndarray, epochs: int = 20, batch: int = 100, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by small batches with per-feature steps. Batches cycle through the
    texts in their order; features that do not occur keep weight 0."""
    order = np.argsort(d, kind="stable")
    d, f, x = d[order], f[order], x[order]
    names, g = np.unique(f, return_inverse=True)
    w, bias, sums, bias_sum = np.zeros(len(names)), 0.0, np.full(len(names), 1e-6), 1e-6
    edges = np.searchsorted(d, np.arange(0, len(q) + batch, batch))
    for _ in range(epochs):
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own = slice(k * batch, min((k + 1) * batch, len(q)))
            if own.start >= own.stop:
                continue
            i, c, v = d[a:b] - own.start, g[a:b], x[a:b]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(i, w[c] * v, own.stop - own.start) + bias, -50, 50)))
            e = p - q[own]
            used, place = np.unique(c, return_inverse=True)
            step, at_bias = np.bincount(place, e[i] * v, len(used)), e.sum()
            sums[used], bias_sum = sums[used] + step**2, bias_sum + at_bias**2
            w[used] -= rate * step / np.sqrt(sums[used])
            bias -= rate * at_bias / np.sqrt(bias_sum)
    out = np.zeros(FEATURES)
    out[names] = w
    return out, float(bias)


@dataclass
class Model:
    """Weights and bias per task; rates holds the labellers' estimated P(vote | class)."""

    quality: tuple[np.ndarray, float]
    toxic: tuple[np.ndarray, float]
    rates: dict[str, np.ndarray] = field(default_factory=dict)


def lexicon(rows: DataFrame, least: int, share: float) -> tuple[set[str], set[str]]:
    """Words and stems that occur in at least `least` labelled texts, nearly all of them toxic."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, y in zip(batch["t"], batch["toxic"], strict=True):
                words = {w for w in map(word_of, set(t.split())) if len(w) >= STEM}
                names = [("word", w) for w in words] + [("stem", w) for w in {w[:STEM] for w in words}]
                yield pd.DataFrame(names, columns=["kind", "name"]).assign(y=float(y or 0))

    each = rows.select("t", F.coalesce("toxic", F.lit(0)).alias("toxic")).mapInPandas(found, "kind string, name string, y double")
    table = each.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).where((F.col("n") >= least) & (F.col("y") >= share)).toPandas()
    return tuple(set(table.loc[table["kind"] == k, "name"]) for k in ("word", "stem"))


def features(rows: DataFrame, words: set[str], stems: set[str], posteriors: dict[str, dict[tuple, float]]) -> DataFrame:
    """doc_id, task, feature, value, q: the features of labelled texts with the posteriors of their votes."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["t"], SLICE):
                own = batch.iloc[part]
                f, d, again = _features.of(list(own["t"]))
                given = [[ABSTAIN if pd.isna(v) else int(v) for v in own[c]] for c in ("quality", "toxic")]
                bad = [(*quality_votes(t), ABSTAIN if y == ABSTAIN else 1 - y) for t, y in zip(own["t"], given[0], strict=True)]
                hits = [(*toxic_votes(t, words, stems), y) for t, y in zip(own["t"], given[1], strict=True)]
                for task, v, (d, g, x) in (("quality", bad, quality_parts(f, d, again, len(own))), ("toxic", hits, toxic_parts(f, d, len(own)))):
                    q = np.array([posteriors[task].get(k, 0.0) for k in v])
                    yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy()[d], "task": task, "feature": g, "value": x, "q": q[d]})

    return rows.mapInPandas(emit, "doc_id long, task string, feature long, value double, q double")


def votes(docs: DataFrame, labels: DataFrame, words: set[str], stems: set[str], doc_id: str, text: str) -> DataFrame:
    """doc_id and every labeller's vote for each text, the labelled rows' own labels among them."""
    names = (*QUALITY[:-1], *TOXIC[:-1])

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*quality_votes(t), *toxic_votes(t, words, stems)) for t in batch["t"]]
            yield pd.DataFrame(rows, columns=names).assign(doc_id=batch["d"].to_numpy())

    chosen = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"))
    found = chosen.mapInPandas(cast, ", ".join(f"{n} int" for n in names) + ", doc_id string")
    given = labels.select("doc_id", (1 - F.col("quality")).cast("int").alias("q_label"), F.col("toxic").cast("int").alias("t_label"))
    joined = found.withColumn("doc_id", F.col("doc_id").cast("long")).join(given, "doc_id", "left")
    return joined.fillna(ABSTAIN, ["q_label", "t_label"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 10_000, least: int = 5, share: float = 0.9) -> Model:
    """The scorers, from all texts' votes and the posteriors of at most `sample` labelled texts.

    labels has doc_id, quality and toxic, 1 or 0 or null; of rows of one id the worse counts, and ids without a
    text are no matter. The sample is the labelled rows with the least hashes of their ids; the lexicon of toxic
    words and the choice of features are counted on it by Spark. Features in fewer than `least` texts, and for
    toxicity those whose texts deviate from the mean by less than STRENGTH standard errors, take no part. The
    driver gets the others' entries, at most `sample` times the few that a text has, and trains on them. Without
    labelled rows the heuristics' posteriors are still estimated, but nothing is scored as bad. The voting
    patterns, at most 3 to the power of the labellers, are counted over all documents."""
    given = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("t IS NOT NULL")
    rows = saved(own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "quality", "toxic")).alias("r")).select("doc_id", "r.*"), "labelled")
    words, stems = lexicon(rows, least, share)
    cast = votes(docs, given, words, stems, doc_id, text).groupBy(*QUALITY, *TOXIC).count().toPandas()
    model = Model((np.zeros(FEATURES), -1.0), (np.zeros(FEATURES), -1.0))
    posteriors = {}
    for task, names in (("quality", QUALITY), ("toxic", TOXIC)):
        counted = cast.groupby(list(names))["count"].sum().reset_index()
        patterns = counted[list(names)].to_numpy(int)
        q, rate = estimate(patterns, counted["count"].to_numpy(float))
        posteriors[task] = {tuple(p): float(x) for p, x in zip(patterns.tolist(), q, strict=True)}
        model.rates |= dict(zip(names, rate, strict=True))
    found = saved(features(rows, words, stems, posteriors), "features")
    for task, strength in (("quality", 0.0), ("toxic", STRENGTH)):
        own = found.where(F.col("task") == task)
        texts = own.groupBy("doc_id").agg(F.first("q").alias("q")).orderBy("doc_id").toPandas()
        if not len(texts):
            continue
        mean = float(texts["q"].mean())
        kept = own.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("s")).where(
            (F.col("n") >= least) & (F.abs(F.col("s") - F.col("n") * mean) >= strength * F.sqrt(F.col("n") * max(mean * (1 - mean), 1e-9)))
        )
        used = own.join(kept.select("feature"), "feature").select("doc_id", "feature", "value").orderBy("doc_id", "feature").toPandas()
        d = np.searchsorted(texts["doc_id"].to_numpy(), used["doc_id"].to_numpy())
        setattr(model, task, train(d, used["feature"].to_numpy(), used["value"].to_numpy(), texts["q"].to_numpy()))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with bad_quality and toxic (probabilities) and kept: neither is above one half.

    A text that is null or has no words scores 0 and is kept. Rows are independent, so that repeated rows, null ids
    and an empty table need no care; columns named bad_quality, toxic or kept are replaced. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("bad_quality double, toxic double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [score_texts(list(batch.iloc[part]), shared.value) for part in slices(batch, SLICE)]
            yield pd.DataFrame(np.vstack(out) if out else np.zeros((0, 2)), columns=["bad_quality", "toxic"])

    found = docs.withColumn("__found", scored(F.col(text)))
    bad, toxic = F.col("__found.bad_quality"), F.col("__found.toxic")
    return found.withColumns({"bad_quality": bad, "toxic": toxic, "kept": (bad <= 0.5) & (toxic <= 0.5)}).drop("__found")


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    n = len(texts)
    f, doc, again = _features.of(texts)
    out = []
    for (w, bias), (d, g, x) in ((model.quality, quality_parts(f, doc, again, n)), (model.toxic, toxic_parts(f, doc, n))):
        out.append(1 / (1 + np.exp(-np.clip(np.bincount(d, w[g] * x, n) + bias, -50, 50))))
    return np.where(np.bincount(doc, minlength=n)[:, None] > 0, np.stack(out, axis=1), 0.0)
