"""What each of several document filters removes under every order of applying them.

Every document is judged once by all filters; its failures are a mask of bits. Spark counts masks per part, so a
part of any size becomes at most 2**filters counts with their label tallies. A decision diagram over these counts
has one level per filter: a node knows how many documents reach it, its low branch passes the filter of its level
and its high branch fails it. Exchanging two neighbouring levels gives the diagram of another order, and orders
can be listed so that each differs from the one before by one such exchange. The all-pass path of each diagram
holds the steps: what leaves on a high branch is removed there.

Null texts count as empty, a null part as the empty string. A document without doc_id never fails as a copy, since
no id is smaller than an unknown one. Repeated rows count as often as they occur; rows of equal id and text are not
copies of each other. Several label rows of a document count once, true where any says 1. Labels of unknown
documents and extra columns of either table change nothing. No documents give no rows. A text of any length is
judged whole, in one slice of its own if need be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import slices

#: Bits of a mask, in this order. The copy filter is judged by Spark, the others from the text alone.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, MARKS = 100, 80, 10, b"#$%&*|"

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_mask(data: bytes, length: int) -> int:
    """Failures of filters A to D of a text in UTF-8 with that many code points."""
    words = data.split()  # cuts at exactly 09 to 0D and 20
    values = np.frombuffer(data, np.uint8)
    capitals = int(np.count_nonzero((values - np.uint8(65)) < 26))
    few = len(words) < MIN_WORDS
    dull = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    loud = 100 * capitals > MAX_CAPITAL_PERCENT * length
    marked = len(data.translate(None, MARKS)) < len(data)
    return few | dull << 1 | loud << 2 | marked << 3


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, digest) per row of docs(doc_id, text, lang)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cut in slices(batch["text"]):
                rows = batch.iloc[cut]
                masks, digests = [], []
                for text in rows["text"]:
                    data = (text or "").encode("utf-8", "surrogatepass")
                    masks.append(text_mask(data, len(text or "")))
                    digests.append(hashlib.blake2b(data, digest_size=16).digest())
                yield pd.DataFrame({"doc_id": rows["doc_id"], "part": rows["part"], "mask": np.array(masks, np.int32), "digest": digests})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("part"))
    return rows.mapInPandas(judge, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of the mask, with labels.

    Copies meet their first document by digest in a join, whose hot keys Spark splits; nothing else moves but
    sums."""
    rows = judged(docs)
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic")
    )
    copy = F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)
    full = rows.join(first, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask")).join(marks, "doc_id", "left")
    return full.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


class Diagram:
    """A count-weighted decision diagram in one variable order. Equal sub-diagrams are one node, known by its
    number; a node is (low, high), a terminal a tally (n, good, toxic); weight[node] sums the tallies below it."""

    def __init__(self, tallies: dict[int, tuple[int, int, int]], variables: int):
        self.order = list(range(variables))
        self.known: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.weight: list[tuple[int, int, int]] = []
        self.root = self._built(tallies, 0, 0)

    def _node(self, key: tuple, weight: tuple[int, int, int]) -> int:
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
            self.weight.append(weight)
        return self.known[key]

    def _join(self, low: int, high: int) -> int:
        a, b = self.weight[low], self.weight[high]
        return self._node(("node", low, high), (a[0] + b[0], a[1] + b[1], a[2] + b[2]))

    def _built(self, tallies: dict[int, tuple[int, int, int]], level: int, mask: int) -> int:
        if level == len(self.order):
            tally = tallies.get(mask, (0, 0, 0))
            return self._node(("tally", *tally), tally)
        return self._join(self._built(tallies, level + 1, mask), self._built(tallies, level + 1, mask | 1 << level))

    def branches(self, node: int) -> tuple[int, int]:
        return self.nodes[node][1:]

    def swap(self, level: int) -> None:
        """Exchange the variables of a level and the next."""
        done: dict[int, int] = {}

        def moved(node: int, depth: int) -> int:
            if node not in done:
                low, high = self.branches(node)
                if depth:
                    done[node] = self._join(moved(low, depth - 1), moved(high, depth - 1))
                else:
                    (ll, lh), (hl, hh) = self.branches(low), self.branches(high)
                    done[node] = self._join(self._join(ll, hl), self._join(lh, hh))
            return done[node]

        self.root = moved(self.root, level)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, int, int], tuple[int, int, int], int]]:
        """Along the all-pass path: variable, tally that stays, tally that leaves, documents that fail here alone."""
        out, node = [], self.root
        for variable in self.order:
            low, high = self.branches(node)
            alone = high
            for _ in range(len(self.order) - len(out) - 1):
                alone = self.branches(alone)[0]
            out.append((variable, self.weight[low], self.weight[high], self.weight[alone][0]))
            node = low
        return out


def neighbour_swaps(n: int) -> Iterator[int]:
    """Levels to exchange, one after another, so that all n! orders pass by (each element runs to and fro through
    the orders of those before it)."""
    place, way = list(range(n)), [-1] * n
    order = list(range(n))
    while True:
        movable = [v for v in range(n) if 0 <= place[v] + way[v] < n and order[place[v] + way[v]] < v]
        if not movable:
            return
        v = max(movable)
        here, there = place[v], place[v] + way[v]
        other = order[there]
        order[here], order[there] = other, v
        place[v], place[other] = there, here
        for w in range(v + 1, n):
            way[w] = -way[w]
        yield min(here, there)


def audit_part(counts: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """All steps of all orders for one part's mask counts."""
    rows_in = zip(counts["mask"], counts["n"], counts["good"], counts["toxic"])
    tallies = {int(m): (int(n), int(g), int(t)) for m, n, g, t in rows_in}
    fails = [sum(t[0] for m, t in tallies.items() if m >> v & 1) for v in range(len(filters))]
    diagram, rows, share = Diagram(tallies, len(filters)), [], [0] * len(filters)

    def note() -> None:
        order = "".join(filters[v] for v in diagram.order)
        for step, (v, stay, leave, alone) in enumerate(diagram.steps(), 1):
            share[v] += leave[0]
            rows.append([order, step, stay[0], leave[0], fails[v] - leave[0], alone, leave[1], leave[2], v])

    note()
    for level in neighbour_swaps(len(filters)):
        diagram.swap(level)
        note()
    out = pd.DataFrame([[*r[:-1], share[r[-1]]] for r in rows], columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    out.insert(0, "part", counts["part"].iloc[0])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part of docs(doc_id, text, lang), order of the five filters and step."""
    return mask_counts(docs, labels).groupBy("part").applyInPandas(lambda counts: audit_part(counts), RESULT)
