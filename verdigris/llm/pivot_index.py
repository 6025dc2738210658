"""Exact top-k inner-product search by a pivot-distance index.

Vectors are lifted by one component so that all have the same norm; then the largest inner product is the
smallest distance. Every vector is keyed by its nearest pivot and its distance from it. The vectors of a
pivot, sorted by that distance, are cut into annuli. A query expands the annuli around its own distance
from each pivot; the triangle inequality says which annuli cannot hold a better vector and ends the
expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import saved


def whole_vectors(table: DataFrame, is_query: Column, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, is_query, x: components floor(scale * component) as 64-bit numbers, of the vectors that take part."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    chosen = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector).cast("array<double>").alias("v"))
    kept = chosen.where(F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    return kept.select("vec_id", "is_query", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def pivots_of(x: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Up to n distinct pivots of a sample: a few rounds of nearest-mean refinement from farthest-first rows."""
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    near = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(axis=1))
    p = np.array(chosen)
    for _ in range(5):
        own = distances(x, p).argmin(axis=1)
        p = np.array([x[own == i].mean(axis=0) if (own == i).any() else p[i] for i in range(len(p))])
    return p


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * x @ p.T
    return np.sqrt(np.maximum(d, 0))


class Space:
    """The lifted space: vectors of at most `width` components, none beyond `largest`, all lifted to squared norm
    norm2."""

    def __init__(self, width: int, norm2: float, largest: int):
        self.width, self.norm2, self.exact = width, norm2, largest**2 * width < 1 << 53
        self.kind = np.int16 if largest < 1 << 15 else np.float64

    def plain(self, rows: pd.Series) -> np.ndarray:
        """Rows as a matrix; shorter vectors end in zeros."""
        if len(rows) and min(map(len, rows)) == self.width:
            return np.stack(rows.to_numpy()).astype(np.float64)
        out = np.zeros((len(rows), self.width))
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def packed(self, x: np.ndarray) -> list[bytes]:
        return [v.tobytes() for v in x.astype(self.kind)]

    def read(self, raw: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(raw), self.kind).reshape(-1, self.width).astype(np.float64)

    def reach(self, x: np.ndarray, least: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Distance up to which a vector can reach the score `least` with queries x, which are up to d from pivots."""
        most = np.sqrt(np.maximum((x**2).sum(axis=1) + self.norm2 - 2 * least, 0))
        most = np.minimum(most, 2 * np.sqrt(self.norm2) + 1)  # all there is, where the k-th score is unknown
        return most + 1e-6 * (1 + most + d)

    def bound(self, score) -> float:
        """A score as a double that is not above it."""
        return float(score) if self.exact else np.nextafter(float(score), -np.inf)

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x**2).sum(axis=1), 0))
        return np.column_stack([x, more])

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products; with doubles where every sum is exact, else with Python's whole numbers."""
        if self.exact:
            return q @ x.T
        whole = [np.vectorize(int, otypes=[object])(a) for a in (q, x)]
        return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1)

    @staticmethod
    def whole(scores: np.ndarray) -> np.ndarray:
        return np.array([int(s) for s in scores], np.int64)


def top_pairs(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best entries, ties to the smaller id, never the row's own id."""
    s = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    if s.shape[1] > k:
        cut = np.partition(s, -k, axis=1)[:, -k][:, None]
    else:
        cut = np.full((len(s), 1), -np.inf)
    r, c = np.nonzero((s >= cut) & (s > -np.inf))
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k]


def build_index(vectors: DataFrame, pivots: np.ndarray, space: Space, most: int) -> DataFrame:
    """Vectors as rows of their own: block_id, pivot, distance (from it), vec_id, is_query, x (whole components). A
    block has up to `most` vectors of one pivot, neighbours by their distance.

    Rows are dealt by ranges of (pivot, distance, id): a pivot or a distance that many rows share is still
    many partitions."""

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = space.plain(batch["x"])
            d = distances(space.lifted(x), pivots)
            own = d.argmin(axis=1)
            yield batch.assign(x=space.packed(x), pivot=own, distance=d[np.arange(len(d)), own])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, pivot, n = TaskContext.get().partitionId(), -1, -1, 0
        for batch in batches:
            ids = np.zeros(len(batch), np.int64)
            for now, at in sorted(batch.groupby("pivot").indices.items()):
                if now != pivot:
                    block, pivot, n = block + 1, now, 0
                nth = n + np.arange(len(at))
                ids[at] = block + nth // most
                block, n = int(ids[at[-1]]), int(nth[-1]) % most + 1
            yield batch.assign(block_id=part << 32 | ids)

    keyed = vectors.mapInPandas(key, "vec_id long, is_query boolean, x binary, pivot int, distance double")
    order = ["pivot", "distance", "vec_id"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(dealt.mapInPandas(cut, "block_id long, pivot int, distance double, vec_id long, is_query boolean, x binary"), "annuli")


def search(
    table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256,
    n_pivots: int = 64, sample: int = 5_000, block: int = 1_000, wide: int = 64,
) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of table with is_query its k best other rows, exactly.

    Null vectors, vectors with null or non-finite components, empty vectors and rows with a null id take no
    part. Shorter vectors count as ending in zeros. A query never meets rows of its own id; repeated
    candidates are rows of their own, repeated queries of equal vector answer once. Ties go to the smaller
    id. With fewer candidates than k, all are returned; an empty table gives no rows. Scores beyond 64 bits
    are cut off there.

    Pivots are fitted on `sample` rows chosen by hash; every row is indexed. A query first scores neighbours in its
    own task, which bounds its k-th score; then it meets only the blocks, of `wide` stretches of `block` vectors,
    that the triangle inequality leaves, and in them only such stretches. A row is one vector, never a block, and a
    query travels once to a block. Blocks and the queries that reach them are merged as sorted streams: a task holds
    one block. A (query, block) sends on at most k rows; of a block, its place and distances reach the driver."""
    vectors = saved(whole_vectors(table, is_query, vec_id, vector, scale), "vectors")
    squares = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    facts = vectors.agg(F.max(F.size("x")).alias("width"), F.max(squares).alias("norm2"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest"), F.count("*").alias("n")).first()
    if facts.width is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    space = Space(facts.width, facts.norm2, facts.largest)
    # about twice the sample, so that not every task sends as many rows as are wanted in all
    turn = F.xxhash64("vec_id")
    few = vectors.where(turn <= min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * sample // facts.n))
    first = lambda rows: rows.orderBy(turn, "vec_id").limit(sample).select("x").toPandas()
    chosen = first(few)
    chosen = chosen if len(chosen) else first(vectors)
    pivots = pivots_of(space.lifted(space.plain(chosen["x"])), n_pivots)
    index = build_index(vectors, pivots, space, block * wide)
    rings = index.groupBy("block_id").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("near"), F.max("distance").alias("far")).toPandas()

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every query with its k-th score among the rows that come with it."""
        for batch in batches:
            x, ids, at = space.read(batch["x"]), batch["vec_id"].to_numpy(), np.flatnonzero(batch["is_query"].to_numpy(bool))
            for i in range(0, len(at), 200):
                some = at[i : i + 200]
                s = space.scores(x[some], x)
                r, c = top_pairs(s, ids, ids[some], k)
                counts = np.bincount(r, minlength=len(some))
                least = [space.bound(s[r[e - 1], c[e - 1]]) if n == k else -np.inf for e, n in zip(np.cumsum(counts), counts, strict=True)]
                yield pd.DataFrame({"query_id": ids[some], "x": batch["x"].to_numpy()[some], "least": least})

    bounded = index.select("vec_id", "is_query", "x").mapInPandas(inside, "query_id long, x binary, least double")
    begun = saved(bounded.dropDuplicates(["query_id", "x"]).withColumn("nth", F.monotonically_increasing_id()), "queries")

    def annuli(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blocks in which a vector can still reach the query's k-th score."""
        between, ring = distances(pivots, pivots), rings["pivot"].to_numpy()
        for batch in batches:
            for at in range(0, len(batch), 500):
                own = batch.iloc[at : at + 500]
                x = space.read(own["x"])
                d = distances(space.lifted(x, query=True), pivots)
                reach = space.reach(x, own["least"].to_numpy(), d.max(axis=1))[:, None]
                best = d.argmin(axis=1)
                # a vector is no nearer to the query's pivot than to its own: it lies beyond the middle plane
                gap = d**2 - d[np.arange(len(d)), best][:, None] ** 2 <= 2 * between[best] * reach
                met = gap[:, ring] & (rings["far"].to_numpy() >= d[:, ring] - reach) & (rings["near"].to_numpy() <= d[:, ring] + reach)
                for first in range(0, met.shape[1], 200):
                    i, b = np.nonzero(met[:, first : first + 200])
                    yield own.iloc[i].assign(block_id=rings["block_id"].to_numpy()[first + b])

    visits = begun.mapInPandas(annuli, "block_id long, nth long, query_id long, least double, x binary")
    stream = index.select("block_id", F.lit(-1).cast("long").alias("nth"), F.col("vec_id").alias("id"), F.col("distance").alias("number"), "x", "pivot").unionByName(
        visits.select("block_id", "nth", F.col("query_id").alias("id"), F.col("least").alias("number"), "x", F.lit(0).alias("pivot"))
    )

    def answers(own: pd.DataFrame, x: np.ndarray, ids: np.ndarray, distance: np.ndarray, pivot: int) -> pd.DataFrame:
        """The k best of a block for each of its visitors."""
        q, own_id, least = space.read(own["x"]), own["id"].to_numpy(), own["number"].to_numpy().copy()
        d = distances(space.lifted(q, query=True), pivots[pivot : pivot + 1])[:, 0]
        row, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(x), block):
            some = slice(at, at + block)
            reach = space.reach(q, least, d)
            met = np.flatnonzero((distance[some][0] <= d + reach) & (distance[some][-1] >= d - reach))
            if not len(met):
                continue
            s = space.scores(q[met], x[some])
            s = np.where(s >= least[met][:, None], s, -np.inf)
            r, c = top_pairs(s, ids[some], own_id[met], k)
            row.append(met[r])
            found.append(ids[some][c])
            scores.append(space.whole(s[r, c]))
            counts = np.bincount(r, minlength=len(met))
            full = np.flatnonzero(counts == k)
            last = np.cumsum(counts)[full] - 1
            least[met[full]] = np.maximum(least[met[full]], [space.bound(v) for v in s[r[last], c[last]]])
        row, found, scores = np.concatenate(row), np.concatenate(found), np.concatenate(scores)
        order = np.lexsort((found, ~scores, row))
        order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
        return pd.DataFrame({"nth": own["nth"].to_numpy()[row[order]], "query_id": own_id[row[order]], "vec_id": found[order], "score": scores[order]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The vectors of a block, then the queries that visit it, and so on."""
        current, held, whole = None, [], None
        for batch in batches:
            for block_id, g in batch.groupby("block_id", sort=False):
                if block_id != current:
                    current, held, whole = block_id, [], None
                vector_rows = g["nth"].to_numpy() < 0
                if vector_rows.any():
                    held.append(g[vector_rows])
                g = g[~vector_rows]
                if len(g) and whole is None:
                    v = pd.concat(held)
                    held, whole = [], (space.read(v["x"]), v["id"].to_numpy(), v["number"].to_numpy(), int(v["pivot"].iloc[0]))
                for i in range(0, len(g), 500):
                    yield answers(g.iloc[i : i + 500], *whole)

    # as many partitions as there are: the work of a visit is not visible in its bytes
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stream.repartition(parts, "block_id").sortWithinPartitions("block_id", F.col("nth") >= 0, "number").mapInPandas(merge, "nth long, query_id long, vec_id long, score long")
    order = Window.partitionBy("nth").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
