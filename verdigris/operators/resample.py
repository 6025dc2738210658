"""Bootstrap and permutation tests on per-paper counts.

Rows are reduced to per-paper counts, and papers with equal counts to a profile with a multiplicity: work grows with
distinct profiles, not papers. Numbers are drawn by inversion from uniform ones of a profile, group or tree node,
either from a generator or from md5, which SQL can repeat.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.windows import running_totals
from verdigris.session import cut_lineage

BLOCK = 250
def hash_uniforms(seed, place: tuple, iters: np.ndarray) -> np.ndarray:
    """One seeded md5 number per replicate at a place (a group, a profile, a tree node): any engine can repeat them."""
    tail = "".join(f"|{x}" for x in place)
    texts = (f"{seed}|{i}{tail}" for i in iters.tolist())
    return np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts]) / 4294967296.0


def drawn_uniforms(seed, place: tuple, iters: np.ndarray) -> np.ndarray:
    """The same from a generator with a seed of its own per place and block of replicates."""
    text = "|".join(map(str, (seed, *place, int(iters[0]))))
    return np.random.default_rng(int.from_bytes(hashlib.md5(text.encode()).digest(), "little")).random(len(iters))


def profiles(papers: DataFrame, by: list) -> DataFrame:
    return papers.groupBy(*by, "nb", "na").agg(F.count("*").alias("m"))


def _inverted(weights: np.ndarray, lo: int, u: np.ndarray) -> np.ndarray:
    """The least number from lo on whose cumulative weight reaches u."""
    cdf = np.cumsum(weights)
    return lo + np.minimum(np.searchsorted(cdf / cdf[-1], u, "left"), len(cdf) - 1)


def poisson(m: int, u: np.ndarray) -> np.ndarray:
    """Poisson(m) numbers by inversion; what lies 12 standard deviations off is less than a number of 53 bits can tell."""
    reach = int(12 * math.sqrt(m)) + 40
    lo, hi = max(0, m - reach), m + reach
    logs = np.concatenate([[0.0], np.cumsum(math.log(m) - np.log(np.arange(lo + 1, hi + 1)))])
    return _inverted(np.exp(logs - logs.max()), lo, u)


def _schema(df: DataFrame, by: list, extra: str) -> str:
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + [extra])


def bootstrap(papers: DataFrame, by: list, n_iter: int, seed, uniforms=drawn_uniforms) -> DataFrame:
    """(by, iter, b, a): each paper counts a Poisson(1) number of times, the large-sample form of drawing papers with
    replacement, so that m papers of equal counts, one profile, count a Poisson(m) number of times. Profiles are rows
    with numbers of their own in every group, wherever they lie; a task sends on a sum per group and replicate."""
    rows = profiles(papers.filter("nb + na > 0"), by).select(*by, "nb", "na", "m")

    def draw(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                nb, na, m = map(int, r[-3:])
                w = poisson(m, uniforms(seed, (*r[:-3], nb, na), np.arange(n_iter)))
                at = sums.setdefault(tuple(r[:-3]), np.zeros((2, n_iter)))
                at += [w * nb, w * na]
        for key, (b, a) in sums.items():
            yield pd.DataFrame({**dict(zip(by, key)), "iter": np.arange(n_iter), "b": b, "a": a})

    parts = rows.mapInPandas(draw, _schema(papers, by, "iter long, b double, a double"))
    return parts.groupBy(*by, "iter").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))


def cluster_bootstrap(papers: DataFrame, by: list, n_iter: int = 10_000, seed=42, uniforms=drawn_uniforms) -> DataFrame:
    """Observed ratio, one-sided p against the centred replicates, and 95% interval per group."""
    reps = bootstrap(papers, by, n_iter, seed, uniforms)
    obs = papers.groupBy(*by).agg(
        F.count_if(F.col("nb") + F.col("na") > 0).alias("n_papers"),
        F.sum("nb").alias("below"),
        F.sum("na").alias("above"),
    )
    reps = reps.filter("a > 0").withColumn("r", F.col("b") / F.col("a"))
    reps = reps.withColumn("mean", F.avg("r").over(Window.partitionBy(*by)))
    joined = reps.join(obs, by) if by else reps.withColumns(
        {c: obs.select(c).scalar() for c in ("n_papers", "below", "above")}
    )
    ratio = F.col("below") / F.col("above")
    return (
        joined.filter("above > 0")
        .groupBy(*by, "n_papers", "below", "above")
        .agg(
            F.avg((F.col("r") - F.col("mean") + 1.0 >= ratio).cast("double")).alias("p_boot"),
            F.percentile("r", F.lit(0.025)).alias("ci_low"),
            F.percentile("r", F.lit(0.975)).alias("ci_high"),
        )
        .withColumn("ratio", ratio)
    )


def within_window_draws(papers: DataFrame, by: list, n_iter: int, seed, uniforms=drawn_uniforms) -> DataFrame:
    """Simulated p of the fair-coin split of all in-window statistics, per group."""
    obs = papers.groupBy(*by).agg(F.sum("nb").alias("below"), F.sum("na").alias("above"))

    def draw(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                below, above = int(r[-2]), int(r[-1])
                n, u = below + above, uniforms(seed, tuple(r[:-2]), np.arange(n_iter))
                logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(n, 0, -1)) - np.log(np.arange(1, n + 1)))])
                x = _inverted(np.exp(logs - logs.max()), 0, u)
                ok = x < n
                out.append(float(((x[ok] / (n - x[ok])) >= below / above).mean()) if above > 0 and ok.any() else None)
            yield pdf.assign(p_perm=out)

    return obs.mapInPandas(draw, _schema(papers, by, "below long, above long, p_perm double"))


#: Heights of the tree of profiles that one task settles on its own: 2**8 profiles.
LEAF_HEIGHT = 8


def hypergeometric(left: int, right: int, k: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of k[i] items drawn from left + right come from the left, by inversion at u[i].

    Probabilities follow from the ratio of neighbours, starting at the mode; 12 standard deviations on either side
    hold all that a number of 53 bits can tell."""
    out = np.zeros(len(k), np.int64)
    for n in np.unique(k).tolist():
        lo, hi = max(0, n - right), min(left, n)
        total = left + right
        spread = 12 * math.sqrt(n * (left / total) * (right / total) * (total - n) / max(total - 1, 1)) + 12 if total else 0
        mode = min(max((n + 1) * (left + 1) // (total + 2), lo), hi)
        lo, hi = max(lo, mode - int(spread)), min(hi, mode + int(spread))
        x = np.arange(lo, hi)
        steps = np.log((left - x) * (n - x)) - np.log((x + 1.0) * (right - n + x + 1.0))
        weight = np.concatenate([[0.0], np.cumsum(steps)])
        here = k == n
        out[here] = _inverted(np.exp(weight - weight.max()), lo, u[here])
    return out


def _settle(height: int, place: int, sizes: np.ndarray, k: np.ndarray, draw) -> np.ndarray:
    """Draws per profile (rows) and replicate (columns) below a node, halving it again and again; sizes has
    2**height entries."""
    if height == 0:
        return k[None, :]
    half = len(sizes) // 2
    left, right = int(sizes[:half].sum()), int(sizes[half:].sum())
    if left == 0 or right == 0:
        x = k if right == 0 else np.zeros_like(k)
    else:
        x = hypergeometric(left, right, k, draw((height, place)))
    return np.concatenate([_settle(height - 1, 2 * place, sizes[:half], x, draw), _settle(height - 1, 2 * place + 1, sizes[half:], k - x, draw)])


def label_permutation(papers: DataFrame, first: Column, n_iter: int, seed, uniforms=drawn_uniforms) -> DataFrame:
    """(iter, b, a) of the papers that a random relabelling calls `first`, as many as are so called.

    Papers with equal counts are one profile; how many of each a relabelling takes is one multivariate hypergeometric
    number. It is drawn top-down over a binary tree of the profiles in order: a node's draws are divided between its
    halves. The upper levels are joins of nodes with their sizes, a block of 2**LEAF_HEIGHT profiles is settled in
    one task per block of replicates, and tasks send on sums. Each node and replicate has a number of its own, so
    results do not depend on the partitioning."""
    flagged = papers.select(F.when(first, 1).otherwise(0).alias("f"), "nb", "na")
    counted = flagged.groupBy("nb", "na").agg(F.count("*").alias("m"), F.sum("f").alias("f"))
    ordered = cut_lineage(counted.withColumn("order", F.col("nb").cast("long") * 2**31 + F.col("na")).withColumn("one", F.lit(1).cast("long")))
    n_profiles, n_first = ordered.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    top = max(LEAF_HEIGHT, (max(n_profiles, 1) - 1).bit_length())
    ranked = cut_lineage(running_totals(ordered, "order", {"rank": "one"}).withColumn("place", F.shiftright("rank", LEAF_HEIGHT)))
    packed = ranked.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("rank", "m", "nb", "na"))).alias("p"))
    packed = packed.select("place", *[F.col(f"p.{c}").cast("array<long>").alias(c) for c in ("rank", "m", "nb", "na")])
    size = ranked.groupBy("place").agg(F.sum("m").alias("m"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_iter - 1) // BLOCK)))
    share = F.least(F.lit(BLOCK), F.lit(n_iter) - F.col("block") * BLOCK)
    one = papers.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), blocks.alias("block"))
    draws = one.withColumn("k", F.array_repeat(F.lit(n_first).cast("long"), share.cast("int")))
    for height in range(top, LEAF_HEIGHT, -1):
        halves = size.groupBy(F.shiftright("place", height - 1 - LEAF_HEIGHT).alias("half")).agg(F.sum("m").alias("m"))
        sides = halves.groupBy(F.shiftright("half", 1).alias("place")).agg(
            *[F.coalesce(F.sum(F.when(F.col("half") % 2 == side, F.col("m"))), F.lit(0)).alias(name) for side, name in ((0, "left"), (1, "right"))]
        )
        draws = draws.join(sides, "place").mapInPandas(_halver(height, seed, uniforms), "place long, block int, k array<long>")

    def settle(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                sizes = np.zeros(1 << LEAF_HEIGHT, np.int64)
                at = np.asarray(r.rank) & ((1 << LEAF_HEIGHT) - 1)
                sizes[at] = r.m
                iters = r.block * BLOCK + np.arange(len(r.k))
                taken = _settle(LEAF_HEIGHT, r.place, sizes, np.asarray(r.k), lambda node: uniforms(seed, node, iters))[at]
                yield pd.DataFrame({"iter": iters, "b": np.asarray(r.nb) @ taken, "a": np.asarray(r.na) @ taken})

    parts = draws.join(packed, "place").repartition("place", "block").mapInPandas(settle, "iter long, b long, a long")
    return parts.groupBy("iter").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))


def _halver(height: int, seed, uniforms):
    def halve(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                k = np.asarray(r.k)
                iters = r.block * BLOCK + np.arange(len(k))
                x = hypergeometric(int(r.left), int(r.right), k, uniforms(seed, (height, r.place), iters)) if r.left and r.right else np.where(r.right == 0, k, 0)
                yield pd.DataFrame({"place": [2 * r.place, 2 * r.place + 1], "block": r.block, "k": [x, k - x]})

    return halve


def cross_group_p(papers: DataFrame, first: Column, n_iter: int = 10_000, seed=99, uniforms=drawn_uniforms) -> DataFrame:
    """Share of relabellings whose ratio reaches the observed one of the first group."""
    obs = papers.filter(first).agg((F.sum("nb") / F.sum("na")).alias("ratio"))
    reps = label_permutation(papers, first, n_iter, seed, uniforms).filter("a > 0").withColumn("ratio", obs.scalar())
    return reps.groupBy("ratio").agg(
        F.count("*").alias("n_iter"),
        F.avg((F.col("b") / F.col("a") >= F.col("ratio")).cast("double")).alias("p_cross"),
    )


# ---------------------------------------------------------------- excess mass
def histogram(df: DataFrame, by: list, z: str, low: float, high: float, width: float) -> DataFrame:
    """(by, bin, n) with the last bin closed on the right; bins without rows are absent."""
    n_bins = int(round((high - low) / width))
    spot = F.floor((F.col(z) - low) / width + 1e-9).cast("int")
    return (
        df.filter(F.col(z).between(low, high))
        .withColumn("bin", F.least(spot, F.lit(n_bins - 1)))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("n"))
    )


def excess_mass(hist: DataFrame, low: float, high: float, width: float, fit: tuple, test: tuple, n_boot: int = 2000, seed=42, uniforms=drawn_uniforms) -> DataFrame:
    """Rows in the test range beyond a cubic fitted left of it, with a residual-bootstrap error.

    hist(bin, n) has at most a few hundred bins. The bins travel as one array; the replicates are
    spread over tasks, each solving its own four-term least squares."""
    n_bins = int(round((high - low) / width))
    slots = F.aggregate(
        F.collect_list(F.struct("bin", "n")),
        F.array_repeat(F.lit(0).cast("bigint"), n_bins),
        lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["bin"], x["n"]).otherwise(v)),
    )
    one = hist.agg(slots.alias("counts"))
    reps = one.select("counts", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BLOCK))).alias("block"))

    def solve(batches):
        centres = low + width * (np.arange(n_bins) + 0.5)
        fit_mask = (centres >= fit[0]) & (centres < fit[1])
        test_mask = (centres >= test[0]) & (centres <= test[1])
        design = np.vander(centres[fit_mask], 4)
        ahead = np.vander(centres[test_mask], 4)
        for pdf in batches:
            for counts, block in zip(pdf["counts"], pdf["block"]):
                y = np.asarray(counts, dtype=float)
                beta = np.linalg.lstsq(design, y[fit_mask], rcond=None)[0]
                base = design @ beta
                resid = y[fit_mask] - base
                iters = int(block) * BLOCK + np.arange(min(BLOCK, n_boot - int(block) * BLOCK))
                picks = np.stack([(uniforms(seed, (j,), iters) * len(resid)).astype(int) for j in range(len(resid))], axis=1)
                shaken = base + resid[picks]
                betas = np.linalg.lstsq(design, shaken.T, rcond=None)[0]
                actual = y[test_mask].sum()
                yield pd.DataFrame(
                    {
                        "actual": actual,
                        "counterfactual": float((ahead @ beta).sum()),
                        "boot": actual - (ahead @ betas).sum(axis=0),
                    }
                )

    out = reps.repartition("block").mapInPandas(solve, "actual double, counterfactual double, boot double")
    return out.groupBy("actual", "counterfactual").agg(
        F.stddev_pop("boot").alias("se"), F.count("*").alias("n_boot")
    ).withColumn("excess", F.col("actual") - F.col("counterfactual"))
