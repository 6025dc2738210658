"""One-to-one assignments: ordered greedy choice and propensity pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.regress import propensity
from verdigris.operators.windows import best, hash_number, hashed_rank, range_rank, running_totals
from verdigris.session import cut_lineage


def _holders_before(asked: DataFrame, held: DataFrame) -> DataFrame:
    """asked(id, r_key, ..) with `before`: how many rows of held(id, r_key) with a smaller id hold the same r_key.

    Ids are cut into even ranges, so that a key that many rows hold is counted in many tasks."""
    ends = asked.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    bucket = F.floor((F.col("id") - lo) / (hi - lo + 1) * 1024).cast("int")
    holds = held.select("id", "r_key", bucket.alias("bucket"))
    counts = holds.groupBy("r_key", "bucket").count()
    keys = asked.select("r_key", bucket.alias("bucket")).distinct()
    marks = keys.withColumn("count", F.lit(0).cast("long")).unionByName(counts)
    upto = Window.partitionBy("r_key").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    offsets = marks.groupBy("r_key", "bucket").agg(F.sum("count").alias("count")).select("r_key", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("offset"))
    both = asked.withColumns({"bucket": bucket, "holds": F.lit(0)}).unionByName(holds.withColumn("holds", F.lit(1)), allowMissingColumns=True)
    smaller = Window.partitionBy("r_key", "bucket").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("inside", F.coalesce(F.sum("holds").over(smaller), F.lit(0))).filter("holds = 0")
    return counted.join(offsets, ["r_key", "bucket"]).withColumn("before", F.col("offset") + F.col("inside")).drop("bucket", "holds", "inside", "offset")


def ordered_one_to_one(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """One-to-one pairs as if the left rows chose one after another, in id order, the best right row still free, of
    equally good ones that with the smallest id.

    left(id, l_key), right(id, r_key), edges(l_key, r_key, score): equal keys are one group on either side, so copies
    never meet pairwise. The rows of a right group are taken in id order, so all that a left row must know of a group
    is how many rows with smaller ids hold it: that names the row it would get. In each round every left row chooses
    anew against what the rows before it chose in the last round. Once nothing changes, each choice is right given
    those before it, which only the sequential outcome is; every round settles at least one more row, and a chain
    of refusals one row per round only where each refusal causes the next."""
    places = right.groupBy("r_key").agg(F.count("*").alias("places"))
    numbered = cut_lineage(range_rank(right.select("id", "r_key"), ["r_key"], "id", "place").withColumnRenamed("id", "match_id"))
    live = cut_lineage(left.join(edges, "l_key").join(places, "r_key").select("id", "r_key", "score", "places"))
    held = None
    while True:
        asked = live.withColumn("before", F.lit(0).cast("long")) if held is None else _holders_before(live, held)
        open_ = asked.filter("before < places").withColumn("place", F.col("before") + 1).join(numbered, ["r_key", "place"])
        now = cut_lineage(best(open_, ["id"], [F.desc("score"), F.asc("match_id")]).select("id", "r_key", "match_id", "score"))
        if held is not None:
            old = held.select("id", F.col("match_id").alias("old_id"))
            if now.join(old, "id", "full_outer").filter(~F.col("match_id").eqNullSafe(F.col("old_id"))).isEmpty():
                return now.select("id", "match_id", "score")
        held = now


def _use_controls(segment: pd.DataFrame) -> pd.DataFrame:
    """How many controls of each score nearest-first matching uses within one segment: treated units in rising
    order of score each take the nearest control left, the lower one of two equally near.

    The strata at an open end never run out. Two pointers lead over used-up strata, so that each is passed once."""
    rows = segment.sort_values("score").reset_index(drop=True)
    scores, left = rows["score"].tolist(), [float("inf") if e else c for e, c in zip(rows["open_end"], rows["controls"])]
    n, used = len(rows), [0] * len(rows)
    below, above = [j - 1 for j in range(n)], [j + 1 for j in range(n)]
    for i, need in enumerate(rows["treated"]):
        need = 0 if rows["open_end"][i] else int(need)
        while need:
            lo, hi = _seek(i, left, below), _seek(i, left, above)
            if lo < 0 and hi >= n:
                break
            j = lo if hi >= n or (lo >= 0 and scores[i] - scores[lo] <= scores[hi] - scores[i]) else hi
            take = int(min(need, left[j]))
            left[j] -= take
            used[j] += take
            need -= take
    return pd.DataFrame({"score": rows["score"], "used": used})


def _seek(j: int, left: list[float], lead: list[int]) -> int:
    """The first stratum from j on, in the direction of `lead`, that has controls; the way to it is shortened."""
    path = []
    while 0 <= j < len(left) and left[j] == 0:
        path.append(j)
        j = lead[j]
    for k in path:
        lead[k] = j
    return j


def segments(strata: DataFrame) -> DataFrame:
    """strata(score, treated, controls) with `segment`, `barrier` and `open_end`: parts of the score line that
    matching can settle apart.

    Where some stretch around a stratum holds at least as many treated units as controls, the stratum may run out.
    Every other stratum is a barrier: whatever the choices, controls are left there, so no unit passes over it. It
    belongs to the segments on both sides as an end that never runs out. Such stretches are found from running sums
    of treated minus controls: one ends at or behind the stratum and starts before it where the largest sum from
    there on is at least the smallest one before. Partitions by score range are summed on their own and shifted."""
    spark = strata.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(strata.repartitionByRange(n, "score").withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("part").orderBy("score").rowsBetween(0, Window.unboundedFollowing)
    net = F.col("treated") - F.col("controls")
    inside = parts.withColumn("after", F.sum(net).over(upto)).withColumn("before", F.col("after") - net)
    whole = inside.groupBy("part").agg(F.sum(net).alias("total"), F.min("before").alias("low"), F.max("after").alias("high"))
    earlier, later = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    shifted = whole.withColumn("shift", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    ends = shifted.select("part", "shift", F.min(F.col("shift") + F.col("low")).over(earlier).alias("low_before"), F.max(F.col("shift") + F.col("high")).over(later).alias("high_behind"))
    low = F.least(F.col("shift") + F.min("before").over(upto), "low_before")
    high = F.greatest(F.col("shift") + F.max("after").over(onward), "high_behind")
    marked = inside.join(ends, "part").withColumn("barrier", (high < low).cast("int")).select("score", "treated", "controls", "barrier")
    counted = cut_lineage(running_totals(marked, "score", {"segment": "barrier"}))
    inner = counted.filter("barrier = 0").withColumn("open_end", F.lit(False))
    rims = counted.filter("barrier = 1").withColumn("segment", F.explode(F.array("segment", F.col("segment") + 1))).withColumn("open_end", F.lit(True))
    live = inner.select("segment").distinct()
    return inner.unionByName(rims.join(live, "segment", "left_semi")).unionByName(counted.filter("barrier = 1").withColumns({"segment": F.lit(None).cast("long"), "open_end": F.lit(False)}))


def controls_used(strata: DataFrame) -> DataFrame:
    """(score, used): how many controls of each score nearest-first matching without replacement takes."""
    split = cut_lineage(segments(strata))
    settled = split.filter("segment is not null").groupBy("segment").applyInPandas(_use_controls, "score double, used long")
    own = split.filter("segment is null").select("score", F.col("treated").alias("used"))
    return settled.union(own).groupBy("score").agg(F.sum("used").alias("used"))


def propensity_pairs(df: DataFrame, treat: str, x: str, id_col: str, scores: DataFrame, seed=42) -> DataFrame:
    """Treated rows and their matched controls, one for one without replacement.

    Units of equal score are one stratum, so the nearest-first rule is settled on counts per stratum, each segment of
    the score line on its own; inside a stratum the controls with the smallest hash numbers are taken."""
    xd = F.col(x).cast("double")
    rated = df.withColumn("__x", xd).join(scores.toDF("__x", "__score"), "__x")
    strata = rated.groupBy(F.col("__score").alias("score")).agg(F.count_if(F.col(treat)).alias("treated"), F.count_if(~F.col(treat)).alias("controls"))
    used = controls_used(strata).withColumnRenamed("score", "__score")
    controls = hashed_rank(rated.filter(~F.col(treat)).withColumn("__h", hash_number(seed, id_col)), ["__score"], "__h", id_col, "__rank")
    matched = controls.join(used, "__score").filter(F.col("__rank") <= F.col("used")).select(*df.columns)
    return df.filter(F.col(treat)).unionByName(matched)


def propensity_matched(df: DataFrame, treat: str, x: str, id_col: str, seed=42) -> DataFrame:
    """propensity_pairs with scores fitted on df itself.

    df is written out once: a covariate made from floating sums may differ in its last digit from one reading to the
    next, as parts of a sum arrive in any order, and would then miss its own score."""
    fixed = cut_lineage(df)
    return propensity_pairs(fixed, treat, x, id_col, propensity(fixed, treat, x), seed)


def two_sample_t(df: DataFrame, group: Column, y: str) -> DataFrame:
    """Equal-variance t statistic of the true group against the rest, from moments in one pass."""
    d = df.select(group.alias("g"), F.col(y).cast("double").alias("y"))
    one = d.agg(
        F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n0"),
        F.avg(F.when(F.col("g"), F.col("y"))).alias("mean1"),
        F.avg(F.when(~F.col("g"), F.col("y"))).alias("mean0"),
        F.var_samp(F.when(F.col("g"), F.col("y"))).alias("v1"),
        F.var_samp(F.when(~F.col("g"), F.col("y"))).alias("v0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = ((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n1 + n0 - 2)
    t = (F.col("mean1") - F.col("mean0")) / F.sqrt(pooled * (1 / n1 + 1 / n0))
    return one.withColumn("t", t).withColumn("df", (n1 + n0 - 2).cast("double"))
