"""Weighted-term vectors, cosine joins by bounded lengths, and by products of blocks of sparse vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.stats import bound
from verdigris.functions.text import text_or_empty
from verdigris.operators.similarity import cell_splits, meet, spread
from verdigris.operators.windows import top_k
from verdigris.session import cut_lineage, scratch_path

WORD = r"[\p{L}\p{N}\p{M}_]{2,}"


def terms(c, bigrams: bool = True, stop_words=()) -> Column:
    """Words of two or more characters, and pairs of neighbouring words."""
    t = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD), F.lit(0))
    if stop_words:
        t = F.filter(t, lambda w: ~w.isin(*stop_words))
    if not bigrams:
        return t

    def with_pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(w, pairs)

    return bound(t, with_pairs)


#: Weights of a batch that are sorted together.
BATCH_TERMS = 2_000_000


def _distinct_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each record's list of term numbers as distinct ones with their counts."""
    lists = batch.column("ids")
    sizes = np.diff(lists.offsets.to_numpy())
    row, term = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(term) != 0)])) if len(row) else np.zeros(0, np.int64)
    edges = pa.array(np.searchsorted(row[first], np.arange(len(sizes) + 1)), pa.int32())
    tf = np.diff(np.append(first, len(row)))
    parts = [batch.column("rec"), batch.column("copies"), pa.ListArray.from_arrays(edges, pa.array(term[first])), pa.ListArray.from_arrays(edges, pa.array(tf, pa.int32()))]
    return pa.RecordBatch.from_arrays(parts, ["rec", "copies", "ids", "tfs"])


def term_counts(df: DataFrame, **kw) -> DataFrame:
    """(rec, copies, tid, tf) of df(rec, text, copies). A record is counted inside its own task; a term is known by
    64 bits of a hash."""
    numbered = df.select("rec", "copies", F.transform(terms("text", **kw), lambda t: F.xxhash64(t)).alias("ids"))

    def count(batches):
        for batch in batches:
            sizes = np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_TERMS, "right")))
                yield _distinct_counts(batch.slice(at, end - at))
                at = end

    counted = numbered.mapInArrow(count, "rec long, copies long, ids array<long>, tfs array<int>")
    return counted.select("rec", "copies", F.inline(F.arrays_zip("ids", "tfs"))).toDF("rec", "copies", "tid", "tf")


def vocabulary(df: DataFrame, min_df: int, max_features: int | None, **kw) -> DataFrame:
    """(tid, df, idf) over a corpus of distinct records(rec, text, copies), each standing for `copies` equal ones.
    With `max_features`, the most frequent terms only, ties in the order of the terms."""
    n = df.agg(F.sum("copies"))
    if max_features is None:
        per_term = term_counts(df, **kw).groupBy("tid").agg(F.sum("copies").alias("df")).filter(F.col("df") >= min_df)
    else:
        rows = df.select("rec", "copies", F.explode(terms("text", **kw)).alias("term")).groupBy("rec", "term").agg(F.count("*").alias("tf"), F.first("copies").alias("copies"))
        by_term = rows.groupBy("term").agg(F.sum("copies").alias("df"), F.sum(F.col("tf") * F.col("copies")).alias("total")).filter(F.col("df") >= min_df)
        per_term = by_term.orderBy(F.desc("total"), "term").limit(max_features).withColumn("tid", F.xxhash64("term"))
    return per_term.select("tid", "df", (F.log((1 + n.scalar()) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(rec, tid, df, w): logarithmic counts times idf, not yet scaled to unit length."""
    return counts.join(vocab, "tid").select("rec", "tid", "df", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def vectors(weighted: DataFrame) -> DataFrame:
    """(rec, ids, ws): a row per record, rare terms first."""
    packed = weighted.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("df", "tid", "w"))).alias("t"))
    return packed.select("rec", F.col("t.tid").alias("ids"), F.col("t.w").alias("ws"))


# ---------------------------------------------------------------- vectors of the terms that both sides have
#: Occurrences of terms in a block of records, ranges of hashes that terms are counted in.
BLOCK_TERMS, RANGES = 4_000_000, 1_024
LISTS = "kind int, block long, part int, rec long, at binary, n binary, tids binary"


def _lists(values: np.ndarray, ends: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, first bytes of all together and so on: of small ones, most is zeros to a compressor."""
    return np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows, and how many each row has."""
    rows = [np.frombuffer(x, np.uint8).reshape(8, -1).T for x in table.column(name).to_pylist()]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.ascontiguousarray(np.concatenate([np.zeros((0, 8), np.uint8), *rows])).view(np.int64).ravel(), sizes


def _gaps(rising: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Stretches of rising numbers as their first one and the steps from there."""
    out = np.diff(rising, prepend=0)
    out[first] = rising[first]
    return out


def _rising(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total, ends = np.cumsum(gaps), np.cumsum(sizes)
    before = np.concatenate([[0], total])[ends - sizes]
    return total - np.repeat(before, sizes)


def _block(block: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Records of a block as places among its distinct terms and counts (kind 0), and the terms in order, by ranges
    of hashes, with the numbers of records that hold them (kind 1). Rising numbers are kept as gaps."""
    records = _distinct_counts(batch)
    ids, tf = records.column("ids"), records.column("tfs").flatten().to_numpy()
    sizes = np.diff(ids.offsets.to_numpy())
    names, at = np.unique(ids.flatten().to_numpy(), return_inverse=True)
    holders = np.bincount(at, np.repeat(records.column("copies").to_numpy(), sizes), minlength=len(names)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    gaps = _gaps(at, starts[sizes > 0])
    parts, first = np.unique((names >> 54) + RANGES // 2, return_index=True)
    steps, ends = _gaps(names, first), np.append(first[1:], len(names))
    rows = [(0, block, 0, rec, _packed(gaps[s : s + k]), _packed(tf[s : s + k]), None) for rec, s, k in zip(records.column("rec").to_pylist(), starts, sizes)]
    rows += [(1, block, int(part), 0, None, _packed(holders[s:e]), _packed(steps[s:e])) for part, s, e in zip(parts, first, ends)]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], [c.split()[0] for c in LISTS.split(", ")])


def _blocks(side: DataFrame, number: int, **kw) -> DataFrame:
    """Blocks of a side (rec, text, copies): rows as in LISTS. Odd block numbers are of side 1."""
    numbered = side.select("rec", "copies", F.transform(terms("text", **kw), lambda t: F.xxhash64(t)).alias("ids"))

    def count(batches):
        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes, at = np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_TERMS, "right")))
                yield _block(task << 32 | n << 1 | number, batch.slice(at, end - at))
                at, n = end, n + 1

    return numbered.mapInArrow(count, LISTS)


def shared_vectors(left: DataFrame, right: DataFrame, n: int, least: float, min_df: int, fitted: tuple[int, ...], **kw) -> DataFrame:
    """(rec, side, ids, ws, dfs, norm): records(rec, text, copies) of both sides, left 0, right 1, as the terms that
    both sides have, rare ones first, with the length of the whole vector; records whose shared terms reach no cosine
    of `least` are left out. Terms are fitted on n records of the sides `fitted`.

    A record's terms never travel one by one: tasks ask once for each distinct term of a block of records, and the
    answer is how many records hold it and whether the other side does."""
    made = stored(_blocks(left, 0, **kw).unionByName(_blocks(right, 1, **kw)), "terms")
    asked = made.filter("kind = 1").select("block", "part", "n", "tids")

    def look_up(table: pa.Table) -> pa.Table:
        steps, sizes = _numbers(table, "tids")
        names, at = np.unique(_rising(steps, sizes), return_inverse=True)
        block = table.column("block").to_numpy()
        side = np.repeat(block & 1, sizes)
        counted = np.isin(side, fitted)
        df = np.bincount(at[counted], _numbers(table, "n")[0][counted], minlength=len(names)).astype(np.int64)
        both = (np.bincount(at[side == 0], minlength=len(names)) > 0) & (np.bincount(at[side == 1], minlength=len(names)) > 0)
        kept = both & (df >= min_df)
        # twice the number of holders, and one more where the other side has the term too
        found, shared = np.where(df < min_df, 0, 2 * df + kept)[at], kept[at]
        ends = np.cumsum(sizes)
        own = [slice(e - n, e) for e, n in zip(ends, sizes)]
        held = [names[at[s]][shared[s]] for s in own]
        return pa.table({
            "block": block, "part": table.column("part"), "dfs": pa.array([_packed(found[s]) for s in own], pa.binary()),
            "tids": pa.array([_packed(np.diff(h, prepend=0)) for h in held], pa.binary()),
        })

    answers = spread(asked, "part").groupBy("part").applyInArrow(look_up, "block long, part int, dfs binary, tids binary")
    records = made.filter("kind = 0").select("block", "rec", "at", "n")

    def weigh(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("part")
        df_of = _numbers(b, "dfs")[0]
        tid_of = np.zeros(len(df_of), np.int64)
        tid_of[df_of & 1 == 1] = _rising(*_numbers(b, "tids"))
        rec, (gaps, sizes) = a.column("rec").to_numpy(), _numbers(a, "at")
        row, place = np.repeat(np.arange(len(rec)), sizes), _rising(gaps, sizes)
        df, shared = df_of[place] >> 1, df_of[place] & 1 == 1
        w = np.where(df > 0, (1 + np.log(_numbers(a, "n")[0])) * (np.log((1 + n) / (1 + df)) + 1), 0.0)
        norm2 = np.bincount(row, w * w, minlength=len(rec))
        reach = np.bincount(row, np.where(shared, w * w, 0.0), minlength=len(rec))
        kept = np.flatnonzero(shared & (reach >= (least - 1e-6) ** 2 * norm2)[row])
        kept = kept[np.lexsort((tid_of[place[kept]], df[kept], row[kept]))]
        sizes = np.bincount(row[kept], minlength=len(rec))
        held = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)[held]
        side = np.full(len(held), a.column("block")[0].as_py() & 1 if len(held) else 0)
        return pa.table({
            "rec": rec[held], "side": pa.array(side, pa.int32()), "ids": _lists(tid_of[place[kept]], ends),
            "ws": _lists(w[kept], ends), "dfs": _lists(df[kept], ends, pa.int64()), "norm": np.sqrt(norm2[held]),
        })

    both = spread(records, "block").groupBy("block").cogroup(spread(answers.withColumnRenamed("block", "to"), "to").groupBy("to"))
    return stored(both.applyInArrow(weigh, "rec long, side int, ids array<long>, ws array<double>, dfs array<long>, norm double"), "vectors")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to shared storage, packed, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- pairs above a high cut
#: Share of the cut down to which terms of two vectors meet.
LEVEL = 0.75


def _heads(vecs: DataFrame, cut: float) -> DataFrame:
    """(rec, tid, w, s), and df where it is known: the terms of unit vectors from which on, rare ones first, at least
    the cut of a vector's length s is left."""
    dfs = "dfs" in vecs.columns

    def head(batches):
        for batch in batches:
            rec, row, ids, w = _unit_entries(pa.Table.from_batches([batch]))
            left = np.cumsum((w * w)[::-1])[::-1]
            first = np.searchsorted(row, np.arange(len(rec)))
            ends = np.append(first[1:], len(row))
            behind = np.append(left, 0.0)[ends][row]
            s = np.sqrt(np.maximum(left - behind, 0.0))
            kept = np.flatnonzero(s >= cut - 1e-6)
            parts = [rec[row], ids, w.astype(np.float32), s.astype(np.float32)] + ([batch.column("dfs").flatten().to_numpy()] if dfs else [])
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in parts], ["rec", "tid", "w", "s", "df"][: len(parts)])

    return vecs.mapInArrow(head, "rec long, tid long, w float, s float" + ", df long" * dfs)


def near_pairs(left: DataFrame, right: DataFrame, cut: float) -> DataFrame:
    """(l_rec, r_rec, cosine): all pairs of vectors(rec, ids, ws), terms in one order on both sides, with cosine at
    least the cut.

    What two unit vectors have in common from a shared term on is at most the product of the lengths they have left
    there. Terms meet where that product reaches a level below the cut, rare ones as a rule; the terms behind them
    add less than the level, and no more than the lengths left behind the last of them. Pairs that can reach the cut
    with that are multiplied in full."""
    level = LEVEL * cut
    side = lambda df, p: _heads(df, level).withColumnsRenamed({c: f"{p}_{c}" for c in ("rec", "w", "s", "df")})
    l, r = side(left, "l"), side(right, "r")
    if "dfs" in left.columns:
        l, r = (x.withColumn("splits", cell_splits(F.col(f"{p}_df"))).drop(f"{p}_df") for x, p in ((l, "l"), (r, "r")))
    else:
        size = lambda df, name: df.groupBy("tid").agg(F.count("*").alias(name))
        grid = size(l, "nl").join(size(r, "nr"), "tid").select("tid", cell_splits(F.greatest("nl", "nr")).alias("splits"))
        l, r = l.join(grid, "tid"), r.join(grid, "tid")
    met = meet(l, r, ["tid"], "l_rec", "r_rec", F.col("l_s") * F.col("r_s") >= level - 1e-6)
    # weights and lengths travel as floats, so what is left behind a term is taken a bit too long
    rest = lambda p: F.sqrt(F.greatest(F.col(f"{p}_s").cast("double") * F.col(f"{p}_s") - F.col(f"{p}_w").cast("double") * F.col(f"{p}_w"), F.lit(0.0)) + 1e-6)
    bounds = met.groupBy("l_rec", "r_rec").agg(F.sum(F.col("l_w") * F.col("r_w")).alias("sure"), F.min((rest("l") * rest("r")).cast("float")).alias("most"))
    pairs = cut_lineage(bounds.filter(F.col("sure") + F.least(F.col("most"), F.lit(level)) >= cut - 1e-5).select("l_rec", "r_rec"))
    vector = ["ids", "ws", *(["norm"] if "norm" in left.columns else [])]
    named = lambda side, p: side.select(*[F.col(c).alias(f"{p}_{c}") for c in ("rec", *vector)])
    full = pairs.join(named(left, "l"), "l_rec").join(named(right, "r"), "r_rec")

    def multiply(batches):
        for batch in batches:
            found = [_product(*[batch.column(c)[i].values.to_numpy() for c in ("l_ids", "l_ws", "r_ids", "r_ws")]) for i in range(batch.num_rows)]
            norm = [batch.column(f"{p}_norm").to_numpy() if "norm" in vector else np.array([np.sqrt((w.values.to_numpy() ** 2).sum()) for w in batch.column(f"{p}_ws")]) for p in "lr"]
            yield pa.RecordBatch.from_arrays([batch.column("l_rec"), batch.column("r_rec"), pa.array(np.array(found, np.float64) / (norm[0] * norm[1]))], ["l_rec", "r_rec", "cosine"])

    return full.mapInArrow(multiply, "l_rec long, r_rec long, cosine double").filter(F.col("cosine") >= cut)


def _product(l_ids: np.ndarray, l_ws: np.ndarray, r_ids: np.ndarray, r_ws: np.ndarray) -> float:
    _, i, j = np.intersect1d(l_ids, r_ids, assume_unique=True, return_indices=True)
    return float((l_ws[i] * r_ws[j]).sum())


# ---------------------------------------------------------------- products of blocks
#: Vectors and weights of one block at most, on average; a term is multiplied densely where listing the pairs of its
#: records would be more than DENSE_GAIN times a row of the dense product.
BLOCK_ROWS, BLOCK_WEIGHTS, DENSE_GAIN = 1_024, 4_000_000, 150


def _unit_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records, and per weight of their unit vectors its row, term and value. Vectors that are parts of longer ones
    have the `norm` of those."""
    ids, ws = table.column("ids").combine_chunks(), table.column("ws").combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids, ws = pa.concat_arrays(ids.chunks), pa.concat_arrays(ws.chunks)
    sizes = np.diff(ids.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    w = ws.flatten().to_numpy()
    norm = table.column("norm").to_numpy() if "norm" in table.column_names else np.sqrt(np.bincount(row, w * w, minlength=len(sizes)))
    return table.column("rec").to_numpy(), row, ids.flatten().to_numpy(), w / norm[row]


def _listed_products(l_row, l_w, l_begin, l_count, r_row, r_w, r_begin, r_count, shape, most: int = 4_000_000) -> np.ndarray:
    """Sum of weight products per pair of rows, over terms given by their stretches of entries on both sides."""
    out = np.zeros(shape[0] * shape[1])
    at = np.repeat(np.arange(len(l_count)), l_count)
    entry = np.arange(int(l_count.sum())) - np.repeat(np.cumsum(l_count) - l_count, l_count) + l_begin[at]
    n = r_count[at]
    edges = np.concatenate([[0], np.cumsum(n)])
    start = 0
    while start < len(entry):
        end = max(start + 1, int(np.searchsorted(edges, edges[start] + most, "right")) - 1)
        k = n[start:end]
        partner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(r_begin[at[start:end]], k)
        own = np.repeat(entry[start:end], k)
        out += np.bincount(l_row[own] * shape[1] + r_row[partner], l_w[own] * r_w[partner], minlength=len(out))
        start = end
    return out.reshape(shape)


def block_product(left: pa.Table, right: pa.Table, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines of all pairs of a left and a right block that can reach the cut: left row, right row, cosine.

    Terms that few records of the blocks share are multiplied pair by pair. What the rest, the common terms, can add
    to a pair is at most the product of the lengths that are left of its vectors; only if some pair may still reach
    the cut are they multiplied, as dense columns."""
    _, l_row, l_ids, l_w = _unit_entries(left)
    _, r_row, r_ids, r_w = _unit_entries(right)
    shape = (left.num_rows, right.num_rows)
    l_order, r_order = np.argsort(l_ids, kind="stable"), np.argsort(r_ids, kind="stable")
    l_row, l_ids, l_w = l_row[l_order], l_ids[l_order], l_w[l_order]
    r_row, r_ids, r_w = r_row[r_order], r_ids[r_order], r_w[r_order]
    lt, l_begin, l_count = np.unique(l_ids, return_index=True, return_counts=True)
    rt, r_begin, r_count = np.unique(r_ids, return_index=True, return_counts=True)
    _, li, ri = np.intersect1d(lt, rt, assume_unique=True, return_indices=True)
    l_begin, l_count, r_begin, r_count = l_begin[li], l_count[li], r_begin[ri], r_count[ri]
    dense = l_count * r_count * DENSE_GAIN > shape[0] * shape[1]
    thin = ~dense
    total = _listed_products(l_row, l_w, l_begin[thin], l_count[thin], r_row, r_w, r_begin[thin], r_count[thin], shape)
    if dense.any():

        def columns(rows, row, w, begin, count):
            at = np.repeat(np.arange(len(count)), count)
            entry = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[at]
            out = np.zeros((rows, len(count)))
            out[row[entry], at] = w[entry]
            return out

        def length(rows, row, w, begin, count):
            entry = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            return np.sqrt(np.bincount(row[entry], w[entry] ** 2, minlength=rows))

        rest = length(shape[0], l_row, l_w, l_begin[dense], l_count[dense])[:, None] * length(shape[1], r_row, r_w, r_begin[dense], r_count[dense])
        open_rows = np.flatnonzero((total + rest >= cut - 1e-9).any(axis=1))
        for some in np.array_split(np.flatnonzero(dense), -(-int(dense.sum()) // 2_000)) if len(open_rows) else ():
            a = columns(shape[0], l_row, l_w, l_begin[some], l_count[some])
            b = columns(shape[1], r_row, r_w, r_begin[some], r_count[some])
            total[open_rows] += a[open_rows] @ b.T
    l, r = np.nonzero(total >= cut)
    return l, r, total[l, r]


def cosine_pairs(left: DataFrame, right: DataFrame, cut: float, top: int | None = None) -> DataFrame:
    """(l_rec, r_rec, cosine): pairs of vectors(rec, ids, ws) with cosine at least the cut; with `top`, at least the
    `top` best of each left record by cosine rounded to 12 places, then r_rec.

    Both sides are dealt into blocks; a vector travels once to each block of the other side. A block keeps at most
    `top` pairs of a left record, so what leaves it is bounded by its records."""

    def dealt(side: DataFrame, name: str) -> tuple[DataFrame, int]:
        size = side.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("weights")).first()
        blocks = max(1, -(-size["n"] // BLOCK_ROWS), -(-size["weights"] // BLOCK_WEIGHTS))
        return side.withColumn(name, F.pmod(F.xxhash64("rec"), F.lit(blocks)).cast("int")), blocks

    (l, l_blocks), (r, r_blocks) = dealt(left, "row"), dealt(right, "column")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l, r = l.withColumn("column", every(r_blocks)), r.withColumn("row", every(l_blocks))
    vector = ["rec", "ids", "ws", *(["norm"] if "norm" in left.columns else [])]
    l = l.select(*vector, "row", "column")
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in (*vector, "row", "column")])  # names of its own, also where both sides are one table

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        b, found = b.select([f"r_{c}" for c in vector]).rename_columns(vector), ([], [], [])
        if a.num_rows and b.num_rows:
            i, j, c = block_product(a, b, cut)
            rl, rr = a.column("rec").to_numpy()[i], b.column("rec").to_numpy()[j]
            if top is not None:
                order = np.lexsort((rr, -np.round(c, 12), i))
                first = np.searchsorted(i[order], i[order], "left")
                kept = order[np.arange(len(order)) - first < top]
                rl, rr, c = rl[kept], rr[kept], c[kept]
            found = (rl, rr, c)
        return pa.table({"l_rec": pa.array(found[0], pa.int64()), "r_rec": pa.array(found[1], pa.int64()), "cosine": pa.array(found[2], pa.float64())})

    n = min(l_blocks * r_blocks, 10_000)
    both = l.repartition(n, "row", "column").groupBy("row", "column").cogroup(r.repartition(n, "r_row", "r_column").groupBy("r_row", "r_column"))
    return both.applyInArrow(multiply, "l_rec long, r_rec long, cosine double")


def _distinct_texts(df: DataFrame, gates: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct texts within gates (rec, copies, __k, gates), all rows (id, __k, gates), both kept without the texts,
    and the distinct records with theirs (rec, text, copies)."""
    keyed = df.withColumn("__k", F.sha2(text_or_empty("text"), 256))
    group = ["__k", *gates]
    rows = stored(keyed.select("id", *group), "rows")
    d = stored(rows.groupBy(*group).agg(F.min("id").alias("rec"), F.count("*").alias("copies")), "records")
    texts = keyed.groupBy(*group).agg(F.min("id").alias("rec"), F.first("text").alias("text"), F.count("*").alias("copies"))
    return d, rows, texts.select("rec", "text", "copies")


def tfidf_best(
    left: DataFrame, right: DataFrame, min_cosine: float, gates: list[str], accept, min_df: int = 2,
    max_features: int | None = None, top: int | None = None,
) -> DataFrame:
    """Best right record of each left one by cosine of weighted terms, fitted on both sides.

    left, right: (id, text, *gates). `accept` takes the gate columns of both sides, prefixed l_ and
    r_, and says whether a pair may match. With `top`, only the `top` nearest right records are
    looked at, as rows, before the gates. Returns (id, match_id, cosine)."""
    l, l_all, l_texts = _distinct_texts(left, gates)
    r, r_all, r_texts = _distinct_texts(right, gates)
    if max_features is None:
        n = sum(x.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] for x in (l, r))
        vecs = shared_vectors(l_texts, r_texts, n, min_cosine, min_df, (0, 1))
        lv, rv = (vecs.filter(F.col("side") == i) for i in (0, 1))
    else:
        numbered = lambda x, i: x.select((F.col("rec") * 2 + i).alias("rec"), "text", "copies")
        both = numbered(l_texts, 0).unionAll(numbered(r_texts, 1))
        vecs = cut_lineage(vectors(weights(term_counts(both), vocabulary(both, min_df, max_features))))
        lv, rv = (vecs.filter(F.pmod("rec", F.lit(2)) == i).withColumn("rec", F.floor(F.col("rec") / 2).cast("long")) for i in (0, 1))
    pairs = near_pairs(lv, rv, min_cosine).select("l_rec", "r_rec", "cosine")
    if top is not None:
        rows = top_k(r_all.join(r.select("__k", *gates, "rec"), ["__k", *gates]), ["rec"], [F.col("id")], top)
        pairs = pairs.join(rows.select(F.col("rec").alias("r_rec"), F.col("id").alias("r_id")), "r_rec")
        pairs = top_k(pairs, ["l_rec"], [F.desc(F.round("cosine", 12)), F.col("r_id")], top)
    else:
        pairs = pairs.withColumn("r_id", F.col("r_rec"))
    for side, p in ((l, "l"), (r, "r")):
        pairs = pairs.join(
            side.select(F.col("rec").alias(p + "_rec"), *[F.col(g).alias(f"{p}_{g}") for g in gates]),
            p + "_rec",
        )
    chosen = top_k(pairs.filter(accept()), ["l_rec"], [F.desc(F.round("cosine", 12)), F.col("r_id")], 1)
    back = l.select("rec", "__k", *gates).join(
        chosen.select(F.col("l_rec").alias("rec"), F.col("r_id").alias("match_id"), "cosine"), "rec"
    ).drop("rec")
    return l_all.join(back, ["__k", *gates]).select("id", "match_id", "cosine")


def tfidf_candidates(
    queries: DataFrame, pool: DataFrame, top: int = 40, above: float = 0.05, min_df: int = 2,
    max_features: int | None = None, stop_words=(),
) -> DataFrame:
    """The `top` nearest pool records of each query, cosine above the floor; terms are weighted on
    the pool alone. queries(id, text), pool(id, text). Returns (id, match_id, cosine, rank)."""
    q, q_all, q_texts = _distinct_texts(queries, [])
    p, p_all, p_texts = _distinct_texts(pool, [])
    if max_features is None:
        n = p.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        vecs = shared_vectors(q_texts, p_texts, n, above, min_df, (1,), stop_words=stop_words)
        qv, pv = (vecs.filter(F.col("side") == i) for i in (0, 1))
    else:
        vocab = vocabulary(p_texts, min_df, max_features, stop_words=stop_words)
        qv, pv = (cut_lineage(vectors(weights(term_counts(x, stop_words=stop_words), vocab))) for x in (q_texts, p_texts))
    pairs = cosine_pairs(qv, pv, above, top).filter(F.col("cosine") > above)
    rows = top_k(p_all.join(p.select("__k", "rec"), "__k"), ["rec"], [F.col("id")], top)
    wide = pairs.join(rows.select(F.col("rec").alias("r_rec"), F.col("id").alias("match_id")), "r_rec")
    ranked = top_k(wide, ["l_rec"], [F.desc(F.round("cosine", 12)), F.col("match_id")], top, "rank")
    back = q.select("__k", F.col("rec").alias("l_rec"))
    return (
        q_all.join(back, "__k").join(ranked, "l_rec").select("id", "match_id", "cosine", "rank")
    )
