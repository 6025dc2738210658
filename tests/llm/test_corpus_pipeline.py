import corpus_pipeline
from pyspark.sql import functions as F
from test_jaccard_join import brute as groups
from test_packing import check
from test_recompression import BLANK

from verdigris.llm import weak_labels
from verdigris.llm.decontamination import norm_words

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def windows_left(rows, window):
    """Words of each text outside windows that a document of smaller id has."""
    first, words = {}, {d: BLANK.findall(t or "") for d, t in rows}
    for d, ws in words.items():
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, ws in words.items():
        gone = {j for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] < d for j in range(i, i + window)}
        out[d] = " ".join(w for i, w in enumerate(ws) if i not in gone) if gone else None
    return out


def test_stages_equal_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == docs.columns
    model = weak_labels.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {d: t for d, t in texts(docs).items() if (weak_labels.score_texts([t], model) <= 0.5).all()}
    assert texts(kept) == want

    single = stages["near_duplicates"](spark, docs, SF)
    before = texts(docs)
    assert texts(single) == {d: before[d] for d, _, c in groups(list(before.items())) if c == d}

    unique = stages["repeated_passages"](spark, docs, SF)
    left = windows_left(before.items(), 50)
    assert texts(unique) == {d: t if left[d] is None else left[d] for d, t in before.items()}
    assert unique.where(F.col("n_chars") != F.length("text")).count() == docs.where(F.col("n_chars") != F.length("text")).count()

    safe = texts(stages["benchmark_leaks"](spark, docs, SF))
    items = [" ".join(norm_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {d for d, t in before.items() if any(f" {i} " in f" {' '.join(norm_words(t))} " for i in items)}
    assert whole and not whole & set(safe) and set(safe) <= set(before) and len(safe) > 0.8 * len(before)

    check(stages["packing"](spark, docs, SF).collect(), before, 2048)


def test_run_packs_what_the_stages_keep(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    check(rows, texts(docs), 2048)
    assert 0 < len({r.doc_id for r in rows}) < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_take_nulls_repeats_more_columns_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "en", "s", 11, 1), (None, None, None, None, None, 1), (2, "a b c d e f", "en", "s", 11, 1), (2, "a b c d e f", "en", "s", 11, 1), (3, "", None, "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    empty = docs
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, SF), stage(spark, empty.limit(0), SF)
        assert empty.count() == 0
        if name != "packing":
            assert docs.columns == empty.columns == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 3, None]
