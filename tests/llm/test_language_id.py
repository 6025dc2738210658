import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from verdigris.llm.language_id import START, Model, Pieces, expected, fit, forward, pieces_of, predict
from verdigris.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    """All ways to cut a word into pieces, as lists of piece numbers."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        piece = int(pieces.ending([word], k, k)[0])
        if piece < pieces.size:
            for rest in segmentations(word[k:], pieces):
                yield [piece, *rest]


@pytest.mark.parametrize("word", ["theo", "été", "漢字the", "ßzzq"])
def test_forward_and_expectation_sum_all_segmentations(word):
    pieces, rng = pieces_of(PATH), np.random.default_rng(1)
    logp = np.vstack([np.log(rng.dirichlet(np.ones(pieces.size), 2)).T, [[-np.inf] * 2]])
    ways = list(segmentations(START + word, pieces))
    weights = np.exp([[logp[w, j].sum() for j in (0, 1)] for w in ways])
    assert len(ways) > 1
    assert np.allclose(forward(pieces, [START + word] * 2, logp)[1], np.log(weights.sum(axis=0)))
    want = np.zeros(pieces.size)
    for w, p in zip(ways, weights[:, 0] / weights[:, 0].sum(), strict=True):
        for piece in w:
            want[piece] += 3 * p
    assert np.allclose(expected(pieces, [START + word], np.array([3.0]), logp[:, 0]), want)


def test_pieces_in_words_are_found_without_a_look_up_per_piece():
    pieces, words = Pieces(PATH), [START + w for w in ("thehouse", "zürichte", "漢字theqq_", "intensiv")]
    words = [w[:9] for w in words]
    want = {(end, k): [pieces.index.get(w[end - k : end], pieces.size) for w in words] for end in range(1, 10) for k in range(2, end + 1)}
    assert len({x for row in want.values() for x in row}) > 30
    assert all(pieces.ending(words, end, k).tolist() == row for (end, k), row in want.items())
    logp = np.vstack([np.full((pieces.size, 2), -9.0), [[-np.inf] * 2]])
    pieces.index = None
    assert np.isfinite(forward(pieces, words, logp)).all() and expected(pieces, words, np.ones(4), logp[:, 0]).sum() > 4


def test_long_words_do_not_underflow():
    pieces = pieces_of(PATH)
    logp = np.full((pieces.size + 1, 1), -50.0)
    logp[-1] = -np.inf
    assert math.isfinite(forward(pieces, [START + "q" * 20_000], logp)[0, 0])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op1_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(1, "the house and the garden", "en", 0.5), (2, "das haus und der garten", "de", 0.5), (2, "das haus und der garten", "de", 0.5), (3, None, "en", 0.5), (4, "12 !? ½", None, 0.5), (None, "", None, 0.5), (5, "und das", None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred) for r in predict(df, fit(df, PATH)).collect()]
    assert got == [(1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (None, "und"), (5, "de")]
    empty = fit(df.limit(0), PATH)
    assert empty.languages == []
    assert {r.lang_pred for r in predict(df, empty).collect()} == {"und"}
    assert predict(df.limit(0), Model(PATH, ["en"], empty.logp)).count() == 0
