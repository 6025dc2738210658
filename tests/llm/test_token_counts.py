import random

import public_tokenizers
from tokenizers import Tokenizer

from verdigris.llm.queries import QUERIES
from verdigris.llm.token_counts import count_tokens, merge_counter

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library():
    t, c, rng = library(), merge_counter(PATH), random.Random(3)
    letters = "aabcdeéèßñ тест 漢字🙂́ \n\t\r\x0b\x1c\x1f\x85\xa0 　'stre,.!?0123456789"
    texts = ["", " ", "don't we'll I'm  x", "a" * 5000, " " * 300 + "x", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "\x00\x7f", "it's\n\n  ok"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(3000)]
    for s in texts:
        assert c.tokens(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(None, None, 5), (1, "", 5), (2, "Hello world", 5), (2, "Hello world", 5), (3, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in count_tokens(df, PATH).collect()), key=repr)
    assert got == sorted([(None, None, 0), (1, "", 0), (2, "Hello world", 2), (2, "Hello world", 2), (3, None, 0)], key=repr)
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_query_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    t = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_token_counts"](spark, sf).collect()}
    want = {d: (len(s.encode()), n := len(t.encode(s, add_special_tokens=False).ids), n > 512) for d, s in texts.items()}
    assert got == want
