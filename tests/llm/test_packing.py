import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from verdigris.llm.packing import best_fit, exchange, local_search, pack, places, word_ids
from verdigris.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def spread(bins):
    return Counter(x for b, m in bins.items() for x in b for _ in range(m))


def test_word_ids_equal_the_library():
    t, rng = Tokenizer.from_file(PATH), random.Random(5)
    letters = "aabcdeéÈßİñ тест 漢字🙂́ \n\t\r\x0b\x1c\x1f\x85\xa0 　'stre,.!?0123"
    texts = ["", None, "don't we'll", "x<|endoftext|>y <|startoftext|>", "a" * 3000]
    texts += ["İx ŉ ab", "Ǆ ﬁ ΣΑΣ", " ".join(f"w{chr(97 + i % 26)}{'x' * (i % 7)}" for i in range(3000)), "ａ" * 40]
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 50))) for _ in range(2000)]
    for s, ids in zip(texts, word_ids(PATH).ids(texts), strict=True):
        assert ids.tolist() == t.encode(s or "", add_special_tokens=False).ids, repr(s)


def test_histogram_packing_keeps_pieces_and_capacity():
    rng = random.Random(7)
    for case in range(60):
        cap = rng.choice([10, 50, 200])
        counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, cap + 1), rng.randrange(1, 10))}
        start = best_fit(counts, cap)
        end = local_search(start, cap)
        for bins in (start, end):
            assert spread(bins) == Counter(counts) and all(0 < sum(b) <= cap for b in bins)
        assert math.ceil(sum(n * c for n, c in counts.items()) / cap) <= sum(end.values()) <= sum(start.values())


def test_search_empties_a_bin():
    start = Counter({(6, 3): 1, (5, 4): 1, (2,): 1})  # 20 of 3 x 10: two bins suffice
    assert sum(local_search(start, 10).values()) == 2
    assert exchange((2,), (6, 4), 10) is None
    assert exchange((3, 2), (6, 1), 10) == ((2,), (6, 3, 1))


def test_places_are_gapless():
    bins = Counter({(5, 3, 3): 4, (3, 3): 2, (11,): 1})
    at, filled = places(bins), defaultdict(list)
    for length, c in spread(bins).items():
        for r in range(c):
            i = max(j for j in range(len(at["length"])) if (at["length"][j], at["rank"][j]) <= (length, r))
            nth, copy = divmod(r - at["rank"][i], at["each"][i])
            filled[at["bin"][i] + nth].append((at["offset"][i] + copy * length, length))
    assert sorted(filled) == list(range(7))
    for ps in filled.values():
        assert [o for o, _ in sorted(ps)] == np.cumsum([0, *[n for _, n in sorted(ps)]])[:-1].tolist()


def check(rows, texts, cap):
    t, by_doc, by_seq = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids = t.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(math.ceil(len(ids) / cap)))
        for p in ps:
            part = ids[p.piece * cap : (p.piece + 1) * cap]
            assert (p.start, p.length, p.ids_crc32) == (p.piece * cap, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for ps in by_seq.values():
        end = 0
        for p in sorted(ps, key=lambda r: r.offset):
            assert p.offset == end
            end += p.length
        assert end <= cap


def test_query_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_packing"](spark, sf).collect()
    check(rows, texts, 2048)
    assert len({r.sequence_id for r in rows}) <= math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(None, None, 1), (1, "", 1), (2, "one two three four five", 1), (3, None, 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack(df, PATH, capacity=4).collect()
    assert Counter(r.doc_id for r in got) == Counter({None: 2, 1: 1, 2: 2, 3: 1})
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    same = spark.createDataFrame([(7, "a b c d e f")] * 3, "doc_id long, text string")
    assert len({(r.sequence_id, r.offset) for r in pack(same, PATH, capacity=4).collect()}) == 6
    assert pack(df.limit(0), PATH).count() == 0
