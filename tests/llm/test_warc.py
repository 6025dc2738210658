import base64
import hashlib
import io
import os
import zlib
from collections import Counter

import pytest

from verdigris.llm.queries import QUERIES
from verdigris.llm.warc import CorruptArchive, archive_folder, read_archives, record, records, write_archives


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_records_come_back_whole():
    big = os.urandom(1 << 20).hex().encode()
    raw = record(1, "http://a/\r\nb", b"\r\n\r\nx", None) + record(2, None, big, None) + record(None, "u", b"", None) + record(3, "u", big, 2)
    got = list(records(io.BytesIO(raw), True))
    assert [r["page_id"] for r in got] == ["1", "2", None, "3"]
    assert [r["html"] for r in got] == ["\r\n\r\nx", big.decode(), "", None]
    assert got[3]["refers_to"] == "2" and got[3]["payload_bytes"] == len(big) and got[3]["payload_digest"] == sha(big)
    assert got[0]["url"] == "http://a/%0D%0Ab"


def gz(raw):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def test_broken_archives_raise():
    raw = record(1, "u", b"hello hello", None)
    plain = zlib.decompress(raw, 31)
    broken = [raw[:-9], gz(plain.replace(b"hello h", b"hellO h")), gz(plain + b"x"), gz(plain[:-6]), gz(b"junk\r\n" + plain), raw + b"junk"]
    for b in broken:
        with pytest.raises(CorruptArchive):
            list(records(io.BytesIO(b), False))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    raw = {r.page_id: (r.html or "").encode() for r in rows}
    last = {}
    for p, h in raw.items():
        last[h] = max(p, last.get(h, p))
    want = sorted((p, len(h), sha(h), *(("response", None) if last[h] == p else ("revisit", last[h]))) for p, h in raw.items())
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op6_warc"](spark, sf).collect())
    assert got == want


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "", "x"), (5, "u", "é" * 9, "x"), (5, "u", "é" * 9, "x"), (4, "u", "é" * 9, "x"), (None, "u", "lone", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    got = read_archives(write_archives(df, archive_folder(df), archive_bytes=600)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.html) for r in got) == Counter(
        [(1, "revisit", 2, None), (2, "response", None, ""), (None, "revisit", 2, None), (5, "response", None, "é" * 9), (5, "response", None, "é" * 9), (4, "revisit", 5, None), (None, "response", None, "lone")]
    )
    assert read_archives(write_archives(df.limit(0), archive_folder(df))).count() == 0
    small = {r.page_id: r.record_type for r in read_archives(write_archives(df, archive_folder(df), least_bytes=1)).collect()}
    assert small[1] == small[2] == "response" and small[4] == "revisit"
