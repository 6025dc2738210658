"""Readers and record shapes on small files."""

import json

from pyspark.sql import functions as F

from verdigris.operators import regress as rg
from verdigris.sources import records as rec
from verdigris.sources import tables as ta


def test_pieces_joined_are_the_file(spark, tmp_path):
    texts = {"a.txt": "one\ntwo\r\n\nfour " + "x" * 95 + "\nlast", "b.txt": "\n".join(f"line {i}" for i in range(300)) + "\n", "c.txt": "é" * 25 + "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        pieces = ta.read_text_pieces(spark, str(tmp_path), 20).orderBy("file", "piece").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, text in texts.items():
        own = [p for p in pieces if p.file.endswith(name)]
        assert "".join(p.text for p in own) == text + ("" if text.endswith("\n") else "\n")
        assert [p.piece for p in own] == list(range(len(own))) and max(len(p.text) for p in own) <= 40


def test_statistics_come_back_with_defaults(spark, tmp_path):
    rows = [(i % 3 if i < 60 else 7, f"v{i}", float(i), "None" if i % 2 else "**") for i in range(2000)]
    df = spark.createDataFrame(rows, "paper long, variable string, z_abs double, stars string")
    ta.write_statistics_json(df, str(tmp_path / "s"), "paper", 100)
    papers = spark.createDataFrame([(7, "Title", 2001)], "paper long, paper_title string, year int")
    back = ta.read_statistics_json(spark, str(tmp_path / "s"), papers, "paper", "bigint")
    assert sorted((r.paper, r.variable, r.z_abs, r.stars) for r in back.collect()) == sorted((p, v, z, "" if s == "None" else s) for p, v, z, s in rows)
    assert {(r.paper_title, r.year) for r in back.filter("paper = 7").select("paper_title", "year").collect()} == {("Title", 2001)}
    assert back.filter("paper = 1 and paper_title is not null").count() == 0
    assert spark.read.text(str(tmp_path / "s")).agg(F.max(F.length("value"))).first()[0] < 20_000


def test_landed_arrays_are_read_too(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps([{"variable": "x", "z_abs": 1.5}, {"variable": "y", "stars": "*", "year": 1999}]))
    (tmp_path / "p2.json").write_text("[]")
    papers = spark.createDataFrame([("p1", 2010)], "paper string, year int")
    got = ta.read_landed_statistics(spark, str(tmp_path), papers, "paper").filter("variable is not null").select("paper", "variable", "year", "stars").collect()
    assert sorted(tuple(r) for r in got) == [("p1", "x", 2010, ""), ("p1", "y", 1999, "*")]


def test_location_edges_need_both_ends(spark):
    relation = {"relation": {"is-based-on": [{"id-type": "doi", "id": "10.3386/W5"}], "has-preprint": [{"id-type": "uri", "id": "10.3386/w9"}]}}
    cited = {"reference": [{"DOI": "10.1111/a"}, {}, {"DOI": "10.3386/w6"}]}
    versions = {"doi": "https://doi.org/10.1111/X", "locations": [{"doi": None, "url": "see 10.1111/none"}, {"landing_page_url": "https://j.org/10.1111/y)."}]}
    landed = [("relation", "10.1111/x", relation), ("relation", "10.1111/y", cited), ("relation", "10.1111/z", {"relation": None}), ("draft versions", "w7", versions), ("open", "10.1111/x", {"oa_locations": [{"url": "nber.org/papers/w404"}]})]
    records = spark.createDataFrame([(s, k, json.dumps(r)) for s, k, r in landed], "shape string, key string, json string")
    articles = spark.createDataFrame([("10.1111/x",), ("10.1111/y",), ("10.1111/z",)], "doi string")
    drafts = spark.createDataFrame([("w5",), ("w6",), ("w7",)], "wp_number string")
    got = {tuple(r) for r in rec.location_edges(records, articles, drafts).collect()}
    assert got == {("10.1111/x", "w5", "relation"), ("10.1111/y", "w6", "relation"), ("10.1111/y", "w7", "draft versions")}


def test_joint_probits_equal_single_ones(spark):
    df = spark.range(4000).selectExpr("CAST(hash(id) % 100 < id % 7 * 9 - 20 AS INT) AS y", "id % 7 AS a", "IF(id % 11 = 0, null, id % 3) AS b", "id % 2 = 0 AS even")
    specs = [rg.Spec("1", "y", ["a"]), rg.Spec("2", "y", ["a", "b"]), rg.Spec("3", "y", ["a"], "even"), rg.Spec("4", "y", ["b"], "a = 99")]
    joint = rg.fit_probits(df, specs)
    alone = [rg.fit_probit(df.filter(s.where), s.y, s.xs, s.name) for s in specs]
    assert joint[3] is None and alone[3] is None
    for x, y in zip(joint[:3], alone[:3]):
        assert x.n == y.n and abs(x.beta - y.beta).max() < 1e-7 and abs(x.cov - y.cov).max() < 1e-7 and abs(x.pseudo_r2 - y.pseudo_r2) < 1e-9
