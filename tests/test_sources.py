import csv
import glob
import json

from pyspark.sql import functions as F

from vahini.sources import html, state

PAGE = """<html><table><tr><th>No</th><th>Bidder Name</th><th>Status</th><th>Value</th></tr><tr><td>1</td><td>Om <b>Traders</b></td><td>Admitted</td><td>5,00,000</td></tr>
<tr><td>2.</td><td>{}</td><td>x</td><td>1</td></tr></table><table><tr><td>Tender ID :</td><td>T1</td></tr><tr><td>Tender ID</td><td>T2</td></tr><tr><td>Title</td><td>Pipe &amp; pump <a href='/u/1.pdf'>file</a></td></tr></table></html>""".format("y" * 130)


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>no table"), (5, "<table><tr><td>unclosed")], "id int, html string")
    rows = df.select("id", html.table_rows("html").alias("r"), html.page_links("html").alias("l")).collect()
    assert rows[0].r[1] == ["1", "Om Traders", "Admitted", "5,00,000"] and [len(x.r) for x in rows] == [6, 0, 0, 0, 0] or rows[4].r == [["unclosed"]]
    assert [(x.text, x.href) for x in rows[0].l] == [("file", "/u/1.pdf")]
    assert [r.cells[1] for r in html.listing(df, "html", 4).collect()][0] == "Om Traders"
    parsed = df.filter("id = 1").select(html.table_rows("html").alias("rows"))
    first = parsed.select(html.captions(F.col("rows")).alias("m"), html.bidders(F.col("rows")).alias("b")).first()
    assert first.m["Tender ID"] == "T1" and first.m["Title"].startswith("Pipe & pump") and [(b.name, b.status, b.value) for b in first.b] == [("Om Traders", "Admitted", "5,00,000")]


def test_state(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"T1": {"title": "a", "closing": "c"}, "T2": {"title": None}}))
    (tmp_path / "bad.json").write_text("{not json")
    seen = state.keyed_records(spark, str(tmp_path / "s.json"), state.SEEN)
    assert {r.id: r.title for r in seen.collect()} == {"T1": "a", "T2": None}
    assert state.keyed_records(spark, str(tmp_path / "bad.json"), state.SEEN).count() == 0 and state.keyed_records(spark, str(tmp_path / "none.json"), state.SEEN).count() == 0
    assert {tuple(r) for r in state.overlay(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("a", 2)], "k string, v int"), "k").collect()} == {("a", 2), ("b", 1)}


def test_canonical(spark):
    s = "id string, title string, closing string, published string, org_chain string"
    live, seen = spark.createDataFrame([("1", "t1", None, None, "o")], s), spark.createDataFrame([("1", "old", "c1", "p1", None), ("2", "t2", None, None, None), ("3", " ", "c3", None, None)], s)
    details = spark.createDataFrame([("3", {"Title": "from page", "Location": "x"})], "id string, record map<string,string>")
    got = {r.id: (r.title, r.closing, r.status) for r in state.canonical_tenders(live, seen, details, spark.createDataFrame([("2",), ("9",)], "id string")).collect()}
    assert got == {"1": ("t1", "c1", "live"), "2": ("t2", None, "awarded"), "3": ("from page", "c3", "closed"), "9": (None, None, "awarded")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=cmd()", 'say "x"', 1), ("ok", None, -2)], "a string, b string, n int")
    state.write_csv(df, str(tmp_path / "out"))
    rows = [r for f in glob.glob(str(tmp_path / "out/*.csv")) for r in list(csv.reader(open(f)))[1:]]
    assert sorted(rows) == sorted([["'=cmd()", 'say "x"', "1"], ["ok", "", "-2"]])
    state.write_bundle({"t": df}, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b/t")).count() == 2


def test_nested_and_parts(spark):
    parent = spark.createDataFrame([("p",), ("q",)], "k string")
    feed = state.nested_feed(parent, {"docs": spark.createDataFrame([("p", 2, "b"), ("p", 1, "a")], "k string, d int, x string")}, "k", {"docs": "d"})
    assert {r.k: [x.d for x in r.docs] for r in feed.collect()} == {"p": [1, 2], "q": []}
    files = spark.createDataFrame([("e", i, s) for i, s in enumerate([10, 9, 5, 30, 1])], "e string, o int, s int")
    assert [r.part for r in state.parts_by_size(files, "e", "o", "s", 20).orderBy("o").collect()] == [1, 1, 2, 3, 4]
    assert files.select(F.count("*")).first()[0] == 5
