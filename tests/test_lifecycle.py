import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vahini.functions import dates, extraction, money, text
from vahini.operators import fuzzy, ledger, resolve, upsert, watch
from vahini.operators.search import parse_query
from vahini.sources import html, state
from vahini.sources.registry import registry


def values(spark, rows, column, schema="v string"):
    return [r.x for r in spark.createDataFrame([(r,) for r in rows], schema).select(column.alias("x")).collect()]


def test_names(spark):
    v = F.col("v")
    typed = ["M/s. ABC Constructions Pvt. Ltd.", "ABC  Constructions", "Shri Ltd", "  ", None, "शिव कन्स्ट्रक्शन."]
    assert values(spark, typed, text.contractor_key(v)) == ["abc constructions", "abc constructions", "ltd", "", None, "शिव कन्स्ट्रक्शन"]
    assert values(spark, [" - Name,. ", None, "a–b"], text.display_name(v)) == ["Name", None, "a-b"]
    assert values(spark, ["a b", "", None], text.partial(v, F.lit("x A  B y"))) == [100, 0, 0]
    assert values(spark, ["Pump house at Rampur water", None, ""], text.distinctive(v, ("pump", "house", "water"))) == [["rampur"], [], []]
    assert values(spark, ["in East and West", "none", None], text.first_listed(v, ["West", "East"])) == ["West", None, None]
    assert values(spark, ["12 days", "no", None, "99999999999999"], text.first_int(v)) == [12, None, None, None]
    assert values(spark, ["पाणी", "water", None], text.script(v)) == ["mr", "en", "en"]


def test_title_blocks(spark):
    block = text.title_block(F.col("v"), r"\d{4}_\w+_\d+_\d+")
    got = values(spark, ["[Road [A] works] [No 5 [b]][2026_AB_1_2]", "[Only a title]", "[T][2026_X_3_1]", None, "x" * 20_000], block)
    assert [tuple(g) for g in got[:3]] == [("Road [A] works", "No 5 [b]", "2026_AB_1_2"), ("Only a title", "", ""), ("", "T", "2026_X_3_1")]
    assert got[3].title is None and got[4].title == "x" * 20_000


def test_captions(spark):
    df = spark.createDataFrame([({"Tender Value in Rs": "5", " Value ": "7", "Note": " "},), ({"Contract value": "9"},), ({},), (None,)], "m map<string,string>")
    assert [r.x for r in df.select(text.caption(F.col("m"), ["value", "note"]).alias("x")).collect()] == ["7", "9", None, None]


def test_amounts_and_days(spark):
    v = F.col("v")
    got = values(spark, ["Rs. 3,83,92,892 and रु. १०.५०, 24.9925 कोटी", "2 crore", "no", "", None], money.text_amounts(v))
    assert got[:4] == [[Decimal("38392892"), Decimal("10.5"), Decimal("249925000")], [Decimal("20000000")], [], []] and got[4] is None
    assert values(spark, [Decimal("10.500000"), Decimal("100.000000"), Decimal("0"), None], money.plain_text(v), "v decimal(28,6)") == ["10.5", "100", "0", None]
    assert values(spark, ["05-02-2026", "5/2/2026", "31-02-2026", "2026-02-05", None], dates.iso_day(v)) == ["2026-02-05", "2026-02-05", None, None, None]
    assert values(spark, ["1-Jan-1970", "x", None], dates.epoch_or_zero(v)) == [0, 0, 0]
    assert values(spark, [datetime(2026, 1, 31, 20, 0), None], dates.indian_label(v), "v timestamp") == ["01 Feb 2026, 01:30 IST", None]


def test_extraction(spark):
    paper = "Administrative approval is accorded by the Chief Engineer, Water Division to works (Construction of rising main and jack well) at Rs. 1,00,000. Parts: Rs. 60,000 and Rs. 20,000. G.R. No: WS-2026/C.R.5"
    docs = spark.createDataFrame([(1, paper), (2, ""), (3, None), (4, "Chief Engineer was told. " * 3_000)], "i int, body string")
    got = extraction.extract(docs, F.lit(None).cast("string"), F.col("body"), F.lit("https://x/2026000000370.pdf"), "Chief Engineer", [("approval", "approving", 0.9)])
    rows = {r.i: r.facts for r in got.collect()}
    one = rows[1]
    assert (one.kind, one.role, one.total_inr, one.n_parts, one.code) == ("administrative_approval", "approving", Decimal(100000), 2, "2026000000370")
    assert one.doubtful == ["parts differ from total"] and one.missing == [] and one.works == ["Construction of rising main and jack well"] and one.order_number == "WS-2026/C.R.5" and one.office == "Chief Engineer, Water Division"
    assert rows[2].missing == rows[3].missing == ["total", "role"] and rows[2].doubtful == ["no text layer"] and rows[4].role == "mentioned"


def plain_ratio(a, b):
    return resolve.ratio(sorted(set(a.split())), sorted(set(b.split())))


def test_resolution_against_plain_python(spark):
    rng = random.Random(3)
    words = ["ganesh", "ganeshh", "traders", "trader", "agro", "shiv", "shivam", "water", "works", "pumps", "nashik", "nasik"]
    firms = [(f"f{i}", " ".join(rng.sample(words, rng.randrange(1, 4)))) for i in range(30)]
    names = [(" ".join(rng.sample(words, rng.randrange(1, 4))),) for _ in range(40)] + [(None,), (" ",), (names_of := "zzz",)]
    got = {r.key: r for r in resolve.resolve(spark.createDataFrame(names, "key string"), spark.createDataFrame([*firms, ("f0", None)], "firm_id string, key string")).collect()}
    best_of = {}
    for i, k in firms:
        best_of[k] = min(i, best_of.get(k, i))
    for key in {n for n, in names if n and n.strip()}:
        if key in best_of:
            assert got[key].decision == "exact" and got[key].firm_id == best_of[key]
            continue
        scored = sorted((-plain_ratio(key, k), i) for k, i in best_of.items() if key.split()[0] in k.split())
        score = -scored[0][0] if scored else None
        want = "new" if score is None or score < 85 else "review" if score < 95 else "exact" if score == 100 else "merged"
        assert got[key].decision == want and got[key].firm_id == (scored[0][1] if scored else None)
    assert got[names_of].decision == "new" and None not in got and " " not in got
    assert resolve.ratio(["a", "b"], ["a", "b", "c"]) == 100 and resolve.ratio(["abc"], ["xyz"]) == 0


def test_ledger(spark):
    p = spark.createDataFrame([("a", 5, None), ("b", None, 7), ("c", None, None)], "id string, x int, y int")
    keys = ledger.event_keys(p, "id", {"first": F.col("x"), "second": F.col("y")})
    assert {r.event_key for r in keys.collect()} == {"first:a:5", "second:b:7"}
    assert [r.event_key for r in ledger.pending(keys.union(keys), keys.filter("kind = 'first'"), ["event_key"]).collect()] == ["second:b:7"]
    parts = spark.createDataFrame([("e", 1), ("e", 2), ("f", 1)], "event string, part int")
    assert {tuple(r) for r in ledger.completed(parts, parts.filter("part = 1"), "event", "part").collect()} == {("e", 2, 1, False), ("f", 1, 1, True)}
    assert ledger.completed(parts, parts.limit(0), "event", "part").filter("done").count() == 0
    assert ledger.mode(parts, False).select("how").distinct().collect()[0].how == "digest"


def test_merges(spark):
    rows = spark.createDataFrame([("t", 2, "late", "n2"), ("t", 1, " ", "n1"), ("t", 3, "x", None), ("u", 1, None, "")], "k string, i int, v string, name string")
    assert {tuple(map(str, r)) for r in upsert.merge_parses(rows, "k", "i", ["v"], "name").collect()} == {("t", "late", "['n1', 'n2']"), ("u", "None", "[]")}
    kept, error = upsert.keep_last_good(rows, lambda: spark.read.parquet("/tmp/there/is/none"), ["k"])
    assert kept is rows and error == "PATH_NOT_FOUND"
    old = spark.createDataFrame([("a", "x")], "k string, s string")
    assert {tuple(r) for r in upsert.with_previous(old, spark.createDataFrame([("a", "y"), ("b", "z")], "k string, s string"), ["k"], "s").collect()} == {("a", "y", "x"), ("b", "z", None)}


def test_lists(spark):
    assert [watch.limit(x, 9) for x in ("5", "-1", "x", None, 0, "7.5")] == [5, 9, 9, 9, 0, 9]
    df = spark.createDataFrame([(1, "b"), (2, "A"), (3, None), (4, "C")], "i int, t string")
    assert [r.i for r in watch.sorted_list(df, "t", False, "i", 3).collect()] == [2, 1, 4] and [r.i for r in watch.sorted_list(df, "i", True, "i", 2).collect()] == [4, 3]
    urls = ["https://a.docs.example/x.pdf", "http://docs.example/x.pdf", "https://evil.example/x.pdf", "https://docs.example/x.html", None]
    assert values(spark, urls, watch.reject_reason(F.col("v"), ("docs.example",), "pdf")) == ["accepted", "not https", "host", "no pdf", "no address"]


def test_units_of_a_query():
    assert parse_query("roads above 5 crore").least == 50_000_000 and parse_query("below 20 lakh").most == 2_000_000 and parse_query("over 3 k").least == 3_000 and parse_query("").terms == []


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_without_day_and_value_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = ["pipe", "works", "at", "village", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "tank"]
    rows = [(f"i{k:02}", "org", " ".join(rng.sample(words, rng.choice([2, 10, 11, 12, 13]))), None, None) for k in range(40)] + [("n", None, "pipe works", None, None), ("m", "org", None, None, None), ("e", "org", " ", None, None)]

    def alike(a, b):
        x, y = set(a.split()), set(b.split())
        return x and y and (len(x & y) == min(len(x), len(y)) or round(200 * len(x & y) / (len(x) + len(y)), 4) >= 90)

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and b[1] and a[2] and b[2] and alike(a[2], b[2])}
    got = fuzzy.duplicate_pairs(spark.createDataFrame(rows, "id string, org string, title string, day date, value decimal(18,2)")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_registry_and_files(spark, small):
    readers = registry(spark, small)
    assert readers["portals"]().count() == 5 and set(readers) >= {"tenders", "awards"}
    pages = spark.createDataFrame([("t", '<a href="/x/a.PDF">A</a><a href="/help">h</a><a href="b.zip">B</a>'), ("u", None), ("v", "")], "t string, page string")
    assert {(r.t, r.name, r.href) for r in html.file_links(pages, "page").collect()} == {("t", "A", "/x/a.PDF"), ("t", "B", "b.zip")}
    df = spark.createDataFrame([('=1+1', 'a"b', None)], "x string, y string, z int")
    assert df.select(state.csv_line("x", "y", "z").alias("l")).first().l == '"\'=1+1","a""b",""'
