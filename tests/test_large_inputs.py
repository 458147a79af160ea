"""What findings on large inputs changed: the same rows, made without the step that didn't fit."""

import datetime
import random
from decimal import Decimal

import numpy as np
import pytest
from compare import rows_of, sql_rows

from vahini.operators import fuzzy, pairing, resolve
from vahini.queries import lifecycle, listing

PROJECT = "id string, municipality string, district string"
TENDER = "row_id long, title string, district string"


def tables(spark, path, **rows):
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def con_of(path):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in path.iterdir():
        con.execute(f"create view {p.name[:-8]} as select * from '{p}/*.parquet'")
    return con


def test_l14_pairs_come_once_and_are_not_shuffled(spark, tmp_path):
    projects = [("a", "Gram Rampur", "X"), ("b", "rampur", " x "), ("c", None, "y"), ("d", "--", None), ("e", "Rampur Bk", None), ("f", "Nowhere", "z"), ("a", "Gram Rampur", "X")]
    tenders = [(1, "Road at Gram Rampur", "x"), (2, "Rampur, Rampur water", "y"), (3, "Rampur Bk: rampur bk", None), (4, None, "X"), (5, "gram works", "q"), (1, "Road at Gram Rampur", "x")]
    d = tables(spark, tmp_path, mjp_projects=(PROJECT, projects), tenders=(TENDER, tenders))
    got = lifecycle.candidates(spark, d)
    assert rows_of(got) == sql_rows(con_of(tmp_path), lifecycle.ORACLE_SQL["l14_candidates"])
    assert got.count() == got.distinct().count()
    assert not any(x in line for line in got._jdf.queryExecution().executedPlan().toString().split("Union")[0].splitlines() for x in ("Aggregate", "Exchange"))


LINK_PROJECT = "id string, scheme string, municipality string, gr_number string, primary_doc_code string, works_en array<string>, district string, mjp_role string"
LINK_TENDER = "row_id long, title string, description string, publishing_org string, funding_scheme string, district string"
ODD_PROJECTS = [
    ("a", "Apna Nal", "Rampur", "PP-2022/C.R.19/W6", "2026000038410", ["Repairs to jack well", "Sewage treatment plant"], " X ", "mentioned"), ("b", "", "", "PP-1", "", None, "x", None),
    ("c", "Nal", "Road at Rampur, Tal. Y", None, "12", ["sewage treatment", None], "X", "tendering_authority"), ("d", None, None, None, None, [], None, "mentioned"),
    ("e", " apna  nal ", "RAMPUR", "AB/12345678901234567", "2026000038411", ["Sewage plant"], "y", "unknown"), ("f", "Own", "रामपूर", "P P 2 0 2 2 C", "99", ["works"], "lonely", None),
]
ODD_TENDERS = [
    (1, "Road at  rampur", "sewage treatment of jack", "Zilla Parishad X", "apna nal scheme", "x"), (2, None, None, None, None, "X"), (3, "", "GR PP 2022 CR 19 W6", "Water Board", "Nal", "x "),
    (4, "See 2026000038410 12", None, "Other", " ", "q"), (5, "2026 0000 38410", "plant", "ZILLA PARISHAD", "Apna Nal", "x"), (6, "रामपूर sewage plant", "12345678", "water", "APNA NAL", "Y"), (7, "Rampur", "AB123456789012", None, None, "y"), (8, "x", "y", "water", "own", None),
]


@pytest.fixture(scope="module")
def odd_links(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    return path, tables(spark, path, mjp_projects=(LINK_PROJECT, ODD_PROJECTS + ODD_PROJECTS[:1]), tenders=(LINK_TENDER, ODD_TENDERS + ODD_TENDERS[:1]))


@pytest.mark.parametrize("name", ["a27_link_counts", "d10_evidence_links", "o07_strongest_links", "d11_decided_links"])
@pytest.mark.parametrize("cells", [1, 8_000_000])
def test_links_of_odd_rows_in_slices_of_any_size(spark, odd_links, monkeypatch, name, cells):
    monkeypatch.setattr(pairing.in_slices, "__defaults__", (cells,))
    path, d = odd_links
    assert rows_of(lifecycle.QUERIES[name](spark, d)) == sql_rows(con_of(path), lifecycle.ORACLE_SQL[name])


def test_a27_and_the_others_see_links_and_not_all_pairs(spark, odd_links):
    assert lifecycle.evidence_links(spark, odd_links[1]).filter("link_status = 'none'").isEmpty()


def test_d11_links_do_not_meet_the_projects_again(spark, odd_links):
    plan = lifecycle.decided_links(spark, odd_links[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "FullOuter" not in plan


@pytest.fixture(scope="module")
def many_links(spark, tmp_path_factory):
    rng = random.Random(5)
    towns, works = ["Rampur", "Rampur Bk", "Sonai", "Devgad", None, ""], [["Sewage treatment plant"], ["Repairs to jack well", "Sewage treatment"], ["Jack well repairs"], None]
    project = lambda i: (f"p{i:03}", rng.choice(["Nal", "Own", None]), rng.choice(towns), rng.choice([None, "PP-2022/C.R.19/W6"]), f"20260000{i:05}", rng.choice(works), rng.choice(["x", "X ", "y", None]), rng.choice(["mentioned", "unknown", None]))
    said = lambda: " ".join(rng.choice(["sewage", "treatment", "plant", "jack well", "road", "PP 2022 CR 19 W6", f"20260000{rng.randrange(90):05}"]) for _ in range(rng.randrange(0, 4)))
    tender = lambda i: (i, rng.choice(["Road", "Works at ", "", None]) and f"Works at {rng.choice(towns)}", said(), rng.choice(["Zilla Parishad", "Other", None]), rng.choice(["nal", "own", None]), rng.choice(["x", "y", "q", None]))
    path = tmp_path_factory.mktemp("many")
    return path, tables(spark, path, mjp_projects=(LINK_PROJECT, [project(i) for i in range(90)]), tenders=(LINK_TENDER, [tender(i) for i in range(220)]))


@pytest.mark.parametrize("name", ["d10_evidence_links", "o07_strongest_links", "d11_decided_links"])
@pytest.mark.parametrize("cells", [300, 8_000_000])
def test_links_of_classes_with_single_pairs(spark, many_links, monkeypatch, name, cells):
    monkeypatch.setattr(pairing.in_slices, "__defaults__", (cells,))
    path, d = many_links
    assert rows_of(lifecycle.QUERIES[name](spark, d)) == sql_rows(con_of(path), lifecycle.ORACLE_SQL[name])
    lists = lifecycle.listed_links(spark, d)
    assert 0 < lists.filter("size(project_ids) > 1 AND size(row_ids) > 1").count() and lists.count() < lifecycle.evidence_links(spark, d).count()


def test_d10_alike_pairs_are_one_row(spark, tmp_path):
    projects = [(f"p{i}", "Nal", "Sonai", None, None, ["Sewage treatment"], "x", None) for i in range(40)]
    tenders = [(i, "Plant", "Sewage treatment", "Water Board", "Nal", "x" if i else "q") for i in range(51)]
    d = tables(spark, tmp_path, mjp_projects=(LINK_PROJECT, projects), tenders=(LINK_TENDER, tenders))
    (one,) = lifecycle.listed_links(spark, d).collect()
    assert (len(one.project_ids), len(one.row_ids)) == (40, 50)


def test_o07_spreads_the_first_lists_only(spark, many_links):
    path, d = many_links
    assert len(rows_of(lifecycle.evidence_links(spark, d))[1]) > 100
    plan = lifecycle.strongest_links(spark, d)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spread, limits = ([i for i, x in enumerate(plan) if y in x] for y in ("Generate explode(row_ids", "GlobalLimit 100"))
    assert len(spread) == 1 and limits[0] < spread[0] < limits[-1]


def test_d11_lists_are_decided_before_they_are_spread(spark, odd_links):
    plan = lifecycle.decided_links(spark, odd_links[1])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spread, decided = ([i for i, x in enumerate(plan) if y in x] for y in ("Generate explode(project_ids", "rejected"))
    assert len(spread) == 1 and spread[0] < min(decided)


def test_texts_in_texts():
    rng = random.Random(1)
    some = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))) for _ in range(60)] + [None, "aba" * 9]
    more = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, ""]
    got = pairing.holders(some, more)
    assert {*zip(*map(np.ndarray.tolist, got))} == {(i, j) for i, x in enumerate(some) for j, y in enumerate(more) if x is not None and y is not None and x in y}
    got = pairing.either_holds(some, more)
    assert {*zip(*map(np.ndarray.tolist, got))} == {(i, j) for i, x in enumerate(some) for j, y in enumerate(more) if x and y and (x in y or y in x)}


def test_d03_bounds_leave_the_best_name(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    some = [word() for _ in range(25)]
    name = lambda: sorted({"x", *(rng.choice(some) if rng.random() < 0.6 else word() for _ in range(rng.randrange(0, 5)))})
    firms = [name() for _ in range(300)] + [["x", "y" * 230], ["x", "ab" * 110]]
    ids = [f"f{i:03}" for i in rng.sample(range(900), len(firms))]
    known = resolve.Firms(ids, firms)
    for words in [name() for _ in range(150)] + [["x", "y" * 220, "z"], ["ab" * 108, "x"]]:
        worst = min((-resolve.ratio(words, f), i) for i, f in zip(ids, firms))
        assert known.best(words) == (-worst[0], worst[1])


def test_d03_works_out_few_ratios(monkeypatch):
    asked = []
    monkeypatch.setattr(resolve, "ratio", lambda a, b, own=resolve.ratio: asked.append(1) or own(a, b))
    firms = [sorted(["ram", f"{a}{b}ate", f"{b}{a}u"]) for a in ("ko", "la", "mi", "ne", "po", "ru") for b in ("shi", "tha", "vu", "dha", "ghe")]
    found = resolve.Firms([str(i) for i in range(len(firms))], firms)
    assert found.best(["koshiate", "koshu", "ram"])[0] > 70 and len(asked) < len(firms) / 2


WINNER, FIRM = "id long, contractor_name_raw string", "id string, canonical_name string"


def test_w04_names_meet_on_sets_of_words(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    name = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(0, most)))
    firms = [(f"c{i}", name(6)) for i in rng.sample(range(900), 120)] + [("long", " ".join(words)), ("none", None), ("dash", "--"), ("rare", "zz w1")]
    winners = [(i, name(7)) for i in range(120)] + [(900, " ".join(words[:10])), (901, None), (902, ""), (903, "ZZ"), (904, "nobody")]
    d = tables(spark, tmp_path, awards=(WINNER, winners), contractors=(FIRM, firms))
    assert rows_of(listing.best_candidate(spark, d)) == sql_rows(con_of(tmp_path), listing.ORACLE_SQL["w04_best_candidate"])
    monkeypatch.setattr(listing, "MOST_WORDS", 2)
    assert rows_of(listing.best_candidate(spark, d)) == sql_rows(con_of(tmp_path), listing.ORACLE_SQL["w04_best_candidate"])


def test_j09_values_meet_in_steps(spark):
    schema = "id string, org string, title string, day date, value decimal(18,2)"
    day = lambda n: datetime.date(2026, 1, 1) + datetime.timedelta(n)
    rng = random.Random(4)
    amounts = [None, 0, -5, 100, 98, "98.01", "97.99", 102, "0.02", "0.01", 10**12, 98 * 10**10]
    rows = [(f"t{i:03}", rng.choice(["o", "p", None]), rng.choice(["a b", "a b c", "B a", "", None]), rng.choice([None, *map(day, range(0, 400, 60))]), None if (v := rng.choice(amounts)) is None else Decimal(v)) for i in range(250)]
    first = rows[:80]
    got = fuzzy.counterparts(spark.createDataFrame(first, schema), spark.createDataFrame(rows, schema))

    def close(x, y):
        return x is None and y is None or x is not None and y is not None and max(x, y) > 0 and abs(x - y) <= max(x, y) * Decimal("0.02")

    def alike(x, y):
        x, y = set(x.lower().split()), set(y.lower().split())
        return bool(x and y) and (len(x & y) == min(len(x), len(y)) or 200 * len(x & y) / (len(x) + len(y)) >= 90)

    whole = lambda r: None not in r[1:4]
    best = {a[0]: (a[3], min(m)) for a in first if whole(a) and (m := [(b[3], b[0]) for b in rows if whole(b) and b[1] == a[1] and b[0] != a[0] and 0 <= (b[3] - a[3]).days <= 180 and close(a[4], b[4]) and alike(a[2], b[2])])}
    taken = {}
    for i, (at, (_, later)) in best.items():
        taken[later] = min(taken.get(later, (at, i)), (at, i))
    assert {(r.id, r.later_id) for r in got.collect()} == {(i, later) for later, (_, i) in taken.items()} and len(taken) > 5
    assert "vs" in got._jdf.queryExecution().optimizedPlan().toString()
