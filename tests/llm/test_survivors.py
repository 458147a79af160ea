import json
import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from vahini.llm import survivors as S
from vahini.operators.graph import components


def groups_of(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5), (None, 1)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = groups_of([e for e in edges if None not in e], {x for e in edges for x in e if x is not None and None not in e})
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and set(got) == {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert components(df.limit(0)).count() == 0


def brute(rows, trust):
    rows = list({r["row_id"]: r for r in rows}.values())
    keys, pairs = {}, []
    for r in rows:
        if r["source_portal"] and r["source_tender_id"]:
            keys.setdefault((r["source_portal"], r["source_tender_id"]), []).append(r["row_id"])
        if r["dedupe_hash"]:
            keys.setdefault(r["dedupe_hash"], []).append(r["row_id"])
    for v in keys.values():
        pairs += [(v[0], x) for x in v]
    for r in rows:
        for x in json.loads(r["extra_source_ids"] or "[]"):
            k = tuple(x.split(":", 1)) if isinstance(x, str) else (x["portal"], x["id"])
            pairs += [(r["row_id"], keys[k][0])] if k in keys else []
    root = groups_of(pairs, {r["row_id"] for r in rows})
    members = {}
    for r in rows:
        members.setdefault(root[r["row_id"]], []).append(r)
    seen = lambda r: r["last_seen_at"] or datetime(1, 1, 1, tzinfo=UTC)
    fillers = {"", "-", "--", "na", "n.a.", "nil", "null", "tbd", "unknown", "not available", "not specified", "?", "to be announced", "निरंक", "other"}
    out = set()
    for g, ms in members.items():
        if len(ms) < 2:
            continue
        for f in ("description", "estimated_value_inr", "emd_inr", "bid_submission_end", "status", "district"):
            ok = [m for m in ms if m[f] is not None and (m[f] != 0 if f.endswith("inr") else m[f].strip().lower() not in fillers)]
            if not ok:
                continue
            rank = lambda m: (seen(m), -m["row_id"])
            if f == "description":
                rank = lambda m: (len(m["description"].strip()), seen(m), -m["row_id"])
            if f.endswith("inr"):
                rank = lambda m: (-trust.get(m["source_portal"], 10**9), seen(m), -m["row_id"])
            out.add((g, f, max(ok, key=rank)["row_id"]))
    return out


def test_against_plain_python(spark):
    d = "/root/testdata/sf0.01"
    t, p = spark.read.parquet(f"{d}/tenders.parquet"), spark.read.parquet(f"{d}/portals.parquet")
    rows = [{**r.asDict(), "last_seen_at": r.last_seen_at.replace(tzinfo=UTC) if r.last_seen_at else None} for r in t.drop("raw").collect()]
    assert {tuple(r) for r in S.tender_survivors(t, p).collect()} == brute(rows, {r.source_portal: r.trust_rank for r in p.collect()})


SCHEMA = (
    "row_id bigint, source_portal string, source_tender_id string, dedupe_hash string, extra_source_ids string, description string, estimated_value_inr decimal(18,2), emd_inr decimal(18,2), bid_submission_end string,"
    " status string, district string, taluka string, last_seen_at timestamp, group_id string, field string"
)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_edges(spark):
    at = datetime(2026, 1, 1)
    rows = [
        (1, "a", "x", None, "not json", None, None, None, None, None, None, None, None), (2, "a", "x", None, None, "y" * 30_000, 0, None, " ", "NA", "-", None, at), (3, None, None, None, '["a:x", "a:gone"]', "d", 5, None, None, "live", "D", None, at),
        (4, None, None, " ", "[]", None, None, None, None, None, None, None, at), (5, None, None, " ", None, None, None, None, None, None, None, None, at), (2, "a", "x", None, None, "y" * 30_000, 0, None, " ", "NA", "-", None, at),
        (6, "b", "z", None, '["q:gone"]', None, 1, None, None, None, None, None, at), (7, "c", "z", None, '["q:gone"]', None, 1, None, None, None, None, None, at),
    ]
    from decimal import Decimal

    rows = [tuple(Decimal(v) if i in (6, 7) and v is not None else v for i, v in enumerate(r)) for r in rows]
    portals = spark.createDataFrame([("a", 1)], "source_portal string, trust_rank int")
    got = {tuple(r) for r in S.tender_survivors(table(spark, rows), portals).collect()}
    assert got == {(1, "description", 2), (1, "estimated_value_inr", 3), (1, "status", 3), (1, "district", 3)}
    assert S.tender_survivors(table(spark, []), portals).count() == 0


def test_bundles_that_depend_on_each_other(spark):
    day = lambda n: datetime(2026, 1, n)
    base = lambda i, district, taluka, n: (i, "a", "x", None, None, None, None, None, None, None, district, taluka, day(n))
    rows = [base(1, "East", "Rivertown", 1), base(2, "West", None, 3), base(3, None, "Rivertown", 4), base(4, "West", "Hilltown", 2)]
    places = spark.createDataFrame([("Rivertown", "East"), ("Hilltown", "West")], "taluka string, district string")
    portals = spark.createDataFrame([("a", 1)], "source_portal string, trust_rank int")
    got = {(r.field, r.row_id) for r in S.consistent_tenders(table(spark, rows), portals, places).collect()}
    # The best district (row 2, West) and the best taluka (row 3, Rivertown) contradict each other; two choices cost the same.
    assert got in ({("district", 1), ("taluka", 3)}, {("district", 2), ("taluka", 4)})
    free = {(r.field, r.row_id) for r in S.tender_survivors(table(spark, rows), portals).collect()}
    assert free == {("district", 2)}


def test_a_bundle_survives_whole(spark):
    from decimal import Decimal as D

    day = lambda n: datetime(2026, 1, n)
    rows = [(1, "a", "x", None, None, None, D(10), None, None, None, None, None, day(9)), (2, "b", "x", None, None, None, D(20), D(1), None, None, None, None, day(1)), (3, "a", "y", None, None, None, None, D(5), None, None, None, None, day(1)), (4, "a", "y", None, None, None, D(0), D(0), None, None, None, None, day(2))]
    rows = [(i, "p", t, h, e, d, v, m, b, s, di, ta, n) for i, _, t, h, e, d, v, m, b, s, di, ta, n in rows]
    places = spark.createDataFrame([], "taluka string, district string")
    portals = spark.createDataFrame([("p", 1)], "source_portal string, trust_rank int")
    got = {(r.group_id, r.field, r.row_id) for r in S.consistent_tenders(table(spark, rows), portals, places).collect()}
    assert got == {(1, "estimated_value_inr", 2), (1, "emd_inr", 2), (3, "emd_inr", 3)}


def test_branch_and_bound_is_the_best_of_all(spark):
    rng = random.Random(9)
    rows, names = [], ["t0", "t1", "t2"]
    known = {("t0", "d0"), ("t1", "d1"), ("t2", "d2")}
    for g in range(25):
        for k in range(4):
            rows.append((g * 10 + k, f"p{g}", "x", None, None, None, None, None, None, None, f"d{rng.randrange(3)}", rng.choice(names), datetime(2026, 1, 1 + rng.randrange(20))))
    places = spark.createDataFrame(sorted(known), "taluka string, district string")
    portals = spark.createDataFrame([("a", 1)], "source_portal string, trust_rank int")
    got = {}
    for r in S.consistent_tenders(table(spark, rows), portals, places).collect():
        got.setdefault(r.group_id, {})[r.field] = r.row_id
    by = {r[0]: r for r in rows}
    for g, c in got.items():
        if "district" in c and "taluka" in c:
            assert (by[c["taluka"]][11], by[c["district"]][10]) in known
