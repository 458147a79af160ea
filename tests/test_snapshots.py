import pandas as pd
from pyspark.sql import functions as F

from vahini.operators import snapshots as S
from vahini.queries.problems import p7_found


def brute(df):
    """The statement in plain Python."""
    from vahini.functions.text import squeeze  # noqa: F401

    norm = lambda x: None if x is None or not " ".join(x.split()) else " ".join(x.lower().split())
    best = {}
    for r in df:
        k = (r.snapshot_id, r.source_portal, r.source_tender_id.strip().upper() if r.source_tender_id is not None else None)
        if k not in best or (r.last_seen_at or 0) > (best[k].last_seen_at or 0):
            best[k] = r
    value = lambda r: (norm(r.title), norm(r.status), r.estimated_value_inr, r.us)
    out = set()
    snaps = sorted({k[0] for k in best})
    for s in range(snaps[0] + 1, snaps[-1] + 1):
        old, new = {k[1:] for k in best if k[0] == s - 1}, {k[1:] for k in best if k[0] == s}
        out |= {(s, *k, "added") for k in new - old} | {(s, *k, "removed") for k in old - new}
        out |= {(s, *k, "changed") for k in new & old if value(best[(s, *k)]) != value(best[(s - 1, *k)])}
    return out


def test_against_plain_python(spark, small):
    from vahini.functions.dates import instant_us

    raw = spark.read.parquet(f"{small}/tender_snapshots.parquet").withColumn("us", instant_us(F.col("bid_submission_end"))).withColumn("last_seen_at", F.unix_micros("last_seen_at"))
    assert {tuple(r) for r in p7_found(spark, small).collect()} == brute(raw.collect())


def changes(spark, rows):
    df = spark.createDataFrame(rows, "snap int, k string, late bigint, v string, bucket string, r string")
    return list(tuple(x) for x in S.snapshot_changes(df, "snap", {"k": F.col("k")}, F.col("late"), [F.col("v")]).collect())


def test_cases(spark):
    rows = [
        (1, "a", 1, "x", "", ""), (1, "b", 1, "x", "", ""), (1, None, 1, "x", "", ""), (1, "d", 2, "new", "", ""), (1, "d", 1, "old", "", ""),
        (2, "a", 1, None, "", ""), (2, "c", 1, "x", "", ""), (2, None, None, "x", "", ""), (2, "d", 1, "new", "", ""), (2, "d", 1, "new", "", ""),
        (None, "z", 1, "x", "", ""), (4, "a", 1, None, "", ""),
    ]
    assert set(changes(spark, rows)) == {(2, "a", "changed"), (2, "b", "removed"), (2, "c", "added"), (3, "a", "removed"), (3, "c", "removed"), (3, "d", "removed"), (3, None, "removed"), (4, "a", "added")}
    assert changes(spark, [(1, "a", 1, "x", "", "")]) == []


def test_empty(spark):
    df = spark.createDataFrame([], "snap int, k string, late bigint, v string")
    assert S.snapshot_changes(df, "snap", {"k": F.col("k")}, F.col("late"), [F.col("v")]).count() == 0


def test_equal_first_halves_of_hashes():
    import numpy as np

    within = np.array([(1, 1), (1, 5), (2, 0)], dtype=[("k", "i8"), ("r", "i8")])
    keys = np.array([(1, 5), (1, 2), (2, 0), (3, 0)], dtype=within.dtype)
    assert S._find(within, keys).tolist() == [1, -1, 2, -1]
    assert isinstance(S._diff(*(np.array([], dtype="i8"),) * 5, 1, 2), pd.DataFrame)
