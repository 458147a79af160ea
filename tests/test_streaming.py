from datetime import datetime, timedelta

from vahini.operators.upsert import merge_upsert
from vahini.streaming import pipelines as P


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_once_and_replay(spark, tmp_path):
    at = datetime(2026, 1, 1)
    path, s = str(tmp_path / "in"), "k string, at timestamp"
    land(spark, path, [("a", at), ("a", at), ("b", at)], s)
    land(spark, path, [("a", at), ("c", at + timedelta(hours=1))], s)
    got = P.drain(P.once(P.read_stream(spark, path, 1), ["k"], "at"), "t")
    assert sorted(r.k for r in got.collect()) == ["a", "b", "c"]


def test_late_row_inside_the_window_is_linked(spark, tmp_path):
    at = datetime(2026, 1, 1)
    s = "k string, id string, at timestamp"
    land(spark, str(tmp_path / "a"), [("x", "o1", at), ("y", "o2", at)], s)
    land(spark, str(tmp_path / "b"), [("x", "n1", at + timedelta(days=100)), ("y", "n2", at + timedelta(days=200))], s)
    got = P.drain(P.later_counterparts(P.read_stream(spark, str(tmp_path / "a")), P.read_stream(spark, str(tmp_path / "b")), "k"), "j")
    assert [(r.id, r.later_id) for r in got.collect()] == [("o1", "n1")]


def test_upsert_sink_equals_batch(spark, tmp_path):
    path, s = str(tmp_path / "in"), "k string, first int, last int"
    land(spark, path, [("a", 1, 1), ("b", 2, 2)], s)
    land(spark, path, [("a", 5, 5), (None, 7, 7)], s)
    out = str(tmp_path / "out")
    P.upsert_sink(P.read_stream(spark, path, 1), out, ["k"], [], ["last"]).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.k, r.last) for r in P.latest(spark, out).collect()}
    touched = [len(P._folders(spark, f"{out}/{v}")) for v in P._folders(spark, out)]
    assert len(touched) == 2 and max(touched) <= 2 and P.latest(spark, str(tmp_path / "none")) is None
    whole = spark.read.parquet(path)
    assert got == {(r.k, r.last) for r in merge_upsert(whole.limit(0), whole, ["k"], order=["last"]).collect()} == {("a", 5), ("b", 2), (None, 7)}


def test_transitions_and_windows(spark, tmp_path):
    path, s = str(tmp_path / "in"), "k string, st string, at timestamp"
    at = datetime(2026, 1, 1)
    land(spark, path, [("a", "live", at), ("a", "live", at), ("a", None, at), (None, "x", at)], s)
    land(spark, path, [("a", "closed", at + timedelta(days=2))], s)
    got = P.drain(P.transitions(P.read_stream(spark, path, 1), "k", "st", "at"), "tr")
    assert {tuple(r) for r in got.collect()} in ({("a", None, "live"), ("a", "live", "closed")}, {("a", None, "closed"), ("a", "closed", "live")})
    assert sum(r.n for r in P.drain(P.windowed_counts(P.read_stream(spark, path), "at", ["st"]), "w", "complete").collect()) == 5
