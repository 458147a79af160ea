import numpy as np
from pyspark.sql import functions as F

from vahini.llm import mixing as M


def tables(spark):
    docs = [(i, f"word {i} " * 20, " Big " if i % 2 else "big") for i in range(200)] + [(1000 + i, "small text here", "small") for i in range(10)] + [(2000, None, "small"), (2001, "", None), (2002, "a b c", "outside")]
    plan = [(1, "big", 1.0, 1), (1, "small", 1.0, 3), (1, "gone", 0.5, 2), (1, "big", 1.0, 1), (2, "big", None, None), (2, "small", 2.0, 1000)]
    return spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, source string, block int"), spark.createDataFrame(plan, "plan_id int, source string, weight double, max_repeats int")


def test_counts_match_the_tokenizer_and_parts_do_not_change_them(monkeypatch):
    count = M._counter(M.TOKENIZER)
    text = "The chief officer shall ensure that पाणीपुरवठा work is issued. " * 40
    whole = count(text)
    glued = "abc123.-पाणी!!x9" * 60
    other = [count(glued), count("x" * 500), count("a  b\n\n  c " * 80)]
    monkeypatch.setattr(M, "PART", 100)
    assert count(text) == whole and [count(glued), count("x" * 500), count("a  b\n\n  c " * 80)] == other


def test_split_tree_is_exact():
    rng = np.random.default_rng(1)
    quotas = np.array([1000, 37, 0, 512])
    parts = M.split_tree(quotas, 7, rng)
    assert parts.shape == (7, 4) and (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
    assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 7


def test_mixture(spark):
    docs, plan = tables(spark)
    m = M.mixture(docs, plan, shards=4).cache()
    assert m.count() == m.dropDuplicates(["plan_id", "doc_id", "repeat_no"]).count()
    assert m.filter("plan_id = 1").agg(F.max("repeat_no")).first()[0] <= 2
    small = m.filter("plan_id = 1 AND source = 'small' AND n_tokens > 0")
    assert small.count() == 30  # three times all: short of half
    assert m.filter("source = 'gone'").count() == 0 and m.select("shard").distinct().count() == 4
    again = M.mixture(docs, plan, shards=4)
    assert {tuple(r) for r in m.collect()} == {tuple(r) for r in again.collect()}


def test_shares_and_short_sources(spark):
    docs, plan = tables(spark)
    got = {(r.plan_id, r.source): r for r in M.actual_shares(docs, plan).collect()}
    assert {k for k, r in got.items() if r.short} == {(1, "small"), (1, "gone")}
    big = got[(1, "big")]
    assert abs(big.mixed_tokens - big.wanted) / big.wanted < 0.05 and len(got) == 5
    assert M.actual_shares(docs.limit(0), plan).filter("n_rows > 0").count() == 0 and M.mixture(docs, plan.limit(0)).count() == 0
