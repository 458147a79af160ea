import random

from vahini.llm import abuse as A

CLEAN = ["The officer inspected site number {} today.", "Work was stopped for {} days owing to rain.", "The pump of {} horse power was lowered.", "Copies were sent to {} offices for record."]
BAD = ["You shameless dog, get lost or be beaten.", "Those people are vermin and must be driven out."]


def corpus(n, rng):
    rows = []
    for i in range(n):
        s = [rng.choice(CLEAN).format(rng.randrange(99)) for _ in range(6)]
        y = i % 4 == 0
        if y:
            s.insert(rng.randrange(7), rng.choice(BAD))
        rows.append((i, " ".join(s), int(y)))
    return rows


def test_disguises():
    assert A.sentences("You $H@M3LE$$ Dog!!! Next one.") == [["you", "shameles", "dog"], ["next", "one"]] and A.sentences(None) == [] and A.sentences(" . ") == []
    assert A.normal_word("scummmm") == A.normal_word("scum") and A.normal_word("b*****d") == "<masked>"
    assert all(len(s) <= 40 for s in A.sentences("word " * 5_000))


def test_features_of_many_sentences_are_those_of_each(monkeypatch):
    rng = random.Random(6)
    pieces = [[rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(30)]
    x, starts = A.features(pieces)
    for p, got in zip(pieces, [*zip(starts, [*starts[1:], len(x)])]):
        alone, at = A.features([p])
        assert x[got[0] : got[1]].tolist() == alone.tolist() and at.tolist() == [0]
    w = {int(k): rng.random() for k in set(x.tolist())}
    texts = [". ".join(" ".join(p) for p in pieces[a : a + 3]) for a in range(0, 30, 3)] + [None, ""]
    whole = A.score_texts(w, texts)
    monkeypatch.setattr(A, "CHUNK", 5)
    assert A.score_texts(w, texts).tolist() == whole.tolist() and whole[-1] == -9 and (whole[:-2] > 0).all()


def test_held_out():
    rows = corpus(400, random.Random(4))
    bags = [A.bag(t) for _, t, _ in rows]
    w, th = A.train(bags[:200], [y for _, _, y in rows[:200]])
    hit = (A.score_texts(w, [t for _, t, _ in rows[200:]]) > th) == [bool(y) for _, _, y in rows[200:]]
    assert sum(hit) >= 198 and 0 < len(w) < 20_000


def test_table(spark):
    rows = corpus(120, random.Random(5))
    docs = spark.createDataFrame([(i, t, "A" if i % 3 else " a ", 9.0) for i, t, _ in rows] + [(900, None, None, 0.0), (901, "", "b", 0.0), (902, "clean words " * 20_000, "b", 0.0)], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, "r", y) for i, _, y in rows[:60]] + [(3, "r2", 1), (0, "r2", None), (77_777, "r", 1)], "doc_id bigint, reviewer string, abusive int")
    got = {r.doc_id: r for r in A.score_documents(docs, labels).collect()}
    assert len(got) == 123 and not got[900].abusive and not got[901].abusive and not got[902].abusive and got[0].source == "a"
    assert sum(got[i].abusive == bool(y) for i, _, y in rows[60:]) >= 58
    assert not any(r.abusive for r in A.score_documents(docs, labels.limit(0)).collect())
    assert A.score_documents(docs.limit(0), labels).count() == 0
