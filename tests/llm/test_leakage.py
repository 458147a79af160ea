import random

from vahini.llm import leakage as L
from vahini.llm.words import words

ITEM = "When the annular gabion is rerouted by every oblique siphon, which plastic limit explains 1,475 fathoms of a fluted caisson and one dormant voussoir beside that turbid weir?"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_against_plain_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.choice("abcdef") for _ in range(rng.randrange(1, 90))] for _ in range(2)]
        assert L.common(L.bits(a), len(a), b) == plain_lcs(a, b)


def test_words():
    assert words(None) == [] and words(" .,- ") == []
    assert words("Rs. 3,83,92,892 and 1,475") == ["rs", "38392892", "and", "1475"] and words("ﬂuted cai​sson wa-\nter Ｗｅｉｒ") == ["fluted", "caisson", "water", "weir"]


def test_found(spark):
    item = words(ITEM)
    half = " ".join(item[: len(item) // 2])
    kept = " ".join(w for i, w in enumerate(item) if i % 6)
    docs = [
        (1, "Noise before. " + ITEM.upper() + " noise after"), (2, half), (3, kept), (4, " ".join(item[:10]) + " the officer inspected the site in between and left " + " ".join(item[10:])), (5, None), (6, ""), (7, "!!"),
        (8, ("filler words here " * 20_000) + ITEM), (9, " ".join(sorted(item))), (1, "again " + ITEM), (10, "word " * 30),
    ]
    d = spark.createDataFrame([(*x, 0, 1.0) for x in docs], "doc_id bigint, text string, item_id int, share_found double")
    items = spark.createDataFrame([(70, ITEM, 1), (71, None, 2), (72, "", 3), (None, "x y", 4), (73, "zyzzyva", 5)], "item_id bigint, text string, doc_id int")
    got = L.find_leaks(d, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 70), (3, 70), (4, 70), (8, 70)} and got.count() == 4
    assert L.find_leaks(d, items.limit(0)).count() == 0 and L.find_leaks(d.limit(0), items).count() == 0
    blocks = {(r.doc_id, r.item_id) for r in L.find_leaks(d, items, block=1).collect()}
    assert blocks == {(1, 70), (3, 70), (4, 70), (8, 70)}


def test_interruptions_of_any_length_and_added_words(spark):
    rng = random.Random(8)
    item = words(ITEM)
    filler = lambda n: [rng.choice(["the", "officer", "of", "site", "every", "inspected", "and", "for", "is", "by"]) for _ in range(n)]
    far = filler(300) + item[:9] + filler(600) + item[9:18] + filler(900) + item[18:] + filler(50)
    added = [x for w in item for x in ([w, "quite"] if rng.random() < 0.7 else [w])]
    docs = [(1, " ".join(far)), (2, " ".join(added)), (3, " ".join(filler(6_000))), (4, " ".join(filler(300) + item[:12] + filler(3_000)))]
    got = L.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(70, ITEM)], "item_id bigint, text string"))
    assert {r.doc_id for r in got.collect()} == {1, 2}


def test_against_all_pairs(spark, small):
    d, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/eval_items.parquet")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(d, items).collect()}
    texts = [(r.doc_id, words(r.text)) for r in d.select("doc_id", "text").collect()]
    want = set()
    for r in items.collect():
        w = words(r.text)
        m = L.bits(w)
        want |= {(i, r.item_id) for i, t in texts if L.best_window(m, len(w), t) >= L.SHARE * len(w)}
    assert got == want
