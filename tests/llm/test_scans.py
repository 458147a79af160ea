from vahini.llm import scans

TEXT = [
    "Office of the Zilla Parishad Gilimundar (File 57)     Page 5", "The contractor shall provide the pipe-", "line before the monsoon at the pre5ence of the", "executive engineer in 20Zb under 1,23,4S6 rupees.", "Signature of tenderer",
    "Office of the Zilla Parishad Gilimundar (File 57)     Page 6", "Work was stopped for days owing to a multi-", "village agreement and the contraetor was told.", "Sr. No.   Quantity", "592", "854", "Signature of tenderer",
]


def documents(spark, extra=()):
    filler = "The contractor shall provide the pipeline and the presence of the contractor in a multi-village agreement is noted. " * 20
    rows = [(i, filler, None, "k") for i in range(3)]
    rows += [(10 + i, None, "\n".join(x.replace("57", str(i)) for x in TEXT), "k") for i in range(4)]
    return spark.createDataFrame([*rows, *extra], "doc_id bigint, text string, ocr_text string, kind string")


def test_repairs(spark):
    got = {tuple(r)[1:] for r in scans.repairs(documents(spark)).filter("doc_id = 10").collect()}
    furniture = {(n, "furniture", "") for n in (1, 5, 6, 12)}
    assert furniture <= got and {x for x in got if x[1] == "furniture"} == furniture
    assert {(2, "hyphen", "pipeline"), (7, "hyphen", "multi-village"), (3, "misread", "presence"), (4, "misread", "2026"), (4, "misread", "1,23,456"), (8, "misread", "contractor")} <= got


def test_edges(spark):
    extra = [(50, None, "", "k"), (51, None, "   \n ", "k"), (52, "x", None, "k"), (53, None, "word " * 50_000, "k"), (54, None, "-\n-\n", "k"), (10, None, "\n".join(x.replace("57", "0") for x in TEXT), "k")]
    got = scans.repairs(documents(spark, extra)).collect()
    assert len(got) == len({tuple(r) for r in got}) and not {r.doc_id for r in got} & {50, 51, 52, 53}
    assert scans.repairs(documents(spark).limit(0)).count() == 0


def test_numbers():
    assert [scans.number(w) for w in ("20Zb", "2026", "B1", "1,03,1SB", "abc", "5,55,1B3")] == ["2026", None, "81", "1,03,158", None, "5,55,183"]


def test_bare_page_numbers():
    head = "Zilla Parishad Gilimundar   NIT 16"
    lines = [head, "text runs on", "7", head, "Sr. No.   Quantity", "592", "854", "8"]
    sure = {0, 3}
    full = list(range(len(lines)))
    assert scans.bare_numbers(lines, full, sure) == {2, 7}


def test_many_shapes_are_joined(spark):
    every = {tuple(r) for r in scans.repairs(documents(spark)).collect()}
    assert {tuple(r) for r in scans.repairs(documents(spark), most_shapes=0).collect()} == every


def test_misread_shapes_against_all_pairs(spark):
    import random

    from vahini.llm.latin import osa

    rng = random.Random(1)
    sure = ["".join(rng.choice("A+ #.abc") for _ in range(rng.randrange(10, 30))) for _ in range(40)]

    def edited(s):
        k = rng.randrange(len(s) - 1)
        return rng.choice([s[:k] + s[k + 1] + s[k] + s[k + 2 :], s[:k] + s[k + 1 :], s[:k] + "x" + s[k:], s[:k] + "x" + s[k + 1 :]])

    others = {e for s in sure for e in (edited(s), edited(edited(s)), edited(edited(edited(s))))} - set(sure)
    frame = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "shape string")
    want = {x for x in others if len(x) >= 10 and any(len(s) >= 12 and osa(x, s, 2) <= 2 for s in sure)}
    assert {r.shape for r in scans._misread(frame(others), frame(set(sure))).collect()} == want and len(want) > 40


def test_paragraphs(spark):
    got = {r.paragraph: r for r in scans.paragraphs(documents(spark)).filter("doc_id = 10").collect()}
    text = " ".join(got[k].text for k in sorted(got))
    assert "shall provide the pipeline before the monsoon at the presence of the executive engineer in 2026 under 1,23,456 rupees." in text
    assert "owing to a multi-village agreement and the contractor was told." in text and "Signature" not in text and "Page" not in text and got[1].n_repairs >= 10
    made = [(2, "furniture", "", ""), (4, "hyphen", "pipeline", "pipeline")]
    assert scans.rebuilt("One line without\n- 1 -\n\n  end, a (pipe-\nline). Next.\n\nNew words.", made) == ["One line without end, a (pipeline). Next.", "New words."]
    assert scans.paragraphs(documents(spark).limit(0)).count() == 0
