import itertools
import random
from collections import Counter
from decimal import Decimal

import pytest

from vahini.llm import linkage as K
from vahini.llm.works import title_parts, village

TITLES = {
    "Augmentation of piped water scheme at Remumumala (Bk)": ("rmummla", "u", "water", 0), "Vilesutanda: Repairs to K.T. bandhara Ph-2": ("vilestnd", "", "weir", 2), "नुदोसेओवळा खुर्द पाझर तलाव दुरुस्ती": (None, "l", "tank", 0),
    "Sanction to WSS of Tokide (Phase I), Tal. Rumut": (None, "", "water", 1), "Desilting of S.W. drain stage 2, Johehugaon Kh": (None, "l", "storm", 2),
}


@pytest.mark.parametrize("title", TITLES)
def test_titles(title):
    got, want = title_parts(title), TITLES[title]
    assert got[1:] == want[1:] and len(got[0]) >= 3


VILLAGES = {
    "Augmentation of piped water scheme at Remumumala (Bk)": "Remumumala", "Vilesutanda: Repairs to K.T. bandhara Ph-2": "Vilesutanda", "नुदोसेओवळा खुर्द पाझर तलाव दुरुस्ती": "नुदोसेओवळा", "Sanction to WSS of Tokide (Phase I), Tal. Rumut": "Tokide",
    "Desilting of S.W. drain stage 2, Johehugaon Kh": "Johehugaon", "Balance works of water supply scheme, Hironivihir": "Hironivihir", "Improvement of WSS (Phase 2), Roraghepada": "Roraghepada", "Operation and repair of S.T.P., Sotodhubardi BK": "Sotodhubardi",
    "Construction of ESR and rising main for drinking water works, Tanisitanda, Tal. Rumut": "Tanisitanda", "Special repairs to samaj mandir, Jesimkund": "Jesimkund", "Improvement of link road at Hachokipimpal, Rumut": "Hachokipimpal", "Construction of bandhara, Chichurepur, (Kh)": "Chichurepur",
}


@pytest.mark.parametrize("title", VILLAGES)
def test_villages(title):
    assert title_parts(title)[0] == village(VILLAGES[title])


def test_no_parts():
    assert title_parts(None) is None and title_parts("  ") is None and title_parts("Supply of chairs") is None and title_parts("x" * 20_000) is None


def test_close_names_always_share_a_block_key():
    rng = random.Random(2)
    letters = "abdeghikmnoprstuv"

    def edited(n):
        k = rng.randrange(len(n))
        return rng.choice([n[:k] + rng.choice(letters) + n[k + 1 :], n[:k] + n[k + 1 :], n[:k] + rng.choice(letters) + n[k:]])

    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 14))) for _ in range(400)]
    apart = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(K.vector(x), K.vector(y)))
    for n in names:
        for other in (n, edited(n), edited(edited(n))):
            assert apart(n, other) <= K.RADIUS and K.block_keys(n) & K.block_keys(other)
    for x, y in itertools.combinations(names + [edited(n)[:6] for n in names], 2):
        if apart(x, y) <= K.RADIUS:
            assert K.block_keys(x) & K.block_keys(y)


def test_no_key_of_many_names():
    rng = random.Random(3)
    names = {"".join(rng.choice("bdghkmnprstv") + rng.choice(["", "e", "i", "o", "u"]) for _ in range(rng.randrange(3, 8))) for _ in range(2_000)}
    count = Counter(k for n in names for k in K.block_keys(n))
    assert max(count.values()) < 0.15 * len(names)


def test_links(spark):
    ref = [(1, "Dhisololapur", None, "DHS", None, None), (2, "Gilimundar", None, "GLM", None, None), (11, "Dhisololapur", "Bhipalachi", None, None, None)]
    places = spark.createDataFrame(ref, "place_id bigint, district string, taluka string, code string, former_name string, name_mr string")
    p_schema = "id string, title_original string, title_en string, municipality string, district string, mjp_office string, approved_cost_inr decimal(18,2), revised_cost_inr decimal(18,2), works_en array<string>, row_id int"
    project = ("p1", None, "Sanction to WSS of Tokidetanda KH (Phase I), Tal. Bhipalachi", "Tokidetanda Kh", "Dhisololapur", None, Decimal(1000), None, ["x"], 0)
    empty = ("p2", None, None, None, None, None, None, None, None, 0)
    projects = spark.createDataFrame([project, project, empty], p_schema)
    t_schema = "row_id bigint, title string, location_raw string, district string, taluka string, estimated_value_inr decimal(18,2), score double"
    title = "Repairs to pump house under water supply scheme at Tokidetanda Kh Ph-1"
    rows = [
        (1, title, None, "Dhisololapur", None, Decimal(950)), (2, title, None, "Gilimundar", None, Decimal(950)), (3, title, None, "DHS", None, Decimal(4000)), (4, title, None, None, None, None), (5, title.replace("Kh", "Bk"), None, "DHS", None, None),
        (6, title.replace("Ph-1", ""), None, "DHS", None, None), (7, title.replace("Tokidetanda", "Tokidteanda"), None, "DHS", None, Decimal(0)), (8, None, None, None, None, None), (9, "", "x" * 20_000, None, None, None), (1, title, None, "Dhisololapur", None, Decimal(950)),
    ]
    tenders = spark.createDataFrame([(*r, 0.0) for r in rows], t_schema)
    got = K.link(projects, tenders, places).collect()
    assert {(r.project_id, r.row_id) for r in got} == {("p1", 1), ("p1", 4), ("p1", 7)} and len(got) == 3 and all(0 <= r.confidence <= 1 for r in got)
    assert K.link(projects.limit(0), tenders, places).count() == 0 and K.link(projects, tenders.limit(0), places).count() == 0
