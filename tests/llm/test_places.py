import pytest

from vahini.llm.places import Reference, map_places

REF = [
    (1, "Dhisololapur", None, "DHS", "Khevugawati", "धिसोलोलापूर"), (2, "Gilimundar", None, "GLM", None, "गिलिमुंदर"), (11, "Dhisololapur", "Bhipalachi", None, None, "भिपालाची"),
    (12, "Dhisololapur", "Homopumba", None, None, None), (13, "Gilimundar", "Homopumba", None, None, None), (14, "Gilimundar", "Teloroni", None, None, None), (15, "Dhisololapur", "Retebola", None, None, None),
]
CASES = [
    (("At Post Semesowadi Bk Tal Bhipalachi Dist. Khevugawati", None, None), 11), ((None, "Dhisololapur", None), 1), ((None, "Dhsiololapur", "Bhipalachee"), 11), (("Dt. DHS", None, None), 1),
    (("Tal. Homopumba", "GLM", None), 13), (("Tal. Homopumba", "धिसोलोलापूर", None), 12), (("Tq. Bhipalachi and Retebola", None, None), 1), (("Tal. Bhipalachi, Retebola - Dist Dhisololapur", None, "N.A."), 1),
    (("Village Bhipalachi Dist. Gilimundar", None, None), 2), (("NA", "-", "निरंक"), 0), (("Japachuru (other state)", "Japachuru", None), 0), (("Tal-Bhipal achi  dhisololapur", None, None), 11),
    (("ता. भिपालाची - जि. धिसोलोलापूर", None, None), 11), (("Bhipal.", "Dhiso.", None), 11), (("x" * 50_000, None, None), 0), (("", "  ", "Teloroni"), 14),
]


@pytest.mark.parametrize("fields,place", CASES)
def test_place(fields, place):
    assert Reference(REF).place(*fields) == place


def test_rows(spark):
    ref = spark.createDataFrame([(*r, 0) for r in REF], "place_id bigint, district string, taluka string, code string, former_name string, name_mr string, row_id int")
    schema = "row_id bigint, location_raw string, district string, taluka string, place_id string"
    rows = [(i, *f, "clash") for i, (f, _) in enumerate(CASES)] + [(0, *CASES[0][0], "clash"), (100, None, None, None, None), (101, " ", "", None, None)]
    got = {r.row_id: r.place_id for r in map_places(spark.createDataFrame(rows, schema), ref).collect()}
    assert got == {i: p for i, (_, p) in enumerate(CASES)}
    assert map_places(spark.createDataFrame([], schema), ref).count() == 0
    assert {r.place_id for r in map_places(spark.createDataFrame(rows, schema), ref.limit(0)).collect()} == {0}


def test_a_long_list_is_joined(spark, small):
    t, ref = spark.read.parquet(f"{small}/tenders.parquet"), spark.read.parquet(f"{small}/place_ref.parquet")
    sent = {tuple(r) for r in map_places(t, ref).collect()}
    joined = {tuple(r) for r in map_places(t, ref, most=5).collect()}
    assert sent == joined and len(sent) > 50


def test_weights_of_a_part_are_those_of_the_list(spark):
    from vahini.llm.places import _idf

    ref = Reference(REF)
    got = {r.place_id: (r.idf_t, r.idf_d) for r in _idf(spark.createDataFrame(REF, "place_id bigint, district string, taluka string, code string, former_name string, name_mr string")).collect()}
    part = Reference([r for r in REF if r[0] in (1, 2, 12, 13)], got)
    for (name, d), place in part.taluka_entry.items():
        whole = next(k for k, v in ref.taluka_entry.items() if v == place)
        assert abs(part.idf["t", name] - ref.idf["t", whole[0]]) < 1e-9 and abs(part.idf["d", d] - ref.idf["d", whole[1]]) < 1e-9
