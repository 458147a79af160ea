"""Queries of the problems tagged llm, by the methods of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahini.functions.text import FILLERS
from vahini.llm import abuse, leakage, linkage, mixing, places, scans, survivors, variants
from vahini.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.same_firm_pairs(table(spark, sf_dir, "contractors"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contractors that stand under several names, with the least id of their group."""
    g = variants.groups(table(spark, sf_dir, "contractors"))
    return g.join(g.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n_names")), "root").select("id", "group_id", "n_names")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.map_places(table(spark, sf_dir, "tenders"), table(spark, sf_dir, "place_ref"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per entry of the reference list, unmatched rows under 0."""
    return p2_found(spark, sf_dir).groupBy("place_id").agg(F.count("*").alias("n_rows"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repairs(table(spark, sf_dir, "documents"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned papers as continuous paragraphs."""
    return scans.paragraphs(table(spark, sf_dir, "documents"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with score and confidence."""
    return linkage.link(*(table(spark, sf_dir, t) for t in ("mjp_projects", "tenders", "place_ref")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_links(spark, sf_dir).select("project_id", "row_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.tender_survivors(table(spark, sf_dir, "tenders"), table(spark, sf_dir, "portals"))


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors with the amounts as one bundle and the taluka besides, chosen so that taluka and district agree with the reference list."""
    return survivors.consistent_tenders(*(table(spark, sf_dir, t) for t in ("tenders", "portals", "place_ref")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found in the corpus with the number of documents and the largest share of an item in one of them."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share_found").alias("best_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mixing.actual_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))
    return shares.filter("short").select("plan_id", "source")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.actual_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).filter("abusive").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive documents per source."""
    return p10_scores(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("int")).alias("rate")
    )


QUERIES = {
    "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_unmatched": p2_unmatched, "p4_found": p4_found, "p4_paragraphs": p4_paragraphs, "p5_found": p5_found, "p5_links": p5_links, "p6_found": p6_found, "p6_consistent": p6_consistent,
    "p8_found": p8_found, "p8_leaked_items": p8_leaked_items, "p9_found": p9_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p10_scores": p10_scores, "p10_found": p10_found, "p10_rates": p10_rates,
}

_FILLERS = ", ".join("'" + f + "'" for f in FILLERS)
_KNOWN = "({0} IS NOT NULL AND lower(trim({0})) NOT IN (" + _FILLERS + "))"


def _best(field: str, present: str, order: str) -> str:
    return (
        f"SELECT group_id, '{field}' AS field, row_id FROM members WHERE {present} "
        f"QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {order}last_seen_at DESC NULLS LAST, row_id) = 1"
    )


_GROUPS = """WITH RECURSIVE t AS (SELECT DISTINCT ON (row_id) * FROM tenders),
    own AS (SELECT row_id, source_portal || chr(1) || source_tender_id AS key FROM t WHERE trim(source_portal) <> '' AND trim(source_tender_id) <> ''),
    named AS (SELECT row_id, unnest(list_transform(from_json(extra_source_ids, '["JSON"]'), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.portal') || chr(1) || json_extract_string(x, '$.id')
        ELSE regexp_replace(json_extract_string(x, '$'), '^([^:]*):', '\\1' || chr(1)) END)) AS key FROM t WHERE extra_source_ids IS NOT NULL),
    links AS (SELECT a.row_id AS a, b.row_id AS b FROM own a JOIN own b ON a.key = b.key UNION SELECT a.row_id, b.row_id FROM t a JOIN t b ON a.dedupe_hash = b.dedupe_hash WHERE trim(a.dedupe_hash) <> ''
        UNION SELECT a.row_id, b.row_id FROM named a JOIN own b ON a.key = b.key UNION SELECT b.row_id, a.row_id FROM named a JOIN own b ON a.key = b.key),
    reach AS (SELECT row_id AS node, row_id AS other FROM t UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
    groups AS (SELECT node AS row_id, min(other) AS group_id FROM reach GROUP BY 1 HAVING count(*) > 1),
    members AS (SELECT t.*, g.group_id, coalesce(p.trust_rank, 2147483647) AS trust FROM t JOIN groups g ON t.row_id = g.row_id LEFT JOIN portals p ON t.source_portal = p.source_portal) """

ORACLE_SQL: dict[str, str] = {
    # Sizes in bytes: which sources fall short is the same for every common measure of size.
    "p9_found": """WITH s AS (SELECT coalesce(lower(trim(source)), '') AS source, sum(strlen(text)) AS n FROM documents GROUP BY 1), p AS (SELECT DISTINCT ON (plan_id, source) * FROM mix_plan),
        w AS (SELECT plan_id, source, weight / sum(weight) OVER (PARTITION BY plan_id) AS share, max_repeats FROM p)
        SELECT w.plan_id, w.source FROM w LEFT JOIN s ON coalesce(lower(trim(w.source)), '') = s.source WHERE coalesce(s.n, 0) * w.max_repeats < w.share * (SELECT sum(n) FROM s)""",
    "p6_found": _GROUPS
    + " UNION ALL ".join(
        f"({q})"
        for q in (
            _best("description", _KNOWN.format("description"), "length(trim(description)) DESC, "),
            _best("estimated_value_inr", "estimated_value_inr <> 0", "trust, "),
            _best("emd_inr", "emd_inr <> 0", "trust, "),
            _best("bid_submission_end", _KNOWN.format("bid_submission_end"), ""),
            _best("status", _KNOWN.format("status"), ""),
            _best("district", _KNOWN.format("district"), ""),
        )
    ),
    "p6_consistent": _GROUPS
    + f""", money AS (SELECT group_id, row_id, coalesce(estimated_value_inr <> 0, false) AS e, coalesce(emd_inr <> 0, false) AS m FROM members WHERE e OR m
            QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY CAST(e AS INT) + CAST(m AS INT) DESC, trust, last_seen_at DESC NULLS LAST, row_id) = 1),
        ranked_a AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY last_seen_at DESC NULLS LAST, row_id) AS place FROM (SELECT group_id, row_id, last_seen_at, lower(trim(taluka)) AS v FROM members
            WHERE {_KNOWN.format("taluka")} QUALIFY row_number() OVER (PARTITION BY group_id, lower(trim(taluka)) ORDER BY last_seen_at DESC NULLS LAST, row_id) = 1)),
        ranked_b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY last_seen_at DESC NULLS LAST, row_id) AS place FROM (SELECT group_id, row_id, last_seen_at, lower(trim(district)) AS v FROM members
            WHERE {_KNOWN.format("district")} QUALIFY row_number() OVER (PARTITION BY group_id, lower(trim(district)) ORDER BY last_seen_at DESC NULLS LAST, row_id) = 1)),
        fits AS (SELECT DISTINCT lower(trim(taluka)) AS va, lower(trim(district)) AS vb FROM place_ref WHERE taluka IS NOT NULL),
        rows_of AS (SELECT group_id, count(*) + 1 AS worst FROM (SELECT group_id FROM ranked_a UNION ALL SELECT group_id FROM ranked_b) GROUP BY 1),
        a AS (SELECT group_id, row_id, v, place FROM ranked_a UNION ALL SELECT group_id, NULL, NULL, worst FROM rows_of),
        b AS (SELECT group_id, row_id, v, place FROM ranked_b UNION ALL SELECT group_id, NULL, NULL, worst FROM rows_of),
        chosen AS (SELECT a.group_id, a.row_id AS ra, b.row_id AS rb FROM a JOIN b ON a.group_id = b.group_id
            WHERE a.v IS NULL OR b.v IS NULL OR a.v NOT IN (SELECT va FROM fits) OR (a.v, b.v) IN (SELECT (va, vb) FROM fits)
            QUALIFY row_number() OVER (PARTITION BY a.group_id ORDER BY a.place + b.place, a.place) = 1) """
    + " UNION ALL ".join(
        f"({q})"
        for q in (
            _best("description", _KNOWN.format("description"), "length(trim(description)) DESC, "),
            _best("bid_submission_end", _KNOWN.format("bid_submission_end"), ""),
            _best("status", _KNOWN.format("status"), ""),
            "SELECT group_id, 'estimated_value_inr' AS field, row_id FROM money WHERE e",
            "SELECT group_id, 'emd_inr' AS field, row_id FROM money WHERE m",
            "SELECT group_id, 'taluka' AS field, ra AS row_id FROM chosen WHERE ra IS NOT NULL",
            "SELECT group_id, 'district' AS field, rb AS row_id FROM chosen WHERE rb IS NOT NULL",
        )
    ),
}
