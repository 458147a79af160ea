"""Queries of the scalar functions and dataflow operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahini.functions import money, text
from vahini.functions.dates import code_date, portal_time
from vahini.operators import evidence, freshness, fuzzy, search, upsert
from vahini.queries import analytics as A
from vahini.queries.analytics import ONE, PROJECTS, TENDERS, counting, day_sql, one_per_tender, tenders
from vahini.session import table

QUERIES, ORACLE_SQL = {}, {}
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = counting(sql)
        return f

    return keep


@query(
    "f09_value_buckets",
    f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN estimated_value_inr > 0 THEN CAST(floor(ln(CAST(estimated_value_inr AS DOUBLE)) / ln(1.02)) AS BIGINT) END AS bucket FROM {TENDERS}) GROUP BY 1""",
)
def value_buckets(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).groupBy(money.value_bucket(F.col("estimated_value_inr")).alias("bucket")).agg(F.count("*").alias("n"))


@query("f10_portal_times", f"SELECT row_id, CAST({day_sql('publish_date')} AS TIMESTAMP) AS published, CAST({day_sql('bid_submission_end')} AS TIMESTAMP) AS ends FROM {TENDERS}")
def portal_times(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).select("row_id", portal_time(F.col("publish_date")).alias("published"), portal_time(F.col("bid_submission_end")).alias("ends"))


@query(
    "f12_code_dates",
    f"""SELECT id AS project_id, primary_doc_code, CAST(try_strptime(substr(primary_doc_code, 1, 8), '%Y%m%d') AS DATE) AS code_day FROM {PROJECTS}""",
)
def code_dates(spark: SparkSession, d: str) -> DataFrame:
    return A.projects(spark, d).select(F.col("id").alias("project_id"), "primary_doc_code", code_date(F.col("primary_doc_code")).alias("code_day"))


@query(
    "f24_word_sets",
    rf"""SELECT row_id, coalesce(len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^\pL\pM\pN]+', ' ', 'g')), ' '), lambda x: x <> ''))), -1) AS n_words FROM {TENDERS}""",
)
def word_sets(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).select("row_id", F.coalesce(F.size(text.word_set(F.col("title"))).cast("bigint"), F.lit(-1)).alias("n_words")).withColumn("n_words", F.when(F.col("n_words") < 0, -1).otherwise(F.col("n_words")).cast("bigint"))


RULES = [("(?i)(water|wss|w\\.s\\.|पाणी)", "water"), ("(?i)(sewer|ugd|s\\.?t\\.?p)", "sewerage"), ("(?i)(road|lanes|रस्ता)", "roads"), ("(?i)(school|anganwadi|शाळा)", "buildings")]


@query(
    "f28_rule_labels",
    f"""SELECT label, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for p, n in RULES)} ELSE 'other' END AS label FROM {TENDERS}) GROUP BY 1""",
)
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).groupBy(text.first_rule(F.col("title"), RULES, "other").alias("label")).agg(F.count("*").alias("n"))


@query(
    "f32_work_hashes",
    rf"""SELECT row_id, sha1(concat_ws('|', trim(regexp_replace(lower(coalesce(publishing_org, '')), '[^\pL\pM\pN]+', ' ', 'g')), coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^\pL\pM\pN]+', ' ', 'g')), ' '), lambda x: x <> ''))), ' '), ''), coalesce(strftime({day_sql('bid_submission_end')}, '%Y-%m-%d'), ''),
        coalesce(CAST(CASE WHEN estimated_value_inr > 0 THEN CAST(floor(ln(CAST(estimated_value_inr AS DOUBLE)) / ln(1.02)) AS BIGINT) END AS VARCHAR), ''))) AS work_hash FROM {TENDERS}""",
)
def work_hashes(spark: SparkSession, d: str) -> DataFrame:
    parts = (
        text.normal_org(F.coalesce("publishing_org", F.lit(""))), F.coalesce(F.array_join(text.word_set(F.col("title")), " "), F.lit("")), F.coalesce(F.date_format(portal_time(F.col("bid_submission_end")), "yyyy-MM-dd"), F.lit("")),
        F.coalesce(money.value_bucket(F.col("estimated_value_inr")).cast("string"), F.lit("")),
    )
    return tenders(spark, d).select("row_id", F.sha1(F.concat_ws("|", *parts)).alias("work_hash"))


@query("f33_url_keys", "SELECT DISTINCT substr(sha256(coalesce(nullif(url, ''), coalesce(doc_code, ''))), 1, 16) AS url_key FROM documents")
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce(F.nullif("url", F.lit("")), F.coalesce("doc_code", F.lit("")))
    return table(spark, d, "documents").select(F.substring(F.sha2(c, 256), 1, 16).alias("url_key")).distinct()


@query(
    "f34_org_hierarchy",
    f"""SELECT org_hierarchy.department AS department, org_hierarchy.agency AS agency, count(*) AS n, count(DISTINCT org_hierarchy.division) AS n_divisions FROM {ONE} GROUP BY 1, 2""",
)
def org_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "org_hierarchy"))
    return t.groupBy(F.col("org_hierarchy.department").alias("department"), F.col("org_hierarchy.agency").alias("agency")).agg(F.count("*").alias("n"), F.countDistinct("org_hierarchy.division").alias("n_divisions"))


def works(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "publishing_org", "title", "bid_submission_end", "estimated_value_inr", "status", "publish_date"))
    return t.select("id", text.normal_org(F.col("publishing_org")).alias("org"), "title", portal_time(F.col("bid_submission_end")).cast("date").alias("day"), F.col("estimated_value_inr").alias("value"), "status", "publish_date")


_WORKS = rf"""(SELECT id, trim(regexp_replace(lower(publishing_org), '[^\pL\pM\pN]+', ' ', 'g')) AS org, title, CAST({day_sql('bid_submission_end')} AS DATE) AS day, CAST({day_sql('publish_date')} AS DATE) AS published,
    estimated_value_inr AS value, status, list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^\pL\pM\pN]+', ' ', 'g')), ' '), lambda x: x <> '')) AS ws FROM {ONE})"""
_ALIKE = "(len(list_intersect(a.ws, b.ws)) = least(len(a.ws), len(b.ws)) OR round(200.0 * len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws)), 4) >= 90) AND least(len(a.ws), len(b.ws)) > 0"
_CLOSE = "((a.value IS NULL AND b.value IS NULL) OR (greatest(a.value, b.value) > 0 AND a.value IS NOT NULL AND b.value IS NOT NULL AND abs(a.value - b.value) <= greatest(a.value, b.value) * 0.02))"


@query(
    "j08_duplicate_pairs",
    f"""WITH w AS {_WORKS} SELECT a.id AS id_a, b.id AS id_b FROM w a JOIN w b ON a.org = b.org AND a.id < b.id WHERE {_CLOSE}
        AND ((a.day IS NULL AND b.day IS NULL) OR abs(date_diff('day', a.day, b.day)) <= 1) AND {_ALIKE}""",
)
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.duplicate_pairs(works(spark, d))


@query(
    "j09_retenders",
    f"""WITH w AS {_WORKS}, p AS (SELECT a.id, a.published AS pa, b.id AS bid, b.published AS pb FROM w a JOIN w b ON a.org = b.org AND a.id <> b.id WHERE a.status IN ('cancelled', 'retendered')
        AND date_diff('day', a.published, b.published) BETWEEN 0 AND 180 AND {_CLOSE} AND {_ALIKE}),
        f AS (SELECT id, pa, arg_min(bid, (pb, bid)) AS later_id FROM p GROUP BY 1, 2) SELECT arg_min(id, (pa, id)) AS id, later_id FROM f GROUP BY 2""",
)
def retenders(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d).withColumn("day", portal_time(F.col("publish_date")).cast("date"))
    return fuzzy.counterparts(w.filter(F.col("status").isin("cancelled", "retendered")), w)


@query(
    "k02_upsert_snapshots",
    """WITH o AS (SELECT DISTINCT ON (source_portal, source_tender_id) source_portal, source_tender_id, min(last_seen_at) OVER (PARTITION BY source_portal, source_tender_id) AS first_seen, last_seen_at FROM tender_snapshots WHERE snapshot_id < 6 ORDER BY source_portal, source_tender_id, last_seen_at DESC NULLS LAST),
        n AS (SELECT source_portal, source_tender_id, min(last_seen_at) AS first_seen, max(last_seen_at) AS last_seen_at FROM tender_snapshots WHERE snapshot_id = 6 GROUP BY 1, 2)
        SELECT coalesce(o.source_portal, n.source_portal) AS source_portal, coalesce(o.source_tender_id, n.source_tender_id) AS source_tender_id, coalesce(o.first_seen, n.first_seen) AS first_seen,
        CASE WHEN n.source_tender_id IS NOT NULL OR n.last_seen_at IS NOT NULL THEN n.last_seen_at ELSE o.last_seen_at END AS last_seen_at FROM o FULL JOIN n ON o.source_portal IS NOT DISTINCT FROM n.source_portal AND o.source_tender_id IS NOT DISTINCT FROM n.source_tender_id""",
)
def upsert_snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tender_snapshots")
    per = lambda k: s.filter(k).groupBy("source_portal", "source_tender_id").agg(F.min("last_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen_at"))
    return upsert.merge_upsert(per("snapshot_id < 6"), per("snapshot_id = 6"), ["source_portal", "source_tender_id"], keep_first=["first_seen"])


@query(
    "k05_new_keys",
    """SELECT DISTINCT source_portal, source_tender_id FROM tender_snapshots n WHERE snapshot_id = 6 AND NOT EXISTS (SELECT 1 FROM tender_snapshots o WHERE o.snapshot_id < 6 AND o.source_portal IS NOT DISTINCT FROM n.source_portal AND o.source_tender_id IS NOT DISTINCT FROM n.source_tender_id)""",
)
def new_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tender_snapshots").select("snapshot_id", "source_portal", "source_tender_id")
    keys = ["source_portal", "source_tender_id"]
    return upsert.new_rows(s.filter("snapshot_id < 6"), s.filter("snapshot_id = 6").select(*keys).distinct(), keys)


@query(
    "k06_event_append",
    "SELECT tender_id, event_type, min(id) AS event_id FROM tender_events WHERE event_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00' OR event_at IS NULL GROUP BY 1, 2 HAVING NOT EXISTS (SELECT 1 FROM tender_events o WHERE o.event_at < TIMESTAMPTZ '2026-06-01 00:00:00+00' AND o.tender_id IS NOT DISTINCT FROM tender_events.tender_id AND o.event_type IS NOT DISTINCT FROM tender_events.event_type)",
)
def event_append(spark: SparkSession, d: str) -> DataFrame:
    """The whole log in two deliveries, before and from June 2026 on: what the second adds."""
    e = table(spark, d, "tender_events").select("id", "tender_id", "event_type", "event_at")
    early = F.unix_micros("event_at") < 1_780_272_000_000_000
    batch = e.filter(~early | F.col("event_at").isNull()).groupBy("tender_id", "event_type").agg(F.min("id").alias("event_id"))
    return upsert.append_events(e.filter(early), batch, ["tender_id", "event_type"])


@query(
    "k07_alias_union",
    """SELECT match_key, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN json_valid(aliases) THEN CAST(from_json(aliases, '["VARCHAR"]') AS VARCHAR[]) ELSE [] END)))), ' | ') AS names, max(last_seen) AS last_seen FROM (SELECT DISTINCT ON (id) * FROM contractors) GROUP BY 1""",
)
def alias_union(spark: SparkSession, d: str) -> DataFrame:
    names = F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>"))
    return A.contractors(spark, d).select("match_key", "last_seen", F.explode_outer(names).alias("name")).groupBy("match_key").agg(
        F.array_join(F.array_sort(F.collect_set("name")), " | ").alias("names"), F.max("last_seen").alias("last_seen")
    )


@query("k11_safe_csv_cells", "SELECT doc_id, CASE WHEN regexp_matches(source, '^[=+\\-@\\t\\r]') THEN '''' || source ELSE source END AS source FROM documents")
def safe_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.safe_cell(F.col("source")).alias("source"))


_OPEN = r"[^\pL\pM\pN_]"
_SCORE = lambda w: rf"(CASE WHEN regexp_matches(title, '(^|{_OPEN}){w}({_OPEN}|$)') THEN 10 WHEN regexp_matches(title, '(^|{_OPEN}){w}') THEN 6 WHEN contains(title, '{w}') THEN 3 WHEN contains(body, '{w}') THEN 1 ELSE 0 END)"


@query(
    "d16_ranked_search",
    f"""WITH c AS (SELECT 'tender' AS kind, id, title AS shown, concat_ws(' ', publishing_org, description, district) AS body, estimated_value_inr AS amount FROM {ONE} UNION ALL SELECT 'award', CAST(id AS VARCHAR), contractor_name_raw, concat_ws(' ', work_order_no), award_value_inr FROM {A.AWARDS}
            UNION ALL SELECT 'contractor', id, canonical_name, concat_ws(' ', aliases, home_district), NULL FROM {A.CONTRACTORS} UNION ALL SELECT 'project', id, coalesce(title_en, title_original), concat_ws(' ', municipality, scheme), approved_cost_inr FROM {PROJECTS}),
        l AS (SELECT kind, id, shown, amount, lower(coalesce(shown, '')) AS title, lower(coalesce(body, '')) AS body FROM c WHERE amount >= 1000000),
        h AS (SELECT kind, id, shown, CAST({_SCORE('water')} + {_SCORE('scheme')} AS BIGINT) AS score FROM l WHERE {_SCORE('water')} > 0 AND {_SCORE('scheme')} > 0 ORDER BY score DESC, shown NULLS FIRST, kind, id LIMIT 80)
        SELECT kind, id, shown AS title, score, round(100.0 * score / greatest(max(score) OVER (), 1), 2) AS share_of_best FROM h""",
)
def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(A.corpus(spark, d), "water scheme above 10 lakh")


@query("d16_search_facets", ORACLE_SQL.get("x03_search_corpus") or A.ORACLE_SQL["x03_search_corpus"])
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(A.corpus(spark, d))


@query(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def tpch_q1(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("count_order")
    )


@query(
    "tpch_segment_revenue",
    """SELECT c_mktsegment, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def segment_revenue(spark: SparkSession, d: str) -> DataFrame:
    # Lines are summed per order before they meet the orders.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("n_orders"))
