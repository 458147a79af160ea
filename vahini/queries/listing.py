"""Queries of lists, watches, facets, merges and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vahini.functions import money, text
from vahini.functions.dates import portal_time
from vahini.operators import watch
from vahini.queries import analytics as A
from vahini.queries.analytics import AWARDS, CONTRACTORS, ONE, PROJECTS, TENDERS, counting, day_sql, one_per_tender, tenders
from vahini.session import cut, table

QUERIES, ORACLE_SQL = {}, {}
WATCHES = [("water", "(?i)(water|wss)"), ("roads", "(?i)road"), ("zilla", "(?i)zilla parishad")]

#: A name of more words has too many sets of words.
MOST_WORDS = 8


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = counting(sql)
        return f

    return keep


_HAY = "concat_ws(' ', title, publishing_org)"


@query(
    "l06_watch_tags",
    f"""SELECT row_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches({_HAY}, '{p}') THEN '{n}' END" for n, p in WATCHES)}], lambda x: x IS NOT NULL), ',') AS watches FROM {TENDERS}
        WHERE {' OR '.join(f"regexp_matches({_HAY}, '{p}')" for _, p in WATCHES)}""",
)
def watch_tags(spark: SparkSession, d: str) -> DataFrame:
    return watch.tag_watches(tenders(spark, d), F.concat_ws(" ", "title", "publishing_org"), WATCHES).select("row_id", F.array_join("watches", ",").alias("watches"))


@query("l05_keyword_hits", f"SELECT row_id FROM {TENDERS} WHERE contains(lower(coalesce(title, '')), 'bandhara') OR contains(lower(coalesce(title, '')), 'रस्ता')")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).filter(watch.any_keyword(F.col("title"), ["Bandhara", "रस्ता"])).select("row_id")


@query("l07_faceted_list", f"SELECT row_id, title FROM {TENDERS} WHERE lower(trim(status)) = 'live' AND lower(trim(source_portal)) = 'statebid' AND contains(lower(concat_ws(' ', title, publishing_org)), 'scheme')")
def faceted_list(spark: SparkSession, d: str) -> DataFrame:
    return watch.facet_filter(tenders(spark, d), {"status": "Live", "source_portal": "statebid", "district": ""}, "Scheme", ("title", "publishing_org")).select("row_id", "title")


@query(
    "l10_project_facets",
    f"SELECT id AS project_id, title_en FROM {PROJECTS} WHERE lower(trim(scheme)) = 'apna nal' AND contains(lower(concat_ws(' ', title_en, municipality)), 'a')",
)
def project_facets(spark: SparkSession, d: str) -> DataFrame:
    return watch.facet_filter(A.projects(spark, d), {"scheme": "Apna Nal"}, "a", ("title_en", "municipality")).select(F.col("id").alias("project_id"), "title_en")


@query(
    "l17_id_shapes",
    rf"""SELECT count(*) AS n, count_if(regexp_matches(source_tender_id, '^[A-Z]+_[0-9]{{4}}_[0-9]+_[0-9]+$')) AS n_ids, (SELECT count_if(regexp_matches(primary_doc_code, '^[0-9]{{6,25}}$')) FROM {PROJECTS}) AS n_codes FROM {TENDERS}""",
)
def id_shapes(spark: SparkSession, d: str) -> DataFrame:
    codes = A.projects(spark, d).agg(F.count_if(F.col("primary_doc_code").rlike(r"^[0-9]{6,25}$")).alias("n_codes"))  # one row
    return tenders(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("source_tender_id").rlike(r"^[A-Z]+_[0-9]{4}_[0-9]+_[0-9]+$")).alias("n_ids")).crossJoin(F.broadcast(codes))


@query("l18_allowed_urls", r"SELECT doc_id, coalesce(regexp_matches(url, '^https://([a-z0-9-]+\.)*(docs\.example|gr\.example|example)([/:?#]|$)'), false) AS allowed FROM documents")
def allowed_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", watch.url_on(F.col("url"), ("docs.example", "gr.example", "example")).alias("allowed"))


NOW = "2026-06-15 12:00:00"


@query(
    "l20_deadlines",
    f"""SELECT state, count(*) AS n FROM (SELECT CASE WHEN e < 0 THEN 'closed' WHEN e < 1 THEN 'urgent' WHEN e < 3 THEN 'soon' WHEN e IS NOT NULL THEN 'open' END AS state FROM (
        SELECT (epoch({day_sql('bid_submission_end')}) - epoch(TIMESTAMP '{NOW}')) / 86400.0 AS e FROM {ONE})) GROUP BY 1""",
)
def deadlines(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "bid_submission_end"))
    return t.groupBy(watch.deadline(portal_time(F.col("bid_submission_end")), F.lit(NOW).cast("timestamp_ntz")).alias("state")).agg(F.count("*").alias("n"))


@query(
    "l22_budgeted_details",
    f"""SELECT id, row_id FROM {ONE} t WHERE NOT EXISTS (SELECT 1 FROM awards a WHERE a.tender_id = t.id) ORDER BY coalesce(estimated_value_inr, -1) DESC, id LIMIT 150""",
)
def budgeted_details(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "awards").select(F.col("tender_id").alias("id"))
    return watch.budgeted(one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "estimated_value_inr")), done, "id", F.coalesce("estimated_value_inr", F.lit(-1)), 150).select("id", "row_id")


@query(
    "l23_new_rows",
    """SELECT DISTINCT source_portal, source_tender_id FROM tender_snapshots n WHERE snapshot_id = 6 AND source_tender_id IS NOT NULL AND source_portal IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM tender_snapshots o WHERE o.snapshot_id < 6 AND o.source_portal = n.source_portal AND o.source_tender_id = n.source_tender_id)""",
)
def new_rows(spark: SparkSession, d: str) -> DataFrame:
    keys = ["source_portal", "source_tender_id"]
    s = table(spark, d, "tender_snapshots").select("snapshot_id", *keys).dropna(subset=keys)
    return s.filter("snapshot_id = 6").select(*keys).join(s.filter("snapshot_id < 6").select(*keys), keys, "left_anti").distinct()


@query(
    "j13_live_merge",
    """WITH o AS (SELECT source_tender_id, max(status) AS status, list_sort(list(DISTINCT source_portal)) AS tags FROM tender_snapshots WHERE snapshot_id < 6 AND source_tender_id IS NOT NULL AND source_portal IS NOT NULL GROUP BY 1),
        f AS (SELECT source_tender_id, max(status) AS status, list_sort(list(DISTINCT source_portal)) AS tags FROM tender_snapshots WHERE snapshot_id = 6 AND source_tender_id IS NOT NULL AND source_portal IS NOT NULL GROUP BY 1)
        SELECT coalesce(o.source_tender_id, f.source_tender_id) AS source_tender_id, CASE WHEN f.source_tender_id IS NOT NULL THEN f.status ELSE o.status END AS status,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(o.tags, []), coalesce(f.tags, [])))), ',') AS tags FROM o FULL JOIN f ON o.source_tender_id = f.source_tender_id""",
)
def live_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tender_snapshots").dropna(subset=["source_portal", "source_tender_id"])
    per = lambda k: s.filter(k).groupBy("source_tender_id").agg(F.max("status").alias("status"), F.array_sort(F.collect_set("source_portal")).alias("tags"))
    return watch.merge_live(per("snapshot_id < 6"), per("snapshot_id = 6"), "source_tender_id", "tags").withColumn("tags", F.array_join("tags", ","))


@query(
    "j12_project_feed",
    f"""SELECT p.id AS project_id, array_to_string(list_sort(list_transform(list_filter(coalesce(p.documents, []), lambda x: x.doc_code IS NOT NULL), lambda x: x.doc_code)), ',') AS codes, count(t.n) AS n_links
        FROM {PROJECTS} p LEFT JOIN (SELECT DISTINCT doc_code AS n FROM documents WHERE doc_code IS NOT NULL) t ON list_contains(list_transform(coalesce(p.documents, []), lambda x: x.doc_code), t.n) GROUP BY 1, 2""",
)
def project_feed(spark: SparkSession, d: str) -> DataFrame:
    p = A.projects(spark, d).select(F.col("id").alias("project_id"), F.coalesce(F.transform("documents", lambda x: x["doc_code"]), F.array().cast("array<string>")).alias("codes"))
    known = table(spark, d, "documents").select(F.col("doc_code").alias("code")).dropna().distinct()
    hits = p.select("project_id", F.explode(F.array_distinct("codes")).alias("code")).join(known, "code").groupBy("project_id").agg(F.count("*").alias("n_links"))
    shown = F.array_join(F.array_sort(F.array_compact("codes")), ",").alias("codes")
    return p.join(hits, "project_id", "left").select("project_id", shown, F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query(
    "a19_profile_stats",
    f"""SELECT (SELECT count(*) FROM {CONTRACTORS}) AS n_contractors, (SELECT count_if(pan IS NOT NULL OR gstin IS NOT NULL) FROM {CONTRACTORS}) AS n_enriched, count(*) AS n_contracts, count(award_value_inr) AS n_known,
        CAST(coalesce(sum(award_value_inr), 0) AS DECIMAL(38,2)) AS total_inr, count(DISTINCT contractor_id) AS n_winners FROM {AWARDS}""",
)
def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    c = A.contractors(spark, d).agg(F.count("*").alias("n_contractors"), F.count_if(F.col("pan").isNotNull() | F.col("gstin").isNotNull()).alias("n_enriched"))  # one row
    v = F.col("award_value_inr")
    return A.awards(spark, d).agg(F.count("*").alias("n_contracts"), F.count(v).alias("n_known"), money.known_sum(v).alias("total_inr"), F.countDistinct("contractor_id").alias("n_winners")).crossJoin(F.broadcast(c))


@query(
    "a20_overview_tiles",
    f"""SELECT count_if(status = 'live') AS n_live, count_if(status = 'live' AND {day_sql('bid_submission_end')} BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 7 DAY) AS n_closing FROM {ONE}""",
)
def overview_tiles(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    ends = portal_time(F.col("bid_submission_end"))
    live = F.col("status") == "live"
    return one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "status", "bid_submission_end")).agg(F.count_if(live).alias("n_live"), F.count_if(live & ends.between(now, now + F.expr("INTERVAL 7 DAYS"))).alias("n_closing"))


@query(
    "a26_latest_approval",
    f"""SELECT id AS project_id, arg_max(x.doc_code, (x.issue_date, x.doc_code)) AS doc_code, max(x.issue_date) AS issue_date FROM (SELECT id, unnest(documents) AS x FROM {PROJECTS})
        WHERE x.doc_type IN ('administrative_approval', 'technical_sanction', 'revised_approval') AND x.issue_date IS NOT NULL AND x.doc_code IS NOT NULL GROUP BY 1""",
)
def latest_approval(spark: SparkSession, d: str) -> DataFrame:
    x = A.projects(spark, d).select("id", F.explode("documents").alias("x")).filter(F.col("x.doc_type").isin("administrative_approval", "technical_sanction", "revised_approval"))
    x = x.filter("x.issue_date IS NOT NULL AND x.doc_code IS NOT NULL")
    return x.groupBy(F.col("id").alias("project_id")).agg(F.max(F.struct("x.issue_date", "x.doc_code")).alias("m")).select("project_id", "m.doc_code", "m.issue_date")


@query(
    "o03_two_part_order",
    f"""SELECT contractor_id, total_inr, n FROM (SELECT contractor_id, CAST(coalesce(sum(award_value_inr), 0) AS DECIMAL(38,2)) AS total_inr, count(*) AS n FROM {AWARDS} GROUP BY 1) ORDER BY total_inr DESC, n DESC, contractor_id NULLS FIRST LIMIT 60""",
)
def two_part_order(spark: SparkSession, d: str) -> DataFrame:
    s = A.awards(spark, d).groupBy("contractor_id").agg(money.known_sum(F.col("award_value_inr")).alias("total_inr"), F.count("*").alias("n"))
    return s.orderBy(F.desc("total_inr"), F.desc("n"), F.col("contractor_id").asc_nulls_first()).limit(60)


@query(
    "w04_best_candidate",
    rf"""WITH c AS (SELECT id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(canonical_name), '[^\pL\pM\pN]+', ' ', 'g')), ' '), lambda x: x <> '')) AS ws FROM {CONTRACTORS} WHERE canonical_name IS NOT NULL),
        a AS (SELECT id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(contractor_name_raw), '[^\pL\pM\pN]+', ' ', 'g')), ' '), lambda x: x <> '')) AS ws FROM {AWARDS} WHERE contractor_name_raw IS NOT NULL),
        p AS (SELECT a.id AS award_id, c.id AS contractor_id, CASE WHEN len(list_intersect(a.ws, c.ws)) = least(len(a.ws), len(c.ws)) THEN 100.0 ELSE round(200.0 * len(list_intersect(a.ws, c.ws)) / (len(a.ws) + len(c.ws)), 4) END AS ratio
            FROM a JOIN c ON len(list_intersect(a.ws, c.ws)) > 0)
        SELECT award_id, arg_min(contractor_id, (-ratio, contractor_id)) AS contractor_id, CAST(max(ratio) AS DOUBLE) AS ratio FROM p GROUP BY 1""",
)
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The contractor whose name shares most words with an award's name.

    Names meet on sets of their words: of the contractors that have such a set, the one of the fewest words is best (any, if the
    set is the whole name), and the words that the best one shares are such a set. So a word of very many names has one row
    for a set, not one for every pair of names. Names of more than ``MOST_WORDS`` words meet word by word.
    """
    c = A.contractors(spark, d).filter("canonical_name IS NOT NULL").groupBy(text.word_set(F.col("canonical_name")).alias("cw")).agg(F.min("id").alias("contractor_id"))
    a = A.awards(spark, d).filter("contractor_name_raw IS NOT NULL").select(F.col("id").alias("award_id"), text.word_set(F.col("contractor_name_raw")).alias("aw"))
    forms = cut(a.select("aw").distinct().select("aw", F.monotonically_increasing_id().alias("form")))

    def ratio(both, x, y):
        return F.when(both == F.least(x, y), 100.0).otherwise(F.round(200.0 * both / (x + y), 4))

    nothing = F.array(F.struct(F.lit("").alias("s"), F.lit(0).alias("n")))
    more = lambda w: lambda x: F.struct(F.concat(x["s"], F.lit(" "), w).alias("s"), (x["n"] + 1).alias("n"))
    sets = lambda ws: F.explode(F.aggregate(ws, nothing, lambda acc, w: F.concat(acc, F.transform(acc, more(w))))).alias("x")
    few = lambda ws: F.size(ws) <= MOST_WORDS
    held = c.filter(few("cw")).select("contractor_id", F.size("cw").alias("m"), sets(F.col("cw"))).filter("x.n > 0").groupBy("x.s").agg(F.min(F.struct("m", "contractor_id")).alias("least"), F.min("contractor_id").alias("first"))
    met = forms.filter(few("aw")).select("form", F.size("aw").alias("k"), sets(F.col("aw"))).select("form", "k", "x.s", "x.n").join(held, "s")
    whole = F.col("n") == F.col("k")
    found = met.select("form", F.when(whole, 100.0).otherwise(ratio(F.col("n"), F.col("k"), F.col("least.m"))).alias("ratio"), F.when(whole, F.col("first")).otherwise(F.col("least.contractor_id")).alias("contractor_id"))
    for some, others in ((forms, c.filter(~few("cw"))), (forms.filter(~few("aw")), c.filter(few("cw")))):
        pairs = some.select("form", F.size("aw").alias("k"), F.explode("aw").alias("w")).join(others.select("contractor_id", F.size("cw").alias("m"), F.explode("cw").alias("w")), "w").groupBy("form", "k", "contractor_id", "m").agg(F.count("*").alias("both"))
        found = found.unionByName(pairs.select("form", ratio(F.col("both"), F.col("k"), F.col("m")).alias("ratio"), "contractor_id"))
    best = found.groupBy("form").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "contractor_id")).alias("m"))
    return a.join(forms.join(best, "form"), "aw").select("award_id", "m.contractor_id", (-F.col("m.r")).alias("ratio"))


@query("f37_codes_in_urls", r"SELECT doc_id, nullif(regexp_extract(coalesce(nullif(regexp_extract(url, '([0-9]{13,20})', 1), ''), doc_code), '([0-9]{13,20})', 1), '') AS code FROM documents")
def codes_in_urls(spark: SparkSession, d: str) -> DataFrame:
    first = F.nullif(F.regexp_extract("url", r"([0-9]{13,20})", 1), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.nullif(F.regexp_extract(F.coalesce(first, "doc_code"), r"([0-9]{13,20})", 1), F.lit("")).alias("code"))

