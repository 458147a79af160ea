"""Analytical queries over the procurement tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vahini.functions.dates import portal_time
from vahini.functions.money import known_sum
from vahini.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TENDERS = "(SELECT DISTINCT ON (row_id) * FROM tenders)"
AWARDS = "(SELECT DISTINCT ON (id) * FROM awards)"
CONTRACTORS = "(SELECT DISTINCT ON (id) * FROM contractors)"
PROJECTS = "(SELECT DISTINCT ON (id) * FROM mjp_projects)"


def day_sql(c: str) -> str:
    formats = ("%d-%b-%Y %I:%M %p", "%d-%b-%Y %H:%M", "%d-%b-%Y", "%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d")
    return "COALESCE(" + ", ".join(f"try_strptime(trim({c}), '{f}')" for f in formats) + ")"


def counting(sql: str) -> str:
    """``count_if(x)`` as ``count(*) FILTER (WHERE x)``, which is a bigint in DuckDB too."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if('):end - 1]}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = counting(sql)
        return f

    return keep


def tenders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tenders").dropDuplicates(["row_id"])


def awards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "awards").dropDuplicates(["id"])


def contractors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contractors").dropDuplicates(["id"])


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mjp_projects").dropDuplicates(["id"])


def one_per_tender(t: DataFrame) -> DataFrame:
    """The latest row of each tender id, the smallest row_id on ties (what a keyed upsert leaves)."""
    rest = [c for c in t.columns if c != "id"]
    return t.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("last_seen_at", -F.col("row_id"))).alias("r")).select("id", "r.*")


# The same in SQL.
ONE = f"(SELECT * FROM {TENDERS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen_at DESC NULLS LAST, row_id) = 1)"


@query(
    "a02_top_contractors",
    f"""SELECT contractor_id, canonical_name, count(*) AS n_contracts, count(award_value_inr) AS n_known,
        CAST(coalesce(sum(award_value_inr), 0) AS DECIMAL(38,2)) AS total_inr
        FROM {AWARDS} a JOIN {CONTRACTORS} c ON a.contractor_id = c.id GROUP BY 1, 2 ORDER BY total_inr DESC, contractor_id LIMIT 25""",
)
def top_contractors(spark: SparkSession, d: str) -> DataFrame:
    # Aggregated before the join, so that a contractor with a third of all awards is one row when it meets its name.
    sums = awards(spark, d).groupBy("contractor_id").agg(F.count("*").alias("n_contracts"), F.count("award_value_inr").alias("n_known"), known_sum(F.col("award_value_inr")).alias("total_inr"))
    names = contractors(spark, d).select(F.col("id").alias("contractor_id"), "canonical_name")
    return sums.join(names, "contractor_id").select("contractor_id", "canonical_name", "n_contracts", "n_known", "total_inr").orderBy(F.desc("total_inr"), "contractor_id").limit(25)


@query(
    "a03_floated_value_by_org_month",
    f"""SELECT coalesce(publishing_org, '') AS org, strftime({day_sql('publish_date')}, '%Y-%m') AS month, count(*) AS n_tenders,
        count(estimated_value_inr) AS n_known, CAST(coalesce(sum(estimated_value_inr), 0) AS DECIMAL(38,2)) AS total_inr
        FROM {ONE} WHERE status <> 'retendered' OR status IS NULL GROUP BY 1, 2""",
)
def floated_value(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "status", "publishing_org", "publish_date", "estimated_value_inr")).filter("status <> 'retendered' OR status IS NULL")
    return t.groupBy(F.coalesce("publishing_org", F.lit("")).alias("org"), F.date_format(portal_time(F.col("publish_date")), "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_tenders"), F.count("estimated_value_inr").alias("n_known"), known_sum(F.col("estimated_value_inr")).alias("total_inr")
    )


@query(
    "a06_award_ratio",
    f"""SELECT a.id AS award_id, a.tender_id, CAST(a.award_value_inr AS DOUBLE) AS award_inr, CAST(t.estimated_value_inr AS DOUBLE) AS estimate_inr,
        round(CAST(a.award_value_inr AS DOUBLE) / CAST(t.estimated_value_inr AS DOUBLE), 4) AS ratio
        FROM {AWARDS} a JOIN {ONE} t ON a.tender_id = t.id WHERE t.estimated_value_inr > 0 AND a.award_value_inr IS NOT NULL""",
)
def award_ratio(spark: SparkSession, d: str) -> DataFrame:
    a = awards(spark, d).filter("award_value_inr IS NOT NULL").select(F.col("id").alias("award_id"), "tender_id", F.col("award_value_inr").cast("double").alias("award_inr"))
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "estimated_value_inr")).filter("estimated_value_inr > 0")
    t = t.select(F.col("id").alias("tender_id"), F.col("estimated_value_inr").cast("double").alias("estimate_inr"))
    return a.join(t, "tender_id").select("award_id", "tender_id", "award_inr", "estimate_inr", F.round(F.col("award_inr") / F.col("estimate_inr"), 4).alias("ratio"))


@query(
    "a07_bidding_summary",
    f"""SELECT count(*) AS n_awards, count_if(bidder_coverage = 'full') AS n_full, count_if(bidder_coverage = 'winner_only') AS n_winner_only,
        count_if(bidder_coverage = 'full' AND bidder_count = 1) AS n_single,
        round(CAST(count_if(bidder_coverage = 'full' AND bidder_count = 1) AS DOUBLE) / nullif(count_if(bidder_coverage = 'full'), 0), 4) AS single_rate FROM {AWARDS}""",
)
def bidding_summary(spark: SparkSession, d: str) -> DataFrame:
    full, single = F.col("bidder_coverage") == "full", (F.col("bidder_coverage") == "full") & (F.col("bidder_count") == 1)
    return awards(spark, d).agg(
        F.count("*").alias("n_awards"), F.count_if(full).alias("n_full"), F.count_if(F.col("bidder_coverage") == "winner_only").alias("n_winner_only"),
        F.count_if(single).alias("n_single"), F.round(F.try_divide(F.count_if(single).cast("double"), F.count_if(full)), 4).alias("single_rate"),
    )


@query(
    "a08_single_bidder_by_org",
    f"""SELECT t.publishing_org AS org, count(*) AS n_full, count_if(a.bidder_count = 1) AS n_single, round(avg(a.bidder_count), 4) AS avg_bidders
        FROM {AWARDS} a JOIN {ONE} t ON a.tender_id = t.id WHERE a.bidder_coverage = 'full' GROUP BY 1""",
)
def single_bidder(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "publishing_org")).select(F.col("id").alias("tender_id"), F.col("publishing_org").alias("org"))
    full = awards(spark, d).filter("bidder_coverage = 'full'").select("tender_id", "bidder_count")
    return full.join(t, "tender_id").groupBy("org").agg(F.count("*").alias("n_full"), F.count_if(F.col("bidder_count") == 1).alias("n_single"), F.round(F.avg("bidder_count"), 4).alias("avg_bidders"))


@query(
    "a10_award_coverage",
    f"""SELECT publishing_org AS org, CAST(year({day_sql('bid_submission_end')}) AS INT) AS year, count(*) AS n_closed, count(w.tender_id) AS n_awarded,
        round(CAST(count(w.tender_id) AS DOUBLE) / count(*), 3) AS coverage FROM {ONE} t
        LEFT JOIN (SELECT DISTINCT tender_id FROM {AWARDS} WHERE tender_id IS NOT NULL) w ON t.id = w.tender_id
        WHERE t.status <> 'live' AND {day_sql('bid_submission_end')} IS NOT NULL GROUP BY 1, 2""",
)
def award_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "publishing_org", "status", "bid_submission_end")).filter("status <> 'live'")
    t = t.withColumn("year", F.year(portal_time(F.col("bid_submission_end")))).filter("year IS NOT NULL")
    won = awards(spark, d).select(F.col("tender_id").alias("won")).dropna().distinct()
    return t.join(won, F.col("id") == F.col("won"), "left").groupBy(F.col("publishing_org").alias("org"), "year").agg(
        F.count("*").alias("n_closed"), F.count("won").alias("n_awarded"), F.round(F.count("won").cast("double") / F.count("*"), 3).alias("coverage")
    )


@query(
    "a11_retender_rate",
    f"""SELECT publishing_org AS org, count(*) AS n_tenders, count(retender_of) AS n_retenders, round(CAST(count(retender_of) AS DOUBLE) / count(*), 4) AS rate FROM {ONE} GROUP BY 1""",
)
def retender_rate(spark: SparkSession, d: str) -> DataFrame:
    return one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "publishing_org", "retender_of")).groupBy(F.col("publishing_org").alias("org")).agg(
        F.count("*").alias("n_tenders"), F.count("retender_of").alias("n_retenders"), F.round(F.count("retender_of").cast("double") / F.count("*"), 4).alias("rate")
    )


@query(
    "a12_time_to_award",
    f"""SELECT t.publishing_org AS org, count(*) AS n, round(avg(date_diff('day', CAST({day_sql('t.bid_submission_end')} AS DATE), CAST({day_sql('a.award_date')} AS DATE))), 1) AS avg_days
        FROM {AWARDS} a JOIN {ONE} t ON a.tender_id = t.id WHERE {day_sql('t.bid_submission_end')} IS NOT NULL AND {day_sql('a.award_date')} IS NOT NULL GROUP BY 1""",
)
def time_to_award(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "publishing_org", "bid_submission_end"))
    t = t.select(F.col("id").alias("tender_id"), F.col("publishing_org").alias("org"), portal_time(F.col("bid_submission_end")).alias("closed")).filter("closed IS NOT NULL")
    a = awards(spark, d).select("tender_id", portal_time(F.col("award_date")).alias("awarded")).filter("awarded IS NOT NULL")
    days = F.datediff(F.col("awarded").cast("date"), F.col("closed").cast("date"))
    return a.join(t, "tender_id").groupBy("org").agg(F.count("*").alias("n"), F.round(F.avg(days), 1).alias("avg_days"))


@query(
    "a13_by_district",
    f"""SELECT coalesce(nullif(trim(district), ''), '(unknown)') AS district, count(*) AS n_tenders, CAST(coalesce(sum(estimated_value_inr), 0) AS DECIMAL(38,2)) AS total_inr FROM {ONE} GROUP BY 1""",
)
def by_district(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "district", "estimated_value_inr"))
    return t.groupBy(F.coalesce(F.nullif(F.trim("district"), F.lit("")), F.lit("(unknown)")).alias("district")).agg(F.count("*").alias("n_tenders"), known_sum(F.col("estimated_value_inr")).alias("total_inr"))


@query(
    "a14_by_funding_scheme",
    f"""SELECT coalesce(nullif(trim(funding_scheme), ''), '(unclassified)') AS scheme, count(*) AS n_tenders, CAST(coalesce(sum(estimated_value_inr), 0) AS DECIMAL(38,2)) AS total_inr FROM {ONE} GROUP BY 1""",
)
def by_scheme(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "funding_scheme", "estimated_value_inr"))
    return t.groupBy(F.coalesce(F.nullif(F.trim("funding_scheme"), F.lit("")), F.lit("(unclassified)")).alias("scheme")).agg(F.count("*").alias("n_tenders"), known_sum(F.col("estimated_value_inr")).alias("total_inr"))


# Names and least amounts of the bands.
BANDS = (("100 Cr +", 1_000_000_000), ("10-100 Cr", 100_000_000), ("1-10 Cr", 10_000_000), ("10 L - 1 Cr", 1_000_000), ("< 10 L", 0))


@query(
    "a15_value_bands",
    f"""WITH b(band, rank) AS (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate([*(b[0] for b in BANDS), '(no value)']))}),
        x AS (SELECT CASE WHEN estimated_value_inr IS NULL THEN '(no value)' {' '.join(f"WHEN estimated_value_inr >= {v} THEN '{n}'" for n, v in BANDS)} END AS band, estimated_value_inr AS v FROM {ONE})
        SELECT b.band, CAST(b.rank AS INT) AS rank, count(x.band) AS n_tenders, CAST(coalesce(sum(x.v), 0) AS DECIMAL(38,2)) AS total_inr FROM b LEFT JOIN x ON b.band = x.band GROUP BY 1, 2""",
)
def value_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands without tenders are there with 0."""
    v = F.col("estimated_value_inr")
    band = F.when(v.isNull(), "(no value)")
    for name, least in BANDS:
        band = band.when(v >= least, name)
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "estimated_value_inr")).groupBy(band.alias("band")).agg(F.count("*").alias("n"), known_sum(v).alias("s"))
    names = spark.createDataFrame([(n, i) for i, n in enumerate([*(b[0] for b in BANDS), "(no value)"])], "band string, rank int")
    return names.join(t, "band", "left").select("band", "rank", F.coalesce("n", F.lit(0)).alias("n_tenders"), F.coalesce("s", F.lit(0)).cast("decimal(38,2)").alias("total_inr"))


@query(
    "a16_summary",
    f"""SELECT (SELECT count(*) FROM {ONE}) AS n_tenders, (SELECT count(estimated_value_inr) FROM {ONE}) AS n_known, (SELECT CAST(coalesce(sum(estimated_value_inr), 0) AS DECIMAL(38,2)) FROM {ONE}) AS floated_inr,
        (SELECT count_if(status = 'live') FROM {ONE}) AS n_live, (SELECT count_if(status = 'awarded') FROM {ONE}) AS n_awarded, (SELECT count_if(extra_source_ids IS NOT NULL) FROM {ONE}) AS n_merged,
        (SELECT count(*) FROM {AWARDS}) AS n_awards, (SELECT CAST(coalesce(sum(award_value_inr), 0) AS DECIMAL(38,2)) FROM {AWARDS}) AS awarded_inr, (SELECT count(*) FROM {CONTRACTORS}) AS n_contractors""",
)
def summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("estimated_value_inr")
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "estimated_value_inr", "status", "extra_source_ids")).agg(
        F.count("*").alias("n_tenders"), F.count(v).alias("n_known"), known_sum(v).alias("floated_inr"), F.count_if(F.col("status") == "live").alias("n_live"),
        F.count_if(F.col("status") == "awarded").alias("n_awarded"), F.count("extra_source_ids").alias("n_merged"),
    )
    a = awards(spark, d).agg(F.count("*").alias("n_awards"), known_sum(F.col("award_value_inr")).alias("awarded_inr"))
    c = contractors(spark, d).agg(F.count("*").alias("n_contractors"))
    # One row each.
    return t.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(c))


@query(
    "a21_facets",
    f"""SELECT 'status' AS facet, coalesce(nullif(lower(trim(status)), ''), '(none)') AS value, count(*) AS n FROM {ONE} GROUP BY 2 UNION ALL
        SELECT 'category', coalesce(nullif(lower(trim(category)), ''), '(none)'), count(*) FROM {ONE} GROUP BY 2 UNION ALL
        SELECT 'portal', coalesce(source_portal, '(none)'), count(*) FROM {ONE} GROUP BY 2""",
)
def facets(spark: SparkSession, d: str) -> DataFrame:
    """All facets in one pass: a row explodes into its facet values, which are summed map-side."""
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "status", "category", "source_portal"))
    low = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("(none)"))
    cells = F.array(*[F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, v in (("status", low("status")), ("category", low("category")), ("portal", F.coalesce("source_portal", F.lit("(none)"))))])
    return t.select(F.explode(cells).alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


@query("a22_events_by_kind", "SELECT event_type, source, count(*) AS n, count(DISTINCT tender_id) AS n_tenders, max(event_at) AS last_at FROM tender_events GROUP BY 1, 2")
def events_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tender_events").groupBy("event_type", "source").agg(F.count("*").alias("n"), F.countDistinct("tender_id").alias("n_tenders"), F.max("event_at").alias("last_at"))


@query(
    "a24_project_rollup",
    f"""SELECT district, scheme, count(*) AS n_projects, arg_max(id, (mjp_role_confidence, id)) AS surest_project, CAST(coalesce(sum(coalesce(revised_cost_inr, approved_cost_inr)), 0) AS DECIMAL(38,2)) AS cost_inr,
        CAST(coalesce(sum(funds_released_inr), 0) AS DECIMAL(38,2)) AS released_inr FROM {PROJECTS} WHERE mjp_role_confidence IS NOT NULL GROUP BY 1, 2""",
)
def project_rollup(spark: SparkSession, d: str) -> DataFrame:
    return projects(spark, d).filter("mjp_role_confidence IS NOT NULL").groupBy("district", "scheme").agg(
        F.count("*").alias("n_projects"), F.max_by("id", F.struct("mjp_role_confidence", "id")).alias("surest_project"),
        known_sum(F.coalesce("revised_cost_inr", "approved_cost_inr")).alias("cost_inr"), known_sum(F.col("funds_released_inr")).alias("released_inr"),
    )


@query(
    "a25_project_documents",
    f"""SELECT p.id AS project_id, count(*) AS n_documents, count(DISTINCT u.x.doc_type) AS n_types, max(u.x.issue_date) AS last_issue, count_if(u.x.ocr_used) AS n_ocr
        FROM {PROJECTS} p, unnest(p.documents) AS u(x) GROUP BY 1""",
)
def project_documents(spark: SparkSession, d: str) -> DataFrame:
    x = projects(spark, d).select(F.col("id").alias("project_id"), F.explode("documents").alias("x"))
    return x.groupBy("project_id").agg(F.count("*").alias("n_documents"), F.countDistinct("x.doc_type").alias("n_types"), F.max("x.issue_date").alias("last_issue"), F.count_if("x.ocr_used").alias("n_ocr"))


@query(
    "j04_events_with_tenders",
    f"""SELECT e.id AS event_id, e.event_type, t.publishing_org, t.title FROM tender_events e JOIN {ONE} t ON e.tender_id = t.id WHERE e.event_type IN ('extension', 'corrigendum', 'cancelled')""",
)
def events_with_tenders(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "tender_events").filter(F.col("event_type").isin("extension", "corrigendum", "cancelled")).select(F.col("id").alias("event_id"), "event_type", "tender_id")
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "publishing_org", "title")).select(F.col("id").alias("tender_id"), "publishing_org", "title")
    return e.join(t, "tender_id").select("event_id", "event_type", "publishing_org", "title")


@query(
    "j05_key_union",
    f"""SELECT coalesce(t.id, a.tender_id) AS tender_id, t.id IS NOT NULL AS has_tender, a.tender_id IS NOT NULL AS has_award FROM (SELECT DISTINCT id FROM tenders) t
        FULL JOIN (SELECT DISTINCT tender_id FROM awards WHERE tender_id IS NOT NULL) a ON t.id = a.tender_id""",
)
def key_union(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tenders").select("id").distinct()
    a = table(spark, d, "awards").select("tender_id").dropna().distinct()
    return t.join(a, t.id == a.tender_id, "full_outer").select(F.coalesce("id", "tender_id").alias("tender_id"), F.col("id").isNotNull().alias("has_tender"), a.tender_id.isNotNull().alias("has_award"))


@query("j06_orphan_awards", f"SELECT count(*) AS n_awards, count_if(tender_id IS NULL OR tender_id NOT IN (SELECT id FROM tenders)) AS n_orphans FROM {AWARDS}")
def orphan_awards(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "tenders").select(F.col("id").alias("known")).distinct()
    a = awards(spark, d).select("tender_id").join(known, F.col("tender_id") == F.col("known"), "left")
    return a.agg(F.count("*").alias("n_awards"), F.count_if(F.col("known").isNull()).alias("n_orphans"))


@query(
    "w01_latest_per_portal",
    f"SELECT source_portal, row_id, last_seen_at FROM {TENDERS} WHERE source_portal IS NOT NULL AND last_seen_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_portal ORDER BY last_seen_at DESC, row_id) = 1",
)
def latest_per_portal(spark: SparkSession, d: str) -> DataFrame:
    # max_by keeps one row per portal and task; a window would sort each portal whole in one task.
    t = tenders(spark, d).filter("source_portal IS NOT NULL AND last_seen_at IS NOT NULL")
    return t.groupBy("source_portal").agg(F.max(F.struct("last_seen_at", (-F.col("row_id")).alias("r"))).alias("m")).select("source_portal", (-F.col("m.r")).alias("row_id"), "m.last_seen_at")


@query(
    "w06_status_transitions",
    """SELECT id AS event_id, tender_id, event_type, lag(event_type) OVER (PARTITION BY tender_id ORDER BY event_at, id) AS previous_type FROM tender_events WHERE tender_id IS NOT NULL AND event_at IS NOT NULL""",
)
def transitions(spark: SparkSession, d: str) -> DataFrame:
    """A tender's own history is short, so its window is."""
    w = Window.partitionBy("tender_id").orderBy("event_at", "id")
    e = table(spark, d, "tender_events").filter("tender_id IS NOT NULL AND event_at IS NOT NULL")
    return e.select(F.col("id").alias("event_id"), "tender_id", "event_type", F.lag("event_type").over(w).alias("previous_type"))


@query(
    "w08_share_of_top",
    f"""WITH s AS (SELECT publishing_org AS org, CAST(coalesce(sum(estimated_value_inr), 0) AS DECIMAL(38,2)) AS total_inr FROM {ONE} GROUP BY 1)
        SELECT org, total_inr, round(100 * CAST(total_inr AS DOUBLE) / greatest(CAST(max(total_inr) OVER () AS DOUBLE), 1), 2) AS pct_of_top FROM s""",
)
def share_of_top(spark: SparkSession, d: str) -> DataFrame:
    s = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "publishing_org", "estimated_value_inr")).groupBy(F.col("publishing_org").alias("org")).agg(known_sum(F.col("estimated_value_inr")).alias("total_inr"))
    top = s.agg(F.max("total_inr").cast("double").alias("top"))  # one row
    return s.crossJoin(F.broadcast(top)).select("org", "total_inr", F.round(100 * F.col("total_inr").cast("double") / F.greatest("top", F.lit(1.0)), 2).alias("pct_of_top"))


@query(
    "o02_live_then_closed",
    f"""SELECT id, title FROM (SELECT *, {day_sql('bid_submission_end')} AS ends FROM {ONE}) ORDER BY (status = 'live') DESC NULLS LAST, CASE WHEN status = 'live' THEN ends END ASC NULLS LAST,
        CASE WHEN status = 'live' THEN NULL ELSE ends END DESC NULLS LAST, id LIMIT 400""",
)
def live_then_closed(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "title", "status", "bid_submission_end")).withColumn("ends", portal_time(F.col("bid_submission_end")))
    live = F.col("status") == "live"
    return t.orderBy(live.desc_nulls_last(), F.when(live, F.col("ends")).asc_nulls_last(), F.when(F.coalesce(live, F.lit(False)), None).otherwise(F.col("ends")).desc_nulls_last(), "id").limit(400).select("id", "title")


@query(
    "x03_search_corpus",
    f"""SELECT kind, count(*) AS n FROM (SELECT 'tender' AS kind FROM {ONE} UNION ALL SELECT 'award' FROM {AWARDS} UNION ALL SELECT 'contractor' FROM {CONTRACTORS} UNION ALL SELECT 'project' FROM {PROJECTS}) GROUP BY 1""",
)
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Records of all kinds for the search: (kind, id, title, body, amount, day)."""
    body = lambda *c: F.concat_ws(" ", *c)
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "title", "publishing_org", "description", "district", "estimated_value_inr", "publish_date")).select(F.lit("tender").alias("kind"), "id", "title", body("publishing_org", "description", "district").alias("body"), F.col("estimated_value_inr").alias("amount"), portal_time(F.col("publish_date")).cast("date").alias("day"))
    a = awards(spark, d).select(F.lit("award").alias("kind"), F.col("id").cast("string").alias("id"), F.col("contractor_name_raw").alias("title"), body("work_order_no").alias("body"), F.col("award_value_inr").alias("amount"), portal_time(F.col("award_date")).cast("date").alias("day"))
    c = contractors(spark, d).select(F.lit("contractor").alias("kind"), "id", F.col("canonical_name").alias("title"), body("aliases", "home_district").alias("body"))
    p = projects(spark, d).select(F.lit("project").alias("kind"), "id", F.coalesce("title_en", "title_original").alias("title"), body("municipality", "scheme").alias("body"), F.col("approved_cost_inr").alias("amount"))
    return t.unionByName(a).unionByName(c, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)


@query("s04_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("tenders", "tender_events", "contractors", "awards", "mjp_projects", "documents", "place_ref", "portals")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("tenders", "tender_events", "contractors", "awards", "mjp_projects", "documents", "place_ref", "portals")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "s08_captions",
    f"""SELECT k AS caption, count(*) AS n, count(DISTINCT v) AS n_values FROM (SELECT unnest(json_keys(raw)) AS k, unnest(list_transform(json_keys(raw), lambda x: json_extract_string(raw, '$."' || x || '"'))) AS v FROM {TENDERS} WHERE json_valid(raw)) GROUP BY 1""",
)
def captions(spark: SparkSession, d: str) -> DataFrame:
    x = tenders(spark, d).select(F.explode(F.from_json("raw", "map<string,string>")).alias("k", "v"))
    return x.groupBy(F.col("k").alias("caption")).agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_values"))
