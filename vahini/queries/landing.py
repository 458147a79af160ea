"""Queries of the readers and sinks: pages put together from the tables and read back, registries, merges and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vahini.functions import text
from vahini.functions.dates import iso_day
from vahini.operators import upsert, watch
from vahini.queries import analytics as A
from vahini.queries.analytics import AWARDS, ONE, PROJECTS, TENDERS, counting, one_per_tender, tenders
from vahini.queries.texts import ID, clean_sql
from vahini.session import table
from vahini.sources import html, state
from vahini.sources.registry import registry

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = counting(sql)
        return f

    return keep


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def page(*rows: list[Column]) -> Column:
    """A page with a table of these rows, each a list of cells."""
    line = lambda cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>\n")) for c in cells], F.lit("</tr>"))
    return F.concat(F.lit("<html><body><table>"), *[line(r) for r in rows], F.lit("</table></body></html>"))


def shown_sql(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{00A0}}]+', ' ', 'g'))"


@query("s05_project_counts", f"SELECT 'projects' AS table_name, count(*) AS n FROM {PROJECTS} UNION ALL SELECT 'papers', count(*) FROM {PROJECTS} p, unnest(p.documents) AS u(x) UNION ALL SELECT 'works', count(*) FROM {PROJECTS} p, unnest(p.works_en) AS u(x)")
def project_counts(spark: SparkSession, d: str) -> DataFrame:
    sizes = A.projects(spark, d).agg(F.count("*").alias("projects"), F.sum(F.greatest(F.size("documents"), F.lit(0))).alias("papers"), F.sum(F.greatest(F.size("works_en"), F.lit(0))).alias("works"))
    return sizes.select(F.explode(F.array(*[F.struct(F.lit(n).alias("table_name"), F.coalesce(n, F.lit(0)).alias("n")) for n in ("projects", "papers", "works")])).alias("c")).select("c.*")


@query("s06_portal_index", "SELECT source_portal AS name, 'https://' || source_portal || '.example/list' AS url FROM portals WHERE source_portal IS NOT NULL")
def portal_index(spark: SparkSession, d: str) -> DataFrame:
    """An index page's rows (serial, name, link), a heading and a remark around them."""
    link = F.concat(F.lit('<a href="https://'), F.col("source_portal"), F.lit('.example/list">'), F.col("source_portal"), F.lit("</a>"))
    pages = table(spark, d, "portals").filter("source_portal IS NOT NULL").select(page([F.lit("S.No"), F.lit("Name"), F.lit("Count")], [F.lit("1"), link, F.lit("7")], [F.lit("note")]).alias("page"))
    return html.listing(pages, "page", 3).select(F.col("cells")[1].alias("name"), html.page_links("page")[0]["href"].alias("url"))


@query("s07_listing_rows", f"SELECT row_id, {shown_sql('publish_date')} AS published, {shown_sql('bid_submission_end')} AS closing, {shown_sql('title')} AS title, {shown_sql('source_tender_id')} AS ref, {shown_sql('publishing_org')} AS org FROM {TENDERS} WHERE trim(title) <> ''")
def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tenders as rows of a portal's list, read back: rows without an id in their title block are none."""
    t = tenders(spark, d).filter("trim(title) <> ''")
    block = F.concat(F.lit("["), escaped(F.col("title")), F.lit("] ["), escaped(F.col("source_tender_id")), F.lit("][2026_AB_"), F.col("row_id"), F.lit("_1]"))
    own = [F.lit("1."), escaped(F.col("publish_date")), escaped(F.col("bid_submission_end")), F.lit("-"), block, escaped(F.col("publishing_org"))]
    pages = t.select("row_id", page([F.lit(x) for x in ("S.No", "Published", "Closing", "Opening", "Title", "Organisation")], own, [F.lit("2."), *[F.lit("-")] * 5]).alias("page"))
    read = html.listing(pages, "page", 6).withColumn("b", text.title_block(F.col("cells")[4], ID)).filter("b.id <> ''")
    return read.select("row_id", F.col("cells")[1].alias("published"), F.col("cells")[2].alias("closing"), "b.title", "b.ref", F.col("cells")[5].alias("org"))


@query("s09_result_rows", rf"SELECT row_id, {shown_sql('title')} AS title, {shown_sql('org_hierarchy.department')} AS department, {shown_sql('org_hierarchy.division')} AS division FROM {TENDERS}")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """The organisation of a result is the cell with its chain; the chain's ends are department and division."""
    chain = F.concat_ws("||", escaped(F.col("org_hierarchy.department")), F.lit("Office"), escaped(F.col("org_hierarchy.division")), F.lit("End"))
    pages = tenders(spark, d).select("row_id", page([F.lit("1"), escaped(F.col("title")), chain, F.lit("x")]).alias("page"))
    rows = html.listing(pages, "page", 4)
    org = F.split(F.filter("cells", lambda c: c.contains("||"))[0], r"\|\|")
    return rows.select("row_id", F.col("cells")[1].alias("title"), F.trim(org[0]).alias("department"), F.trim(org[2]).alias("division"))


@query("s10_bidder_rows", f"SELECT id AS award_id, {shown_sql('contractor_name_raw')} AS name, 'Awarded' AS status, CAST(award_value_inr AS VARCHAR) AS value FROM {AWARDS} WHERE length({shown_sql('contractor_name_raw')}) BETWEEN 1 AND 120")
def bidder_rows(spark: SparkSession, d: str) -> DataFrame:
    a = A.awards(spark, d)
    pages = a.select(F.col("id").alias("award_id"), page([F.lit("Title"), F.lit("any")], [F.lit(x) for x in ("S.No", "Bidder Name", "Value", "Status")], [F.lit("1"), escaped(F.col("contractor_name_raw")), escaped(F.col("award_value_inr")), F.lit("Awarded")]).alias("page"))
    rows = pages.select("award_id", html.table_rows("page").alias("rows")).select("award_id", F.explode(html.bidders(F.col("rows"))).alias("b"))
    return rows.select("award_id", "b.name", "b.status", F.nullif("b.value", F.lit("")).alias("value"))


@query("s11_uploads", "SELECT doc_id, url FROM documents WHERE contains(url, '/00/') OR contains(url, '/01/')")
def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Grid rows that have a link into an upload folder."""
    link = F.concat(F.lit('<a href="'), escaped(F.col("url")), F.lit('">pdf</a>'))
    pages = table(spark, d, "documents").filter("url IS NOT NULL").select("doc_id", page([F.lit("1"), F.lit("dept"), F.lit("title"), F.lit("code"), F.lit("day"), F.lit("kb"), link]).alias("page"))
    links = html.listing(pages, "page", 7).select("doc_id", F.explode(html.page_links("page")).alias("l"))
    return links.filter("l.href LIKE '%/00/%' OR l.href LIKE '%/01/%'").select("doc_id", F.col("l.href").alias("url"))


@query(
    "s12_dated_links",
    rf"""SELECT row_id, {shown_sql('title')} AS name, CASE WHEN regexp_matches({shown_sql('publish_date')}, '^(\d{{1,2}}-\d{{1,2}}-\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})$') THEN strftime(try_strptime(replace({shown_sql('publish_date')}, '/', '-'), '%d-%m-%Y'), '%Y-%m-%d') END AS day,
        'https://' || source_portal || '.example/t/' || row_id AS url FROM {TENDERS} WHERE source_portal IN ('statebid', 'zpnet')""",
)
def dated_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a link on an allowed host, their dates in ISO form."""
    link = F.concat(F.lit('<a href="https://'), F.col("source_portal"), F.lit(".example/t/"), F.col("row_id"), F.lit('">'), F.lit("view</a>"))
    pages = tenders(spark, d).filter("source_portal IS NOT NULL").select("row_id", page([F.lit("1"), escaped(F.col("title")), escaped(F.col("publish_date")), link]).alias("page"))
    rows = html.listing(pages, "page", 4).withColumn("url", html.page_links("page")[0]["href"])
    return rows.filter(watch.url_on(F.col("url"), ("statebid.example", "zpnet.example"))).select("row_id", F.col("cells")[1].alias("name"), iso_day(F.col("cells")[2]).alias("day"), "url")


@query("s14_document_links", "SELECT DISTINCT coalesce(tender_id, '') AS tender_id, regexp_extract(url, '([^/]+)$', 1) AS name FROM documents WHERE regexp_matches(url, '(?i)\\.(pdf|zip|xlsx?|docx?)$')")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to files (by their ending) on the pages of tenders, each name once."""
    link = F.concat(F.lit('<a href="'), escaped(F.col("url")), F.lit('">'), F.regexp_extract("url", "([^/]+)$", 1), F.lit('</a><a href="/help">help</a>'))
    pages = table(spark, d, "documents").filter("url IS NOT NULL").select(F.coalesce("tender_id", F.lit("")).alias("tender_id"), page([F.lit("files"), link]).alias("page"))
    return html.file_links(pages, "page").select("tender_id", "name").distinct()


_REASON = "CASE WHEN url IS NULL THEN 'no address' WHEN NOT starts_with(url, 'https://') THEN 'not https' WHEN NOT regexp_matches(url, '^https://([a-z0-9-]+\\.)*(docs\\.example|gr\\.example)([/:?#]|$)') THEN 'host' WHEN NOT regexp_matches(url, '(?i)\\.pdf$') THEN 'no pdf' ELSE 'accepted' END"


@query("s16_harvest", f"SELECT reason, count(*) AS n, count(DISTINCT url) AS n_urls FROM (SELECT url, {_REASON} AS reason FROM documents UNION ALL SELECT u.x.url, {_REASON.replace('url', 'u.x.url')} FROM {PROJECTS} p, unnest(p.documents) AS u(x)) GROUP BY 1")
def harvest(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of two lists, with why they are not taken."""
    urls = table(spark, d, "documents").select("url").unionByName(A.projects(spark, d).select(F.explode("documents").alias("x")).select("x.url"))
    return urls.groupBy(watch.reject_reason(F.col("url"), ("docs.example", "gr.example"), "pdf").alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


@query("s19_registry", "SELECT p.source_portal, p.trust_rank, count(t.row_id) AS n_rows FROM portals p LEFT JOIN (SELECT DISTINCT ON (row_id) row_id, source_portal FROM tenders) t ON p.source_portal = t.source_portal GROUP BY 1, 2")
def registered(spark: SparkSession, d: str) -> DataFrame:
    """Every registered portal with what its reader delivers."""
    n = registry(spark, d)["tenders"]().dropDuplicates(["row_id"]).groupBy("source_portal").agg(F.count("*").alias("n"))
    return table(spark, d, "portals").join(n, "source_portal", "left").select("source_portal", "trust_rank", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query(
    "k08_attempts",
    """WITH o AS (SELECT tender_id, event_type, min(event_at) AS sent_at FROM tender_events WHERE event_at < TIMESTAMPTZ '2026-06-01 00:00:00+00' GROUP BY 1, 2), n AS (SELECT tender_id, event_type, max(event_at) AS sent_at FROM tender_events WHERE event_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00' GROUP BY 1, 2)
       SELECT coalesce(o.tender_id, n.tender_id) AS tender_id, coalesce(o.event_type, n.event_type) AS event_type, CASE WHEN o.event_type IS NULL THEN 0 ELSE 1 END + CASE WHEN n.event_type IS NULL THEN 0 ELSE 1 END AS attempts, coalesce(o.sent_at, n.sent_at) AS sent_at
       FROM o FULL JOIN n ON o.tender_id IS NOT DISTINCT FROM n.tender_id AND o.event_type IS NOT DISTINCT FROM n.event_type""",
)
def attempts(spark: SparkSession, d: str) -> DataFrame:
    """A ledger written twice: attempts go up by one, the first time of sending stays."""
    e, cut_at = table(spark, d, "tender_events"), F.unix_micros("event_at") < 1_780_272_000_000_000
    old = e.filter(cut_at).groupBy("tender_id", "event_type").agg(F.min("event_at").alias("sent_at")).withColumn("attempts", F.lit(1))
    new = e.filter(~cut_at).groupBy("tender_id", "event_type").agg(F.max("event_at").alias("sent_at"))
    return upsert.merge_upsert(old, new, ["tender_id", "event_type"], keep_first=["sent_at"], count="attempts")


_LAST = "(SELECT source_portal, source_tender_id, arg_max(status, (last_seen_at, status)) AS status FROM tender_snapshots WHERE snapshot_id {0} AND source_portal IS NOT NULL AND source_tender_id IS NOT NULL AND status IS NOT NULL AND last_seen_at IS NOT NULL GROUP BY 1, 2)"


@query("k09_state_updates", f"SELECT n.source_portal, n.source_tender_id, o.status AS previous, n.status FROM {_LAST.format('= 6')} n LEFT JOIN {_LAST.format('= 5')} o USING (source_portal, source_tender_id)")
def state_updates(spark: SparkSession, d: str) -> DataFrame:
    """A delivery's states with what they were in the one before."""
    keys = ["source_portal", "source_tender_id"]
    s = table(spark, d, "tender_snapshots").dropna(subset=[*keys, "status", "last_seen_at"])
    per = lambda k: s.filter(k).groupBy(*keys).agg(F.max(F.struct("last_seen_at", "status"))["status"].alias("status"))
    return upsert.with_previous(per("snapshot_id = 5"), per("snapshot_id = 6"), keys, "status")


def _cell_sql(c: str) -> str:
    x = f"coalesce(CAST({c} AS VARCHAR), '')"
    return f"""'"' || replace(CASE WHEN regexp_matches({x}, '^[=+\\-@\\t\\r]') THEN '''' || {x} ELSE {x} END, '"', '""') || '"'"""


@query("k12_export_lines", f"SELECT row_id, {' || chr(44) || '.join(_cell_sql(c) for c in ('source_portal', 'title', 'estimated_value_inr', 'district'))} AS line FROM {TENDERS}")
def export_lines(spark: SparkSession, d: str) -> DataFrame:
    """The fixed columns of an export as quoted lines that no spreadsheet runs."""
    return tenders(spark, d).select("row_id", state.csv_line("source_portal", "title", "estimated_value_inr", "district").alias("line"))


@query(
    "k14_nested_feed",
    f"""SELECT id AS project_id, '{{"id":' || to_json(id) || ',"papers":[' || coalesce((SELECT string_agg('{{"code":' || coalesce(to_json(u.x.doc_code)::VARCHAR, 'null') || ',"kind":' || coalesce(to_json(u.x.doc_type)::VARCHAR, 'null') || '}}', ',' ORDER BY coalesce(u.x.doc_code, ''), coalesce(u.x.doc_type, '')) FROM unnest(documents) AS u(x)), '') || ']}}' AS feed FROM {PROJECTS}""",
)
def nested_feed(spark: SparkSession, d: str) -> DataFrame:
    """Projects as JSON with their papers inside, in order."""
    x = F.transform(F.coalesce("documents", F.expr("array()").cast("array<struct<doc_code:string,doc_type:string,issue_date:string,gr_number:string,url:string,ocr_used:boolean>>")), lambda p: F.struct(F.coalesce(p["doc_code"], F.lit("")).alias("a"), F.coalesce(p["doc_type"], F.lit("")).alias("b"), p["doc_code"].alias("code"), p["doc_type"].alias("kind")))
    papers = F.transform(F.array_sort(x), lambda p: F.struct(p["code"].alias("code"), p["kind"].alias("kind")))
    return A.projects(spark, d).select(F.col("id").alias("project_id"), F.to_json(F.struct("id", papers.alias("papers")), {"ignoreNullFields": "false"}).alias("feed"))


@query("k16_run_log", "SELECT source_portal AS portal, CAST(snapshot_id AS INT) AS run, count(*) AS n_rows, max(last_seen_at) AS finished FROM tender_snapshots WHERE snapshot_id IN (1, 2) GROUP BY 1, 2")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Two runs appended to a log in the shared folder, one of them again after a retry, and the log read back."""
    s = table(spark, d, "tender_snapshots")
    log = state.RunLog(spark)
    for run in (1, 2, 2):
        log.append(s.filter(F.col("snapshot_id") == run).groupBy(F.col("source_portal").alias("portal"), F.col("snapshot_id").cast("int").alias("run")).agg(F.count("*").alias("n_rows"), F.max("last_seen_at").alias("finished")), run)
    return log.read()


@query("k18_kept_on_failure", "SELECT source_portal, source_tender_id, min(last_seen_at) AS first_seen FROM tender_snapshots WHERE snapshot_id <= 2 AND source_portal IS NOT NULL AND source_tender_id IS NOT NULL GROUP BY 1, 2")
def kept_on_failure(spark: SparkSession, d: str) -> DataFrame:
    """Three deliveries, the third of which can't be read: what was there stays."""
    keys = ["source_portal", "source_tender_id"]
    s = table(spark, d, "tender_snapshots").dropna(subset=keys)
    read = lambda i: lambda: s.filter(F.col("snapshot_id") == i).groupBy(*keys).agg(F.min("last_seen_at").alias("first_seen"))
    kept = read(1)()
    for source in (read(2), lambda: spark.read.parquet(f"{d}/no_such_table.parquet")):
        kept, _ = upsert.keep_last_good(kept, source, keys, keep_first=["first_seen"])
    earliest = s.filter("snapshot_id <= 2").groupBy(*keys).agg(F.min("last_seen_at").alias("least"))
    return kept.join(earliest, keys).select(*keys, F.least("first_seen", "least").alias("first_seen"))


@query("l01_canonical_tenders", f"""SELECT coalesce(t.id, a.tender_id) AS id, nullif({clean_sql('t.title')}, '') AS title, CASE WHEN lower(trim(t.status)) = 'live' THEN 'live' WHEN a.tender_id IS NOT NULL THEN 'awarded' WHEN trim(t.bid_submission_end) <> '' THEN 'closed' ELSE 'unknown' END AS status
    FROM {ONE} t FULL JOIN (SELECT DISTINCT tender_id FROM awards WHERE tender_id IS NOT NULL) a ON t.id = a.tender_id""")
def canonical_tenders(spark: SparkSession, d: str) -> DataFrame:
    """One record per tender id of any list: live ones, those seen before, awards; the first list that knows a field gives it."""
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "title", "status", "bid_submission_end", "publish_date", "publishing_org"))
    rows = t.select("id", F.nullif(text.clean(F.col("title")), F.lit("")).alias("title"), F.col("bid_submission_end").alias("closing"), F.col("publish_date").alias("published"), F.col("publishing_org").alias("org_chain"), F.coalesce(F.lower(F.trim("status")) == "live", F.lit(False)).alias("is_live"))
    live, seen = rows.filter("is_live").drop("is_live"), rows.filter("NOT is_live").drop("is_live")
    details = spark.createDataFrame([], "id string, record map<string,string>")
    return state.canonical_tenders(live, seen, details, table(spark, d, "awards").select(F.col("tender_id").alias("id")).dropna()).select("id", "title", "status")
