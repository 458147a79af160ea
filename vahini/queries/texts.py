"""Queries of the scalar functions over names, amounts, times and papers, and of what is extracted from texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahini.functions import dates, extraction, money, text
from vahini.operators import freshness, watch
from vahini.queries import analytics as A
from vahini.queries.analytics import CONTRACTORS, ONE, PROJECTS, TENDERS, counting, day_sql, one_per_tender, tenders
from vahini.session import table
from vahini.sources import state

QUERIES, ORACLE_SQL = {}, {}
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
NOW = "2026-06-15 12:00:00"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = counting(sql)
        return f

    return keep


def amounts_sql(c: str) -> str:
    s, number = f"translate({c}, '०१२३४५६७८९', '0123456789')", r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    exact = "TRY_CAST(replace(x, ',', '') AS DECIMAL(28,6))"
    return (
        rf"list_filter(list_concat(list_transform(regexp_extract_all({s}, '(?i)(?:रु|\brs|\binr|₹)\.?\s*{number}', 1), lambda x: {exact}),"
        rf" list_transform(regexp_extract_all({s}, '(?i){number}\s*(?:कोटी|कोटि|crore)', 1), lambda x: CAST({exact} * 10000000 AS DECIMAL(28,6)))), lambda x: x IS NOT NULL)"
    )


def rules_sql(c: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for p, n in rules) + f" ELSE '{default}' END"


def uuid_sql(name: str) -> str:
    """UUID version 5 of a text."""
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({name}))"
    part = lambda i, n: f"substr(h, {i}, {n})"
    variant = f"substr('89ab', (strpos('0123456789abcdef', {part(17, 1)}) - 1) % 4 + 1, 1)"
    return f"(SELECT {part(1, 8)} || '-' || {part(9, 4)} || '-5' || {part(14, 3)} || '-' || {variant} || {part(18, 3)} || '-' || {part(21, 12)} FROM (SELECT {h} AS h))"


@query("f02_amounts_in_text", f"SELECT doc_id, amount, count(*) AS n FROM (SELECT doc_id, unnest({amounts_sql('text')}) AS amount FROM documents) GROUP BY 1, 2")
def amounts_in_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(money.text_amounts(F.col("text"))).alias("amount")).groupBy("doc_id", "amount").agg(F.count("*").alias("n"))


@query("f06_exact_amounts", f"SELECT row_id, CASE WHEN contains(v, '.') THEN regexp_replace(v, '\\.?0+$', '') ELSE v END AS shown FROM (SELECT row_id, CAST(estimated_value_inr AS VARCHAR) AS v FROM {TENDERS})")
def exact_amounts(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).select("row_id", money.plain_text(F.col("estimated_value_inr")).alias("shown"))


_SHORT = "rtrim(rtrim(CAST(CAST(round_even(CAST(v / {0} AS DECIMAL(38,12)), 2) AS DECIMAL(28,2)) AS VARCHAR), '0'), '.')"
_WHOLE = "CAST(CAST(round_even(v, 0) AS DECIMAL(28,0)) AS VARCHAR)"


@query(
    "f07_display_amounts",
    f"""SELECT doc_id, v AS amount, '₹' || CASE WHEN v >= 10000000 THEN {_SHORT.format(10000000)} || ' Cr' WHEN v >= 100000 THEN {_SHORT.format(100000)} || ' L' WHEN length({_WHOLE}) <= 3 THEN {_WHOLE}
        ELSE ltrim(reverse(regexp_replace(reverse(left({_WHOLE}, -3)), '(..)', '\\1,', 'g')), ',') || ',' || right({_WHOLE}, 3) END AS shown
        FROM (SELECT DISTINCT doc_id, unnest({amounts_sql('text')}) AS v FROM documents)""",
)
def display_amounts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(money.text_amounts(F.col("text")))).alias("amount"))
    return x.select("doc_id", "amount", money.format_inr(F.col("amount")).alias("shown"))


@query(
    "f11_iso_days",
    rf"""SELECT row_id, CASE WHEN regexp_matches(trim(publish_date), '^(\d{{1,2}}-\d{{1,2}}-\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})$') THEN strftime(try_strptime(replace(trim(publish_date), '/', '-'), '%d-%m-%Y'), '%Y-%m-%d') END AS iso_day FROM {TENDERS}""",
)
def iso_days(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).select("row_id", dates.iso_day(F.col("publish_date")).alias("iso_day"))


_INDIAN = "last_seen_at AT TIME ZONE 'Asia/Kolkata'"


@query("f14_indian_labels", f"SELECT row_id, strftime({_INDIAN}, '%d %b %Y, %H:%M IST') AS label, strftime({_INDIAN}, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS iso FROM {TENDERS}")
def indian_labels(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).select("row_id", dates.indian_label(F.col("last_seen_at")).alias("label"), dates.indian_iso(F.col("last_seen_at")).alias("iso"))


def age_sql(s: str) -> str:
    unit = lambda n, name: f"CAST(floor({s} / {n}.0) AS BIGINT) || ' {name}' || CASE WHEN floor({s} / {n}.0) = 1 THEN '' ELSE 's' END || ' ago'"
    return f"CASE WHEN {s} < 60 THEN 'just now' WHEN {s} < 3600 THEN {unit(60, 'minute')} WHEN {s} < 86400 THEN {unit(3600, 'hour')} WHEN {s} IS NOT NULL THEN {unit(86400, 'day')} END"


@query("f15_relative_ages", f"SELECT age, count(*) AS n FROM (SELECT {age_sql('s')} AS age FROM (SELECT CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(last_seen_at)) AS BIGINT) AS s FROM {TENDERS})) GROUP BY 1")
def relative_ages(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("last_seen_at")
    return tenders(spark, d).groupBy(freshness.relative_age(seconds).alias("age")).agg(F.count("*").alias("n"))


@query("f16_portal_epochs", f"SELECT row_id, coalesce(CAST(epoch({day_sql('bid_submission_end')}) AS BIGINT), 0) AS ends FROM {TENDERS}")
def portal_epochs(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).select("row_id", dates.epoch_or_zero(F.col("bid_submission_end")).alias("ends"))


def clean_sql(c: str) -> str:
    return r"trim(regexp_replace(translate(" + c + r""", '–—−‐‑‘’“”', '-----''''""'), '[\s\x{00A0}\x{200B}\x{FEFF}]+', ' ', 'g'))"""


@query("f20_clean_titles", f"SELECT row_id, {clean_sql('title')} AS title, {clean_sql('location_raw')} AS place FROM {TENDERS}")
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).select("row_id", text.clean(F.col("title")).alias("title"), text.clean(F.col("location_raw")).alias("place"))


_NORMAL = r"trim(regexp_replace(lower({0}), '[^\pL\pM\pN]+', ' ', 'g'))"


@query(
    "f22_normal_names",
    rf"""SELECT id, {_NORMAL.format('canonical_name')} AS org_form, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(canonical_name), '{text.LEGAL_FORMS}', ' ', 'g'), '[^\pL\pM\pN]+', ' ', 'g')), ''), {_NORMAL.format('canonical_name')}) AS name_form
        FROM {CONTRACTORS}""",
)
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    return A.contractors(spark, d).select("id", text.normal_org(F.col("canonical_name")).alias("org_form"), text.normal_name(F.col("canonical_name")).alias("name_form"))


_SHOWN = f"regexp_replace({clean_sql('canonical_name')}, '^[ .,-]+|[ .,-]+$', '', 'g')"
_BARE = f"lower(regexp_replace(regexp_replace({_SHOWN}, '{text.ADDRESS_FORMS}', ''), '^[ .,-]+|[ .,-]+$', '', 'g'))"
_KEY = rf"""trim(regexp_replace(regexp_replace(regexp_replace({_BARE}, '[.,&''"()/\\-]', ' ', 'g'), '{text.KEY_FORMS}', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("f23_contractor_keys", f"SELECT id, {_SHOWN} AS shown, coalesce(nullif({_KEY}, ''), {_BARE}) AS key FROM {CONTRACTORS}")
def contractor_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("canonical_name")
    return A.contractors(spark, d).select("id", text.display_name(name).alias("shown"), text.contractor_key(name).alias("key"))


GENERIC = ("works", "work", "water", "supply", "scheme", "construction", "under", "main", "rising", "pump", "house", "tank", "road", "with")


@query(
    "f24_distinctive_words",
    f"""SELECT id AS project_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(array_to_string(works_en, ' '), '')), '([a-z]{{4,}})', 1)), lambda w: w NOT IN {GENERIC})), ' ') AS words FROM {PROJECTS}""",
)
def distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    return A.projects(spark, d).select(F.col("id").alias("project_id"), F.array_join(F.array_sort(text.distinctive(F.array_join("works_en", " "), GENERIC)), " ").alias("words"))


@query(
    "f26_partial_places",
    r"""SELECT id AS project_id, CASE WHEN a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) THEN 100 ELSE 0 END AS partial FROM (SELECT id, trim(regexp_replace(lower(municipality), '\s+', ' ', 'g')) AS a,
        trim(regexp_replace(lower(title_en), '\s+', ' ', 'g')) AS b FROM """ + PROJECTS + ")",
)
def partial_places(spark: SparkSession, d: str) -> DataFrame:
    return A.projects(spark, d).select(F.col("id").alias("project_id"), text.partial(F.col("municipality"), F.col("title_en")).alias("partial"))


_FUNDED = "concat_ws(' ', title, funding_scheme, publishing_org)"


@query(
    "f27_funding",
    f"""SELECT scheme, level, CASE WHEN contains(lower(f), 'world bank') THEN 'world_bank' WHEN regexp_matches(lower(f), '\\badb\\b|asian development') THEN 'adb' WHEN scheme <> '' THEN 'css' ELSE 'unknown' END AS source, count(*) AS n
        FROM (SELECT {_FUNDED} AS f, {rules_sql(_FUNDED, text.SCHEMES, '')} AS scheme, {rules_sql(_FUNDED, text.LEVELS, 'state')} AS level FROM {TENDERS}) GROUP BY 1, 2, 3""",
)
def funding(spark: SparkSession, d: str) -> DataFrame:
    t = tenders(spark, d).select(F.concat_ws(" ", "title", "funding_scheme", "publishing_org").alias("f"))
    return t.groupBy(text.funding_scheme(F.col("f")).alias("scheme"), text.funding_level(F.col("f")).alias("level"), text.funding_source(F.col("f")).alias("source")).agg(F.count("*").alias("n"))


@query(
    "f29_districts_in_text",
    "WITH n AS (SELECT list(DISTINCT district ORDER BY district) AS names FROM place_ref WHERE district IS NOT NULL) SELECT doc_id, list_filter(names, lambda x: contains(lower(text), lower(x)))[1] AS district FROM documents, n",
)
def districts_in_text(spark: SparkSession, d: str) -> DataFrame:
    """The first district of the reference list (its districts are a bounded list in the program) that a paper names."""
    names = [r.district for r in table(spark, d, "place_ref").filter("district IS NOT NULL").select("district").distinct().orderBy("district").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("a list of more than 1000 names has to be joined")
    return table(spark, d, "documents").select("doc_id", text.first_listed(F.col("text"), names).alias("district"))


@query("f30_uuid5_keys", f"SELECT row_id, {uuid_sql('''concat_ws('|', coalesce(source_portal, ''), coalesce(source_tender_id, ''))''')} AS key FROM {TENDERS}")
def uuid_keys(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).select("row_id", text.uuid5(NAMESPACE, F.col("source_portal"), F.col("source_tender_id")).alias("key"))


@query(
    "f31_project_keys",
    f"""SELECT id AS project_id, {uuid_sql("CASE WHEN coalesce(trim(municipality), '') = '' THEN 'project|' || coalesce(primary_doc_code, '') ELSE concat_ws('|', 'project', lower(trim(coalesce(district, ''))), lower(trim(municipality)), coalesce(work_theme, '')) END")} AS key FROM {PROJECTS}""",
)
def project_keys(spark: SparkSession, d: str) -> DataFrame:
    """By district, town and theme; without a town a paper is a project of its own."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    alone = text.uuid5(NAMESPACE, F.lit("project"), F.col("primary_doc_code"))
    return A.projects(spark, d).select(F.col("id").alias("project_id"), F.when(low("municipality") == "", alone).otherwise(text.uuid5(NAMESPACE, F.lit("project"), low("district"), low("municipality"), F.col("work_theme"))).alias("key"))


ID = r"\d{4}_\w+_\d+_\d+"


@query(
    "f35_title_blocks",
    f"""SELECT row_id, regexp_replace(coalesce(title, ''), '^[\\[\\]\\s]+|[\\[\\]\\s]+$', '', 'g') AS title, trim(coalesce(publishing_org, '') || ' [' || coalesce(district, '') || ']') AS ref, '2026_AB_' || row_id || '_1' AS id FROM {TENDERS}""",
)
def title_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Titles, references (with a bracket of their own) and ids put into the form of a portal's list, and read back from it."""
    none = F.lit("")
    block = F.concat(F.lit("["), F.coalesce("title", none), F.lit("] ["), F.coalesce("publishing_org", none), F.lit(" ["), F.coalesce("district", none), F.lit("]][2026_AB_"), F.col("row_id"), F.lit("_1]"))
    return tenders(spark, d).select("row_id", text.title_block(block, ID).alias("b")).select("row_id", "b.title", "b.ref", "b.id")


@query("f36_work_days", f"""SELECT row_id, TRY_CAST(nullif(regexp_extract(json_extract_string(raw, '$."Period Of Work (Days)"'), '(\\d+)', 1), '') AS INT) AS days FROM {TENDERS} WHERE raw IS NOT NULL""")
def work_days(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).filter("raw IS NOT NULL").select("row_id", text.first_int(F.from_json("raw", "map<string,string>")["Period Of Work (Days)"]).alias("days"))


def _caption_sql(test: str) -> str:
    return f"""json_extract_string(raw, '$."' || list_filter(json_keys(raw), lambda k: {test})[1] || '"')"""


@query("f44_captions", f"""SELECT row_id, coalesce({_caption_sql("lower(trim(k)) = 'contract form'")}, {_caption_sql("lower(trim(k)) = 'period'")}, {_caption_sql("contains(lower(trim(k)), 'contract form')")}, {_caption_sql("contains(lower(trim(k)), 'period')")}) AS value FROM {TENDERS} WHERE raw IS NOT NULL""")
def captions(spark: SparkSession, d: str) -> DataFrame:
    return tenders(spark, d).filter("raw IS NOT NULL").select("row_id", text.caption(F.from_json("raw", "map<string,string>"), ["Contract Form", "Period"]).alias("value"))


OFFICE = r"(?i)\b(?:executive|chief|block|accounts) (?:engineer|officer)"
ROLES = [(r"(?i)administrative approval", "approving", 0.9), (r"(?i)tender committee|sealed e-tender", "tendering", 0.85), (r"(?i)technical sanction", "technical", 0.6)]


def papers(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract(table(spark, d, "documents").select("doc_id", "text", "url"), F.lit(None).cast("string"), F.col("text"), F.col("url"), OFFICE, ROLES)


_A = amounts_sql("coalesce(text, '')")
_CODE_OF = f"coalesce(nullif(regexp_extract(coalesce(url, ''), '{extraction.CODE}', 1), ''), nullif(regexp_extract(coalesce(text, ''), '{extraction.CODE}', 1), ''))"


@query(
    "d08_extracted_papers",
    f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS body, {_A} AS amounts, {_CODE_OF} AS code, {rules_sql("coalesce(text, '')", extraction.KINDS, 'other')} AS kind, {rules_sql("coalesce(text, '')", extraction.THEMES, 'other')} AS theme,
            CASE WHEN regexp_matches(coalesce(text, ''), '[ऀ-ॿ]') THEN 'mr' ELSE 'en' END AS language,
            CASE WHEN NOT regexp_matches(coalesce(text, ''), '{OFFICE}') THEN 'none' ELSE {rules_sql("coalesce(text, '')", [(p, n) for p, n, _ in ROLES], 'mentioned')} END AS role FROM documents),
        y AS (SELECT *, list_max(amounts) AS total, list_filter(amounts, lambda a: a < list_max(amounts)) AS parts FROM x),
        z AS (SELECT *, coalesce(list_sum(parts), 0) AS parts_sum FROM y)
        SELECT doc_id, code, kind, theme, language, total AS total_inr, CAST(len(parts) AS INT) AS n_parts, CAST(parts_sum AS DOUBLE) AS parts_inr, role,
        array_to_string(list_filter([CASE WHEN total IS NULL THEN 'total' END, CASE WHEN role = 'none' THEN 'role' END, CASE WHEN code IS NULL THEN 'code' END], lambda m: m IS NOT NULL), ',') AS missing,
        array_to_string(list_filter([CASE WHEN length(trim(body)) < 40 THEN 'no text layer' END, CASE WHEN role = 'mentioned' THEN 'role not stated' END,
            CASE WHEN len(parts) > 0 AND abs(parts_sum - total) > total * 0.02 THEN 'parts differ from total' END], lambda m: m IS NOT NULL), ',') AS doubtful FROM z""",
)
def extracted_papers(spark: SparkSession, d: str) -> DataFrame:
    x = papers(spark, d).select("doc_id", *[f"facts.{n}" for n in ("code", "kind", "theme", "language", "total_inr", "n_parts", "parts_inr", "role", "missing", "doubtful")])
    return x.withColumns({"parts_inr": F.col("parts_inr").cast("double"), "missing": F.array_join("missing", ","), "doubtful": F.array_join("doubtful", ",")})


@query(
    "f38_office_evidence",
    rf"""WITH x AS (SELECT doc_id, text, regexp_extract(text, '{OFFICE}') AS m FROM documents), y AS (SELECT *, CASE WHEN m <> '' THEN strpos(text, m) END AS p FROM x)
        SELECT doc_id, p AS place, trim(regexp_replace(substr(text, CAST(greatest(p - 60, 1) AS BIGINT), CAST(p + 180 - greatest(p - 60, 1) AS BIGINT)), '\s+', ' ', 'g')) AS evidence FROM y WHERE p IS NOT NULL""",
)
def office_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Where a paper first names an office, with the passage around it."""
    at = F.regexp_instr("text", F.lit(OFFICE))
    return table(spark, d, "documents").filter(at > 0).select("doc_id", at.cast("bigint").alias("place"), extraction.passage(F.col("text"), at).alias("evidence"))


@query(
    "f39_works_and_orders",
    rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '{extraction.WORKS}', 1))), '; ') AS works, nullif(regexp_extract(coalesce(text, ''), '{extraction.OFFICE}', 1), '') AS office,
        nullif(trim(regexp_extract(coalesce(text, ''), '{extraction.ORDER_NUMBER}', 1)), '') AS order_number FROM documents""",
)
def works_and_orders(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("doc_id", F.array_join(F.array_sort("facts.works"), "; ").alias("works"), "facts.office", "facts.order_number")


@query(
    "s13_readable_papers",
    "SELECT lower(trim(source)) AS source, count(*) AS n, count_if(length(trim(coalesce(text, ''))) >= 40) AS n_readable, count_if(length(trim(coalesce(ocr_text, ''))) >= 40) AS n_scanned FROM documents GROUP BY 1",
)
def readable_papers(spark: SparkSession, d: str) -> DataFrame:
    layer = lambda c: F.count_if(F.length(F.trim(F.coalesce(c, F.lit("")))) >= extraction.LEAST_CHARS)
    return table(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"), layer("text").alias("n_readable"), layer("ocr_text").alias("n_scanned"))


@query(
    "a28_component_sums",
    f"""SELECT doc_id, CAST(list_sum(parts) AS DOUBLE) AS parts_inr, total AS total_inr, abs(list_sum(parts) - total) > total * 0.02 AS differs FROM (SELECT doc_id, list_max(a) AS total, list_filter(a, lambda x: x < list_max(a)) AS parts
        FROM (SELECT doc_id, {amounts_sql('text')} AS a FROM documents WHERE text IS NOT NULL)) WHERE len(parts) > 0""",
)
def component_sums(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of a paper below its greatest, summed up against that one."""
    return papers(spark, d).filter("facts.n_parts > 0").select("doc_id", F.col("facts.parts_inr").cast("double").alias("parts_inr"), "facts.total_inr", "facts.differs")


_MONEY = "TRY_CAST(json_extract_string(detail, '$.{0}') AS DECIMAL(28,6))"


@query(
    "a29_money_audit",
    f"""SELECT count(*) AS n_scanned, count_if(b IS NULL) AS n_unknown, count_if(b IS NOT NULL AND a IS NOT DISTINCT FROM b) AS n_unchanged, count_if(b IS NOT NULL AND a IS DISTINCT FROM b) AS n_corrected
        FROM (SELECT {_MONEY.format('from')} AS a, {_MONEY.format('to')} AS b FROM tender_events WHERE event_type = 'corrigendum')""",
)
def money_audit(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in corrigenda, before and after; other texts are unknown amounts."""
    e = table(spark, d, "tender_events").filter("event_type = 'corrigendum'").withColumn("x", F.from_json("detail", "map<string,string>"))
    return watch.audit(e, F.col("x")["from"].try_cast(money.MONEY), F.col("x")["to"].try_cast(money.MONEY))


@query(
    "d15_corrections",
    f"""SELECT id AS event_id, tender_id, a AS before_inr, b AS after_inr, CAST(b - a AS DECIMAL(38,6)) AS change_inr FROM (SELECT id, tender_id, {_MONEY.format('from')} AS a, {_MONEY.format('to')} AS b FROM tender_events WHERE event_type = 'corrigendum')
        WHERE b IS NOT NULL AND a IS DISTINCT FROM b""",
)
def corrections(spark: SparkSession, d: str) -> DataFrame:
    """What was corrected, reversible: both amounts are kept."""
    x = F.from_json("detail", "map<string,string>")
    e = table(spark, d, "tender_events").filter("event_type = 'corrigendum'").select(F.col("id").alias("event_id"), "tender_id", x["from"].try_cast(money.MONEY).alias("before_inr"), x["to"].try_cast(money.MONEY).alias("after_inr"))
    return e.filter("after_inr IS NOT NULL AND NOT (before_inr <=> after_inr)").withColumn("change_inr", (F.col("after_inr") - F.col("before_inr")).cast("decimal(38,6)"))


_TOWN = "lower(trim(coalesce(district, ''))) AS district, lower(trim(coalesce(municipality, ''))) AS town, id, first_detected_at, mjp_role, mjp_role_confidence, scheme, work_theme, approved_cost_inr, revised_cost_inr, funds_released_inr"


@query(
    "a24_projects_of_towns",
    f"""SELECT district, town, count(*) AS n_papers, arg_max(mjp_role, (coalesce(mjp_role_confidence, -1), id)) AS role, arg_min(scheme, (first_detected_at, id)) FILTER (WHERE trim(scheme) <> '') AS scheme,
        arg_min(work_theme, (first_detected_at, id)) FILTER (WHERE trim(work_theme) <> '' AND work_theme <> 'other') AS theme, arg_max(approved_cost_inr, (first_detected_at, id)) FILTER (WHERE approved_cost_inr IS NOT NULL) AS approved_inr,
        max(revised_cost_inr) AS revised_inr, CAST(coalesce(sum(funds_released_inr), 0) AS DECIMAL(38,2)) AS released_inr FROM (SELECT {_TOWN} FROM {PROJECTS}) GROUP BY 1, 2""",
)
def projects_of_towns(spark: SparkSession, d: str) -> DataFrame:
    """Approval papers rolled up to one project per district and town."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    p, at = A.projects(spark, d), F.struct("first_detected_at", "id")
    known = lambda c, more=F.lit(True): F.when((F.trim(c) != "") & more & F.col("first_detected_at").isNotNull(), at)
    return p.groupBy(low("district").alias("district"), low("municipality").alias("town")).agg(
        F.count("*").alias("n_papers"), F.max_by("mjp_role", F.struct(F.coalesce("mjp_role_confidence", F.lit(-1.0)), F.col("id"))).alias("role"), F.min_by("scheme", known("scheme")).alias("scheme"),
        F.min_by("work_theme", known("work_theme", F.col("work_theme") != "other")).alias("theme"), F.max_by("approved_cost_inr", F.when(F.col("approved_cost_inr").isNotNull(), at)).alias("approved_inr"),
        F.max("revised_cost_inr").alias("revised_inr"), money.known_sum(F.col("funds_released_inr")).alias("released_inr"),
    )


@query(
    "a25_distinct_works",
    f"SELECT lower(trim(district)) AS district, count(DISTINCT w) AS n_works, string_agg(DISTINCT w, '; ' ORDER BY w) AS works FROM (SELECT district, unnest(works_en) AS w FROM {PROJECTS}) WHERE w IS NOT NULL GROUP BY 1",
)
def distinct_works(spark: SparkSession, d: str) -> DataFrame:
    """The distinct works of a district, in order; repeats are dropped before they are put together."""
    x = A.projects(spark, d).select(F.lower(F.trim("district")).alias("district"), F.explode("works_en").alias("w")).filter("w IS NOT NULL").distinct()
    return x.groupBy("district").agg(F.count("*").alias("n_works"), F.array_join(F.array_sort(F.collect_list("w")), "; ").alias("works"))


@query(
    "w05_papers_in_order",
    f"SELECT id AS project_id, string_agg(coalesce(x.doc_code, '?'), ' > ' ORDER BY coalesce(x.issue_date, ''), coalesce(x.doc_code, '?')) AS papers FROM (SELECT id, unnest(documents) AS x FROM {PROJECTS}) GROUP BY 1",
)
def papers_in_order(spark: SparkSession, d: str) -> DataFrame:
    key = F.transform("documents", lambda x: F.struct(F.coalesce(x["issue_date"], F.lit("")).alias("day"), F.coalesce(x["doc_code"], F.lit("?")).alias("code")))
    return A.projects(spark, d).filter(F.size("documents") > 0).select(F.col("id").alias("project_id"), F.array_join(F.transform(F.array_sort(key), lambda x: x["code"]), " > ").alias("papers"))


@query(
    "w07_parts_by_size",
    """WITH RECURSIVE f AS (SELECT tender_id, doc_id, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY tender_id ORDER BY doc_id) AS k FROM documents WHERE tender_id IS NOT NULL AND text IS NOT NULL),
        r AS (SELECT tender_id, doc_id, size, k, 1 AS part, size AS used FROM f WHERE k = 1 UNION ALL SELECT f.tender_id, f.doc_id, f.size, f.k, CASE WHEN r.used > 0 AND r.used + f.size > 1500 THEN r.part + 1 ELSE r.part END,
            CASE WHEN r.used > 0 AND r.used + f.size > 1500 THEN f.size ELSE r.used + f.size END FROM r JOIN f ON f.tender_id = r.tender_id AND f.k = r.k + 1) SELECT tender_id, doc_id, size, part FROM r""",
)
def parts_by_size(spark: SparkSession, d: str) -> DataFrame:
    """A tender's papers in parts of at most 1500 characters; the papers of one tender are few."""
    files = table(spark, d, "documents").filter("tender_id IS NOT NULL AND text IS NOT NULL").select("tender_id", "doc_id", F.length("text").cast("bigint").alias("size"))
    return state.parts_by_size(files, "tender_id", "doc_id", "size", 1500)


@query("x04_entries_by_priority", f"""SELECT code, arg_min(origin, rank) AS origin FROM (SELECT doc_code AS code, 'listing' AS origin, 0 AS rank FROM documents UNION ALL SELECT u.x.doc_code, 'candidate', 1 FROM {PROJECTS} p, unnest(p.documents) AS u(x)
        UNION ALL SELECT primary_doc_code, 'seed', 2 FROM {PROJECTS}) WHERE code IS NOT NULL GROUP BY 1""")
def entries_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """Entries of three lists, each once, from the first list that has it."""
    p = A.projects(spark, d)
    lists = (table(spark, d, "documents").select(F.col("doc_code").alias("code")), p.select(F.explode("documents.doc_code").alias("code")), p.select(F.col("primary_doc_code").alias("code")))
    every = None
    for rank, (origin, df) in enumerate(zip(("listing", "candidate", "seed"), lists)):
        part = df.filter("code IS NOT NULL").select("code", F.struct(F.lit(rank).alias("rank"), F.lit(origin).alias("origin")).alias("from"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("code").agg(F.min("from").alias("m")).select("code", "m.origin")


_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^\pL\pM\pN]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query("x06_word_overlap", f"SELECT p.id AS project_id, w, len(list_intersect({_WORDS.format('p.title_en')}, {_WORDS.format('w')})) AS n_shared FROM (SELECT id, title_en, unnest(works_en) AS w FROM {PROJECTS}) p WHERE p.title_en IS NOT NULL AND w IS NOT NULL")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = A.projects(spark, d).select(F.col("id").alias("project_id"), "title_en", F.explode("works_en").alias("w")).filter("title_en IS NOT NULL AND w IS NOT NULL")
    return p.select("project_id", "w", F.size(F.array_intersect(text.word_set(F.col("title_en")), text.word_set(F.col("w")))).cast("bigint").alias("n_shared"))


@query("x07_words_within", f"SELECT id AS project_id, len(list_filter({_WORDS.format('municipality')}, lambda y: NOT list_contains({_WORDS.format('title_en')}, y))) = 0 AS within FROM {PROJECTS} WHERE municipality IS NOT NULL AND title_en IS NOT NULL")
def words_within(spark: SparkSession, d: str) -> DataFrame:
    p = A.projects(spark, d).filter("municipality IS NOT NULL AND title_en IS NOT NULL")
    return p.select(F.col("id").alias("project_id"), (F.size(F.array_except(text.word_set(F.col("municipality")), text.word_set(F.col("title_en")))) == 0).alias("within"))


@query("o04_newest_events", "SELECT id AS event_id, event_type, event_at FROM tender_events ORDER BY event_at DESC NULLS LAST, id DESC LIMIT 60")
def newest_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tender_events").orderBy(F.col("event_at").desc_nulls_last(), F.desc("id")).limit(60).select(F.col("id").alias("event_id"), "event_type", "event_at")


@query("o05_chosen_order", f"SELECT row_id, title FROM {TENDERS} ORDER BY lower(title) DESC NULLS LAST, row_id LIMIT 400")
def chosen_order(spark: SparkSession, d: str) -> DataFrame:
    return watch.sorted_list(tenders(spark, d).select("row_id", "title"), "title", True, "row_id", 400)


@query("o08_by_value", f"SELECT id, estimated_value_inr FROM {ONE} ORDER BY estimated_value_inr DESC NULLS LAST, id LIMIT 100")
def by_value(spark: SparkSession, d: str) -> DataFrame:
    t = one_per_tender(tenders(spark, d).select("id", "row_id", "last_seen_at", "estimated_value_inr"))
    return watch.sorted_list(t.select("id", "estimated_value_inr"), "estimated_value_inr", True, "id", 100)


@query("o09_sorted_facets", f"SELECT string_agg(DISTINCT lower(trim(district)), '|' ORDER BY lower(trim(district))) AS districts, string_agg(DISTINCT lower(trim(status)), '|' ORDER BY lower(trim(status))) AS states FROM {TENDERS}")
def sorted_facets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values are kept per task before they meet; spellings of places and states are far fewer than rows."""
    values = lambda c: F.array_join(F.array_sort(F.collect_set(F.lower(F.trim(c)))), "|")
    return tenders(spark, d).agg(values("district").alias("districts"), values("status").alias("states"))


@query(
    "o10_feed_order",
    f"""SELECT id AS project_id, day, last_checked_at FROM (SELECT id, last_checked_at, (SELECT max(u.x.issue_date) FROM unnest(documents) AS u(x)) AS day FROM {PROJECTS}) ORDER BY day DESC NULLS LAST, last_checked_at DESC NULLS LAST, id LIMIT 50""",
)
def feed_order(spark: SparkSession, d: str) -> DataFrame:
    p = A.projects(spark, d).select(F.col("id").alias("project_id"), F.array_max("documents.issue_date").alias("day"), "last_checked_at")
    return p.orderBy(F.col("day").desc_nulls_last(), F.col("last_checked_at").desc_nulls_last(), "project_id").limit(50)
