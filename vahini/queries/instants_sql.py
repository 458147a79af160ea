"""SQL that reads typed timestamps, an independent statement of the conventions in ``vahini.functions.dates``."""

from __future__ import annotations

_ZONE = r"(z|[a-z]{3,4}|[+-][0-9]{2}:?[0-9]{2})?"
_TAIL = rf"(?:(?:t|\s|,|at)+([0-9]{{1,2}})[:.]([0-9]{{2}})(?:[:.]([0-9]{{2}})(\.[0-9]{{1,9}})?)?\s*(am|pm)?\s*{_ZONE})?$"
YEAR_FIRST = rf"^([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}}){_TAIL}"
DAY_FIRST = rf"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?([0-9]{{1,2}})(?:st|nd|rd|th)?[-/. ]([0-9]{{1,2}}|[a-z]{{3,9}})[-/. ]([0-9]{{4}}|[0-9]{{2}}){_TAIL}"
COMPACT = rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})t([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})?(\.[0-9]{{1,9}})?()" + _ZONE + "$"
# Minutes east of Greenwich.
OFFSETS = {"z": 0, "utc": 0, "gmt": 0, "ist": 330, "est": -300, "edt": -240, "cet": 60, "cest": 120, "bst": 60, "cst": -360, "cdt": -300, "pst": -480, "pdt": -420, "mst": -420, "mdt": -360}
_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def instants(cells: str) -> str:
    """CTEs ending in ``instants``: the columns of ``cells`` (a query with v and zone among them) and ts_us, NULL where unreadable."""
    group = lambda i, j=None: f"CASE f WHEN 'y' THEN regexp_extract(s, '{YEAR_FIRST}', {i}) WHEN 'd' THEN regexp_extract(s, '{DAY_FIRST}', {j or i}) WHEN 'c' THEN regexp_extract(s, '{COMPACT}', {i}) END"
    offset = " ".join(f"WHEN '{k}' THEN {v}" for k, v in OFFSETS.items())
    return f"""cells AS ({cells}),
    plain AS (SELECT *, lower(trim(regexp_replace(translate(v, '०१२३४५६७८९', '0123456789'), '\\s+', ' ', 'g'))) AS s FROM cells),
    forms AS (SELECT *, CASE WHEN regexp_matches(s, '^[0-9]{{1,15}}$') THEN 'n' WHEN regexp_matches(s, '{YEAR_FIRST}') THEN 'y' WHEN regexp_matches(s, '{DAY_FIRST}') THEN 'd' WHEN regexp_matches(s, '{COMPACT}') THEN 'c' END AS f FROM plain),
    parts AS (SELECT *, {group(1, 3)} AS ye, {group(2)} AS mo, {group(3, 1)} AS da, {group(4)} AS ho, {group(5)} AS mi, {group(6)} AS se, {group(7)} AS fr, {group(8)} AS ap, {group(9)} AS zo FROM forms),
    nums AS (SELECT *, CASE WHEN length(ye) = 2 THEN 2000 + CAST(ye AS INT) ELSE try_cast(ye AS INT) END AS y_, coalesce(try_cast(mo AS INT), CAST(list_position({_MONTHS}, substr(mo, 1, 3)) AS INT)) AS m_, try_cast(da AS INT) AS d_,
        CASE WHEN ap = '' OR ap IS NULL THEN coalesce(try_cast(nullif(ho, '') AS INT), 0) WHEN CAST(ho AS INT) BETWEEN 1 AND 12 THEN CAST(ho AS INT) % 12 + CASE WHEN ap = 'pm' THEN 12 ELSE 0 END END AS h_ FROM parts),
    walls AS (SELECT *, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y_, m_, d_, h_, coalesce(try_cast(nullif(mi, '') AS INT), 0), coalesce(try_cast(nullif(se, '') AS INT), 0)) || substr(coalesce(fr, ''), 1, 7) AS TIMESTAMP) AS wall FROM nums),
    zoned AS (SELECT *, CASE WHEN zo = '' OR zo IS NULL THEN NULL WHEN regexp_matches(zo, '^[+-]') THEN (CASE WHEN zo[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(zo, 2, 2) AS INT) * 60 + CAST(right(zo, 2) AS INT)) ELSE CASE zo {offset} END END AS shift FROM walls),
    local AS (SELECT *, CASE WHEN (zo = '' OR zo IS NULL) AND zone <> '+05:30' THEN epoch_us(timezone(zone, wall)) END AS first_us FROM zoned),
    instants AS (SELECT *, CASE WHEN f = 'n' THEN CASE WHEN length(s) < 12 THEN CAST(s AS BIGINT) * 1000000 ELSE CAST(s AS BIGINT) * 1000 END WHEN wall IS NULL OR (zo <> '' AND shift IS NULL) THEN NULL WHEN shift IS NOT NULL THEN epoch_us(wall) - CAST(shift AS BIGINT) * 60000000
        WHEN zone = '+05:30' THEN epoch_us(wall) - 19800000000 WHEN timezone(zone, make_timestamptz(first_us - 3600000000)) = wall THEN first_us - 3600000000 ELSE first_us END AS ts_us FROM local)"""


_TENDER_CELL = "SELECT 'tenders' AS table_name, row_id AS row_key, '{0}' AS field_name, {0} AS v, {1} AS zone FROM (SELECT DISTINCT ON (row_id) * FROM tenders) WHERE {0} IS NOT NULL"
P3_CELLS = " UNION ALL ".join(
    [_TENDER_CELL.format("publish_date", "'+05:30'"), _TENDER_CELL.format("bid_submission_end", "'+05:30'"), _TENDER_CELL.format("first_seen_at", "coalesce(crawler_zone, '+05:30')")]
    + ["SELECT 'awards', id, 'award_date', award_date, '+05:30' FROM (SELECT DISTINCT ON (id) * FROM awards) WHERE award_date IS NOT NULL"]
)
P3_FOUND = f"WITH {instants(P3_CELLS)} SELECT table_name, row_key, field_name, ts_us FROM instants WHERE ts_us IS NOT NULL"
_SWAPPED = "try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y_, d_, m_, h_, coalesce(try_cast(nullif(mi, '') AS INT), 0), coalesce(try_cast(nullif(se, '') AS INT), 0)) AS TIMESTAMP)"
P3_FORMATS = f"""WITH {instants(P3_CELLS)}, named AS (SELECT table_name, field_name, CASE WHEN f = 'n' THEN CASE WHEN length(s) < 12 THEN 's' ELSE 'ms' END WHEN f = 'y' THEN 'ymd' WHEN f = 'c' THEN 'compact' WHEN NOT regexp_matches(mo, '^[0-9]') THEN 'd-mon-y' WHEN ts_us IS NULL THEN 'mdy' ELSE 'dmy' END AS fmt, ts_us IS NULL AS against
    FROM instants WHERE ts_us IS NOT NULL OR (f = 'd' AND regexp_matches(mo, '^[0-9]') AND (zo = '' OR zo IS NULL OR shift IS NOT NULL) AND {_SWAPPED} IS NOT NULL))
    SELECT table_name, field_name, fmt, count(*) AS n_values, count(*) FILTER (WHERE against) AS n_against_rule FROM named GROUP BY 1, 2, 3"""

_TEXT = "nullif(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '')"
_SNAPS = f"""WITH {instants("SELECT *, bid_submission_end AS v, '+05:30' AS zone FROM tender_snapshots")},
    rows AS (SELECT snapshot_id, source_portal, upper(trim(source_tender_id)) AS source_tender_id, {_TEXT.format('title')} AS title, {_TEXT.format('status')} AS status, estimated_value_inr AS value, ts_us, last_seen_at FROM instants),
    last AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY snapshot_id, source_portal, source_tender_id ORDER BY last_seen_at DESC NULLS LAST) = 1),
    pairs AS (SELECT coalesce(n.snapshot_id, o.snapshot_id + 1) AS snapshot_id, coalesce(n.source_portal, o.source_portal) AS source_portal, coalesce(n.source_tender_id, o.source_tender_id) AS source_tender_id,
        CASE WHEN o.snapshot_id IS NULL THEN 'added' WHEN n.snapshot_id IS NULL THEN 'removed' WHEN o.title IS DISTINCT FROM n.title OR o.status IS DISTINCT FROM n.status OR o.value IS DISTINCT FROM n.value OR o.ts_us IS DISTINCT FROM n.ts_us THEN 'changed' END AS change_kind,
        CASE WHEN n.snapshot_id IS NULL THEN o.status ELSE n.status END AS status
        FROM last n FULL JOIN last o ON o.snapshot_id = n.snapshot_id - 1 AND o.source_portal IS NOT DISTINCT FROM n.source_portal AND o.source_tender_id IS NOT DISTINCT FROM n.source_tender_id),
    changes AS (SELECT * FROM pairs WHERE change_kind IS NOT NULL AND snapshot_id BETWEEN (SELECT min(snapshot_id) + 1 FROM rows) AND (SELECT max(snapshot_id) FROM rows))"""
P7_FOUND = f"{_SNAPS} SELECT CAST(snapshot_id AS INT) AS snapshot_id, source_portal, source_tender_id, change_kind FROM changes"
P7_COUNTS = f"{_SNAPS} SELECT CAST(snapshot_id AS INT) AS snapshot_id, change_kind, status, count(*) AS n_changes FROM changes GROUP BY 1, 2, 3"
