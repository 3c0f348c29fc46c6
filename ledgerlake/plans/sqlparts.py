"""Shared WITH-parts of the SQL statements: the ledger projection and the protection steps."""

from __future__ import annotations

from ledgerlake import dims
from ledgerlake.sources import adapters as ad


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return text(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def lst(items: list[str]) -> str:
    return "[" + ", ".join(text(i) for i in items) + "]"


FACTS = """facts AS (
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)),
         CAST(round(l_extendedprice * 100) AS BIGINT)) AS fact_id,
  CAST(CASE WHEN round(l_tax * 100) = 8 AND round(l_discount * 100) = 10 AND l_quantity = 50
       THEN l_suppkey + 100000 ELSE l_suppkey END AS VARCHAR) AS document_id,
  CASE WHEN l_returnflag = 'N' THEN 'COAL_PRODUCTION'
       WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'PRODUCTION_TARGET'
       WHEN l_returnflag = 'R' THEN 'OVERBURDEN_REMOVAL'
       WHEN l_linestatus = 'O' THEN 'COAL_OFFTAKE'
       WHEN l_linenumber <= 5 THEN 'COAL_STOCK' ELSE 'DRILLING' END AS metric_code,
  n_name AS org, r_name AS field, s_name AS site,
  CASE WHEN l_linenumber <= 3 THEN fy
       WHEN l_linenumber <= 5 THEN 'Q' || quarter(fiscal) || ' ' || fy
       ELSE strftime(moved, '%b %Y') END AS reporting_period,
  CAST(NULL AS VARCHAR) AS temporal_grain,
  CAST(floor(l_extendedprice / 10000) * 10 AS DOUBLE) AS numeric_value,
  CASE WHEN l_quantity = 50 THEN NULL WHEN l_quantity >= 45 THEN 'BCM' ELSE 'MT' END AS unit,
  (round(l_discount * 100) * 4 + 55) / 100 AS confidence_score,
  CASE WHEN round(l_tax * 100) >= 6 THEN 'VERIFIED' WHEN round(l_tax * 100) >= 3 THEN 'NEEDS_REVIEW'
       ELSE 'REVIEW_REQUIRED' END AS validation_status,
  round(l_tax * 100) >= 6 AS human_verified,
  l_quantity = 1 AS is_demo,
  CASE WHEN l_linestatus = 'O' THEN 'STRUCTURED_TABLE' WHEN l_quantity < 30 THEN 'REGEX_PATTERN'
       ELSE 'OCR_BLOCK' END AS extraction_method,
  CASE WHEN l_linestatus = 'O' THEN 'Sheet' || (l_linenumber % 3 + 1) END AS sheet_name,
  CASE WHEN l_linestatus <> 'O' AND l_quantity >= 3 THEN l_partkey % 40 + 1 END AS page_number,
  CASE WHEN l_linestatus = 'O' THEN l_linenumber + 1 END AS row_number,
  CASE WHEN l_linestatus = 'O' THEN chr(CAST(65 + l_linenumber AS INTEGER)) || (l_linenumber + 1) END
    AS cell_reference,
  CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_seconds(CAST(l_orderkey % 86400 AS INTEGER))
    AS created_at
FROM (SELECT *, 'FY ' || year(fiscal) || '-' || lpad(CAST((year(fiscal) + 1) % 100 AS VARCHAR), 2, '0')
        AS fy
      FROM (SELECT *, CAST(l_shipdate AS DATE) + INTERVAL 240 MONTH AS moved,
              CAST(l_shipdate AS DATE) + INTERVAL 240 MONTH - INTERVAL 3 MONTH AS fiscal
            FROM lineitem)) li
LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey)"""

GRAIN = """CASE WHEN reporting_period IS NULL OR reporting_period = '' THEN 'ANY'
  WHEN regexp_matches(upper(reporting_period), 'Q[1-4]|QUARTER') THEN 'QUARTERLY'
  WHEN regexp_matches(upper(reporting_period), '^\\s*FY\\s*\\d{4}-\\d{2}\\s*$') THEN 'ANNUAL'
  WHEN regexp_matches(upper(reporting_period),
    'JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC|-0[1-6]') THEN 'MONTHLY'
  WHEN regexp_matches(upper(reporting_period), 'FY|ANNUAL|20\\d{2}-\\d{2}') THEN 'ANNUAL'
  ELSE 'ANY' END"""

PERIOD_KEY = """CASE WHEN regexp_matches(reporting_period, '20\\d{2}[-/]\\d{2}')
  THEN 'FY ' || regexp_extract(reporting_period, '(20\\d{2})[-/](\\d{2,4})', 1) || '-' ||
    right(regexp_extract(reporting_period, '(20\\d{2})[-/](\\d{2,4})', 2), 2)
  ELSE upper(trim(coalesce(reporting_period, ''))) END"""

MONTH_NO = """list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'],
  upper(left(reporting_period, 3)))"""
# the test periods are `FY y-y`, `Qn FY y-y` and `Mon y`
FY_KEY = f"""CASE WHEN regexp_matches(reporting_period, '20\\d{{2}}-\\d{{2}}')
  THEN regexp_extract(reporting_period, '20\\d{{2}}-\\d{{2}}')
  WHEN {MONTH_NO} >= 4 THEN right(reporting_period, 4) || '-' ||
    lpad(CAST((CAST(right(reporting_period, 4) AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0')
  ELSE (CAST(right(reporting_period, 4) AS INTEGER) - 1) || '-' || right(reporting_period, 2) END"""


def protection(source: str, scope: str = "1", group: str = f"'{ad.GROUP}'",
               exclude_group: bool = True) -> str:
    """CTEs cand -> lab; `lab` has one row per candidate with its reason. `scope` is an expression."""
    group_rule = ("is_group AND max(CASE WHEN NOT is_group AND coalesce(org, '') <> '' "
                  "THEN 1 ELSE 0 END) OVER (PARTITION BY scope) = 1" if exclude_group else "FALSE")
    return f"""cand AS (
SELECT *, {scope} AS scope, {GRAIN} AS grain, {PERIOD_KEY} AS pk, {FY_KEY} AS fk,
  coalesce(upper(org), '') IN ({group}) AS is_group FROM {source} WHERE numeric_value IS NOT NULL),
dup AS (
SELECT *, row_number() OVER w AS rn, first_value(fact_id) OVER w AS winner, {group_rule} AS gdrop
FROM cand
WINDOW w AS (PARTITION BY scope, upper(org), metric_code, pk, upper(site), round(numeric_value, 3)
  ORDER BY (validation_status = 'VERIFIED') DESC, confidence_score DESC, created_at, fact_id)),
lab AS (
SELECT *, CASE WHEN rn > 1 THEN 'EXACT_DUPLICATE' WHEN gdrop THEN 'CONSOLIDATED_OVERLAP'
  WHEN grain IN ('MONTHLY', 'QUARTERLY') AND
    max(CASE WHEN rn = 1 AND NOT gdrop AND grain = 'ANNUAL' THEN 1 ELSE 0 END) OVER
      (PARTITION BY scope, upper(org), metric_code, fk, upper(site)) = 1
  THEN 'TEMPORAL_OVERLAP' END AS reason FROM dup)"""


def sum_result(source: str, scope_cols: str, scope: str, group: str = f"'{ad.GROUP}'",
               exclude_group: bool = True, agg: str | None = None, extra: str = "",
               refuse: bool = True) -> str:
    """CTEs cand, dup, lab, conf, calc: a protected aggregate per scope."""
    agg = agg or "round(sum(CAST(numeric_value AS DECIMAL(20,6))), 4)"
    semantics = values(
        [(m, s[0], s[4]) for m, s in dims.METRIC_SEMANTICS.items()], "m_code, m_unit, m_sum")
    unsupported = "WHEN NOT coalesce(any_value(m_sum), TRUE) THEN 'UNSUPPORTED_OPERATION'" if refuse else ""
    return f"""{protection(source, scope, group, exclude_group)},
conf AS (
SELECT DISTINCT scope FROM (
  SELECT scope FROM lab WHERE reason IS NULL
  GROUP BY scope, coalesce(upper(org), ''), metric_code, upper(coalesce(reporting_period, '')),
    upper(coalesce(temporal_grain, '')), upper(coalesce(site, ''))
  HAVING count(*) > 1 AND count(DISTINCT document_id) > 1
    AND count(DISTINCT round(numeric_value, 2)) > 1)),
tot AS (SELECT scope, count(*) AS evidence_total FROM lab GROUP BY scope),
calc0 AS (
SELECT {scope_cols}, lab.scope,
  CASE WHEN any_value(conf.scope) IS NOT NULL THEN 'CONFLICT' {unsupported} END AS error_code,
  CAST({agg} AS DOUBLE) AS raw_result, coalesce(any_value(m_unit), 'units') AS unit{extra},
  count(*) AS evidence_used, count(*) FILTER (validation_status = 'VERIFIED') AS verified_count,
  CASE WHEN count(*) FILTER (is_demo) = 0 THEN 'REAL_UPLOADED_DATA'
       WHEN count(*) FILTER (is_demo) = count(*) THEN 'DEMO_DATA' ELSE 'MIXED_WARNING' END AS data_scope
FROM lab LEFT JOIN conf USING (scope) LEFT JOIN {semantics} sem ON m_code = metric_code
WHERE reason IS NULL GROUP BY {scope_cols}, lab.scope),
calc AS (
SELECT calc0.*, tot.evidence_total, tot.evidence_total - evidence_used AS evidence_excluded,
  CASE WHEN error_code IS NULL THEN raw_result END AS result, error_code IS NULL AS success,
  CAST(round(CAST(verified_count * 100 AS DECIMAL(20,6)) / evidence_used, 1) AS DOUBLE) AS verified_pct
FROM calc0 JOIN tot USING (scope))"""
