"""Queries: ledger projection, scopes, protection and calculation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions.text import is_valid_number
from ledgerlake.operators import calc, protect, scope
from ledgerlake.plans.registry import query
from ledgerlake.plans.sqlparts import FACTS, FY_KEY, protection, sum_result, values
from ledgerlake.sources import adapters as ad

GROUPS = [ad.GROUP]
REAL = "(SELECT * FROM facts WHERE NOT is_demo)"
YEARLY = f"(SELECT *, {FY_KEY} AS fiscal_year FROM facts WHERE NOT is_demo)"
SEMANTICS = values(
    [(m, s[0], "|".join(s[1]), s[2], s[3], s[4], s[5]) for m, s in dims.METRIC_SEMANTICS.items()],
    "m_code, m_unit, m_allowed, m_entity, m_time, m_sum, m_op")


def real(spark: SparkSession, sf: str) -> DataFrame:
    return ad.facts(spark, sf).filter(~F.col("is_demo"))


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Real facts with the fiscal year, which is one of the stored period keys."""
    return protect.with_period_keys(real(spark, sf)).withColumn("fiscal_year", F.col("k_fy"))


@query("ledger_facts", f"""WITH {FACTS}
SELECT fact_id, document_id, metric_code, org, field, site, reporting_period, numeric_value, unit,
  confidence_score, validation_status, is_demo, extraction_method, sheet_name,
  CAST(page_number AS INTEGER) AS page_number, CAST(row_number AS INTEGER) AS row_number,
  cell_reference, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM facts""")
def ledger_facts(spark, sf):
    return ad.facts(spark, sf).drop("temporal_grain", "human_verified").withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("scope_filter", f"""WITH {FACTS} SELECT fact_id, numeric_value, reporting_period FROM facts
WHERE metric_code = 'COAL_PRODUCTION' AND numeric_value IS NOT NULL AND org = 'NATION_7'
  AND NOT is_demo AND validation_status = 'VERIFIED'
  AND (contains(lower(reporting_period), '2017-18') OR reporting_period = 'FY 2017-18')""")
def scope_filter(spark, sf):
    s = scope.Scope("COAL_PRODUCTION", org="NATION_7", period="FY 2017-18", only_verified=True)
    return scope.apply_scope(ad.facts(spark, sf), s).select(
        "fact_id", "numeric_value", "reporting_period")


@query("period_contains", f"""WITH {FACTS} SELECT reporting_period, count(*) AS n FROM facts
WHERE contains(lower(reporting_period), '2018-19') GROUP BY 1""")
def period_contains(spark, sf):
    return (ad.facts(spark, sf)
            .filter(scope.period_matches(F.col("reporting_period"), "FY 2018-19"))
            .groupBy("reporting_period").agg(F.count("*").alias("n")))


@query("optional_filters", f"""WITH {FACTS} SELECT metric_code, count(*) AS n FROM facts
WHERE field = 'ASIA' GROUP BY 1""")
def optional_filters(spark, sf):
    return (scope.optional_filters(ad.facts(spark, sf), org="ALL", field="ASIA", period=None)
            .groupBy("metric_code").agg(F.count("*").alias("n")))


@query("valid_numbers", f"""WITH {FACTS} SELECT metric_code, count(*) AS n_valid FROM facts
WHERE numeric_value IS NOT NULL AND NOT isnan(numeric_value) AND NOT isinf(numeric_value)
GROUP BY 1""")
def valid_numbers(spark, sf):
    return (ad.facts(spark, sf).filter(is_valid_number(F.col("numeric_value")))
            .groupBy("metric_code").agg(F.count("*").alias("n_valid")))


@query("unit_mismatch", f"""WITH {FACTS}
SELECT metric_code, unit, coalesce(unit IS NOT NULL AND m_allowed <> ''
  AND NOT list_contains(string_split(m_allowed, '|'), unit), FALSE) AS unit_mismatch, count(*) AS n
FROM facts LEFT JOIN {SEMANTICS} s ON m_code = metric_code GROUP BY 1, 2, 3""")
def unit_mismatch(spark, sf):
    return (scope.unit_mismatch(ad.facts(spark, sf), dims.metrics_frame(spark))
            .groupBy("metric_code", "unit", "unit_mismatch").agg(F.count("*").alias("n")))


@query("metric_semantics", f"""WITH {FACTS}
SELECT metric_code, coalesce(m_unit, 'units') AS canonical_unit, coalesce(m_entity, TRUE) AS
  additive_entity, coalesce(m_time, TRUE) AS additive_time, coalesce(m_sum, TRUE) AS supports_sum,
  coalesce(m_op, 'SUM') AS default_op, count(*) AS n
FROM facts LEFT JOIN {SEMANTICS} s ON m_code = metric_code GROUP BY 1, 2, 3, 4, 5, 6""")
def metric_semantics(spark, sf):
    cols = ["canonical_unit", "additive_entity", "additive_time", "supports_sum", "default_op"]
    counts = ad.facts(spark, sf).groupBy("metric_code").agg(F.count("*").alias("n"))
    return counts.join(dims.metrics_frame(spark).select("metric_code", *cols), "metric_code", "left")


# --- protection ---


@query("dedup_exact", f"""WITH {FACTS}, {protection(REAL, "metric_code", exclude_group=False)}
SELECT fact_id, numeric_value FROM lab WHERE rn = 1""")
def dedup_exact(spark, sf):
    keyed = protect.with_protection_keys(real(spark, sf), GROUPS)
    return protect.drop_exact_duplicates(keyed, ["metric_code"]).select("fact_id", "numeric_value")


def _labelled(spark, sf, **kw):
    return protect.label_exclusions(
        real(spark, sf), scope_keys=["metric_code"], group_codes=GROUPS, **kw)


@query("group_overlap", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT fact_id FROM lab WHERE reason = 'CONSOLIDATED_OVERLAP'""")
def group_overlap(spark, sf):
    return protect.group_overlaps(real(spark, sf), scope_keys=["metric_code"], group_codes=GROUPS).select("fact_id")


@query("temporal_overlap", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT fact_id FROM lab WHERE reason = 'TEMPORAL_OVERLAP'""")
def temporal_overlap(spark, sf):
    return _labelled(spark, sf).filter(F.col("exclusion_reason") == protect.TEMPORAL).select(
        "fact_id")


@query("exclusion_ledger", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT metric_code, fact_id, reason AS exclusion_reason,
  CASE WHEN reason = 'EXACT_DUPLICATE' THEN winner END AS kept_fact_id
FROM lab WHERE reason IS NOT NULL""")
def exclusion_ledger(spark, sf):
    return protect.exclusions(real(spark, sf), scope_keys=["metric_code"], group_codes=GROUPS)


@query("protected_facts", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT metric_code, org, reporting_period, coalesce(reason, 'INCLUDED') AS outcome, count(*) AS n,
  sum(numeric_value) AS total FROM lab GROUP BY 1, 2, 3, 4""")
def protected_facts(spark, sf):
    return (_labelled(spark, sf)
            .groupBy("metric_code", "org", "reporting_period",
                     F.coalesce("exclusion_reason", F.lit("INCLUDED")).alias("outcome"))
            .agg(F.count("*").alias("n"), F.sum("numeric_value").alias("total")))


@query("answer_conflicts", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT metric_code, org, reporting_period, count(DISTINCT round(numeric_value, 2)) AS n_values,
  min(round(numeric_value, 2)) AS low, max(round(numeric_value, 2)) AS high
FROM lab WHERE reason IS NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT round(numeric_value, 2)) > 1""")
def answer_conflicts(spark, sf):
    return protect.value_conflicts(
        protect.included(real(spark, sf), scope_keys=["metric_code"], group_codes=GROUPS))


# --- calculation ---

RESULT = ["success", "error_code", "result", "unit", "evidence_total", "evidence_used",
          "evidence_excluded", "verified_count", "verified_pct", "data_scope"]
RESULT_SQL = ", ".join(RESULT)
ORG_YEAR = "org || '|' || metric_code || '|' || fiscal_year"
ORG_YEAR_COLS = "org, metric_code, fiscal_year"


def _by_org_year(spark, sf, op, **kw):
    return calc.calculate(
        yearly(spark, sf), dims.metrics_frame(spark), op, ["org", "metric_code", "fiscal_year"],
        group_codes=GROUPS, **kw).select("org", "metric_code", "fiscal_year", *RESULT)


def _sql_by_org_year(agg: str | None = None, refuse: bool = False, unit: str = "unit") -> str:
    cols = RESULT_SQL.replace("unit", f"{unit} AS unit", 1) if unit != "unit" else RESULT_SQL
    return (f"WITH {FACTS}, {sum_result(YEARLY, ORG_YEAR_COLS, ORG_YEAR, agg=agg, refuse=refuse)} "
            f"SELECT {ORG_YEAR_COLS}, {cols} FROM calc")


DEC = "CAST(numeric_value AS DECIMAL(20,6))"
AVG_SQL = f"round(sum({DEC}) / count(*), 4)"


@query("protected_sum", _sql_by_org_year(refuse=True))
def protected_sum(spark, sf):
    return _by_org_year(spark, sf, "SUM")


@query("protected_avg", _sql_by_org_year(AVG_SQL))
def protected_avg(spark, sf):
    return _by_org_year(spark, sf, "AVG")


@query("protected_wavg", _sql_by_org_year(
    "round(CAST(sum(CAST(numeric_value * confidence_score AS DECIMAL(20,6))) AS DOUBLE) / "
    "CAST(sum(CAST(confidence_score AS DECIMAL(20,6))) AS DOUBLE), 4)"))
def protected_wavg(spark, sf):
    return _by_org_year(spark, sf, "WAVG", weight=F.col("confidence_score"))


@query("protected_min", _sql_by_org_year("round(min(numeric_value), 4)"))
def protected_min(spark, sf):
    return _by_org_year(spark, sf, "MIN")


@query("protected_max", _sql_by_org_year("round(max(numeric_value), 4)"))
def protected_max(spark, sf):
    return _by_org_year(spark, sf, "MAX")


@query("protected_count", _sql_by_org_year("count(*)", unit="'facts'"))
def protected_count(spark, sf):
    return _by_org_year(spark, sf, "COUNT")


@query("protected_latest", _sql_by_org_year("last(numeric_value ORDER BY created_at, fact_id)"))
def protected_latest(spark, sf):
    return _by_org_year(spark, sf, "LATEST")


@query("conflict_refusal", f"""WITH {FACTS}, {sum_result(YEARLY, ORG_YEAR_COLS, ORG_YEAR)}
SELECT {ORG_YEAR_COLS} FROM calc WHERE error_code = 'CONFLICT'""")
def conflict_refusal(spark, sf):
    return protected_sum(spark, sf).filter(F.col("error_code") == "CONFLICT").select(
        "org", "metric_code", "fiscal_year")


@query("evidence_statistics", f"""WITH {FACTS},
{sum_result(YEARLY, "metric_code, fiscal_year", "metric_code || '|' || fiscal_year")}
SELECT metric_code, fiscal_year, evidence_total, evidence_used, evidence_excluded, verified_count,
  verified_pct FROM calc""")
def evidence_statistics(spark, sf):
    return calc.calculate(
        yearly(spark, sf), dims.metrics_frame(spark), "COUNT", ["metric_code", "fiscal_year"],
        group_codes=GROUPS).select(
            "metric_code", "fiscal_year", "evidence_total", "evidence_used", "evidence_excluded",
            "verified_count", "verified_pct")


@query("data_scope", f"""WITH {FACTS}, {sum_result(
    f"(SELECT *, {FY_KEY} AS fiscal_year FROM facts)", "site, metric_code, fiscal_year",
    "site || '|' || metric_code || '|' || fiscal_year")}
SELECT site, metric_code, fiscal_year, data_scope FROM calc""")
def data_scope(spark, sf):
    both = protect.with_period_keys(ad.facts(spark, sf)).withColumn("fiscal_year", F.col("k_fy"))
    keys = ["site", "metric_code", "fiscal_year"]
    return calc.calculate(both, dims.metrics_frame(spark), "COUNT", keys,
                          group_codes=GROUPS).select(*keys, "data_scope")


SCOPES_SQL = f"""scopes AS (
SELECT DISTINCT metric_code || '|' || org || '|' || p AS scope_id, metric_code, org, p AS period
FROM (SELECT metric_code, org, unnest([reporting_period, 'FY 2031-32', 'Apr 2018']) AS p FROM facts
      WHERE validation_status = 'VERIFIED'))"""
SCOPED_SQL = """(SELECT f.*, s.scope_id FROM facts f JOIN scopes s ON f.metric_code = s.metric_code
  AND f.org = s.org AND (contains(lower(f.reporting_period), lower(trim(replace(s.period, 'FY ', ''))))
    OR f.reporting_period = s.period) WHERE NOT f.is_demo)"""


def _scopes(spark, sf):
    f = ad.facts(spark, sf).filter(F.col("validation_status") == "VERIFIED")
    periods = F.explode(F.array("reporting_period", F.lit("FY 2031-32"), F.lit("Apr 2018")))
    s = f.select("metric_code", "org", periods.alias("period")).distinct()
    return s.withColumn("scope_id", F.concat_ws("|", "metric_code", "org", "period"))


@query("calculate_scopes", f"""WITH {FACTS}, {SCOPES_SQL},
{sum_result(SCOPED_SQL, "scope_id, metric_code", "scope_id")}
SELECT scopes.scope_id, scopes.metric_code, coalesce(success, FALSE) AS success,
  CASE WHEN calc.scope_id IS NULL THEN 'NO_VERIFIED_EVIDENCE' ELSE error_code END AS error_code, result,
  coalesce(evidence_used, 0) AS evidence_used, coalesce(data_scope, CASE WHEN EXISTS (
    SELECT 1 FROM facts d WHERE d.is_demo AND d.metric_code = scopes.metric_code
      AND d.org = scopes.org AND (contains(lower(d.reporting_period),
        lower(trim(replace(scopes.period, 'FY ', '')))) OR d.reporting_period = scopes.period))
    THEN 'DEMO_DATA' ELSE 'UNKNOWN' END) AS data_scope
FROM scopes LEFT JOIN calc USING (scope_id)""")
def calculate_scopes(spark, sf):
    """Every (metric, organisation, period) asked for at once; one fact serves several scopes."""
    f, s = protect.with_period_keys(ad.facts(spark, sf)), _scopes(spark, sf)
    scoped = scope.apply_scopes(f, s, ["metric_code", "org"], ("year", "text"))
    res = calc.calculate(scoped.filter(~F.col("is_demo")), dims.metrics_frame(spark), "SUM",
                         ["scope_id", "metric_code"], group_codes=GROUPS)
    return calc.with_empty_scopes(res, s, scoped.filter("is_demo")).select(
        "scope_id", "metric_code", "success", "error_code", "result", "evidence_used", "data_scope")


@query("achievement", f"""WITH {FACTS}, {sum_result(YEARLY, ORG_YEAR_COLS, ORG_YEAR)},
a AS (SELECT * FROM calc WHERE metric_code = 'COAL_PRODUCTION'),
t AS (SELECT * FROM calc WHERE metric_code = 'PRODUCTION_TARGET'),
j AS (SELECT a.org, a.fiscal_year, a.result AS actual, t.result AS target,
  CASE WHEN NOT a.success THEN a.error_code WHEN t.success IS NULL OR NOT t.success
    THEN 'MISSING_TARGET' WHEN t.result = 0 THEN 'ZERO_DENOMINATOR' END AS error_code,
  a.evidence_used AS au, t.evidence_used AS tu, a.verified_count AS av, t.verified_count AS tv
  FROM a LEFT JOIN t USING (org, fiscal_year))
SELECT org, fiscal_year, error_code IS NULL AS success, error_code, actual, target,
  CASE WHEN error_code IS NULL THEN round(actual * 100 / target, 2) END AS achievement_pct,
  au + CASE WHEN error_code IS NULL THEN tu ELSE 0 END AS evidence_used,
  av + CASE WHEN error_code IS NULL THEN tv ELSE 0 END AS verified_count FROM j""")
def achievement(spark, sf):
    """Actual and target come out of one calculation pass, then meet on (organisation, year)."""
    keys = ["org", "fiscal_year"]
    f = yearly(spark, sf).filter(F.col("metric_code").isin("COAL_PRODUCTION", "PRODUCTION_TARGET"))
    res = calc.calculate(f, dims.metrics_frame(spark), "SUM", ["metric_code", *keys],
                         group_codes=GROUPS)
    out = calc.achievement(res.filter(F.col("metric_code") == "COAL_PRODUCTION"),
                           res.filter(F.col("metric_code") == "PRODUCTION_TARGET"), keys)
    return out.select(*keys, "success", "error_code", "actual", "target", "achievement_pct",
                      "evidence_used", "verified_count")


@query("scope_warnings", f"""WITH {FACTS},
a AS (SELECT DISTINCT site, org, reporting_period AS p FROM facts WHERE metric_code = 'COAL_PRODUCTION'),
t AS (SELECT site, min(org) AS t_org, max(reporting_period) AS t_p FROM facts
      WHERE metric_code = 'PRODUCTION_TARGET' GROUP BY site)
SELECT a.site, p, concat_ws(' | ', CASE WHEN org IS DISTINCT FROM t_org THEN 'SCOPE_MISMATCH org' END,
  CASE WHEN p IS DISTINCT FROM t_p THEN 'SCOPE_MISMATCH period' END) AS warnings
FROM a LEFT JOIN t USING (site)""")
def scope_warnings(spark, sf):
    f = ad.facts(spark, sf)
    a = (f.filter(F.col("metric_code") == "COAL_PRODUCTION")
         .select("site", "org", F.col("reporting_period").alias("p")).distinct())
    t = (f.filter(F.col("metric_code") == "PRODUCTION_TARGET").groupBy("site")
         .agg(F.min("org").alias("t_org"), F.max("reporting_period").alias("t_p")))
    return a.join(t, "site", "left").select(
        "site", "p", calc.scope_warnings(F.col("org"), F.col("t_org"), F.col("p"), F.col("t_p"))
        .alias("warnings"))


@query("entity_totals", f"""WITH {FACTS}, {sum_result(REAL, "org, metric_code", "org || '|' || metric_code")}
SELECT org, metric_code, result, evidence_used, verified_pct,
  rank() OVER (PARTITION BY metric_code ORDER BY result DESC) AS place FROM calc WHERE success""")
def entity_totals(spark, sf):
    return calc.by_entity(real(spark, sf), dims.metrics_frame(spark), group_codes=GROUPS).select(
        "org", "metric_code", "result", "evidence_used", "verified_pct",
        F.col("place").cast("bigint").alias("place"))


TREND_SQL = """(SELECT f.*, s.p AS period FROM facts f
  JOIN (SELECT DISTINCT metric_code AS m, reporting_period AS p FROM facts
        WHERE NOT is_demo AND reporting_period LIKE 'FY%') s
  ON f.metric_code = s.m AND contains(lower(f.reporting_period), lower(replace(s.p, 'FY ', '')))
  WHERE NOT f.is_demo)"""


@query("historical_trend", f"""WITH {FACTS},
{sum_result(TREND_SQL, "metric_code, period", "metric_code || '|' || period")}
SELECT metric_code, period, result, evidence_used, verified_pct FROM calc WHERE success""")
def historical_trend(spark, sf):
    return calc.trend(real(spark, sf), dims.metrics_frame(spark), group_codes=GROUPS).select(
        "metric_code", "period", "result", "evidence_used", "verified_pct")


@query("historical_trend_by_org", f"""WITH {FACTS},
{sum_result(TREND_SQL, "metric_code, period, org", "metric_code || '|' || period || '|' || org")}
SELECT metric_code, org, period, result, evidence_used, verified_pct FROM calc WHERE success""")
def historical_trend_by_org(spark, sf):
    return calc.trend(real(spark, sf), dims.metrics_frame(spark), per_org=True,
                      group_codes=GROUPS).select(
        "metric_code", "org", "period", "result", "evidence_used", "verified_pct")


@query("reconciliation", f"""WITH {FACTS}, {sum_result(YEARLY, ORG_YEAR_COLS, ORG_YEAR)},
s AS (SELECT metric_code, fiscal_year,
  sum(CAST(result AS DECIMAL(20,6))) FILTER (org <> '{ad.GROUP}') AS parts,
  sum(CAST(result AS DECIMAL(20,6))) FILTER (org = '{ad.GROUP}') AS whole
  FROM calc WHERE success GROUP BY 1, 2)
SELECT metric_code, fiscal_year, CAST(round(parts, 3) AS DOUBLE) AS parts_total,
  CAST(whole AS DOUBLE) AS group_total,
  round(CAST(abs(parts - whole) * 100 AS DOUBLE) / CAST(greatest(whole, 0.001) AS DOUBLE), 2) AS discrepancy_pct,
  coalesce(round(CAST(abs(parts - whole) * 100 AS DOUBLE) / CAST(greatest(whole, 0.001) AS DOUBLE), 2) <= 2, TRUE)
    AS passed FROM s""")
def reconciliation(spark, sf):
    return calc.reconcile(_by_org_year(spark, sf, "SUM"), GROUPS, ["metric_code", "fiscal_year"])


@query("parts_versus_year", f"""WITH {FACTS}, k AS (SELECT *, {FY_KEY} AS fiscal_year FROM facts),
s AS (SELECT org, metric_code, fiscal_year,
  sum(numeric_value) FILTER (NOT regexp_matches(reporting_period, 'FY')) AS m,
  sum(numeric_value) FILTER (reporting_period LIKE 'FY%') AS a FROM k GROUP BY 1, 2, 3)
SELECT org, metric_code, fiscal_year, m AS monthly_total, a AS annual_total,
  CASE WHEN m IS NOT NULL AND a IS NOT NULL THEN round(abs(m - a) * 100 / greatest(a, 0.001), 2) END
    AS discrepancy_pct FROM s""")
def parts_versus_year(spark, sf):
    return calc.parts_versus_year(ad.facts(spark, sf), GROUPS)
