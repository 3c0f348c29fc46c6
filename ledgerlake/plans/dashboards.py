"""Queries: dashboard aggregates, top-k, paging, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.text import label
from ledgerlake.operators import analytics as an
from ledgerlake.operators import conflicts as cf
from ledgerlake.operators import protect, ranking
from ledgerlake.plans.calculation import GROUPS, REAL, real
from ledgerlake.plans.ledger_writes import (
    CONFLICTS, DOC_STATUS, ISSUE_STATE, ISSUES, issue_state)
from ledgerlake.plans.registry import query
from ledgerlake.plans.sqlparts import FACTS, GRAIN, protection
from ledgerlake.sources import adapters as ad

DEC = "CAST(numeric_value AS DECIMAL(20,6))"


def ms(code: str) -> str:
    return f"sum({DEC}) FILTER (metric_code = '{code}')"


P, T, D = ms("COAL_PRODUCTION"), ms("PRODUCTION_TARGET"), ms("COAL_OFFTAKE")


def r(x: str, n: int = 1) -> str:
    return f"CAST(round({x}, {n}) AS DOUBLE)"


def pct(num: str, den: str, n: int = 1) -> str:
    return f"CASE WHEN {den} > 0 THEN round(CAST({num} AS DOUBLE) * 100 / CAST({den} AS DOUBLE), {n}) END"


def spine(spark, sf):
    return ad.read_table(spark, sf, "nation").select(F.col("n_name").alias("org"))


@query("kpi_row", f"""WITH {FACTS}, {ISSUES}, {ISSUE_STATE}, {CONFLICTS}
SELECT * FROM (SELECT count(*) AS facts_extracted,
  count(*) FILTER (validation_status = 'VERIFIED') AS verified_evidence,
  CAST(round(sum(CAST(confidence_score AS DECIMAL(10,6))) / count(*), 4) AS DOUBLE) AS average_confidence,
  count(DISTINCT org) FILTER (org NOT IN ('{ad.GROUP}', '{ad.INSTITUTE}')) AS active_entities FROM facts),
 (SELECT count(*) FILTER ({DOC_STATUS} IN ('READY', 'COMPLETED_WITH_WARNINGS', 'INDEXING'))
    AS documents_processed FROM documents),
 (SELECT count(*) FILTER (issue_status <> 'RESOLVED') AS pending_reviews FROM state),
 (SELECT count(*) AS true_conflicts FROM conflicts), (SELECT count(DISTINCT org) AS reports_generated FROM facts)""")
def kpi_row(spark, sf):
    f = ad.facts(spark, sf)
    reports = f.filter("org IS NOT NULL").select("org").distinct()  # one report an organisation
    return an.kpis(f, ad.documents(spark, sf), issue_state(spark, sf), cf.contradictions(f),
                   [ad.GROUP, ad.INSTITUTE], reports)


@query("entity_summary", f"""WITH {FACTS} SELECT org, count(*) AS fact_count,
  count(DISTINCT field) AS field_count, {r(f"coalesce({P}, 0)")} AS production FROM facts
WHERE org IS NOT NULL GROUP BY org ORDER BY fact_count DESC, org LIMIT 10""")
def entity_summary(spark, sf):
    return an.entity_summary(ad.facts(spark, sf))


@query("top_metrics", f"""WITH {FACTS} SELECT metric_code, count(*) AS n FROM facts GROUP BY 1
ORDER BY n DESC, metric_code LIMIT 8""")
def top_metrics(spark, sf):
    return an.count_by(ad.facts(spark, sf), "metric_code", k=8)


TREND = f"""SELECT reporting_period, {r(P)} AS production, {r(T)} AS target, {r(D)} AS dispatch
FROM {{src}} WHERE reporting_period LIKE 'FY%' GROUP BY 1"""


def trend_sql(ctes: str, src: str) -> str:
    return f"""WITH {ctes}, t AS ({TREND.format(src=src)})
SELECT *, {pct("production", "target")} AS achievement_pct FROM t WHERE production IS NOT NULL"""


@query("multi_year_trend", trend_sql(FACTS, "facts"))
def multi_year_trend(spark, sf):
    return an.period_pivot(ad.facts(spark, sf))


@query("multi_year_trend_protected", trend_sql(
    f"{FACTS}, {protection(REAL, 'metric_code')}", "(SELECT * FROM lab WHERE reason IS NULL)"))
def multi_year_trend_protected(spark, sf):
    """The same table over protected facts."""
    return an.period_pivot(protect.included(
        real(spark, sf), scope_keys=["metric_code"], group_codes=GROUPS))


@query("target_vs_actual", f"""WITH {FACTS}, g AS (SELECT org, {P} AS act, {T} AS tgt FROM facts GROUP BY 1)
SELECT n_name AS org, {r("coalesce(act, 0)")} AS actual, CASE WHEN tgt > 0 THEN {r("tgt")} END AS target,
  CASE WHEN tgt > 0 THEN {r("coalesce(act, 0) - tgt")} END AS variance,
  {pct("coalesce(act, 0)", "tgt")} AS achievement_pct FROM nation LEFT JOIN g ON org = n_name""")
def target_vs_actual(spark, sf):
    return an.target_vs_actual(spine(spark, sf), ad.facts(spark, sf))


@query("production_vs_dispatch", f"""WITH {FACTS}, g AS (SELECT org, {P} AS p, {D} AS d FROM facts GROUP BY 1)
SELECT n_name AS org, {r("coalesce(p, 0)")} AS production, {r("coalesce(d, 0)")} AS dispatch,
  {r("coalesce(p, 0) - coalesce(d, 0)")} AS stock_addition FROM nation LEFT JOIN g ON org = n_name""")
def production_vs_dispatch(spark, sf):
    return an.production_vs_dispatch(spine(spark, sf), ad.facts(spark, sf))


@query("confidence_bands", f"""WITH {FACTS} SELECT count(*) FILTER (confidence_score >= 0.9) AS high,
  count(*) FILTER (confidence_score >= 0.75 AND confidence_score < 0.9) AS medium,
  count(*) FILTER (confidence_score < 0.75) AS low FROM facts""")
def confidence_bands(spark, sf):
    return an.confidence_bands(ad.facts(spark, sf))


@query("open_issues_by_type", f"""WITH {FACTS}, {ISSUES}, {ISSUE_STATE}
SELECT replace(issue_type, '_', ' ') AS label, count(*) AS n FROM state WHERE issue_status <> 'RESOLVED'
GROUP BY 1 ORDER BY n DESC, label LIMIT 6""")
def open_issues_by_type(spark, sf):
    kind = F.replace("issue_type", F.lit("_"), F.lit(" ")).alias("label")
    return an.count_by(issue_state(spark, sf).filter("issue_status <> 'RESOLVED'"), kind, k=6)


@query("fiscal_years", f"""WITH {FACTS} SELECT DISTINCT reporting_period FROM facts
WHERE reporting_period LIKE 'FY%'""")
def fiscal_years(spark, sf):
    return (ad.facts(spark, sf).filter(F.col("reporting_period").like("FY%"))
            .select("reporting_period").distinct().orderBy("reporting_period"))


GROWTH = """CASE WHEN lag(production) OVER w > 0 THEN round((production - lag(production) OVER w) * 100
  / lag(production) OVER w, 1) ELSE 0 END AS growth_pct"""


@query("yoy_growth", f"""WITH {FACTS}, t AS (SELECT reporting_period, CAST({P} AS DOUBLE) AS production FROM facts
WHERE reporting_period LIKE 'FY%' GROUP BY 1)
SELECT *, {GROWTH} FROM t WHERE production IS NOT NULL WINDOW w AS (ORDER BY reporting_period)""")
def yoy_growth(spark, sf):
    t = (ad.facts(spark, sf).filter(F.col("reporting_period").like("FY%")).groupBy("reporting_period")
         .agg(an.metric_sum(an.PRODUCTION).cast("double").alias("production"))
         .filter("production IS NOT NULL"))
    return an.growth(t, "production", "reporting_period", [])


@query("yoy_growth_by_org", f"""WITH {FACTS}, t AS (SELECT org, reporting_period, CAST({P} AS DOUBLE) AS production
FROM facts WHERE reporting_period LIKE 'FY%' GROUP BY 1, 2)
SELECT *, {GROWTH} FROM t WHERE production IS NOT NULL
WINDOW w AS (PARTITION BY org ORDER BY reporting_period)""")
def yoy_growth_by_org(spark, sf):
    t = (ad.facts(spark, sf).filter(F.col("reporting_period").like("FY%"))
         .groupBy("org", "reporting_period")
         .agg(an.metric_sum(an.PRODUCTION).cast("double").alias("production"))
         .filter("production IS NOT NULL"))
    return an.growth(t, "production", "reporting_period", ["org"])


@query("share_of_facts", f"""WITH {FACTS} SELECT org, count(*) AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM facts), 1)::DOUBLE AS share_pct FROM facts WHERE org IS NOT NULL
GROUP BY org ORDER BY n DESC, org LIMIT 10""")
def share_of_facts(spark, sf):
    return an.share_of_total(ad.facts(spark, sf))


@query("extraction_methods", f"""WITH {FACTS} SELECT list_element(['Structured Table', 'Regex Pattern',
  'Ocr Block'], list_position(['STRUCTURED_TABLE', 'REGEX_PATTERN', 'OCR_BLOCK'], extraction_method))
  AS label, count(*) AS n FROM facts GROUP BY 1""")
def extraction_methods(spark, sf):
    return an.count_by(ad.facts(spark, sf), label(F.col("extraction_method")).alias("label"))


@query("uploads_per_month", """SELECT strftime(DATE '2024-01-01' + CAST(doc_id % 540 AS INTEGER), '%Y-%m')
  AS month, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1""")
def uploads_per_month(spark, sf):
    return an.per_month(ad.documents(spark, sf), "uploaded_on")


@query("production_by_field", f"""WITH {FACTS} SELECT field, {r(f"sum({DEC})")} AS production FROM facts
WHERE metric_code = 'COAL_PRODUCTION' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def production_by_field(spark, sf):
    return an.production_by(ad.facts(spark, sf), "field")


@query("production_by_site", f"""WITH {FACTS} SELECT site, {r(f"sum({DEC})")} AS production FROM facts
WHERE metric_code = 'COAL_PRODUCTION' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def production_by_site(spark, sf):
    return an.production_by(ad.facts(spark, sf), "site")


@query("verification_rate", f"""WITH {FACTS}, g AS (SELECT org, count(*) AS facts,
  count(*) FILTER (validation_status = 'VERIFIED') AS verified FROM facts GROUP BY 1)
SELECT n_name AS org, coalesce(facts, 0) AS facts, coalesce(verified, 0) AS verified,
  coalesce({pct("verified", "facts")}, 0) AS verified_pct FROM nation LEFT JOIN g ON org = n_name""")
def verification_rate(spark, sf):
    return an.verification_rate(spine(spark, sf), ad.facts(spark, sf))


@query("stripping_ratio", f"""WITH {FACTS}, g AS (SELECT reporting_period,
  coalesce({ms("OVERBURDEN_REMOVAL")}, 0) AS ob, coalesce({P}, 0) AS p FROM facts
  WHERE reporting_period LIKE 'FY%' GROUP BY 1)
SELECT reporting_period, {r("ob")} AS overburden, {r("p")} AS production,
  round(CAST(ob AS DOUBLE) / CAST(greatest(p, 0.1) AS DOUBLE), 2) AS ratio FROM g""")
def stripping_ratio(spark, sf):
    return an.stripping_ratio(ad.facts(spark, sf))


@query("confidence_histogram", f"""WITH {FACTS} SELECT CAST(b AS INTEGER) AS bucket, count(confidence_score) AS n
FROM range(10) t(b) LEFT JOIN facts ON confidence_score < 1
  AND CAST(floor(round(confidence_score * 10, 6)) AS BIGINT) = b GROUP BY 1""")
def confidence_histogram(spark, sf):
    return an.confidence_histogram(ad.facts(spark, sf))


@query("document_types", """SELECT list_element(['PDF', 'CSV', 'XLSX', 'TXT', 'PNG'],
  CAST(doc_id % 5 + 1 AS INTEGER)) AS file_type, count(*) AS n FROM documents GROUP BY 1""")
def document_types(spark, sf):
    return an.count_by(ad.documents(spark, sf), "file_type")


@query("audit_per_day", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1
ORDER BY 1""")
def audit_per_day(spark, sf):
    return an.per_day(ad.audit(spark, sf), "ts")


@query("issue_statistics", f"""WITH {FACTS}, {ISSUES}, {ISSUE_STATE}, {CONFLICTS}
SELECT (SELECT count(*) FROM conflicts) AS conflicts, count(*) AS total, count(*) FILTER (issue_status = 'OPEN') AS open,
  count(*) FILTER (issue_status <> 'OPEN') AS resolved,
  count(*) FILTER (issue_status = 'OPEN' AND severity = 'CRITICAL') AS critical,
  count(*) FILTER (issue_status = 'OPEN' AND severity = 'HIGH') AS high FROM state""")
def issue_statistics(spark, sf):
    return an.issue_statistics(issue_state(spark, sf), cf.contradictions(ad.facts(spark, sf)))


@query("issues_by_entity", f"""WITH {FACTS}, {ISSUES} SELECT org, count(*) AS n FROM issues GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""")
def issues_by_entity(spark, sf):
    return an.count_by(issue_state(spark, sf), "org", k=10)


@query("real_demo_counts", f"""WITH {FACTS} SELECT 'facts' AS name, count(*) FILTER (NOT is_demo) AS real,
  count(*) FILTER (is_demo) AS demo FROM facts UNION ALL SELECT 'documents',
  count(*) FILTER (doc_id % 10 <> 3), count(*) FILTER (doc_id % 10 = 3) FROM documents""")
def real_demo_counts(spark, sf):
    return an.real_demo_counts({"facts": ad.facts(spark, sf), "documents": ad.documents(spark, sf)})


@query("table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n FROM {t}"
    for t in ad.TABLES))
def table_counts(spark, sf):
    return an.table_counts({n: ad.read_table(spark, sf, n) for n in ad.TABLES})


@query("review_queue", f"""WITH {FACTS}, {ISSUES}, {ISSUE_STATE}, {CONFLICTS}
SELECT * FROM (SELECT count(*) FILTER (issue_status = 'OPEN') AS open_issues FROM state),
  (SELECT count(*) AS open_conflicts FROM conflicts), (SELECT count(*) FILTER (confidence_score < 0.75
    OR validation_status IN ('NEEDS_REVIEW', 'REVIEW_REQUIRED')) AS low_confidence FROM facts)""")
def review_queue(spark, sf):
    f = ad.facts(spark, sf)
    return an.review_queue(f, issue_state(spark, sf), cf.contradictions(f))


@query("unverified_sites", f"""WITH {FACTS} SELECT site, count(*) AS n FROM facts WHERE NOT human_verified
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def unverified_sites(spark, sf):
    return an.count_by(ad.facts(spark, sf).filter(~F.col("human_verified")), "site", k=5)


@query("status_distribution", f"""WITH {FACTS} SELECT validation_status, count(*) AS n,
  round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM facts), 2) AS share_pct FROM facts GROUP BY 1""")
def status_distribution(spark, sf):
    return an.status_distribution(ad.facts(spark, sf))


@query("extraction_summary", f"""WITH {FACTS}, {ISSUES}, {CONFLICTS}
SELECT document_id, count(*) AS facts, count(*) FILTER (confidence_score >= 0.85) AS confident,
  count(*) FILTER (validation_status IN ('NEEDS_REVIEW', 'REVIEW_REQUIRED')) AS review,
  CAST(epoch(max(created_at)) - epoch(min(created_at)) AS BIGINT) AS seconds,
  coalesce(any_value(w.n), 0) AS warnings, coalesce(any_value(c.n), 0) AS conflicts
FROM facts LEFT JOIN (SELECT document_id, count(*) AS n FROM issues GROUP BY 1) w USING (document_id)
LEFT JOIN (SELECT primary_document_id AS document_id, count(*) AS n FROM conflicts GROUP BY 1) c
  USING (document_id) GROUP BY 1""")
def extraction_summary(spark, sf):
    f = ad.facts(spark, sf)
    return an.extraction_summary(f, cf.check_rules(f), cf.contradictions(f))


@query("processing_status", """SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS stage,
  count(*) FILTER (event_type = 'error') AS warnings, count(*) AS lines FROM events GROUP BY 1""")
def processing_status(spark, sf):
    log = ad.audit(spark, sf).select(
        F.col("user_id").alias("key"), "ts", "event_id", F.col("action").alias("stage"))
    return an.latest_stage(log)


@query("processing_warnings", """SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'error'""")
def processing_warnings(spark, sf):
    log = ad.audit(spark, sf).select(F.col("user_id").alias("key"), "ts", "event_id", F.col("action").alias("stage"))
    return an.stage_warnings(log).select("key", "event_id", F.col("place").cast("bigint").alias("place"))


@query("entity_rollup", f"""WITH {FACTS} SELECT field, org, site, count(*) AS n,
  CAST(sum({DEC}) AS DOUBLE) AS production, grouping(field, org, site)::BIGINT AS level FROM facts
WHERE metric_code = 'COAL_PRODUCTION' GROUP BY ROLLUP (field, org, site)""")
def entity_rollup(spark, sf):
    return an.entity_rollup(ad.facts(spark, sf))


# --- windows, top-k, sets ---


@query("rank_entities", f"""WITH {FACTS}, t AS (SELECT org, CAST(sum({DEC}) AS DOUBLE) AS total FROM facts
WHERE metric_code = 'COAL_PRODUCTION' GROUP BY 1)
SELECT org, total, rank() OVER (ORDER BY total DESC) AS place FROM t""")
def rank_entities(spark, sf):
    t = (ad.facts(spark, sf).filter(F.col("metric_code") == an.PRODUCTION).groupBy("org")
         .agg(an.exact_sum(F.col("numeric_value")).cast("double").alias("total")))
    return ranking.placed(t, "total").withColumn("place", F.col("place").cast("bigint"))


@query("top_metrics_per_entity", f"""WITH {FACTS}, c AS (SELECT org, metric_code, count(*) AS n FROM facts GROUP BY 1, 2)
SELECT org, metric_code, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY org
  ORDER BY n DESC, metric_code) AS rn FROM c) WHERE rn <= 3""")
def top_metrics_per_entity(spark, sf):
    c = an.count_by(ad.facts(spark, sf), "org", "metric_code")
    return ranking.first_per(c, ["org"], [F.col("n").desc(), "metric_code"], 3, "rn").withColumn("rn", F.col("rn").cast("bigint"))


@query("latest_per_key", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark, sf):
    return ranking.latest_per(ad.read_table(spark, sf, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


# a steep function of the values, which alone are spread too evenly for outliers
@query("sigma_outliers", f"""WITH {FACTS.replace("facts AS", "facts0 AS", 1)},
facts AS (SELECT * REPLACE (pow(numeric_value / 100, 8) AS numeric_value) FROM facts0), s AS (SELECT site, metric_code, avg(numeric_value) AS m,
  stddev_samp(numeric_value) AS sd FROM facts GROUP BY 1, 2)
SELECT fact_id FROM facts JOIN s USING (site, metric_code) WHERE abs(numeric_value - m) > 3 * sd + 1e-9""")
def sigma_outliers(spark, sf):
    steep = ad.facts(spark, sf).withColumn("numeric_value", F.pow(F.col("numeric_value") / 100, F.lit(8)))
    return an.sigma_outliers(steep, ["site", "metric_code"]).select("fact_id")


@query("ledger_page", f"""WITH {FACTS} SELECT fact_id, confidence_score, (SELECT count(*) FROM facts) AS total
FROM facts ORDER BY confidence_score DESC, created_at DESC, fact_id LIMIT 20 OFFSET 40""")
def ledger_page(spark, sf):
    """Page 3 of 20 rows, with the total."""
    f = ad.facts(spark, sf)
    page = f.orderBy(F.col("confidence_score").desc(), F.col("created_at").desc(), "fact_id").offset(
        40).limit(20)
    return page.crossJoin(f.agg(F.count("*").alias("total"))).select(  # one row
        "fact_id", "confidence_score", "total")


@query("largest_conflicts", f"""WITH {FACTS}, {CONFLICTS} SELECT conflict_id, discrepancy_percent,
  (SELECT count(*) FROM conflicts) AS total FROM conflicts
ORDER BY discrepancy_percent DESC, conflict_id LIMIT 10""")
def largest_conflicts(spark, sf):
    c = cf.contradictions(ad.facts(spark, sf))
    best = an.top(c, 10, "discrepancy_percent", "conflict_id")
    return best.crossJoin(c.agg(F.count("*").alias("total"))).select(  # one row
        "conflict_id", "discrepancy_percent", "total")


@query("concat_inputs", f"""WITH {FACTS} SELECT side, count(*) AS n FROM (
  SELECT 'actual' AS side FROM facts WHERE metric_code = 'COAL_PRODUCTION'
  UNION ALL SELECT 'target' FROM facts WHERE metric_code = 'PRODUCTION_TARGET') GROUP BY 1""")
def concat_inputs(spark, sf):
    f = ad.facts(spark, sf).select("fact_id", "metric_code")
    a = f.filter(F.col("metric_code") == an.PRODUCTION).withColumn("side", F.lit("actual"))
    t = f.filter(F.col("metric_code") == an.TARGET).withColumn("side", F.lit("target"))
    return an.count_by(a.unionByName(t), "side")


@query("distinct_first_seen", """SELECT text, source AS first_source, doc_id AS first_doc FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1""")
def distinct_first_seen(spark, sf):
    first = F.min(F.struct("source", "doc_id"))
    return ad.read_table(spark, sf, "documents").groupBy("text").agg(first.alias("f")).select(
        "text", F.col("f.source").alias("first_source"), F.col("f.doc_id").alias("first_doc"))


@query("new_keys", f"""WITH {FACTS} SELECT site FROM (SELECT DISTINCT site FROM facts WHERE
metric_code = 'DRILLING') WHERE site NOT IN (SELECT site FROM facts WHERE metric_code = 'DRILLING'
  AND validation_status = 'VERIFIED' AND is_demo)""")
def new_keys(spark, sf):
    f = ad.facts(spark, sf).filter(F.col("metric_code") == "DRILLING")
    known = f.filter((F.col("validation_status") == "VERIFIED") & F.col("is_demo"))
    return f.select("site").distinct().join(known.select("site").distinct(), "site", "left_anti")


@query("documents_behind_answer", f"""WITH {FACTS} SELECT org, metric_code,
  count(DISTINCT document_id) AS n_documents FROM facts GROUP BY 1, 2""")
def documents_behind_answer(spark, sf):
    return ad.facts(spark, sf).groupBy("org", "metric_code").agg(
        F.countDistinct("document_id").alias("n_documents"))


@query("entities_without_data", f"""WITH {FACTS} SELECT n_name AS org FROM nation WHERE n_name NOT IN
  (SELECT org FROM facts WHERE org IS NOT NULL AND metric_code = 'DRILLING' AND is_demo)""")
def entities_without_data(spark, sf):
    f = ad.facts(spark, sf).filter((F.col("metric_code") == "DRILLING") & F.col("is_demo"))
    return spine(spark, sf).join(f.select("org").distinct(), "org", "left_anti")
