"""Queries: validation rules, contradictions, ledger writes, review decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.operators import conflicts, history, merge, review, scope
from ledgerlake.plans.registry import query
from ledgerlake.plans.sqlparts import FACTS, FY_KEY, GRAIN
from ledgerlake.sources import adapters as ad

ISSUES = """issues AS (
SELECT fact_id || ':' || t AS issue_id, fact_id, document_id, org, created_at, t AS issue_type,
  s AS severity FROM (
  SELECT *, 'MISSING_UNIT' AS t, 'MEDIUM' AS s FROM facts WHERE unit IS NULL
  UNION ALL SELECT *, 'MISSING_PERIOD', 'MEDIUM' FROM facts WHERE reporting_period IS NULL
  UNION ALL SELECT *, 'LOW_CONFIDENCE', 'HIGH' FROM facts WHERE confidence_score < 0.75
  UNION ALL SELECT *, 'UNMAPPED_METRIC', 'LOW' FROM facts WHERE metric_code = 'UNMAPPED'))"""

CONFLICTS = """pairs AS (
SELECT f.fact_id, f.document_id, f.metric_code, f.reporting_period, f.org, f.numeric_value, f.created_at,
  p.fact_id AS pid, p.document_id AS pdoc, p.numeric_value AS pval,
  row_number() OVER (PARTITION BY f.fact_id ORDER BY p.created_at, p.fact_id) AS rn
FROM facts f JOIN facts p ON p.metric_code = f.metric_code AND p.reporting_period = f.reporting_period
  AND p.org = f.org AND p.document_id <> f.document_id AND p.numeric_value <> f.numeric_value
  AND (p.created_at < f.created_at OR (p.created_at = f.created_at AND p.fact_id < f.fact_id))),
conflicts AS (
SELECT pid || '|' || fact_id AS conflict_id, metric_code, reporting_period, org, pid AS primary_fact_id,
  fact_id AS conflicting_fact_id, pdoc AS primary_document_id, document_id AS conflicting_document_id,
  round(abs(numeric_value - pval) / pval * 100, 2) AS discrepancy_percent, 'OPEN' AS status, created_at
FROM pairs WHERE rn = 1 AND pval > 0 AND abs(numeric_value - pval) / pval * 100 >= 5)"""


@query("validation_issues", f"""WITH {FACTS}, {ISSUES}
SELECT issue_id, fact_id, document_id, issue_type, severity FROM issues""")
def validation_issues(spark, sf):
    return conflicts.check_rules(ad.facts(spark, sf)).drop("org", "created_at")


@query("extended_issues", f"""WITH {FACTS},
x AS (SELECT fact_id, 'NEGATIVE_VALUE' AS issue_type, 'HIGH' AS severity FROM facts WHERE numeric_value < 0
UNION ALL SELECT fact_id, 'INVALID_UNIT', 'MEDIUM' FROM facts WHERE (unit = 'BCM' AND metric_code <>
  'OVERBURDEN_REMOVAL') OR (unit = 'MT' AND metric_code IN ('OVERBURDEN_REMOVAL', 'DRILLING'))
UNION ALL SELECT fact_id, 'MISSING_EVIDENCE', 'LOW' FROM facts WHERE cell_reference IS NULL
  AND page_number IS NULL AND row_number IS NULL)
SELECT * FROM x""")
def extended_issues(spark, sf):
    flagged = scope.unit_mismatch(ad.facts(spark, sf), dims.metrics_frame(spark))
    rules = conflicts.extended_rules(F.col("unit_mismatch"))
    return conflicts.check_rules(flagged, rules).select("fact_id", "issue_type", "severity")


@query("contradictions", f"""WITH {FACTS}, {CONFLICTS}
SELECT conflict_id, metric_code, reporting_period, org, primary_fact_id, conflicting_fact_id,
  discrepancy_percent, status FROM conflicts""")
def contradictions(spark, sf):
    return conflicts.contradictions(ad.facts(spark, sf)).drop(
        "primary_document_id", "conflicting_document_id", "created_at")


@query("contradictions_same_site_grain", f"""WITH {FACTS.replace("facts AS", "facts0 AS", 1)},
facts AS (SELECT * REPLACE (reporting_period || '#' || ({GRAIN}) || '#' || site AS reporting_period)
  FROM facts0), {CONFLICTS}
SELECT conflicting_fact_id, primary_fact_id, discrepancy_percent FROM conflicts""")
def contradictions_same_site_grain(spark, sf):
    """The stricter key: same site and grain too."""
    from ledgerlake.operators.protect import with_period_keys

    f = with_period_keys(ad.facts(spark, sf))
    return conflicts.contradictions(f, [*conflicts.CONFLICT_KEYS, "site", "k_grain"]).select(
        "conflicting_fact_id", "primary_fact_id", "discrepancy_percent")


@query("conflict_issues", f"""WITH {FACTS}, {CONFLICTS}
SELECT conflicting_fact_id || ':UNRESOLVED_CONFLICT' AS issue_id, conflicting_fact_id AS fact_id,
  'CRITICAL' AS severity FROM conflicts""")
def conflict_issues(spark, sf):
    return conflicts.conflict_issues(conflicts.contradictions(ad.facts(spark, sf))).select(
        "issue_id", "fact_id", "severity")


@query("ledger_with_conflict_status", f"""WITH {FACTS}, {CONFLICTS}
SELECT metric_code, CASE WHEN fact_id IN (SELECT conflicting_fact_id FROM conflicts) THEN 'CONFLICT'
  ELSE validation_status END AS validation_status, count(*) AS n FROM facts GROUP BY 1, 2""")
def ledger_with_conflict_status(spark, sf):
    f = ad.facts(spark, sf)
    return (conflicts.mark_conflicts(f, conflicts.contradictions(f))
            .groupBy("metric_code", "validation_status").agg(F.count("*").alias("n")))


@query("conflicts_of_documents", f"""WITH {FACTS}, {CONFLICTS}
SELECT conflict_id FROM conflicts WHERE CAST(primary_document_id AS BIGINT) % 7 = 0
  OR CAST(conflicting_document_id AS BIGINT) % 7 = 0""")
def conflicts_of_documents(spark, sf):
    docs = ad.report_documents(spark, sf).filter(F.col("document_id").cast("bigint") % 7 == 0)
    return conflicts.touching_document(
        conflicts.contradictions(ad.facts(spark, sf)), docs).select("conflict_id")


@query("conflicts_with_primary_in", f"""WITH {FACTS}, {CONFLICTS}
SELECT conflict_id FROM conflicts WHERE CAST(primary_document_id AS BIGINT) % 7 = 0""")
def conflicts_with_primary_in(spark, sf):
    docs = ad.report_documents(spark, sf).filter(F.col("document_id").cast("bigint") % 7 == 0)
    c = conflicts.contradictions(ad.facts(spark, sf))
    return c.join(docs.select(F.col("document_id").alias("primary_document_id")),
                  "primary_document_id", "left_semi").select("conflict_id")


@query("conflict_status_per_fact", f"""WITH {FACTS}, {CONFLICTS},
ends AS (SELECT primary_fact_id AS fact_id, status FROM conflicts UNION ALL
         SELECT conflicting_fact_id, status FROM conflicts)
SELECT fact_id, CASE WHEN fact_id IN (SELECT fact_id FROM ends WHERE status = 'OPEN') THEN 'OPEN'
  WHEN fact_id IN (SELECT fact_id FROM ends) THEN 'RESOLVED' ELSE 'NONE' END AS conflict_status
FROM facts""")
def conflict_status_per_fact(spark, sf):
    return conflicts.facts_with_status(ad.facts(spark, sf)).select("fact_id", "conflict_status")


# --- writes ---


@query("duplicate_documents", """SELECT doc_id, sha256(text) AS sha256,
  min(doc_id) OVER (PARTITION BY sha256(text)) AS original_id,
  doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents""")
def duplicate_documents(spark, sf):
    return merge.flag_duplicate_documents(ad.documents(spark, sf))


DOC_STATUS = """list_element(['READY','READY','READY','COMPLETED_WITH_WARNINGS','INDEXING','FAILED',
  'PROCESSING'], CAST(doc_id % 7 + 1 AS INTEGER))"""


@query("ingest_summary", f"""SELECT count(*) AS total, count(*) FILTER (NOT f AND NOT d) AS successful,
  count(*) FILTER (NOT f AND d) AS duplicates, count(*) FILTER (f) AS failed
FROM (SELECT {DOC_STATUS} = 'FAILED' AS f,
  doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS d FROM documents)""")
def ingest_summary(spark, sf):
    docs = ad.documents(spark, sf)
    flagged = merge.flag_duplicate_documents(docs).join(docs.select("doc_id", "status"), "doc_id")
    return merge.ingest_summary(flagged)


@query("fact_keys", f"""WITH {FACTS}
SELECT fact_id, concat_ws(':', document_id, metric_code, reporting_period, org, site,
  coalesce(cell_reference, ''), coalesce(CAST(page_number AS VARCHAR), ''),
  coalesce(CAST(row_number AS VARCHAR), '')) AS dedup_key,
  sha256(concat_ws(':', metric_code, CAST(CAST(numeric_value AS DECIMAL(20,4)) AS VARCHAR),
    reporting_period, '')) AS source_hash FROM facts""")
def fact_keys(spark, sf):
    return merge.with_keys(ad.facts(spark, sf)).select("fact_id", "dedup_key", "source_hash")


UPSERT_KEY_SQL = ", ".join(merge.UPSERT_KEYS)
UPDATED = ["numeric_value", "unit", "confidence_score", "validation_status"]


@query("upsert_facts", f"""WITH {FACTS},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {UPSERT_KEY_SQL}
  ORDER BY created_at DESC, fact_id DESC) AS rn FROM facts) WHERE rn = 1),
ledger AS (SELECT * FROM last WHERE created_at < TIMESTAMP '1999-01-01'),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {UPSERT_KEY_SQL}
  ORDER BY created_at DESC, fact_id DESC) AS rn FROM facts
  WHERE created_at >= TIMESTAMP '1998-06-01') WHERE rn = 1)
SELECT coalesce(l.fact_id, n.fact_id) AS fact_id, coalesce(l.document_id, n.document_id) AS document_id,
  CASE WHEN n.fact_id IS NOT NULL THEN n.numeric_value ELSE l.numeric_value END AS numeric_value,
  CASE WHEN n.fact_id IS NOT NULL THEN n.unit ELSE l.unit END AS unit,
  CASE WHEN n.fact_id IS NOT NULL THEN n.confidence_score ELSE l.confidence_score END AS confidence_score,
  CASE WHEN n.fact_id IS NOT NULL THEN n.validation_status ELSE l.validation_status END AS validation_status
FROM ledger l FULL OUTER JOIN fresh n ON {" AND ".join(f"l.{k} IS NOT DISTINCT FROM n.{k}" for k in merge.UPSERT_KEYS)}""")
def upsert_facts(spark, sf):
    from pyspark.sql import Window

    f = ad.facts(spark, sf)
    w = Window.partitionBy(*merge.UPSERT_KEYS).orderBy(
        F.col("created_at").desc(), F.col("fact_id").desc())
    ledger = (f.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
              .filter("created_at < timestamp '1999-01-01'"))
    fresh = f.filter("created_at >= timestamp '1998-06-01'")
    return merge.upsert_facts(ledger, fresh, UPDATED).select("fact_id", "document_id", *UPDATED)


@query("replace_document", f"""WITH {FACTS}
SELECT document_id, count(*) AS n, sum(numeric_value) AS total FROM (
  SELECT document_id, numeric_value FROM facts WHERE CAST(document_id AS BIGINT) % 5 <> 0
  UNION ALL SELECT document_id, numeric_value + 1 FROM facts
  WHERE CAST(document_id AS BIGINT) % 5 = 0 AND is_demo = FALSE) GROUP BY 1""")
def replace_document(spark, sf):
    f = ad.facts(spark, sf).select("document_id", "numeric_value", "is_demo")
    redo = F.col("document_id").cast("bigint") % 5 == 0
    new = f.filter(redo & ~F.col("is_demo")).withColumn("numeric_value", F.col("numeric_value") + 1)
    ids = ad.report_documents(spark, sf).filter(redo).select("document_id")
    return (merge.replace_document(f, new, ids).groupBy("document_id")
            .agg(F.count("*").alias("n"), F.sum("numeric_value").alias("total")))


@query("delete_documents", f"""WITH {FACTS}, {ISSUES}
SELECT 'facts' AS name, count(*) AS n FROM facts WHERE CAST(document_id AS BIGINT) % 3 <> 0
UNION ALL SELECT 'issues', count(*) FROM issues WHERE CAST(document_id AS BIGINT) % 3 <> 0""")
def delete_documents(spark, sf):
    f = ad.facts(spark, sf)
    ids = ad.report_documents(spark, sf).filter(F.col("document_id").cast("bigint") % 3 == 0)
    kept = merge.delete_documents({"facts": f, "issues": conflicts.check_rules(f)}, ids)
    one = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
           for n, t in kept.items()]
    return one[0].unionByName(one[1])


@query("patch_documents", """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'checked' ELSE d.source END
  AS source, CASE WHEN l.toxic = 1 THEN 'xx' ELSE d.lang END AS lang
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def patch_documents(spark, sf):
    patch = ad.read_table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "checked").alias("source"),
        F.when(F.col("toxic") == 1, "xx").alias("lang"))
    return merge.patch_documents(
        ad.documents(spark, sf).select("doc_id", "source", "lang"), patch)


@query("document_rollup", f"""WITH {FACTS}, {ISSUES}
SELECT document_id, count(*) AS fact_count, count(*) FILTER (NOT is_demo) AS real_fact_count,
  CAST(round(sum(CAST(confidence_score AS DECIMAL(10,6))) / count(*), 2) AS DOUBLE) AS average_confidence,
  coalesce(any_value(w), 0) AS warning_count
FROM facts LEFT JOIN (SELECT document_id, count(*) AS w FROM issues GROUP BY 1) USING (document_id)
GROUP BY 1""")
def document_rollup(spark, sf):
    f = ad.facts(spark, sf)
    return merge.rollup_documents(f, conflicts.check_rules(f))


# --- review ---

DECISIONS = """dec AS (
SELECT 'A:' || fact_id AS decision_id, fact_id, fact_id || ':LOW_CONFIDENCE' AS issue_id,
  list_element(['APPROVE_ISSUE', 'APPROVE', 'REJECT', 'EDIT'], CAST(k % 4 + 1 AS INTEGER)) AS action,
  CASE WHEN k % 4 = 3 THEN numeric_value + 5 END AS new_value,
  CASE WHEN k % 4 = 3 THEN 'Mm3' END AS new_unit, CAST(NULL AS VARCHAR) AS other_fact_id,
  CAST(NULL AS VARCHAR) AS loser_status, 'r' || (k % 3) AS reviewer, created_at AS decided_at
FROM (SELECT *, CAST(epoch(created_at) AS BIGINT) % 97 AS k FROM facts) WHERE k < 12
UNION ALL
SELECT 'S:' || lo, lo, NULL, 'SUPERSEDE', NULL, NULL, hi, NULL, 'r9', ts FROM (
  SELECT min(fact_id) AS lo, max(fact_id) AS hi, min(created_at) AS ts FROM facts
  GROUP BY document_id, metric_code, reporting_period
  HAVING min(fact_id) < max(fact_id) AND CAST(epoch(min(created_at)) AS BIGINT) % 5 = 0)
UNION ALL
SELECT 'R:' || lo, lo, NULL, 'RESOLVE_CONFLICT', 42.5, NULL, hi, 'DUPLICATE', 'r8', ts FROM (
  SELECT min(fact_id) AS lo, max(fact_id) AS hi, max(created_at) AS ts FROM facts
  GROUP BY org, metric_code, reporting_period HAVING min(fact_id) < max(fact_id))),
exp AS (
SELECT decision_id, fact_id, action, 'SELF' AS role, CAST(NULL AS VARCHAR) AS successor, new_value,
  new_unit, loser_status, reviewer, decided_at FROM dec WHERE other_fact_id IS NULL
UNION ALL SELECT decision_id, CASE WHEN action = 'SUPERSEDE' THEN other_fact_id ELSE fact_id END, action,
  'WINNER', NULL, new_value, new_unit, loser_status, reviewer, decided_at FROM dec
  WHERE other_fact_id IS NOT NULL
UNION ALL SELECT decision_id, CASE WHEN action = 'SUPERSEDE' THEN fact_id ELSE other_fact_id END, action,
  'LOSER', CASE WHEN action = 'SUPERSEDE' THEN other_fact_id ELSE fact_id END, new_value, new_unit,
  loser_status, reviewer, decided_at FROM dec WHERE other_fact_id IS NOT NULL),
eff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id
  ORDER BY decided_at DESC, decision_id DESC) AS rn FROM exp) WHERE rn = 1),
after AS (
SELECT f.fact_id, f.numeric_value AS old_numeric_value, f.validation_status AS old_validation_status,
  e.decision_id, e.action,
  CASE WHEN (action = 'EDIT' OR (action = 'RESOLVE_CONFLICT' AND role = 'WINNER'))
    AND new_value IS NOT NULL THEN new_value ELSE numeric_value END AS numeric_value,
  CASE WHEN (action = 'EDIT' OR (action = 'RESOLVE_CONFLICT' AND role = 'WINNER'))
    AND new_value IS NOT NULL THEN numeric_value END AS original_numeric_value,
  CASE WHEN action = 'EDIT' THEN coalesce(new_unit, unit) ELSE unit END AS unit,
  CASE WHEN action IN ('APPROVE_ISSUE', 'EDIT') THEN 1.0 ELSE confidence_score END AS confidence_score,
  CASE WHEN action IN ('APPROVE_ISSUE', 'APPROVE', 'EDIT') OR role = 'WINNER' THEN 'VERIFIED'
    WHEN action = 'REJECT' THEN 'REJECTED' WHEN role = 'LOSER' THEN coalesce(loser_status, 'SUPERSEDED')
    ELSE validation_status END AS validation_status,
  e.reviewer, e.successor AS superseded_by FROM facts f LEFT JOIN eff e USING (fact_id))"""


def decisions(spark, sf):
    f = ad.facts(spark, sf)
    k = F.unix_seconds("created_at") % 97
    null = F.lit(None).cast("string")
    actions = F.array(*[F.lit(a) for a in ("APPROVE_ISSUE", "APPROVE", "REJECT", "EDIT")])
    edit = F.col("k") % 4 == 3
    single = f.withColumn("k", k).filter("k < 12").select(
        F.concat(F.lit("A:"), "fact_id").alias("decision_id"), "fact_id",
        F.concat("fact_id", F.lit(":LOW_CONFIDENCE")).alias("issue_id"),
        F.element_at(actions, (F.col("k") % 4 + 1).cast("int")).alias("action"),
        F.when(edit, F.col("numeric_value") + 5).alias("new_value"),
        F.when(edit, "Mm3").alias("new_unit"), null.alias("new_metric"),
        null.alias("other_fact_id"), null.alias("loser_status"),
        F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("reviewer"),
        F.col("created_at").alias("decided_at"))

    def pairs(keys, ts, tag, action, value, status, by):
        return (f.groupBy(*keys).agg(F.min("fact_id").alias("lo"), F.max("fact_id").alias("hi"),
                                     ts.alias("ts")).filter("lo < hi")
                .select(F.concat(F.lit(tag), "lo").alias("decision_id"), F.col("lo").alias("fact_id"),
                        null.alias("issue_id"), F.lit(action).alias("action"),
                        F.lit(value).cast("double").alias("new_value"), null.alias("new_unit"),
                        null.alias("new_metric"), F.col("hi").alias("other_fact_id"),
                        F.lit(status).cast("string").alias("loser_status"),
                        F.lit(by).alias("reviewer"), F.col("ts").alias("decided_at")))

    sup = pairs(["document_id", "metric_code", "reporting_period"], F.min("created_at"), "S:",
                "SUPERSEDE", None, None, "r9").filter(F.unix_seconds("decided_at") % 5 == 0)
    res = pairs(["org", "metric_code", "reporting_period"], F.max("created_at"), "R:",
                "RESOLVE_CONFLICT", 42.5, "DUPLICATE", "r8")
    return single.unionByName(sup).unionByName(res)


def review_ledger(spark, sf):
    null = F.lit(None)
    return ad.facts(spark, sf).withColumns({
        "original_numeric_value": null.cast("double"), "reviewer": null.cast("string"),
        "superseded_by": null.cast("string")})


@query("apply_decisions", f"""WITH {FACTS}, {DECISIONS}
SELECT fact_id, numeric_value, original_numeric_value, unit, confidence_score, validation_status, reviewer,
  superseded_by FROM after""")
def apply_decisions(spark, sf):
    return review.apply_decisions(review_ledger(spark, sf), decisions(spark, sf)).select(
        "fact_id", "numeric_value", "original_numeric_value", "unit", "confidence_score",
        "validation_status", "reviewer", "superseded_by")


@query("review_actions", f"""WITH {FACTS}, {DECISIONS}
SELECT decision_id, action, fact_id, old_numeric_value, numeric_value AS new_numeric_value,
  old_validation_status, validation_status AS new_validation_status FROM after
WHERE decision_id IS NOT NULL""")
def review_actions(spark, sf):
    led, d = review_ledger(spark, sf), decisions(spark, sf)
    return review.review_actions(led, review.apply_decisions(led, d), d).select(
        "decision_id", "action", "fact_id", "old_numeric_value", "new_numeric_value",
        "old_validation_status", "new_validation_status")


ISSUE_STATE = """state AS (SELECT *, CASE WHEN CAST(epoch(created_at) AS BIGINT) % 11 = 0 THEN 'RESOLVED'
  ELSE 'OPEN' END AS issue_status FROM issues)"""
ISSUE_DEC = """idec AS (SELECT decision_id, issue_id, action FROM dec WHERE issue_id IS NOT NULL
UNION ALL SELECT 'I:' || issue_id, issue_id, list_element(['ASSIGN_ISSUE', 'RESOLVE_ISSUE',
  'DISMISS_ISSUE'], CAST(CAST(epoch(created_at) AS BIGINT) % 3 + 1 AS INTEGER)) FROM issues
  WHERE issue_type = 'MISSING_UNIT')"""


def issue_state(spark, sf):
    return conflicts.check_rules(ad.facts(spark, sf)).withColumn(
        "issue_status", F.when(F.unix_seconds("created_at") % 11 == 0, "RESOLVED").otherwise("OPEN"))


def issue_decisions(spark, sf):
    acts = F.array(*[F.lit(a) for a in ("ASSIGN_ISSUE", "RESOLVE_ISSUE", "DISMISS_ISSUE")])
    own = conflicts.check_rules(ad.facts(spark, sf)).filter("issue_type = 'MISSING_UNIT'").select(
        F.concat(F.lit("I:"), "issue_id").alias("decision_id"), "issue_id",
        F.element_at(acts, (F.unix_seconds("created_at") % 3 + 1).cast("int")).alias("action"),
        F.col("created_at").alias("decided_at"))
    return decisions(spark, sf).unionByName(own, allowMissingColumns=True)


@query("close_issues", f"""WITH {FACTS}, {ISSUES}, {DECISIONS}, {ISSUE_STATE}, {ISSUE_DEC}
SELECT s.issue_id, CASE WHEN issue_status = 'RESOLVED' THEN 'RESOLVED'
  WHEN i.action IN ('APPROVE_ISSUE', 'RESOLVE_ISSUE') THEN 'RESOLVED'
  WHEN i.action = 'DISMISS_ISSUE' THEN 'SUPERSEDED'
  WHEN by_fact IS NOT NULL THEN 'RESOLVED'
  WHEN i.action = 'ASSIGN_ISSUE' THEN 'ASSIGNED' ELSE issue_status END AS issue_status
FROM state s LEFT JOIN idec i USING (issue_id)
LEFT JOIN (SELECT DISTINCT fact_id AS by_fact FROM eff WHERE action <> 'APPROVE_ISSUE') b ON by_fact = s.fact_id""")
def close_issues(spark, sf):
    return review.close_issues(issue_state(spark, sf), issue_decisions(spark, sf)).select(
        "issue_id", "issue_status")


@query("refused_issue_decisions", f"""WITH {FACTS}, {ISSUES}, {DECISIONS}, {ISSUE_STATE}, {ISSUE_DEC}
SELECT decision_id, issue_id, 'ALREADY_RESOLVED' AS reason FROM idec WHERE action IN ('ASSIGN_ISSUE',
  'RESOLVE_ISSUE', 'DISMISS_ISSUE') AND issue_id IN (SELECT issue_id FROM state WHERE
  issue_status = 'RESOLVED')""")
def refused_issue_decisions(spark, sf):
    return review.refused_issue_decisions(issue_state(spark, sf), issue_decisions(spark, sf))


# --- history of facts ---

AT = "1997-01-01"


def history_of(spark, sf):
    return history.fact_history(review_ledger(spark, sf), decisions(spark, sf))


STATE_SQL = """CASE WHEN action IN ('APPROVE_ISSUE', 'APPROVE', 'EDIT') OR role = 'WINNER' THEN 'VERIFIED'
  WHEN action = 'REJECT' THEN 'REJECTED' WHEN role = 'LOSER' THEN coalesce(loser_status, 'SUPERSEDED') END"""


@query("fact_states_as_of", f"""WITH {FACTS}, {DECISIONS},
h AS (SELECT fact_id, arg_max({STATE_SQL}, (decided_at, decision_id, action)) AS status,
  arg_max(new_value, (decided_at, decision_id, action)) FILTER (new_value IS NOT NULL AND (action = 'EDIT'
    OR (action = 'RESOLVE_CONFLICT' AND role = 'WINNER'))) AS v,
  arg_max(new_unit, (decided_at, decision_id, action)) FILTER (action = 'EDIT' AND new_unit IS NOT NULL) AS u,
  bool_or(action IN ('APPROVE_ISSUE', 'EDIT')) AS sure FROM exp WHERE decided_at <= TIMESTAMP '{AT}' GROUP BY 1)
SELECT fact_id, coalesce(v, numeric_value) AS numeric_value, coalesce(u, unit) AS unit, coalesce(status, validation_status) AS validation_status,
  CASE WHEN sure THEN 1.0 ELSE confidence_score END AS confidence_score FROM facts LEFT JOIN h USING (fact_id)""")
def fact_states_as_of(spark, sf):
    return history.as_of(history_of(spark, sf), F.lit(AT).cast("timestamp")).select(
        "fact_id", "numeric_value", "unit", "validation_status", "confidence_score")


@query("fact_review_history", f"""WITH {FACTS}, {DECISIONS} SELECT e.fact_id, e.decision_id, row_number() OVER (PARTITION BY e.fact_id
  ORDER BY decided_at DESC, decision_id DESC, action DESC) AS place, action, {STATE_SQL} AS new_validation_status
FROM exp e SEMI JOIN facts USING (fact_id)""")
def fact_review_history(spark, sf):
    return history.actions_of_facts(history_of(spark, sf)).select(
        "fact_id", "decision_id", F.col("place").cast("bigint").alias("place"), "action", "new_validation_status")


def conflict_decisions(found):
    """Resolves conflicts whose id has a length divisible by 3, naming the newer fact first."""
    return found.filter(F.length("conflict_id") % 3 == 0).select(
        F.concat(F.lit("C:"), "conflict_id").alias("decision_id"), F.col("conflicting_fact_id").alias("fact_id"),
        F.col("primary_fact_id").alias("other_fact_id"), F.lit("RESOLVE_CONFLICT").alias("action"),
        F.lit("r7").alias("reviewer"), F.col("created_at").alias("decided_at"))


@query("closed_conflicts", f"""WITH {FACTS}, {CONFLICTS} SELECT conflict_id,
  CASE WHEN length(conflict_id) % 3 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status,
  CASE WHEN length(conflict_id) % 3 = 0 THEN 'r7' END AS closed_by FROM conflicts""")
def closed_conflicts(spark, sf):
    found = conflicts.contradictions(ad.facts(spark, sf))
    return history.close_conflicts(found, conflict_decisions(found)).select("conflict_id", "status", "closed_by")


@query("conflict_status_after_review", f"""WITH {FACTS}, {CONFLICTS}, ends AS (
  SELECT unnest([primary_fact_id, conflicting_fact_id]) AS fact_id, length(conflict_id) % 3 > 0 AS open FROM conflicts),
s AS (SELECT fact_id, bool_or(open) AS open FROM ends GROUP BY 1)
SELECT fact_id, CASE WHEN open IS NULL THEN 'NONE' WHEN open THEN 'OPEN' ELSE 'RESOLVED' END AS conflict_status
FROM facts LEFT JOIN s USING (fact_id)""")
def conflict_status_after_review(spark, sf):
    f = ad.facts(spark, sf)
    found = conflicts.contradictions(f)
    return conflicts.conflict_status(f, history.close_conflicts(found, conflict_decisions(found))).select("fact_id", "conflict_status")


# --- further issue types ---


def _ids(df):
    return df.select("issue_id", "severity")


@query("period_mismatch_issues", f"""WITH {FACTS}, e AS (SELECT *, CASE WHEN hash_no = 7 THEN 'FY 1900-01' ELSE 'FY ' || document_id END AS said
  FROM (SELECT *, CAST(epoch(created_at) AS BIGINT) % 13 AS hash_no FROM facts)),
c AS (SELECT document_id, said, sum(confidence_score) AS w FROM e GROUP BY 1, 2),
l AS (SELECT document_id, arg_min(said, (-w, said)) AS usual FROM c GROUP BY 1 HAVING max(w) * 100 >= sum(w) * 80)
SELECT fact_id || ':PERIOD_MISMATCH' AS issue_id, 'MEDIUM' AS severity FROM e JOIN l USING (document_id) WHERE said <> usual""")
def period_mismatch_issues(spark, sf):
    # the periods of the test ledger have no majority in a document: every document says its own here, one fact in 13 another
    f = ad.facts(spark, sf).withColumn("reporting_period", F.when(F.unix_seconds("created_at") % 13 == 7, "FY 1900-01").otherwise(
        F.concat(F.lit("FY "), "document_id")))
    return _ids(conflicts.dependency_issues(f, "document_id", "reporting_period", "PERIOD_MISMATCH", weight=F.col("confidence_score")))


@query("site_organisation_issues", f"""WITH {FACTS}, e AS (SELECT *, CASE WHEN CAST(epoch(created_at) AS BIGINT) % 17 = 3 THEN 'NATION_0' ELSE org END AS said FROM facts),
c AS (SELECT site, said, count(*) AS w FROM e WHERE site IS NOT NULL AND said IS NOT NULL GROUP BY 1, 2),
l AS (SELECT site, arg_min(said, (-w, said)) AS usual FROM c GROUP BY 1 HAVING max(w) * 100 >= sum(w) * 80)
SELECT fact_id || ':SITE_ORGANISATION_MISMATCH' AS issue_id, 'HIGH' AS severity FROM e JOIN l USING (site) WHERE said <> usual""")
def site_organisation_issues(spark, sf):
    f = ad.facts(spark, sf).withColumn("org", F.when(F.unix_seconds("created_at") % 17 == 3, ad.GROUP).otherwise(F.col("org")))
    return _ids(conflicts.dependency_issues(f, "site", "org", "SITE_ORGANISATION_MISMATCH", "HIGH"))


@query("duplicate_fact_issues", f"""WITH {FACTS} SELECT fact_id || ':DUPLICATE_FACT' AS issue_id, 'LOW' AS severity FROM facts
QUALIFY row_number() OVER (PARTITION BY org, site, metric_code, reporting_period, numeric_value, unit ORDER BY created_at, fact_id) > 1""")
def duplicate_fact_issues(spark, sf):
    return _ids(conflicts.duplicate_facts(ad.facts(spark, sf), ["org", "site", "metric_code", "reporting_period", "numeric_value", "unit"]))


@query("duplicate_document_issues", """SELECT doc_id || ':DUPLICATE_DOCUMENT' AS issue_id, original_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original_id FROM documents) WHERE doc_id <> original_id""")
def duplicate_document_issues(spark, sf):
    return conflicts.duplicate_document_issues(merge.flag_duplicate_documents(ad.documents(spark, sf))).select("issue_id", "original_id")


@query("aggregation_issues", f"""WITH {FACTS}, k AS (SELECT *, {GRAIN} AS grain, {FY_KEY} AS fk FROM facts),
g AS (SELECT org, metric_code, fk, sum(CAST(numeric_value AS DECIMAL(20,6))) FILTER (grain = 'MONTHLY') AS m,
  sum(CAST(numeric_value AS DECIMAL(20,6))) FILTER (grain = 'ANNUAL') AS a FROM k WHERE numeric_value IS NOT NULL GROUP BY 1, 2, 3)
SELECT concat_ws(':', org, metric_code, fk, 'AGGREGATION_INCONSISTENCY') AS issue_id, 'HIGH' AS severity FROM g
WHERE round(abs(m - a) * 100 / greatest(a, 0.001), 2) > 5""")
def aggregation_issues(spark, sf):
    from ledgerlake.operators import calc

    return _ids(conflicts.aggregation_issues(calc.parts_versus_year(ad.facts(spark, sf))))
