"""Queries: streams run to the end of the files, compared with the same question in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.plans.ledger_writes import CONFLICTS, UPDATED, UPSERT_KEY_SQL
from ledgerlake.plans.registry import query
from ledgerlake.plans.sqlparts import FACTS
from ledgerlake.sources import adapters as ad
from ledgerlake.streaming import jobs
from ledgerlake.streaming.ingest import IncrementalIngest


def events(spark, sf):
    e = jobs.read_file_stream(spark, sf, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                    F.col("event_type").alias("action"),
                    F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))


@query("stream_audit_per_day", """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS action, count(*) AS n
FROM events GROUP BY 1, 2""")
def stream_audit_per_day(spark, sf):
    folder = jobs.shared_folder(spark, "audit")
    return jobs.latest_updates(spark, jobs.audit_per_day(events(spark, sf)), folder, ["day", "action"])


@query("stream_attempts", """SELECT window_start, user_id, count(*) AS n, count(*) >= 5 AS alert FROM (
  SELECT user_id, unnest(range((CAST(floor(epoch(ts)) AS BIGINT) // 10) * 10 - 50,
    (CAST(floor(epoch(ts)) AS BIGINT) // 10) * 10 + 1, 10)) AS window_start FROM events) GROUP BY 1, 2""")
def stream_attempts(spark, sf):
    folder = jobs.shared_folder(spark, "attempts")
    return jobs.latest_updates(
        spark, jobs.attempt_windows(events(spark, sf)), folder, ["window_start", "user_id"])


@query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS brk
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ses FROM g)
SELECT epoch_us(min(ts)) AS session_start, user_id, count(*) AS turns,
  arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_value FROM n GROUP BY user_id, ses
-- finished: half an hour idle before the watermark, which is one hour behind the newest event
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE""")
def stream_sessions(spark, sf):
    folder = jobs.shared_folder(spark, "sessions")
    return jobs.appended(spark, jobs.sessions(events(spark, sf)), folder)


@query("stream_distinct_documents", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def stream_distinct_documents(spark, sf):
    docs = jobs.read_file_stream(spark, sf, "documents").withColumn(
        "uploaded_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 540).cast("int")))
    folder = jobs.shared_folder(spark, "documents")
    return jobs.distinct_documents(spark, docs, "uploaded_on", "600 days", folder).select("sha256")


def _ingest(spark, sf):
    stream = ad.facts(spark, sf, jobs.read_file_stream(spark, sf, "lineitem"))
    return jobs.ingest_stream(spark, stream, jobs.shared_folder(spark, "ingest"), UPDATED)


LAST = f"""last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {UPSERT_KEY_SQL}
  ORDER BY created_at DESC, fact_id DESC) AS rn FROM facts) WHERE rn = 1)"""


@query("stream_ingest_ledger", f"""WITH {FACTS}, {LAST} SELECT fact_id, numeric_value, validation_status FROM last""")
def stream_ingest_ledger(spark, sf):
    return _ingest(spark, sf).ingested().select("fact_id", "numeric_value", "validation_status")


@query("stream_ingest_conflicts", f"""WITH {FACTS.replace("facts AS", "facts0 AS", 1)},
facts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {UPSERT_KEY_SQL}
  ORDER BY created_at DESC, fact_id DESC) AS rn FROM facts0) WHERE rn = 1), {CONFLICTS}
SELECT conflict_id, discrepancy_percent FROM conflicts""")
def stream_ingest_conflicts(spark, sf):
    return _ingest(spark, sf).conflicts().select("conflict_id", "discrepancy_percent")


CUTS = ["1994-01-01", "1996-01-01", "1997-07-01"]
BATCH_NO = " ".join(f"WHEN created_at < TIMESTAMP '{d}' THEN {i}" for i, d in enumerate(CUTS))
BATCHED = f"""WITH {FACTS.replace("facts AS", "facts0 AS", 1)},
each AS (SELECT *, CASE {BATCH_NO} ELSE {len(CUTS)} END AS b FROM facts0),
fresh AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY b, {UPSERT_KEY_SQL}
  ORDER BY created_at DESC, fact_id DESC) = 1),
facts AS (SELECT arg_min(fact_id, b) AS fact_id, document_id, metric_code, reporting_period, org,
  arg_max(numeric_value, b) AS numeric_value, arg_min(created_at, b) AS created_at,
  arg_max(validation_status, b) AS validation_status FROM fresh
  GROUP BY {UPSERT_KEY_SQL}), {CONFLICTS}"""


def _batches(spark, sf):
    """Four batches by time; every one meets a job that knows nothing but the folder, and is sent twice."""
    folder = jobs.shared_folder(spark, "batches")
    lines = ad.read_table(spark, sf, "lineitem")
    # the ingest spreads the rows itself; only a table of few pieces is spread before
    few = lines.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    facts = ad.facts(spark, sf, None if few else lines)
    at = F.col("created_at")
    ends = [F.lit(d).cast("timestamp") for d in CUTS]
    for i in range(len(CUTS) + 1):
        part = facts if i == 0 else facts.filter(at >= ends[i - 1])
        part = part if i == len(CUTS) else part.filter(at < ends[i])
        for _ in range(2):
            IncrementalIngest(spark, folder, UPDATED).process(part, i)
    return IncrementalIngest(spark, folder, UPDATED)


@query("ingest_over_restarts", f"""{BATCHED} SELECT fact_id, numeric_value,
  CASE WHEN c.conflicting_fact_id IS NOT NULL THEN 'CONFLICT' ELSE validation_status END AS validation_status
FROM facts LEFT JOIN (SELECT DISTINCT conflicting_fact_id FROM conflicts) c ON c.conflicting_fact_id = fact_id""")
def ingest_over_restarts(spark, sf):
    return _batches(spark, sf).ledger().select("fact_id", "numeric_value", "validation_status")


@query("conflicts_over_restarts", f"{BATCHED} SELECT conflict_id, discrepancy_percent FROM conflicts")
def conflicts_over_restarts(spark, sf):
    return _batches(spark, sf).conflicts().select("conflict_id", "discrepancy_percent")
