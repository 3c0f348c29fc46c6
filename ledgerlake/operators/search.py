"""Listings and searches over ledger, issues, conflicts and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.scope import all_of
from ledgerlake.sources.folders import shared_folder

SEARCHED = ["metric_name", "metric_code", "site", "field", "source_context"]


def search_ledger(facts: DataFrame, text: str | None = None, metric: str | None = None,
                  period: str | None = None, org: str | None = None, document: str | None = None,
                  status: str | None = None, min_confidence: float | None = None,
                  page: int = 1, size: int = 50) -> DataFrame:
    """One page of matching facts, newest first, with the number of matches and status totals."""
    conds = []
    if text:
        cols = [c for c in SEARCHED if c in facts.columns]
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{text.strip()}%"), F.lit(False))
        conds.append(hit)
    for name, value in (("metric_code", metric), ("reporting_period", period), ("org", org),
                        ("document_id", document), ("validation_status", status)):
        if value is not None:
            conds.append(F.col(name) == value)
    if min_confidence is not None:
        conds.append(F.col("confidence_score") >= min_confidence)
    match = all_of(conds)
    st = F.col("validation_status")
    totals = facts.agg(
        F.count_if(match).alias("total"), F.count_if(st == "VERIFIED").alias("verified_count"),
        F.count_if(st.isin("NEEDS_REVIEW", "REVIEW_REQUIRED")).alias("review_count"),
        F.count_if(st == "CONFLICT").alias("conflict_count"))
    rows = (facts.filter(match).orderBy(F.col("created_at").desc(), "fact_id")
            .offset((page - 1) * size).limit(size))
    return rows.crossJoin(totals)  # one row of totals


def severity_rank(c: str = "severity"):
    s = F.col(c)
    return F.when(s == "CRITICAL", 4).when(s == "HIGH", 3).when(s == "MEDIUM", 2).otherwise(1)


def search_issues(issues: DataFrame, text: str | None = None, page: int = 1, size: int = 50,
                  **equal: str | None) -> DataFrame:
    """Issues by equality filters and text, most severe first, then newest."""
    conds = [F.col(k) == v for k, v in equal.items() if v is not None and v != "ALL"]
    if text:
        hit = F.lit(False)
        for c in ("issue_type", "org", "document_id", "fact_id", "severity"):
            hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        conds.append(hit)
    return (issues.filter(all_of(conds))
            .orderBy(severity_rank().desc(), F.col("created_at").desc(), "issue_id")
            .offset((page - 1) * size).limit(size))


Order = list[tuple[str, bool]]  # column, descending
SAMPLE, BUCKETS = 4096, 64


def page_of(df: DataFrame, order: Order, page: int = 1, size: int = 50) -> DataFrame:
    """Rows of one page, with `total`. `order` must tell rows apart. NULL comes first rising, last falling.

    A sample gives bounds on the first column, one count per bucket tells where the page lies, and only the
    buckets that it meets are sorted, however far behind it is."""
    lead, falling = order[0]
    total = df.count()
    start, stop = (page - 1) * size, min(page * size, total)
    keys = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    if start >= stop:
        return df.limit(0).withColumn("total", F.lit(total))
    drawn = df.select(lead).filter(F.col(lead).isNotNull()).sample(min(1.0, SAMPLE / total), seed=7).distinct().collect()
    values = sorted(r[0] for r in drawn)  # about SAMPLE values
    bounds = sorted({values[i * len(values) // BUCKETS] for i in range(1, BUCKETS)}) if values else []
    above = [F.when(F.col(lead) >= F.lit(v), 1).otherwise(0) for v in bounds]
    bucket = F.when(F.col(lead).isNull(), -1).otherwise(reduce(lambda x, y: x + y, above, F.lit(0)))
    counts = {r["b"]: r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()}
    before, met, seen = 0, [], 0
    for b in sorted(counts, reverse=falling):
        if seen + counts[b] > start and seen < stop:
            before = before if met else seen
            met.append(b)
        seen += counts[b]
    return (df.filter(bucket.isin(*met)).orderBy(*keys).offset(start - before).limit(stop - start)
            .withColumn("total", F.lit(total)))


def listed(df: DataFrame, equal: dict, order: Order, page: int | None, size: int, stored: bool = False) -> DataFrame:
    """Rows by equality filters (None: any; a list: one of them), all of them or one page. A page reads the rows
    four times; `stored` writes them first, for rows that are dear to work out."""
    conds = [F.col(c).isin(*v) if isinstance(v, list) else F.col(c) == v for c, v in equal.items() if v is not None]
    rows = df.filter(all_of(conds))
    if page is not None:
        if stored:
            folder = shared_folder(df.sparkSession, "listed")
            rows.write.parquet(folder)
            rows = df.sparkSession.read.parquet(folder)
        return page_of(rows, order, page, size)
    return rows.orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in order])


def list_documents(docs: DataFrame, name: str | None = None, status: str | None = None, organization: str | None = None,
                   category: str | list[str] | None = None, sort: Order | None = None, page: int | None = None, size: int = 50) -> DataFrame:
    named = docs.filter(F.col("file_name").ilike(f"%{name}%")) if name else docs
    return listed(named, {"status": status, "organization": organization, "category": category},
                  sort or [("uploaded_on", True), ("doc_id", False)], page, size)


def list_conflicts(conflicts: DataFrame, status: str | None = None, org: str | None = None, page: int | None = None, size: int = 50) -> DataFrame:
    """Newest first."""
    return listed(conflicts, {"status": status, "org": org}, [("created_at", True), ("conflict_id", False)], page, size, True)


def list_audit(audit: DataFrame, action: str | None = None, entity_type: str | None = None, page: int | None = None, size: int = 50) -> DataFrame:
    """Newest first."""
    return listed(audit, {"action": action, "entity_type": entity_type}, [("ts", True), ("event_id", False)], page, size)


def children(table: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Rows with their position among the rows of their parent."""
    return table.withColumn("position", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def lookup(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given ids; the one column of `ids` names the key."""
    key = ids.columns[0]
    return table.join(ids.distinct(), key, "left_semi")


def issue_worklist(issues: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Issue with its fact and document."""
    f = facts.select("fact_id", "metric_code", "numeric_value", "unit", "reporting_period")
    d = documents.select("document_id", "document_name")
    return issues.join(f, "fact_id", "left").join(d, "document_id", "left")


def conflict_sides(conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """Conflict with both facts beside each other. Conflicts that bear value and unit of their sides meet no fact."""
    if "primary_numeric_value" in conflicts.columns:
        return conflicts.withColumnsRenamed({"primary_numeric_value": "primary_value", "other_numeric_value": "other_value"})
    def side(name: str, key: str) -> DataFrame:
        return facts.select(F.col("fact_id").alias(key), F.col("numeric_value").alias(f"{name}_value"),
                            F.col("unit").alias(f"{name}_unit"))
    return (conflicts.join(side("primary", "primary_fact_id"), "primary_fact_id", "left")
            .join(side("other", "conflicting_fact_id"), "conflicting_fact_id", "left"))
