"""Dashboard aggregates. Totals are raw unless the caller passes protected facts.

One pass per source table and grain: conditional sums instead of one statement per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.exact import WIDE, exact_sum, quotient

PRODUCTION, TARGET, OFFTAKE = "COAL_PRODUCTION", "PRODUCTION_TARGET", "COAL_OFFTAKE"
OVERBURDEN = ["OVERBURDEN_REMOVAL", "OBR_REMOVAL", "OBR"]


def metric_sum(*codes: str) -> Column:
    return exact_sum(F.when(F.col("metric_code").isin(*codes), F.col("numeric_value")))


def rounded(c: Column, digits: int = 1) -> Column:
    return F.round(c, digits).cast("double")


def ratio_pct(num: Column, den: Column, digits: int = 1) -> Column:
    """num / den * 100, NULL unless den > 0."""
    return F.when(den > 0, quotient(num, den, digits, 100))


def kpis(facts: DataFrame, documents: DataFrame, issues: DataFrame, conflicts: DataFrame,
         not_entities: list[str], reports: DataFrame | None = None) -> DataFrame:
    f = facts.agg(
        F.count("*").alias("facts_extracted"),
        F.count_if(F.col("validation_status") == "VERIFIED").alias("verified_evidence"),
        F.round(F.avg(F.col("confidence_score").cast("decimal(10,6)")), 4).cast("double")
        .alias("average_confidence"),
        F.countDistinct(F.when(~F.col("org").isin(*not_entities), F.col("org")))
        .alias("active_entities"))
    d = documents.agg(F.count_if(F.col("status").isin("READY", "COMPLETED_WITH_WARNINGS", "INDEXING"))
                      .alias("documents_processed"))
    i = issues.agg(F.count_if(F.col("issue_status") != "RESOLVED").alias("pending_reviews"))
    c = conflicts.agg(F.count_if(F.col("status") == "OPEN").alias("true_conflicts"))
    row = f.crossJoin(d).crossJoin(i).crossJoin(c)  # one-row frames
    return row if reports is None else row.crossJoin(reports.agg(F.count("*").alias("reports_generated")))


def top(df: DataFrame, k: int, by: str, *tie: str) -> DataFrame:
    """Top k by a column, names as tie-break."""
    return df.orderBy(F.col(by).desc(), *tie).limit(k)


def entity_summary(facts: DataFrame, k: int = 10) -> DataFrame:
    g = facts.filter(F.col("org").isNotNull()).groupBy("org").agg(
        F.count("*").alias("fact_count"), F.countDistinct("field").alias("field_count"),
        rounded(F.coalesce(metric_sum(PRODUCTION), F.lit(0))).alias("production"))
    return top(g, k, "fact_count", "org")


def count_by(df: DataFrame, *keys: str | Column, k: int | None = None) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g if k is None else top(g, k, "n", *[c for c in g.columns if c != "n"])


def period_pivot(facts: DataFrame) -> DataFrame:
    """Production, target and dispatch per fiscal period in one pass; periods without production
    drop out."""
    g = facts.filter(F.col("reporting_period").like("FY%")).groupBy("reporting_period").agg(
        rounded(metric_sum(PRODUCTION)).alias("production"),
        rounded(metric_sum(TARGET)).alias("target"),
        rounded(metric_sum(OFFTAKE)).alias("dispatch")).filter("production IS NOT NULL")
    return g.withColumn("achievement_pct", ratio_pct(F.col("production"), F.col("target")))


def with_spine(spine: DataFrame, agg: DataFrame, key: str, zero: list[str]) -> DataFrame:
    """Every entity of the spine, 0 where it has no row."""
    return spine.join(agg, key, "left").fillna(0, subset=zero)


def target_vs_actual(spine: DataFrame, facts: DataFrame) -> DataFrame:
    g = facts.groupBy("org").agg(metric_sum(PRODUCTION).alias("act"), metric_sum(TARGET).alias("tgt"))
    j = spine.join(g, "org", "left")
    act, tgt = F.coalesce(F.col("act"), F.lit(0)), F.col("tgt")
    return j.select(
        "org", rounded(act).alias("actual"),
        F.when(tgt > 0, rounded(tgt)).alias("target"),
        F.when(tgt > 0, rounded(act - tgt)).alias("variance"),
        ratio_pct(act, tgt).alias("achievement_pct"))


def production_vs_dispatch(spine: DataFrame, facts: DataFrame) -> DataFrame:
    g = facts.groupBy("org").agg(metric_sum(PRODUCTION).alias("p"), metric_sum(OFFTAKE).alias("d"))
    j = spine.join(g, "org", "left")
    p, d = F.coalesce(F.col("p"), F.lit(0)), F.coalesce(F.col("d"), F.lit(0))
    return j.select("org", rounded(p).alias("production"), rounded(d).alias("dispatch"),
                    rounded(p - d).alias("stock_addition"))


def confidence_bands(facts: DataFrame) -> DataFrame:
    c = F.col("confidence_score")
    return facts.agg(F.count_if(c >= 0.9).alias("high"),
                     F.count_if((c >= 0.75) & (c < 0.9)).alias("medium"),
                     F.count_if(c < 0.75).alias("low"))


def confidence_histogram(facts: DataFrame) -> DataFrame:
    """Ten half-open buckets; 1.0 falls in none. Empty buckets are listed."""
    b = F.floor(F.round(F.col("confidence_score") * 10, 6)).cast("int")
    counts = facts.filter((F.col("confidence_score") >= 0) & (F.col("confidence_score") < 1)).groupBy(
        b.alias("bucket")).agg(F.count("*").alias("n"))
    spine = facts.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    return with_spine(spine, counts, "bucket", ["n"])


def growth(totals: DataFrame, value: str, order: str, partition: list[str]) -> DataFrame:
    """Growth against the previous period in percent; 0 for the first and after a total <= 0."""
    w = Window.partitionBy(*partition).orderBy(order)
    prev = F.lag(value).over(w)
    g = F.when(prev > 0, quotient(F.col(value) - prev, prev, 1, 100)).otherwise(0.0)
    return totals.withColumn("growth_pct", g)


def share_of_total(facts: DataFrame, k: int = 10) -> DataFrame:
    """Share of all facts (NULL entities included in the total) per entity, top k."""
    g = facts.groupBy("org").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    s = (g.crossJoin(total).filter(F.col("org").isNotNull())  # one row
         .withColumn("share_pct", ratio_pct(F.col("n"), F.col("total"))).drop("total"))
    return top(s, k, "n", "org")


def per_month(df: DataFrame, day: str) -> DataFrame:
    """Rows per month; every month that occurs."""
    g = df.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return g.orderBy("month")


def per_day(df: DataFrame, ts: str) -> DataFrame:
    """Rows per day; every day that occurs."""
    g = df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return g.orderBy("day")


def sigma_outliers(facts: DataFrame, keys: list[str], factor: float = 3.0) -> DataFrame:
    """Facts further than `factor` standard deviations from the mean of their keys; statistics are
    aggregated and joined back, not windowed."""
    s = facts.groupBy(*keys).agg(F.avg("numeric_value").alias("_m"), F.stddev_samp("numeric_value").alias("_sd"))
    far = F.abs(F.col("numeric_value") - F.col("_m")) > F.col("_sd") * factor + 1e-9
    return facts.join(s, keys).filter(far).drop("_m", "_sd")


def production_by(facts: DataFrame, key: str, k: int = 10) -> DataFrame:
    g = (facts.filter((F.col("metric_code") == PRODUCTION) & F.col(key).isNotNull()).groupBy(key)
         .agg(rounded(exact_sum(F.col("numeric_value"))).alias("production")))
    return top(g, k, "production", key)


def verification_rate(spine: DataFrame, facts: DataFrame) -> DataFrame:
    g = facts.groupBy("org").agg(
        F.count("*").alias("facts"),
        F.count_if(F.col("validation_status") == "VERIFIED").alias("verified"))
    j = with_spine(spine, g, "org", ["facts", "verified"])
    return j.withColumn("verified_pct", F.coalesce(ratio_pct(F.col("verified"), F.col("facts")),
                                                   F.lit(0.0)))


def stripping_ratio(facts: DataFrame, codes: list[str] = OVERBURDEN) -> DataFrame:
    """Overburden over production per fiscal period (production at least 0.1)."""
    g = facts.filter(F.col("reporting_period").like("FY%")).groupBy("reporting_period").agg(
        F.coalesce(metric_sum(*codes), F.lit(0)).alias("ob"), metric_sum(PRODUCTION).alias("p"))
    p = F.greatest(F.coalesce(F.col("p"), F.lit(0)), F.lit("0.1").cast(WIDE))
    return g.select(
        "reporting_period", rounded(F.col("ob")).alias("overburden"),
        rounded(F.coalesce(F.col("p"), F.lit(0))).alias("production"),
        quotient(F.col("ob"), p, 2).alias("ratio"))


def issue_statistics(issues: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    is_open = F.col("issue_status") == "OPEN"
    counts = issues.agg(
        F.count("*").alias("total"), F.count_if(is_open).alias("open"),
        F.count_if(~is_open).alias("resolved"),
        F.count_if(is_open & (F.col("severity") == "CRITICAL")).alias("critical"),
        F.count_if(is_open & (F.col("severity") == "HIGH")).alias("high"))
    if conflicts is None:
        return counts
    return counts.crossJoin(conflicts.agg(F.count_if(F.col("status") == "OPEN").alias("conflicts")))  # one-row frames


def real_demo_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count_if(~F.col("is_demo")).alias("real"), F.count_if("is_demo").alias("demo"))
             .select(F.lit(n).alias("name"), "real", "demo") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
             for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def review_queue(facts: DataFrame, issues: DataFrame, conflicts: DataFrame) -> DataFrame:
    low = (F.col("confidence_score") < 0.75) | F.col("validation_status").isin(
        "NEEDS_REVIEW", "REVIEW_REQUIRED")
    a = issues.agg(F.count_if(F.col("issue_status") == "OPEN").alias("open_issues"))
    b = conflicts.agg(F.count_if(F.col("status") == "OPEN").alias("open_conflicts"))
    c = facts.agg(F.count_if(low).alias("low_confidence"))
    return a.crossJoin(b).crossJoin(c)  # one-row frames


def status_distribution(facts: DataFrame) -> DataFrame:
    """Count per status and each status' share of all facts."""
    g = facts.groupBy("validation_status").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(total).select(  # one row
        "validation_status", "n", ratio_pct(F.col("n"), F.col("total"), 2).alias("share_pct"))


def extraction_summary(facts: DataFrame, issues: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Per document: facts, confident facts, facts to review, conflicts, warnings, seconds between the
    first and the last fact."""
    f = facts.groupBy("document_id").agg(
        F.count("*").alias("facts"), F.count_if(F.col("confidence_score") >= 0.85).alias("confident"),
        F.count_if(F.col("validation_status").isin("NEEDS_REVIEW", "REVIEW_REQUIRED")).alias("review"),
        (F.unix_seconds(F.max("created_at")) - F.unix_seconds(F.min("created_at"))).alias("seconds"))
    w = issues.groupBy("document_id").agg(F.count("*").alias("warnings"))
    c = conflicts.groupBy(F.col("primary_document_id").alias("document_id")).agg(
        F.count("*").alias("conflicts"))
    return (f.join(w, "document_id", "left").join(c, "document_id", "left")
            .fillna(0, subset=["warnings", "conflicts"]))


def latest_stage(log: DataFrame) -> DataFrame:
    """Last log stage per key, with the number of warnings."""
    return log.groupBy("key").agg(
        F.max(F.struct("ts", "event_id", "stage")).getField("stage").alias("stage"),
        F.count_if(F.col("stage") == "error").alias("warnings"), F.count("*").alias("lines"))


def stage_warnings(log: DataFrame, stage: str = "error") -> DataFrame:
    """The warnings of every key, one row each, newest first by `place`."""
    w = Window.partitionBy("key").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return log.filter(F.col("stage") == stage).withColumn("place", F.row_number().over(w))


def entity_rollup(facts: DataFrame) -> DataFrame:
    """Region, organisation and site totals of production in one pass."""
    g = facts.filter(F.col("metric_code") == PRODUCTION).rollup("field", "org", "site").agg(
        F.count("*").alias("n"), exact_sum(F.col("numeric_value")).alias("t"),
        F.grouping_id().alias("level"))
    return g.select("field", "org", "site", "n", F.col("t").cast("double").alias("production"),
                    F.col("level").cast("bigint").alias("level"))
