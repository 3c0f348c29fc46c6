"""Dossiers, citations and related evidence of facts, for the whole ledger at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import location
from ledgerlake.operators.protect import same_key_join
from ledgerlake.sources.folders import shared_folder

# metric -> metrics that complement it
COMPLEMENTARY = {
    "PROD": ["PRODUCTION_TARGET", "COAL_OFFTAKE", "OVERBURDEN_REMOVAL"],
    "TARGET": ["COAL_PRODUCTION", "COAL_OFFTAKE"],
    "OFFTAKE": ["COAL_PRODUCTION", "COAL_STOCK"],
    "DRILL": ["EXPLORATION_BOREHOLES", "GEOLOGICAL_RESERVES"],
}


def complementary(metric: Column) -> Column:
    out = None
    for part, codes in COMPLEMENTARY.items():
        cond, val = F.contains(metric, F.lit(part)), F.array(*[F.lit(c) for c in codes])
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.array().cast("array<string>"))


def fact_location() -> Column:
    column = F.lit(None).cast("string")
    return location(F.col("sheet_name"), F.col("cell_reference"), F.col("row_number"), column,
                    F.col("page_number"))


def citations(facts: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select("document_id", "document_name", "file_type")
    return facts.join(d, "document_id", "left").select(
        "fact_id", "document_id", F.coalesce("document_name", F.lit("Document")).alias("document_name"),
        "file_type", "metric_code", "numeric_value", "unit", "org", "reporting_period",
        fact_location().alias("location"), "confidence_score", "human_verified")


def dossiers(facts: DataFrame, documents: DataFrame, statuses: DataFrame | None = None, more: list[Column] = ()) -> DataFrame:
    """Source, location, raw, normalised, extraction and validation parts of every fact as structs. Facts that have
    their conflict_status already need no `statuses`, and meet nothing by their id; `more` columns come after these."""
    d = documents.select("document_id", "document_name", "file_type")
    j = facts.join(d, "document_id", "left")
    if statuses is not None:
        j = j.join(statuses.select("fact_id", "conflict_status"), "fact_id", "left")
    parser = F.when(F.col("cell_reference").isNotNull(), "Deterministic Table / Cell Parser").otherwise(
        "Structured Layout Extractor")
    return j.select(
        "fact_id",
        F.struct("document_id", "document_name", "file_type").alias("source"),
        F.struct("sheet_name", "cell_reference", "row_number", "page_number",
                 F.coalesce(fact_location(), F.lit("Precise coordinates tracked in Evidence Ledger"))
                 .alias("summary")).alias("location"),
        F.struct("metric_code", "numeric_value", "unit", "reporting_period", "org", "field", "site")
        .alias("normalised"),
        F.struct("extraction_method", parser.alias("parser"),
                 F.round("confidence_score", 4).alias("confidence")).alias("extraction"),
        F.struct("validation_status", "human_verified", "conflict_status").alias("validation"), *more)


def related_facts(facts: DataFrame, n: int = 8) -> DataFrame:
    """Top n related facts of every fact: same or complementary metric of the organisation, or the
    same document, by confidence.

    No pairs are built. The best n of a fact lie among the best n + 1 of each of its groups, so each
    group keeps n + 1 rows. The lists are put together once for each organisation, metric and document, and
    stored, so that the planner knows their size; facts meet them last and carry no list over a shuffle."""
    row = F.struct((-F.col("confidence_score")).alias("o"), "fact_id", "metric_code",
                   "reporting_period", "document_id")

    def best(keys: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.col("confidence_score").desc(), "fact_id")
        top = facts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n + 1)
        return top.groupBy(*keys).agg(F.collect_list(row).alias(name))

    by_metric = best(["org", "metric_code"], "own")
    kinds = by_metric.select("org", "metric_code").select(
        "org", "metric_code", F.explode(F.array_append(complementary(F.col("metric_code")),
                                                      F.col("metric_code"))).alias("m"))
    lists = (kinds.join(by_metric.withColumnRenamed("metric_code", "m"), ["org", "m"])
             .groupBy("org", "metric_code").agg(F.flatten(F.collect_list("own")).alias("near")))
    docs = best(["document_id"], "same_doc")
    base = facts.select("fact_id", "org", "metric_code", "reporting_period", "document_id")
    keys = ["org", "metric_code", "document_id"]
    empty = F.array().cast(docs.schema["same_doc"].dataType)
    folder = shared_folder(facts.sparkSession, "related")
    base.select(*keys).distinct().join(lists, ["org", "metric_code"], "left").join(docs, "document_id", "left").select(*keys, F.array_sort(
        F.array_distinct(F.concat(F.coalesce("near", empty), F.coalesce("same_doc", empty)))).alias("pool")).write.parquet(folder)
    j = same_key_join(base, facts.sparkSession.read.parquet(folder), keys)
    others = F.filter("pool", lambda x: x["fact_id"] != F.col("fact_id"))
    x = j.select("fact_id", "metric_code", "reporting_period", "document_id",
                 F.posexplode(F.slice(others, 1, n)).alias("place", "x"))
    comp = F.array_contains(complementary(F.col("metric_code")), F.col("x.metric_code"))
    kind = (F.when(comp, "COMPLEMENTARY_METRIC")
            .when((F.col("x.metric_code") == F.col("metric_code"))
                  & F.col("x.reporting_period").eqNullSafe(F.col("reporting_period")),
                  "SAME_PERIOD_PEER")
            .when(F.col("x.document_id") == F.col("document_id"), "SAME_SOURCE_DOCUMENT")
            .otherwise("ADJACENT_PERIOD"))
    return x.select("fact_id", (F.col("place") + 1).alias("place"),
                    F.col("x.fact_id").alias("related_fact_id"), kind.alias("relationship_type"))
