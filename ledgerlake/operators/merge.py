"""Ledger writes: duplicate documents, upsert, replacement, deletes, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPSERT_KEYS = ["document_id", "metric_code", "reporting_period", "org", "page_number",
               "cell_reference", "row_number"]


def flag_duplicate_documents(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """SHA-256 of the text; the first holder of a hash is the original.

    Only hash and id are shuffled; a hash held by very many documents is one aggregated row.
    """
    hashed = docs.select(F.col(order).alias("doc_id"), F.sha2("text", 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("doc_id").alias("original_id"))
    return hashed.join(first, "sha256").withColumn(
        "is_duplicate", F.col("doc_id") != F.col("original_id"))


def ingest_summary(batch: DataFrame) -> DataFrame:
    """Total, successful, duplicate and failed documents of a batch with is_duplicate and status."""
    failed = F.col("status") == "FAILED"
    return batch.agg(
        F.count("*").alias("total"),
        F.count_if(~failed & ~F.col("is_duplicate")).alias("successful"),
        F.count_if(~failed & F.col("is_duplicate")).alias("duplicates"),
        F.count_if(failed).alias("failed"))


def with_keys(facts: DataFrame) -> DataFrame:
    """Eight-part dedup key and source hash. Values enter the hash with four decimals."""
    def part(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat_ws(":", part("document_id"), part("metric_code"), part("reporting_period"),
                      part("org"), part("site"), part("cell_reference"), part("page_number"),
                      part("row_number"))
    source = F.concat_ws(":", part("metric_code"),
                         F.when(F.abs("numeric_value") < 1e15, F.coalesce(
                             F.col("numeric_value").cast("decimal(20,4)").cast("string"), F.lit("")))
                         .otherwise(F.coalesce(F.col("numeric_value").cast("string"), F.lit(""))),
                         part("reporting_period"),
                         part("source_context") if "source_context" in facts.columns else F.lit(""))
    return facts.withColumns({"dedup_key": key, "source_hash": F.sha2(source, 256)})


def latest(new: DataFrame, first: list[str] = ()) -> DataFrame:
    """The last row per upsert key, by created_at and fact_id. `first`: columns that follow from the key; rows are
    placed by them and sorted by them first."""
    new = new.repartition(*first) if first else new
    w = Window.partitionBy(*first, *UPSERT_KEYS).orderBy(F.col("created_at").desc(), F.col("fact_id").desc())
    return new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert_unique(ledger: DataFrame, new: DataFrame, updated: list[str], first: list[str] = ()) -> DataFrame:
    """As upsert_facts, for a ledger with one row per key: both sides are shuffled once, together. `first` as in `latest`."""
    both = ledger.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    both = both.repartition(*first) if first else both
    w = Window.partitionBy(*first, *UPSERT_KEYS).orderBy(F.col("_new").desc(), F.col("created_at").desc(), F.col("fact_id").desc())
    kept = [c for c in ledger.columns if c not in (*updated, *first, *UPSERT_KEYS)]
    # the row of the ledger comes last; of a key that is in `new` only, no other row counts than the first
    old = F.last(F.struct("_new", *kept)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = both.withColumn("_old", old).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return rows.select(*[F.when(F.col("_old._new"), F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) if c in kept else F.col(c)
                         for c in ledger.columns])


def upsert_facts(ledger: DataFrame, new: DataFrame, updated: list[str]) -> DataFrame:
    """Ledger after new rows were written on (document, metric, period, organisation, page, cell,
    row). NULL equals NULL. `updated` columns come from the new row; a new key is appended.

    New rows are made unique first (last by created_at, fact_id), so that reruns give the same.
    """
    fresh = latest(new)
    n = fresh.select(*[F.col(c).alias(f"n_{c}") for c in fresh.columns])
    cond = None
    for k in UPSERT_KEYS:
        c = F.col(k).eqNullSafe(F.col(f"n_{k}"))
        cond = c if cond is None else cond & c
    matched = ledger.join(n, cond, "full_outer")
    has_new, has_old = F.col("n_fact_id").isNotNull(), F.col("fact_id").isNotNull()
    out = []
    for c in ledger.columns:
        if c in updated:
            out.append(F.when(has_new, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(has_old, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c))
    return matched.select(*out)


def replace_document(ledger: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given documents are dropped and the new ones appended; idempotent."""
    kept = ledger.join(ids.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    gone = ids.select("document_id").distinct()
    return {n: t.join(gone, "document_id", "left_anti") for n, t in tables.items()}


def patch_documents(docs: DataFrame, patch: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only non-NULL fields of the patch overwrite; one patch row per key."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"p_{c}") for c in fields])
    j = docs.join(p, key, "left")
    return j.select(*[F.coalesce(F.col(f"p_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                      for c in docs.columns])


def rollup_documents(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Fact count, real count, warnings and mean confidence per document."""
    f = facts.groupBy("document_id").agg(
        F.count("*").alias("fact_count"), F.count_if(~F.col("is_demo")).alias("real_fact_count"),
        F.round(F.avg(F.col("confidence_score").cast("decimal(10,6)")), 2).cast("double")
        .alias("average_confidence"))
    i = issues.groupBy("document_id").agg(F.count("*").alias("warning_count"))
    return f.join(i, "document_id", "left").withColumn(
        "warning_count", F.coalesce("warning_count", F.lit(0).cast("bigint")))
