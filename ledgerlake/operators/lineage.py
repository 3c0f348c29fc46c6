"""Calculation runs, their inputs, and where a fact was used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _run_id(operation, keys: list[str], run_at: Column | None) -> Column:
    """A hash of operation, scope and, in a log of runs, the time. It is never NULL, and said not to be: a join on it
    would else test it in one of two equal branches, which then could not share their shuffle."""
    return F.coalesce(F.sha2(F.concat_ws("|", operation, *keys, *([] if run_at is None else [run_at.cast("string")])), 256), F.lit(""))


def run_rows(results: DataFrame, keys: list[str], initiated_by: str, run_at: Column | None = None) -> DataFrame:
    """One run per scope. Without a time a rerun gives the same row; with run_at it is a row of its own."""
    more = [] if run_at is None else [run_at.alias("run_at")]
    return results.select(
        _run_id("operation", keys, run_at).alias("run_id"), *keys, "operation", "success", "error_code", "result", "unit",
        "evidence_total", "evidence_used", "evidence_excluded", "verified_pct",
        F.lit(initiated_by).alias("initiated_by"), *more)


def input_rows(labelled: DataFrame, keys: list[str], operation: str = "SUM", run_at: Column | None = None) -> DataFrame:
    """Every fact a run saw, INCLUDED or EXCLUDED with the reason."""
    return labelled.select(
        _run_id(F.lit(operation), keys, run_at).alias("run_id"), "fact_id", "document_id",
        F.when(F.col("exclusion_reason").isNull(), "INCLUDED").otherwise("EXCLUDED").alias("role"),
        "exclusion_reason", F.col("numeric_value").alias("value"))


def append_runs(runs: DataFrame, inputs: DataFrame, folder: str) -> None:
    """Adds runs and their inputs to the log; rows that are there stay. Inputs first: a run that is listed has all of its."""
    inputs.write.mode("append").parquet(f"{folder}/inputs")
    runs.write.mode("append").parquet(f"{folder}/runs")


def read_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(runs, inputs); a run that was appended twice, after a failure, counts once."""
    runs, inputs = (spark.read.parquet(f"{folder}/{part}") for part in ("runs", "inputs"))
    return runs.dropDuplicates(["run_id"]), inputs.dropDuplicates(["run_id", "fact_id"])


def run_details(runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """A run with its inputs, one row per input: a run over many facts is never one nested row."""
    return runs.select("run_id", "operation", "result", "success").join(inputs, "run_id")


def run_input_counts(runs: DataFrame, inputs: DataFrame) -> DataFrame:
    c = inputs.groupBy("run_id").agg(
        F.count_if(F.col("role") == "INCLUDED").alias("included"),
        F.count_if(F.col("role") == "EXCLUDED").alias("excluded"))
    return runs.join(c, "run_id", "left")


def evidence_bundle(runs: DataFrame, inputs: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select("document_id", "document_name")
    return run_details(runs, inputs).join(d, "document_id", "left")


def where_used(inputs: DataFrame, runs: DataFrame, k: int = 10) -> DataFrame:
    """The last k runs per fact, by time where the runs have one. Each task keeps k rows a fact before the shuffle."""
    time = ["run_at"] if "run_at" in runs.columns else []
    w = Window.partitionBy("fact_id").orderBy(*[F.col(c).desc() for c in (*time, "run_id")])
    return (inputs.filter("role = 'INCLUDED'").select("fact_id", "run_id").distinct()
            .join(runs.select("run_id", "operation", "result", *time), "run_id")
            .withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k))


def claim_usage(links: DataFrame, claims: DataFrame, reports: DataFrame) -> DataFrame:
    """fact -> link -> claim -> report."""
    return links.join(claims, "claim_id").join(reports, "report_id")
