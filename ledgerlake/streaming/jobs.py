"""Structured Streaming twins of batch operators, run over files with availableNow.

Every micro-batch writes only its own folder, so a batch that is repeated after a failure overwrites
itself. Folders lie under the session's shared checkpoint directory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.sources.folders import shared_folder  # noqa: F401
from ledgerlake.streaming.ingest import IncrementalIngest

FILES = 64  # files a batch

def read_file_stream(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """A table as stream, with the schema of the static table; it may be one file or a folder of files."""
    schema = spark.read.parquet(f"{directory}/{table}.parquet").schema
    # a file stream takes a folder or a pattern, no single file; this pattern fits that name alone
    name = f"[{table[0]}]{table[1:]}.parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{directory}/{name}")


def run_available(stream: DataFrame, folder: str, mode: str,
                  write: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over everything that is there now."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()


def latest_updates(spark: SparkSession, stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Final state of an aggregation stream: the last update written per key."""
    out = f"{folder}/updates"

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_available(stream, folder, "update", write)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "batch_id")


def distinct_documents(spark: SparkSession, docs: DataFrame, ts: str, delay: str, folder: str
                       ) -> DataFrame:
    """Drops documents whose content hash was seen within the watermark delay."""
    hashed = docs.select(F.col(ts).cast("timestamp").alias("ts"), F.sha2("text", 256).alias("sha256"))
    unique = hashed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha256"])
    return appended(spark, unique, folder)


def audit_per_day(events: DataFrame, delay: str = "1 day") -> DataFrame:
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "action")
            .agg(F.count("*").alias("n"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "action", "n"))


def attempt_windows(events: DataFrame, length: str = "60 seconds", slide: str = "10 seconds",
                    limit: int = 5, delay: str = "5 minutes") -> DataFrame:
    """Attempts per key in sliding windows with an alert flag."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide).alias("w"), "user_id")
            .agg(F.count("*").alias("n"))
            .select(F.unix_seconds("w.start").alias("window_start"), "user_id", "n",
                    (F.col("n") >= limit).alias("alert")))


def appended(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Rows an append-mode stream has finished."""
    out = f"{folder}/rows"

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_available(stream, folder, "append", write)
    return spark.read.option("basePath", out).parquet(out).drop("batch_id")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Session windows per user: start, turns, and the last value given in the session. A session is
    put out once the watermark has passed its end."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
            .agg(F.count("*").alias("turns"),
                 F.max(F.when(F.col("v").isNotNull(), F.struct("ts", "event_id", "v"))).alias("last"))
            .select(F.unix_micros("w.start").alias("session_start"), "user_id", "turns",
                    F.col("last.v").alias("last_value")))


def ingest_stream(spark: SparkSession, facts: DataFrame, folder: str, updated: list[str]
                  ) -> IncrementalIngest:
    job = IncrementalIngest(spark, folder, updated)
    run_available(facts, folder, "append", job.process)
    return job
