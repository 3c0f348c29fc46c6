"""File sources and sinks: CSV cells with provenance, ledger tables, exports, the audit log."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXPORT_COLUMNS = [
    "fact_id", "metric_code", "metric_name", "raw_metric_name", "numeric_value", "unit",
    "reporting_period", "organization", "org", "field", "site", "location", "document_id",
    "document_name", "page_number", "sheet_name", "row_number", "column_name", "cell_reference",
    "confidence_score", "validation_status", "is_demo"]


def _cp1252(line: Column) -> Column:
    """Text read as ISO-8859-1 turned into cp1252: both agree but for the codes 0x80-0x9F."""
    pairs = [(chr(i), bytes([i]).decode("cp1252", "ignore")) for i in range(0x80, 0xA0)]
    pairs = [(a, b) for a, b in pairs if b]
    return F.translate(line, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


LINES = "line string, file string, block long, mid long, odd boolean, state int, r0 long, r1 long"


def _scanned(batches):
    """Lines of a split in order -> whether they hold an odd number of quotes; the quote state before them, if
    the split began outside quotes; and how many records have begun so far if it began outside or inside."""
    at, state, seen = None, 0, np.zeros(2, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        line = batch.column("line")
        odd = pc.count_substring(line, '"').to_numpy() % 2
        full = pc.utf8_length(pc.utf8_trim_whitespace(line)).to_numpy() > 0
        block, file = batch.column("block").to_numpy(), batch.column("file").to_pylist()
        keys = list(zip(file, block.tolist(), strict=True))
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        out = []
        for x, y in zip(edges, edges[1:], strict=False):
            if keys[x] != at:
                at, state, seen = keys[x], 0, np.zeros(2, np.int64)
            before = (state + np.r_[0, np.cumsum(odd[x:y])]) % 2
            begun = np.cumsum(np.stack([(before[:-1] == s) & full[x:y] for s in (0, 1)]), axis=1) + seen[:, None]
            out.append((before[:-1], *begun))
            state, seen = int(before[-1]), begun[:, -1]
        states, r0, r1 = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [line, batch.column("file"), batch.column("block"), batch.column("mid"), pa.array(odd > 0), pa.array(states, pa.int32()), pa.array(r0), pa.array(r1)],
            [f.split()[0] for f in LINES.split(", ")])


def read_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV records of files with their 0-based number in the file: file, record_number, record.

    A line break inside quotes belongs to its record; a quote toggles wherever it stands, so two of them change
    nothing. A file may be cut into many splits. Each split is scanned once for both quote states that it may
    begin in; sums over the splits before tell which one holds and how many records came earlier. Only lines of
    records that take several are brought together. Blank lines outside quotes are no records. Encodings must
    keep line breaks and quotes single bytes; files must not change between two scans."""
    windows = encoding.lower() in ("cp1252", "windows-1252")
    charset = "ISO-8859-1" if windows or encoding.lower() in ("latin1", "iso-8859-1") else encoding
    text = F.col("value")
    if charset.lower() not in ("utf-8", "utf8"):
        text = F.decode(text.cast("binary"), charset)
    raw = spark.read.option("lineSep", "\n").text(path).select(
        (_cp1252(text) if windows else text).alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    lines = raw.mapInArrow(_scanned, LINES)
    splits = lines.groupBy("file", "block").agg(  # one row a split
        (F.sum(F.col("odd").cast("int")) % 2).alias("odd"), F.max("r0").alias("n0"), F.max("r1").alias("n1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    held = F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1"))
    splits = splits.withColumn("base", F.coalesce(F.sum(held).over(earlier), F.lit(0))).select("file", "block", "inside", "base")
    placed = lines.join(splits, ["file", "block"]).select(
        "file", "block", "mid", "line", "odd", ((F.col("state") + F.col("inside")) % 2 == 0).alias("starts"),
        (F.col("base") + F.when(F.col("inside") == 0, F.col("r0")).otherwise(F.col("r1")) - 1).alias("record_number"))
    whole = placed.filter(F.col("starts") & ~F.col("odd") & F.col("line").rlike(r"\S")).select("file", "record_number", F.col("line").alias("record"))
    several = placed.filter(~F.col("starts") | F.col("odd")).groupBy("file", "record_number").agg(
        F.array_sort(F.collect_list(F.struct("block", "mid", "line"))).alias("lines"))
    return whole.unionByName(several.select("file", "record_number", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record")))


def record_fields(record: Column, sep: str = ",") -> Column:
    """Fields of a CSV record: separators between quotes do not count, outer quotes go, doubled ones are one.
    The character U+0001 must not occur."""
    bare = F.regexp_replace(record, "\r$", "")
    parts = F.transform(F.split(bare, '"'), lambda x, i: F.when(i % 2 == 0, F.translate(x, sep, "\u0001")).otherwise(x))
    quoted = lambda v: v.startswith('"') & v.endswith('"') & (F.length(v) > 1)
    return F.transform(F.split(F.array_join(parts, '"'), "\u0001", -1), lambda v: F.when(
        quoted(v), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))


def read_csv_cells(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8"
                   ) -> DataFrame:
    """CSV files as cells: headers trimmed, sheet CSV_DATA, row number = record in the file, the header being 1.
    A document is named by its file, by its whole path where several files bear the name."""
    records = read_records(spark, path, encoding).withColumn("fields", record_fields(F.col("record"), sep))
    header = records.filter("record_number = 0").select("file", F.transform("fields", lambda v: F.trim(F.replace(v, F.lit("\ufeff"), F.lit("")))).alias("names"))
    name = F.element_at(F.split("file", "/"), -1)
    known = header.select("file", name.alias("name"))
    several = known.groupBy("name").agg(F.count("*").alias("n"))
    header = header.join(known.join(several, "name").select("file", F.when(F.col("n") > 1, F.col("file")).otherwise(F.col("name")).alias("document_id")), "file")
    rows = records.filter("record_number > 0").join(header, "file")
    cells = rows.select(
        "document_id", (F.col("record_number") + 1).cast("int").alias("row_number"), "names",
        F.posexplode("fields").alias("p", "value"))
    return cells.select(
        "document_id", F.lit("CSV_DATA").alias("sheet_name"), "row_number",
        (F.col("p") + 1).alias("column_number"), F.get("names", F.col("p")).alias("column_name"),
        F.concat(F.lit("R"), F.col("row_number").cast("string"), F.lit("C"),
                 (F.col("p") + 1).cast("string")).alias("cell_reference"), "value")


def write_ledger(facts: DataFrame, path: str, mode: str = "append") -> None:
    """Ledger as Parquet by metric, with the period keys stored. Partitions are overwritten singly."""
    from ledgerlake.operators.protect import with_period_keys

    (with_period_keys(facts).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("metric_code").parquet(path))


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def export_frame(facts: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """The 22 export columns; with a register only the facts it lists."""
    if register is not None:
        facts = facts.join(register.select("fact_id"), "fact_id", "left_semi")
    return facts.select(*[
        F.col(c) if c in facts.columns else F.lit(None).cast("string").alias(c)
        for c in EXPORT_COLUMNS])


def export_facts(facts: DataFrame, path: str, register: DataFrame | None = None) -> None:
    export_frame(facts, register).write.mode("overwrite").option("header", True).csv(path)
