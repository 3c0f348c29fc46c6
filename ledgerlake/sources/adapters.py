"""Star-schema tables seen as ledger tables.

Every adapter is a narrow projection, so column pruning and filters still reach the Parquet scan.
Joins with suppliers are left to the planner: it broadcasts the side only when its size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
GROUP = "NATION_0"
INSTITUTE = "NATION_1"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Balanced pieces of a table, whatever its files look like.

    One big row group cannot be split by the scan and would leave heavy per-row work to one task. Adaptive
    execution sizes the pieces; columns and filters are pushed below the exchange.
    """
    return df.hint("rebalance", *keys)


def _fiscal_period(day: Column, line: Column) -> Column:
    """Period text of a ship date moved 20 years ahead: year, quarter or month by line number."""
    moved = F.add_months(day, 240)
    fiscal = F.add_months(moved, -3)
    start = F.year(fiscal)
    year = F.concat(F.lit("FY "), start.cast("string"), F.lit("-"),
                    F.lpad(((start + 1) % 100).cast("string"), 2, "0"))
    quarter = F.concat(F.lit("Q"), F.quarter(fiscal).cast("string"), F.lit(" "), year)
    month = F.concat(
        F.element_at(F.array(*[F.lit(m) for m in (
            "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]),
            F.month(moved)),
        F.lit(" "), F.year(moved).cast("string"))
    return F.when(line <= 3, year).when(line <= 5, quarter).otherwise(month)


def facts(spark: SparkSession, directory: str, lineitem: DataFrame | None = None) -> DataFrame:
    """lineitem x supplier x nation x region as a fact ledger; `lineitem` may be a stream. The work per row is light
    and row groups share it out, so the rows are not shuffled: queries read the ledger several times, and each time
    would do so."""
    li = read_table(spark, directory, "lineitem") if lineitem is None else lineitem
    sup = read_table(spark, directory, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    nat = read_table(spark, directory, "nation")
    reg = read_table(spark, directory, "region")
    day = F.to_date("l_shipdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    tax = F.round(F.col("l_tax") * 100)
    disc = F.round(F.col("l_discount") * 100)
    status = (F.when(tax >= 6, "VERIFIED").when(tax >= 3, "NEEDS_REVIEW")
              .otherwise("REVIEW_REQUIRED"))
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    open_line = F.col("l_linestatus") == "O"
    metric = (F.when(flag == "N", "COAL_PRODUCTION")
              .when((flag == "R") & open_line, "PRODUCTION_TARGET")
              .when(flag == "R", "OVERBURDEN_REMOVAL")
              .when(open_line, "COAL_OFFTAKE")
              .when(line <= 5, "COAL_STOCK").otherwise("DRILLING"))
    qty = F.col("l_quantity")
    # one plain scan per join side, so that the planner can judge the size of each
    joined = (li.join(sup, li.l_suppkey == sup.s_suppkey, "left")
              .join(nat, F.col("s_nationkey") == F.col("n_nationkey"), "left")
              .join(reg, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.unix_date(day), cents).alias("fact_id"),
        F.when((tax == 8) & (disc == 10) & (qty == 50), F.col("l_suppkey") + 100000)
        .otherwise(F.col("l_suppkey")).cast("string").alias("document_id"),
        metric.alias("metric_code"),
        F.col("n_name").alias("org"), F.col("r_name").alias("field"), F.col("s_name").alias("site"),
        _fiscal_period(day, line).alias("reporting_period"),
        F.lit(None).cast("string").alias("temporal_grain"),
        (F.floor(F.col("l_extendedprice") / 10000) * 10).cast("double").alias("numeric_value"),
        F.when(qty == 50, None).when(qty >= 45, "BCM").otherwise("MT").alias("unit"),
        ((disc * 4 + 55) / 100).alias("confidence_score"),
        status.alias("validation_status"),
        (status == "VERIFIED").alias("human_verified"),
        (qty == 1).alias("is_demo"),
        F.when(open_line, "STRUCTURED_TABLE").when(qty < 30, "REGEX_PATTERN")
        .otherwise("OCR_BLOCK").alias("extraction_method"),
        F.when(open_line, F.concat(F.lit("Sheet"), (line % 3 + 1).cast("string")))
        .alias("sheet_name"),
        F.when(~open_line & (qty >= 3), (F.col("l_partkey") % 40 + 1).cast("int"))
        .alias("page_number"),
        F.when(open_line, (line + 1).cast("int")).alias("row_number"),
        F.when(open_line, F.concat(F.char(F.lit(65) + line), (line + 1).cast("string")))
        .alias("cell_reference"),
        F.timestamp_seconds(
            F.unix_date(day).cast("bigint") * 86400 + F.col("l_orderkey") % 86400)
        .alias("created_at"))


def documents(spark: SparkSession, directory: str) -> DataFrame:
    """documents as document rows with name, type, status, upload day and text."""
    d = spread(read_table(spark, directory, "documents"), "doc_id")
    k = F.col("doc_id")

    def pick(values: list[str], step: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (step % len(values) + 1).cast("int"))

    return d.select(
        k.alias("doc_id"), "text", "lang", "source",
        F.concat(
            pick(["prod_", "drill_log_", "dispatch_", "geol_", "reserve_", "misc_"], k),
            F.col("source"), F.lit("_"), k.cast("string"), F.lit("."),
            pick(["pdf", "csv", "xlsx", "txt", "png"], k)).alias("file_name"),
        pick(["PDF", "CSV", "XLSX", "TXT", "PNG"], k).alias("file_type"),
        pick(["READY", "READY", "READY", "COMPLETED_WITH_WARNINGS", "INDEXING", "FAILED",
              "PROCESSING"], k).alias("status"),
        F.when(k % 9 == 0, None).otherwise(F.concat(F.lit("Org "), F.col("lang"))).alias("organization"),
        (k % 10 == 3).alias("is_demo"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 540).cast("int")).alias("uploaded_on"))


def report_documents(spark: SparkSession, directory: str) -> DataFrame:
    """The documents the facts of `facts` point at: one main and one revised file per supplier."""
    s = read_table(spark, directory, "supplier")
    both = s.select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(100000))).alias("shift"))
    return both.select(
        (F.col("s_suppkey") + F.col("shift")).cast("string").alias("document_id"),
        F.concat(F.lit("report_"), F.col("s_suppkey").cast("string"),
                 F.when(F.col("shift") > 0, "_rev").otherwise(""), F.lit(".xlsx"))
        .alias("document_name"),
        F.when(F.col("s_suppkey") % 2 == 0, "XLSX").otherwise("PDF").alias("file_type"))


def audit(spark: SparkSession, directory: str) -> DataFrame:
    e = read_table(spark, directory, "events")
    return e.select(
        F.col("event_id"), F.col("ts"), F.col("user_id"), F.col("event_type").alias("action"),
        F.when(F.col("event_id") % 3 == 0, "fact").when(F.col("event_id") % 3 == 1, "document")
        .otherwise("report").alias("entity_type"))


def questions(spark: SparkSession, directory: str) -> DataFrame:
    """Questions phrased from orders: organisation, metric, period and a claimed figure."""
    o = spread(read_table(spark, directory, "orders"), "o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(values: list[str], step: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (step % len(values) + 1).cast("int"))

    def one_of(texts: list[Column], step: Column) -> Column:
        """As pick, but only the chosen text is put together."""
        return reduce(lambda w, i: w.when(step % len(texts) == i, texts[i]), range(1, len(texts)), F.when(step % len(texts) == 0, texts[0]))

    org = pick(Q_ORGS, c)
    metric = pick(Q_METRICS, k)
    year = F.year("o_orderdate") + 20
    short = F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    ys = year.cast("string")
    period = one_of([
        F.concat(F.lit("FY "), ys, F.lit("-"), short),
        F.concat(ys, F.lit("-"), short),
        F.concat(ys, F.lit("/"), short),
        F.concat(F.lit("FY"), (year + 1).cast("string")),
        F.concat(F.lit("Financial Year "), ys, F.lit("-"), short),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" FY "), ys,
                 F.lit("-"), short),
        F.concat(F.date_format("o_orderdate", "MMMM"), F.lit(" "), ys),
        F.lit("last year")], c)
    number = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("."),
                      (k % 10).cast("string"))
    text = one_of([
        F.concat(F.lit("What was "), org, F.lit(" "), metric, F.lit(" in "), period, F.lit("?")),
        F.concat(F.lit("Verify claim: "), org, F.lit(" "), metric, F.lit(" was "), number,
                 F.lit(" MT in "), period),
        F.concat(F.lit("Compare "), metric, F.lit(" across all subsidiaries in "), period),
        F.concat(F.lit("Show the "), metric, F.lit(" trend of "), org, F.lit(" over time")),
        F.concat(F.lit("What percentage of its target did "), org, F.lit(" achieve in "), period,
                 F.lit("?")),
        F.concat(org, F.lit(" produced "), number, F.lit(" MT in "), period),
        F.concat(F.lit("Any conflicts in "), metric, F.lit(" of "), org, F.lit("?")),
        F.concat(F.lit("Why did "), org, F.lit(" miss it? Who stopped the October plan")),
        F.lit("hello there"),
        F.concat(F.lit("Summarize the report of "), org),
        F.concat(F.lit("Prepare a Lok Sabha answer on "), metric),
        F.concat(F.lit("Where does this figure come from: "), number)], k)
    return o.select(
        k.alias("question_id"), c.alias("user_id"), F.col("o_orderdate").alias("asked_on"),
        org.alias("org_text"), metric.alias("metric_text"), period.alias("period_text"),
        number.alias("number_text"), text.alias("question"))


Q_ORGS = [
    "SECL", "Mahanadi Coalfields Limited", "ecl", "Coal India", " NCL ", "Gevra mine", "wcl",
    "Bharat Coking Coal", "CMPDI", "Acme Minerals"]
Q_METRICS = [
    "coal production", "Target", "overburden_removal", "Coal Despatches (MT)", "drilling",
    "boreholes drilled", "geological reserve", "capex", "closing-stock", "Raw Coal Production (MT)",
    "OB", "weather"]


def wide_cells(spark: SparkSession, directory: str) -> DataFrame:
    """orders as wide sheets (Subsidiary | Production | Target | Period), one row per order.

    The row number is arithmetic on the order key, so no window is needed to number rows.
    """
    o = spread(read_table(spark, directory, "orders"), "o_orderkey")
    year = F.year("o_orderdate") + 20
    return o.select(
        (F.col("o_orderkey") % 100).cast("string").alias("document_id"),
        F.lit("Sheet1").alias("sheet_name"),
        (F.floor(F.col("o_orderkey") / 100) + 2).cast("int").alias("row_number"),
        F.element_at(F.array(*[F.lit(x) for x in TABLE_ORGS]),
                     (F.col("o_custkey") % len(TABLE_ORGS) + 1).cast("int")).alias("Subsidiary"),
        F.when(F.col("o_custkey") % 11 == 0, "")
        .otherwise(F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(".5")))
        .alias("Production"),
        F.when(F.col("o_custkey") % 13 == 0, F.lit("2031"))
        .otherwise(F.concat(F.floor(F.col("o_totalprice") / 900).cast("string"), F.lit(" MT")))
        .alias("Target"),
        F.concat(year.cast("string"), F.lit("-"),
                 F.lpad(((year + 1) % 100).cast("string"), 2, "0")).alias("Period"))


TABLE_ORGS = ["SECL", "Mahanadi Coalfields", "NCL", "ecl", "Unknown Co"]
