import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import cells as ce
from ledgerlake.operators import extract as ex
from ledgerlake.sources import files


def table(spark, columns, rows, sheet="Sheet1"):
    data = [("doc", sheet, i + 2, *r) for i, r in enumerate(rows)]
    names = ", ".join(f"`{c}` string" for c in columns)
    df = spark.createDataFrame(data, f"document_id string, sheet_name string, row_number int, {names}")
    return ce.melt_cells(df, columns)


def test_wide_sheet(spark):
    c = table(spark, ["Subsidiary", "Production", "Target", "Period"], [
        ("MCL", "40", "42", "FY 2025-26"), ("SECL", "35", "36", "FY 2025-26"), ("NCL", "30", "32", "FY 2025-26")])
    f = {(r.org, r.metric_code): r for r in ex.facts_from_tables(c).collect()}
    assert len(f) == 6
    assert f["MCL", "COAL_PRODUCTION"].cell_reference == "B2"
    assert f["SECL", "PRODUCTION_TARGET"].cell_reference == "C3"
    assert f["NCL", "COAL_PRODUCTION"].cell_reference == "B4"
    assert sorted(r.numeric_value for r in f.values()) == [30, 32, 35, 36, 40, 42]
    assert {r.validation_status for r in f.values()} == {"HIGH_CONFIDENCE"}
    assert {(r.unit, r.reporting_period) for r in f.values()} == {("MT", "FY 2025-26")}


def test_long_table(spark):
    c = table(spark, ["Mine", "Metric", "Value", "Unit", "Period"], [
        ("Kusmunda", "Coal Production", "50.5", "MT", "FY 2025-26"),
        ("Gevra", "Coal Production", "60.2", "MT", "FY 2025-26"),
        ("Dipka", "Overburden Removal", "45.0", "Mm3", "FY 2025-26"),
        ("Dipka", "Rainfall", "12", "", "FY 2025-26")], "CSV_DATA")
    f = {r.site + r.metric_code: r for r in ex.facts_from_tables(c).collect()}
    assert len(f) == 4
    k = f["KusmundaCOAL_PRODUCTION"]
    assert (k.row_number, k.numeric_value, k.unit) == (2, 50.5, "MT")
    assert f["DipkaOVERBURDEN_REMOVAL"].unit == "Mm3"
    u = f["DipkaUNMAPPED"]
    assert (u.confidence_score, u.validation_status, u.unit) == (0.65, "NEEDS_REVIEW", "count")


def test_rows_are_not_shuffled(spark):
    """A row is read where it lies; single cells are shuffled once, as they are. Both ways give the same facts."""
    tables = {"long": (["Mine", "Metric", "Value", "Unit", "Period"], [
        ("Gevra", "Coal Production", "1,050.5", "", "last year"), ("NCL", "Rainfall", "12", "Mm3", "2024-25"), ("x", "y", "7", "", ""),
        ("Dipka", "Drilling", "none", "m", "Q1 FY 2024-25"), ("Dipka", None, "5", "m", "")]),
        "wide": (["Subsidiary", "Production (2023-24)", "Target", "Note", "Period"], [
            ("MCL", "40", "1990", "3 t", "FY 2025-26"), ("drilling", "2000.0", "₹ 7 BCM", "1e13", None), ("", "-4", "", "2", "2024")])}
    rows, cells = [], []
    for sheet, (columns, data) in tables.items():
        df = spark.createDataFrame([("doc", sheet, i + 2, *r) for i, r in enumerate(data)], "document_id string, sheet_name string, row_number int, "
                                   + ", ".join(f"`{c}` string" for c in columns))
        rows.append(ce.rows_of(df, columns))
        cells.append(ce.melt_cells(df, columns))
    a, b = ex.facts_from_rows(rows[0].unionByName(rows[1])), ex.facts_from_tables(cells[0].unionByName(cells[1]))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 7
    plans = [df.select("*")._jdf.queryExecution().executedPlan().toString() for df in (a, b)]  # not run: a run plan is printed twice
    assert [p.count("Exchange hashpartitioning") for p in plans] == [0, 1]


def test_column_with_two_names(spark):
    """A cell goes by the name of its own column, once, where rows of a sheet disagree on the name."""
    two = [table(spark, ["Subsidiary", name], [("MCL", "40")]).withColumn("row_number", F.lit(r)) for r, name in ((2, "Production"), (3, "Target"))]
    f = ex.facts_from_tables(two[0].unionByName(two[1])).collect()
    assert sorted((r.row_number, r.metric_code) for r in f) == [(2, "COAL_PRODUCTION"), (3, "PRODUCTION_TARGET")]


def test_row_metric_table(spark):
    c = table(spark, ["Head", "2023-24", "2024-25"], [("Coal Production", "10.5", "11.5"),
                                                    ("Remarks", "none", "none")])
    f = {(r.reporting_period, r.numeric_value, r.metric_code) for r in ex.facts_from_tables(c).collect()}
    assert f == {("FY 2023-24", 10.5, "COAL_PRODUCTION"), ("FY 2024-25", 11.5, "COAL_PRODUCTION")}


def test_year_is_no_value(spark):
    c = table(spark, ["Subsidiary", "Production", "Drilling"], [("MCL", "2024", "2024")])
    assert [r.metric_code for r in ex.facts_from_tables(c).collect()] == ["DRILLING"]


def test_context_fallback(spark):
    c = table(spark, ["Subsidiary", "Production"], [("Unit 7", "40")])
    ctx = spark.createDataFrame([("doc", "FY 2024-25", "ECL", "Pit A")],
                                "document_id string, g_period string, g_org string, g_site string")
    r = ex.facts_from_tables(c, ctx).collect()[0]
    assert (r.org, r.reporting_period, r.site) == ("ECL", "FY 2024-25", "Pit A")


def test_text_facts(spark):
    text = ("In FY 2023-24, ECL achieved raw coal production of 35.40 MT across all open cast mines. "
            "NCL recorded overburden removal of 1,234.5 Mm3 during FY 2023-24.")
    p = spark.createDataFrame([("d", 1, text)], "document_id string, page_number int, content string")
    got = {(r.org, r.metric_code, r.numeric_value, r.unit, r.reporting_period)
           for r in ex.facts_from_text(p).collect()}
    assert ("ECL", "COAL_PRODUCTION", 35.4, "MT") in {g[:4] for g in got}
    assert ("NCL", "OVERBURDEN_REMOVAL", 1234.5, "Mm3", "FY 2023-24") in got


def test_header_detection_and_names(spark):
    grid = [("d", "S", 1, 1, "Annual statement"), ("d", "S", 2, 1, "Subsidiary"), ("d", "S", 2, 2, "Target"),
            ("d", "S", 2, 3, "Target"), ("d", "S", 2, 4, ""), ("d", "S", 3, 1, "SECL"), ("d", "S", 3, 2, "5"),
            ("d", "S", 3, 3, "6"), ("d", "S", 3, 4, "x"), ("d", "S", 4, 1, ""), ("d", "S", 4, 2, " ")]
    g = spark.createDataFrame(grid, "document_id string, sheet_name string, row_number int, "
                                    "column_number int, value string")
    h = ce.detect_header(g)
    assert h.collect()[0].header_row == 2
    named = {(r.column_name, r.value) for r in ce.name_columns(g, h).collect()}
    assert named == {("Subsidiary", "SECL"), ("Target", "5"), ("Target_1", "6"), ("Column_D", "x")}


def chunks_by_loop(text, size, overlap, page_size, separator):
    out = []
    for p in range(0, max(len(text) - 1, 0) + 1, page_size):
        page, cur = text[p:p + page_size], ""
        for para in (x.strip() for x in page.split(separator)):
            if not para:
                continue
            if len(cur) + len(para) + 2 <= size:
                cur = f"{cur}\n\n{para}" if cur else para
                continue
            if cur:
                out.append((p // page_size + 1, cur))
            cur = para
            if len(para) > size:
                out += [(p // page_size + 1, para[s:s + size]) for s in range(0, len(para), size - overlap)]
                cur = ""
        if cur:
            out.append((p // page_size + 1, cur))
    return out


@pytest.mark.parametrize("size, overlap", [(100, 20), (60, 10)])
def test_chunking_against_loop(spark, size, overlap):
    rng = random.Random(3)
    texts = ["", "one", " \n\n ", "a" * 350]
    for _ in range(20):
        texts.append("\n\n".join("w" * rng.randint(0, 180) for _ in range(rng.randint(1, 9))))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in ex.chunk(df, "k", size=size, overlap=overlap, page_size=400).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append((r.page_number, r.content))
    for k, t in enumerate(texts):
        assert got.get(k, []) == chunks_by_loop(t, size, overlap, 400, "\n\n"), k


def test_csv_cells_over_splits(spark, tmp_path):
    lines = ["Subsidiary , Production,Note"] + [f'SECL,{i},"a, b {i}"' for i in range(2000)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_csv_cells(spark, str(tmp_path / "t.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 6000
    cell = {(r.row_number, r.column_name): r.value for r in rows}
    assert cell[2, "Production"] == "0" and cell[2001, "Production"] == "1999"
    assert cell[1001, "Note"] == "a, b 999"
    assert {r.sheet_name for r in rows} == {"CSV_DATA"}


def test_csv_encoding_and_separator(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("Mine;Wert\nGévra;1\n".encode("cp1252"))
    rows = files.read_csv_cells(spark, str(tmp_path / "u.csv"), ";", "cp1252").collect()
    assert {(r.column_name, r.value, r.cell_reference) for r in rows} == {
        ("Mine", "Gévra", "R2C1"), ("Wert", "1", "R2C2")}


def test_ledger_write_and_export(spark, ledger, tmp_path):
    f = ledger({"numeric_value": 1.0}, {"numeric_value": 2.0, "metric_code": "DRILLING"})
    files.write_ledger(f, str(tmp_path / "l"), "overwrite")
    back = spark.read.parquet(str(tmp_path / "l"))
    assert back.filter("metric_code = 'DRILLING'").select("k_fy").first()[0] == "2024-25"
    files.export_facts(f, str(tmp_path / "x"), f.filter("numeric_value = 2"))
    csv = spark.read.option("header", True).csv(str(tmp_path / "x"))
    assert csv.columns == files.EXPORT_COLUMNS and csv.count() == 1
    files.append_audit(f.select("fact_id"), str(tmp_path / "a"))
    files.append_audit(f.select("fact_id"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4


def test_chunk_hash(spark):
    from ledgerlake.functions.text import chunk_hash
    r = spark.createDataFrame([("  abc \n",)], "t string").select(chunk_hash(F.col("t"))).first()[0]
    assert r == hashlib.sha256(b"abc").hexdigest()[:16]


def test_document_context_reads_the_whole_text(spark):
    text = "lorem ipsum, " * 400 + "North Pit OCP of MCL in FY 2024-25."
    d = spark.createDataFrame([("a", "report.txt", text)], "id string, name string, text string")
    assert ex.document_context(d, "id", "name", "text").first()[:] == ("a", "MCL", "FY 2024-25", "North Pit OCP")
    assert ex.document_context(d, "id", "name", "text", 3000).first()[:] == ("a", None, None, None)
