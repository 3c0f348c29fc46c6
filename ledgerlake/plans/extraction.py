"""Queries: cell tables, fact extraction, pages and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.operators import cells as ce
from ledgerlake.operators import extract as ex
from ledgerlake.plans.normalise import ORG_ROWS, metric_of, pick
from ledgerlake.plans.registry import query
from ledgerlake.plans.sqlparts import lst
from ledgerlake.plans.sqlparts import text as q
from ledgerlake.sources import adapters as ad

WIDE_COLUMNS = ["Subsidiary", "Production", "Target", "Period"]
WIDE = f"""wide AS (SELECT CAST(o_orderkey % 100 AS VARCHAR) AS document_id, 'Sheet1' AS sheet_name,
  CAST(o_orderkey // 100 + 2 AS INTEGER) AS row_number, {pick(ad.TABLE_ORGS, "o_custkey")} AS a,
  CASE WHEN o_custkey % 11 = 0 THEN '' ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) || '.5' END AS b,
  CASE WHEN o_custkey % 13 = 0 THEN '2031' ELSE CAST(floor(o_totalprice / 900) AS BIGINT) || ' MT' END AS c,
  (year(o_orderdate) + 20) || '-' || lpad(CAST((year(o_orderdate) + 21) % 100 AS VARCHAR), 2, '0') AS d
  FROM orders),
cells AS (""" + " UNION ALL ".join(
    f"SELECT document_id, sheet_name, row_number, {i + 1} AS column_number, '{n}' AS column_name, "
    f"'{'ABCD'[i]}' || row_number AS cell_reference, {'abcd'[i]} AS value FROM wide"
    for i, n in enumerate(WIDE_COLUMNS)) + ")"


def wide_cells(spark, sf):
    return ce.melt_cells(ad.wide_cells(spark, sf), WIDE_COLUMNS)


@query("melt_cells", f"WITH {WIDE} SELECT * FROM cells")
def melt_cells(spark, sf):
    return wide_cells(spark, sf).withColumn("column_number", F.col("column_number").cast("int"))


GRID = f"""{WIDE}, docs AS (SELECT DISTINCT document_id, CAST(document_id AS INTEGER) AS k FROM wide),
grid AS (SELECT document_id, sheet_name, row_number + CAST(document_id AS INTEGER) % 2 AS row_number,
  column_number, value FROM cells
UNION ALL SELECT document_id, 'Sheet1', k % 2 + 1, i, CASE WHEN k % 3 = 0 THEN
  list_element(['Subsidiary', 'Target', 'Target', ''], CAST(i AS INTEGER))
  ELSE list_element({lst(WIDE_COLUMNS)}, CAST(i AS INTEGER)) END FROM docs, range(1, 5) r(i)
UNION ALL SELECT document_id, 'Sheet1', 1, 1, 'Annual statement' FROM docs WHERE k % 2 = 1)"""
SCORES = f"""vals AS (SELECT DISTINCT trim(value) AS v FROM grid WHERE row_number <= 12 AND trim(value) <> ''),
sc AS (SELECT v, 1 + CASE WHEN {metric_of("v")} IS NOT NULL THEN 5 ELSE 0 END
  + CASE WHEN lower(v) IN (SELECT alias FROM {ORG_ROWS} o WHERE code IN ({", ".join(q(c) for c in dims.TABLE_ORG_CODES)}))
    THEN 4 ELSE 0 END + CASE WHEN regexp_matches(v, '^\\d{{4}}-\\d{{2}}$') THEN 3 ELSE 0 END
  + CASE WHEN {" OR ".join(f"contains(lower(v), {q(w)})" for w in dims.HEADER_WORDS)} THEN 3 ELSE 0 END AS s FROM vals),
best AS (SELECT document_id, sheet_name, row_number AS header_row, score FROM (
  SELECT document_id, sheet_name, row_number, CAST(sum(s) AS BIGINT) AS score, row_number() OVER (
    PARTITION BY document_id, sheet_name ORDER BY sum(s) DESC, row_number) AS rn
  FROM grid JOIN sc ON v = trim(value) WHERE row_number <= 12 GROUP BY 1, 2, 3) WHERE rn = 1)"""
NAMED = """names AS (SELECT document_id, sheet_name, column_number, CASE WHEN rn > 1 THEN name || '_' || (rn - 1)
  ELSE name END AS column_name FROM (SELECT *, row_number() OVER (PARTITION BY document_id, sheet_name, name
    ORDER BY column_number) AS rn FROM (SELECT document_id, sheet_name, column_number, CASE WHEN trim(value) = ''
    THEN 'Column_' || chr(CAST(64 + column_number AS INTEGER)) ELSE trim(value) END AS name
    FROM grid JOIN best USING (document_id, sheet_name) WHERE row_number = header_row))),
named AS (SELECT g.document_id, g.row_number, column_name, value FROM grid g
  JOIN best USING (document_id, sheet_name) JOIN names USING (document_id, sheet_name, column_number)
  WHERE g.row_number > header_row)"""


def grid(spark, sf):
    w = wide_cells(spark, sf)
    k = F.col("document_id").cast("int")
    body = w.withColumn("row_number", F.col("row_number") + k % 2).drop(
        "column_name", "cell_reference")
    docs = ad.wide_cells(spark, sf).select("document_id").distinct()
    odd = F.array(*[F.lit(x) for x in ("Subsidiary", "Target", "Target", "")])
    usual = F.array(*[F.lit(x) for x in WIDE_COLUMNS])
    head = docs.select("document_id", F.posexplode(F.when(k % 3 == 0, odd).otherwise(usual)).alias(
        "p", "value")).select(
        "document_id", F.lit("Sheet1").alias("sheet_name"), (k % 2 + 1).alias("row_number"),
        (F.col("p") + 1).alias("column_number"), "value")
    title = docs.filter(k % 2 == 1).select(
        "document_id", F.lit("Sheet1").alias("sheet_name"), F.lit(1).alias("row_number"),
        F.lit(1).alias("column_number"), F.lit("Annual statement").alias("value"))
    return body.unionByName(head).unionByName(title)


@query("detect_header", f"WITH {GRID}, {SCORES} SELECT document_id, sheet_name, header_row, score FROM best")
def detect_header(spark, sf):
    return ce.detect_header(grid(spark, sf)).withColumn("score", F.col("score").cast("bigint"))


@query("clean_named_cells", f"""WITH {GRID}, {SCORES}, {NAMED}
SELECT document_id, row_number, column_name, value FROM named""")
def clean_named_cells(spark, sf):
    g = grid(spark, sf)
    return ce.name_columns(g, ce.detect_header(g)).select(
        "document_id", "row_number", "column_name", "value")


@query("sheet_profile", f"""WITH {WIDE} SELECT document_id, sheet_name, count(DISTINCT row_number) AS row_count,
  CAST(max(column_number) AS INTEGER) AS column_count, 'A1:D' || max(row_number) AS used_range,
  count(*) FILTER (trim(value) = '') AS empty_cells FROM cells GROUP BY 1, 2""")
def sheet_profile(spark, sf):
    return ce.sheet_profile(wide_cells(spark, sf)).drop("last_row")


@query("csv_range", f"""WITH {WIDE} SELECT document_id, sheet_name, 'R1C1:R' || max(row_number) || 'C' ||
  max(column_number) AS used_range FROM cells GROUP BY 1, 2""")
def csv_range(spark, sf):
    return ce.csv_range(wide_cells(spark, sf))


@query("table_snapshot", f"""WITH {WIDE}, r AS (SELECT document_id, row_number, dense_rank() OVER (PARTITION BY document_id
  ORDER BY row_number) AS n FROM wide)
SELECT document_id, 'Subsidiary,Production,Target,Period' AS headers, count(*) AS n_rows,
  min(row_number) AS first_row FROM r WHERE n <= 250 GROUP BY 1""")
def table_snapshot(spark, sf):
    """Nested snapshot, flattened for comparison."""
    s = ce.snapshot_tables(wide_cells(spark, sf))
    lowest = wide_cells(spark, sf).groupBy("document_id").agg(F.min("row_number").alias("first_row"))
    return s.join(lowest, "document_id").select(
        "document_id", F.array_join("headers", ",").alias("headers"),
        F.size("data").cast("bigint").alias("n_rows"), "first_row")


@query("table_quality", f"""WITH {WIDE}, g AS (SELECT document_id, count(DISTINCT row_number) AS n_rows,
  count(*) FILTER (trim(value) = '') AS n_empty, max(column_number) AS n_cols FROM cells GROUP BY 1),
s AS (SELECT *, greatest(0.2, least(1.0, round(1 - 0.4 * n_empty / (n_rows * n_cols), 2)))::DOUBLE AS score FROM g)
SELECT document_id, n_rows, n_empty, score, CASE WHEN score >= .85 THEN 'EXCELLENT' WHEN score >= .7 THEN 'GOOD'
  WHEN score >= .5 THEN 'FAIR' WHEN score >= .3 THEN 'POOR' ELSE 'UNREADABLE' END AS label FROM s""")
def table_quality(spark, sf):
    return ce.table_quality(wide_cells(spark, sf)).select(
        "document_id", "n_rows", "n_empty", "score", "label")


@query("column_roles", f"""WITH {GRID}, {SCORES}, {NAMED}
SELECT document_id, role, CAST(max(column_number) AS INTEGER) AS column_number FROM (
  SELECT document_id, column_number, CASE WHEN column_name = 'Subsidiary' THEN 'org' WHEN column_name = 'Period'
    THEN 'period' WHEN column_name LIKE 'Column%' THEN 'org' END AS role FROM names) WHERE role IS NOT NULL GROUP BY 1, 2""")
def column_roles(spark, sf):
    g = grid(spark, sf)
    names = ce.name_columns(g, ce.detect_header(g)).select(
        *ce.SHEET, "column_number", "column_name").distinct()
    return ex.column_roles(names).select(
        "document_id", "role", F.col("column_number").cast("int").alias("column_number"))


ORG_CODE = """CASE a WHEN 'Mahanadi Coalfields' THEN 'MCL' WHEN 'ecl' THEN 'ECL' WHEN 'Unknown Co' THEN NULL ELSE a END"""
FACT_OUT = ["document_id", "row_number", "metric_code", "raw_metric_name", "numeric_value", "unit",
            "reporting_period", "org", "cell_reference", "confidence_score", "validation_status"]


@query("facts_from_wide", f"""WITH {WIDE}
SELECT document_id, row_number, 'COAL_PRODUCTION' AS metric_code, 'Production' AS raw_metric_name,
  CAST(b AS DOUBLE) AS numeric_value, 'MT' AS unit, 'FY ' || d AS reporting_period, {ORG_CODE} AS org,
  'B' || row_number AS cell_reference, 0.99::DOUBLE AS confidence_score, 'HIGH_CONFIDENCE' AS validation_status
FROM wide WHERE b <> ''
UNION ALL SELECT document_id, row_number, 'PRODUCTION_TARGET', 'Target', CAST(replace(c, ' MT', '') AS DOUBLE),
  'MT', 'FY ' || d, {ORG_CODE}, 'C' || row_number, 0.99, 'HIGH_CONFIDENCE' FROM wide WHERE c <> '2031'""")
def facts_from_wide(spark, sf):
    return ex.facts_from_rows(ce.rows_of(ad.wide_cells(spark, sf), WIDE_COLUMNS)).select(*FACT_OUT)


LONG_COLUMNS = ["Mine", "Metric", "Value", "Unit", "Period"]


def long_rows(spark, sf):
    qs = ad.questions(spark, sf)
    units = F.array(*[F.lit(u) for u in ("MT", "Mm3", "", "m")])
    return ce.rows_of(qs.select(
        F.concat(F.lit("L"), (F.col("question_id") % 50).cast("string")).alias("document_id"),
        F.lit("CSV_DATA").alias("sheet_name"),
        (F.floor(F.col("question_id") / 50) + 2).cast("int").alias("row_number"),
        F.concat(F.lit("Pit "), (F.col("user_id") % 9).cast("string")).alias("Mine"),
        F.col("metric_text").alias("Metric"), F.col("number_text").alias("Value"),
        F.element_at(units, (F.col("user_id") % 4 + 1).cast("int")).alias("Unit"),
        F.col("period_text").alias("Period")), LONG_COLUMNS)


def _metric_literal() -> str:
    """Metric of the question vocabulary's metric words, looked up by the dictionary rule."""
    return "(SELECT metric_text, " + metric_of("metric_text") + " AS mc FROM (SELECT DISTINCT metric_text FROM questions))"


def facts_from_long(spark, sf):
    return ex.facts_from_rows(long_rows(spark, sf)).select(*FACT_OUT, "site")


def _long_sql() -> str:
    from ledgerlake.plans.normalise import METRICS, PERIOD_SQL, QUESTIONS

    per = PERIOD_SQL.replace("(x,", "(period_text,")
    unit = "list_element(['MT', 'Mm3', '', 'm'], CAST(user_id % 4 + 1 AS INTEGER))"
    return f"""WITH {QUESTIONS}, s AS (SELECT q.*, mc, {per} AS per, {unit} AS u, question_id // 50 + 2 AS rn
  FROM questions q JOIN {_metric_literal()} m USING (metric_text)),
r AS (SELECT s.*, coalesce(nullif(u, ''), md.unit, 'count') AS unit,
  least(0.99, 0.92 + 0.04 + CASE WHEN per IS NULL THEN -0.05 ELSE 0.04 END)::DOUBLE AS conf
  FROM s LEFT JOIN {METRICS} md ON md.code = mc)
SELECT 'L' || (question_id % 50) AS document_id, CAST(rn AS INTEGER) AS row_number, coalesce(mc, 'UNMAPPED') AS metric_code,
  trim(metric_text) AS raw_metric_name, CAST(number_text AS DOUBLE) AS numeric_value, unit, per AS reporting_period,
  CAST(NULL AS VARCHAR) AS org, 'C' || rn AS cell_reference,
  CASE WHEN mc IS NULL THEN 0.65 ELSE round(conf, 2) END AS confidence_score,
  CASE WHEN mc IS NULL THEN 'NEEDS_REVIEW' WHEN round(conf, 2) >= 0.9 THEN 'HIGH_CONFIDENCE' ELSE 'NEEDS_REVIEW' END
    AS validation_status, 'Pit ' || (user_id % 9) AS site FROM r"""


query("facts_from_long", _long_sql())(facts_from_long)

ROW_COLUMNS = ["Head", "2016-17", "2017-18"]


def head_rows(spark, sf):
    o = ad.questions(spark, sf)
    return ce.rows_of(o.select(
        F.concat(F.lit("R"), (F.col("question_id") % 50).cast("string")).alias("document_id"),
        F.lit("Sheet1").alias("sheet_name"),
        (F.floor(F.col("question_id") / 50) + 2).cast("int").alias("row_number"),
        F.col("metric_text").alias("Head"), F.col("number_text").alias("2016-17"),
        F.col("user_id").cast("string").alias("2017-18")), ROW_COLUMNS)


def _row_sql() -> str:
    from ledgerlake.plans.normalise import METRICS, QUESTIONS

    one = """SELECT 'R' || (question_id % 50) AS document_id, CAST(question_id // 50 + 2 AS INTEGER) AS row_number,
  mc AS metric_code, trim(metric_text) AS raw_metric_name, CAST({v} AS DOUBLE) AS numeric_value, md.unit AS unit,
  'FY {p}' AS reporting_period, '{c}' || (question_id // 50 + 2) AS cell_reference
  FROM questions JOIN m USING (metric_text) JOIN {md} md ON md.code = mc
  WHERE NOT (contains(CAST({v} AS VARCHAR), '.') = FALSE AND CAST({v} AS DOUBLE) BETWEEN 1950 AND 2050
    AND mc NOT IN ('DRILLING', 'BOREHOLE_COUNT'))"""
    a = one.replace("{v}", "number_text").replace("{p}", "2016-17").replace("{c}", "B").replace("{md}", METRICS)
    b = one.replace("{v}", "user_id").replace("{p}", "2017-18").replace("{c}", "C").replace("{md}", METRICS)
    return f"WITH {QUESTIONS}, m AS {_metric_literal()} {a} UNION ALL {b}"


@query("facts_from_rows", _row_sql())
def facts_from_rows(spark, sf):
    return ex.facts_from_rows(head_rows(spark, sf)).select(
        "document_id", "row_number", "metric_code", "raw_metric_name", "numeric_value", "unit",
        "reporting_period", "cell_reference")


# --- text ---

SENTENCE = f"""{{prefix}} AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 1 AS page_number,
  {pick(["ECL", "NCL", "SECL"], "o_custkey")} AS o, {pick(["raw coal production", "overburden removal", "coal dispatch"], "o_orderkey")} AS m,
  CAST(floor(o_totalprice / 1000) AS BIGINT) || '.' || (o_orderkey % 10) AS n, (year(o_orderdate) + 20) || '-' ||
  lpad(CAST((year(o_orderdate) + 21) % 100 AS VARCHAR), 2, '0') AS fy FROM orders)"""


def sentences(spark, sf):
    o = ad.spread(ad.read_table(spark, sf, "orders"), "o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pk(items, step):
        return F.element_at(F.array(*[F.lit(i) for i in items]), (step % len(items) + 1).cast("int"))

    year = F.year("o_orderdate") + 20
    fy = F.concat(year.cast("string"), F.lit("-"),
                  F.lpad(((year + 1) % 100).cast("string"), 2, "0"))
    org, metric = pk(["ECL", "NCL", "SECL"], c), pk(
        ["raw coal production", "overburden removal", "coal dispatch"], k)
    number = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("."),
                      (k % 10).cast("string"))
    return o.select(
        k.cast("string").alias("document_id"), F.lit(1).alias("page_number"),
        F.concat(org, F.lit(" achieved "), metric, F.lit(" of "), number, F.lit(" MT in FY "), fy,
                 F.lit(". "), org, F.lit(" recorded drilling of 1,2"), (k % 90 + 10).cast("string"),
                 F.lit(" m during FY "), fy, F.lit(".")).alias("content"))


@query("facts_from_text", f"""WITH {SENTENCE.replace("{prefix}", "s")}
SELECT document_id, list_element(['COAL_PRODUCTION', 'OVERBURDEN_REMOVAL', 'COAL_OFFTAKE'], list_position(
  ['raw coal production', 'overburden removal', 'coal dispatch'], m)) AS metric_code, CAST(n AS DOUBLE) AS numeric_value,
  'MT' AS unit, 'FY ' || fy AS reporting_period, o AS org, CAST(0.87 AS DOUBLE) AS confidence_score FROM s
UNION ALL SELECT document_id, 'DRILLING', 1200 + CAST(document_id AS BIGINT) % 90 + 10, 'm', 'FY ' || fy, o, 0.87 FROM s""")
def facts_from_text(spark, sf):
    return ex.facts_from_text(sentences(spark, sf)).select(
        "document_id", "metric_code", "numeric_value", "unit", "reporting_period", "org",
        "confidence_score")


@query("document_context")
def document_context(spark, sf):
    return ex.document_context(ad.documents(spark, sf), "doc_id", "file_name", "text")


@query("union_of_extracted", None)
def union_of_extracted(spark, sf):
    both = ex.all_facts(ex.facts_from_rows(ce.rows_of(ad.wide_cells(spark, sf), WIDE_COLUMNS)),
                        ex.facts_from_text(sentences(spark, sf)))
    return both.groupBy("extraction_method", "metric_code").agg(F.count("*").alias("n"))


PAGES = """pages3 AS (SELECT doc_id, i // 3000 + 1 AS page_number, substr(text, i + 1, 3000) AS content
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 3000)) AS i FROM documents))"""


@query("paginate", f"""WITH {PAGES} SELECT doc_id, page_number, md5(content) AS digest, length(content) AS chars
FROM pages3""")
def paginate(spark, sf):
    p = ce.paginate(ad.documents(spark, sf), "doc_id")
    return p.select("doc_id", F.col("page_number").cast("bigint").alias("page_number"),
                    F.md5("content").alias("digest"),
                    F.length("content").cast("bigint").alias("chars"))


@query("page_stats", f"""WITH {PAGES} SELECT doc_id, page_number, length(content) AS char_count,
  CASE WHEN trim(content, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(content, ' '), '\\s+')) END AS word_count,
  trim(content, ' ') <> '' AS has_native_text FROM pages3""")
def page_stats(spark, sf):
    s = ce.page_stats(ce.paginate(ad.documents(spark, sf), "doc_id"), "doc_id").drop("needs_ocr")
    return s.withColumns({c: F.col(c).cast("bigint") for c in ("page_number", "char_count", "word_count")})


@query("slice_chunks", """SELECT doc_id, (i - 1) // 850 AS slice_no, md5(substr(text, i, 1000)) AS digest
FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 850)) AS i FROM documents)""")
def slice_chunks(spark, sf):
    d = ad.documents(spark, sf)
    s = d.select("doc_id", F.posexplode(ex.slices(F.col("text"), 1000, 150)).alias("p", "c"))
    return s.select("doc_id", F.col("p").cast("bigint").alias("slice_no"), F.md5("c").alias("digest"))


@query("chunk_documents")
def chunk_documents(spark, sf):
    return ex.chunk(ad.documents(spark, sf), "doc_id", separator="\n")


@query("preview_pages", f"""WITH {PAGES} SELECT doc_id, page_number, md5(substr(content, 1, 2000)) AS digest FROM pages3
WHERE page_number <= 5""")
def preview_pages(spark, sf):
    p = ce.preview_pages(ce.paginate(ad.documents(spark, sf), "doc_id"), "doc_id")
    return p.select("doc_id", F.col("page_number").cast("bigint").alias("page_number"),
                    F.md5("content").alias("digest"))


@query("preview_text", """SELECT doc_id AS document_id, md5(substr(text, 1, 3000)) AS digest FROM documents
WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0 AND length(text) > 0""")
def preview_text(spark, sf):
    """Every third document has neither pages nor sheets; its text is one chunk."""
    d = ad.documents(spark, sf).select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")).filter("length(content) > 0")
    chunks = d.withColumn("chunk_index", F.lit(0)).unionByName(d.select("document_id", F.lit("later").alias("content"), F.lit(1).alias("chunk_index")))
    return ce.preview_text(d, d.filter("document_id % 3 <> 0"), d.filter("document_id % 4 = 0"), chunks).select(
        "document_id", F.md5("text").alias("digest"))


@query("preview_rows", f"""WITH {WIDE}, r AS (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY row_number)
  AS n FROM cells) SELECT document_id, row_number, column_name, value FROM r WHERE n <= 10""")
def preview_rows(spark, sf):
    return ce.preview_rows(wide_cells(spark, sf)).select(
        "document_id", "row_number", "column_name", "value")


@query("surrounding_rows", f"""WITH {WIDE} SELECT f.document_id || ':' || f.row_number AS fact_id, c.row_number,
  c.column_name, c.value FROM wide f JOIN cells c ON c.document_id = f.document_id
  AND c.row_number BETWEEN greatest(f.row_number - 3, 1) AND f.row_number + 3""")
def surrounding_rows(spark, sf):
    w = ad.wide_cells(spark, sf)
    facts = w.select(F.concat_ws(":", "document_id", F.col("row_number").cast("string")).alias("fact_id"),
                     "document_id", "sheet_name", "row_number")
    return ce.surrounding_rows(wide_cells(spark, sf), facts).select(
        "fact_id", "row_number", "column_name", "value")


@query("children_in_order", """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
  AS position FROM conversations""")
def children_in_order(spark, sf):
    from ledgerlake.operators import search

    return search.children(ad.read_table(spark, sf, "conversations"), "conv_id", ["turn"]).select(
        "conv_id", "turn", "role", F.col("position").cast("bigint").alias("position"))


@query("csv_documents", """SELECT column_name, md5(value) AS digest FROM (
  SELECT unnest(['doc_id', 'lang', 'text']) AS column_name,
    unnest([CAST(doc_id AS VARCHAR), coalesce(lang, ''), coalesce(text, '')]) AS value FROM documents)""")
def csv_documents(spark, sf):
    """Documents written as quoted CSV files, line breaks and quotes included, and read back as cells."""
    from ledgerlake.sources import files, folders

    folder = folders.shared_folder(spark, "csv")
    (ad.read_table(spark, sf, "documents").select("doc_id", "lang", "text").fillna("", ["lang", "text"]).write
     .option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(folder))
    return files.read_csv_cells(spark, f"{folder}/*.csv").select("column_name", F.md5("value").alias("digest"))
