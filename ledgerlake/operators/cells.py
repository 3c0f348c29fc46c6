"""Cell tables: melt, headers, profiles, snapshots, previews, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions.period import norm_period
from ledgerlake.functions.text import a1_column, has_any
from ledgerlake.functions.vocab import is_table_org, norm_metric

SHEET = ["document_id", "sheet_name"]


def paginate(df: DataFrame, key: str, text: str = "text", size: int = 3000, extra: tuple[str, ...] = ()) -> DataFrame:
    """Logical pages of `size` characters, with the extra columns of their document; an empty text has one empty page."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return df.select(key, *extra, F.col(text).alias("_t"), F.posexplode(starts).alias("p", "s")).select(
        key, *extra, (F.col("p") + 1).alias("page_number"),
        F.substr("_t", F.col("s") + 1, F.lit(size)).alias("content"))


def page_stats(pages: DataFrame, key: str) -> DataFrame:
    trimmed = F.trim("content")
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    return pages.select(
        key, "page_number", F.length("content").alias("char_count"),
        words.alias("word_count"), (F.length(trimmed) > 0).alias("has_native_text"),
        (F.length(trimmed) == 0).alias("needs_ocr"))


def melt_cells(df: DataFrame, columns: list[str], extra: list[str] = ()) -> DataFrame:
    """Wide rows (document_id, sheet_name, row_number, columns...) to long cells with A1 references.

    One row in, len(columns) rows out: no shuffle."""
    cells = F.array(*[
        F.struct(F.lit(i + 1).alias("column_number"), F.lit(c).alias("column_name"),
                 F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(*SHEET, "row_number", *extra, F.explode(cells).alias("c")).select(
        *SHEET, "row_number", *extra, "c.column_number", "c.column_name",
        F.concat(a1_column(F.col("c.column_number")), F.col("row_number").cast("string"))
        .alias("cell_reference"), F.coalesce("c.value", F.lit("")).alias("value"))


def rows_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide rows (document_id, sheet_name, row_number, columns...) as rows of cells: layout (column_number and
    column_name of each) and cells (cell_reference and value of each). No shuffle, and no row per cell."""
    layout = F.array(*[F.struct(F.lit(i + 1).alias("column_number"), F.lit(c).alias("column_name")) for i, c in enumerate(columns)])
    cells = F.array(*[
        F.struct(F.concat(a1_column(F.lit(i + 1)), F.col("row_number").cast("string")).alias("cell_reference"),
                 F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for i, c in enumerate(columns)])
    return df.select(*SHEET, "row_number", layout.alias("layout"), cells.alias("cells"))


def gathered_rows(cells: DataFrame) -> DataFrame:
    """Single cells as rows of cells, from left to right; only the cells as they are get shuffled."""
    of = F.sort_array(F.collect_list(F.struct("column_number", "column_name", "cell_reference", "value")))
    return cells.groupBy(*SHEET, "row_number").agg(of.alias("x")).select(
        *SHEET, "row_number", F.transform("x", lambda c: F.struct(c["column_number"].alias("column_number"), c["column_name"].alias("column_name"))).alias("layout"),
        F.transform("x", lambda c: F.struct(c["cell_reference"].alias("cell_reference"), c["value"].alias("value"))).alias("cells"))


def filled(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) != ""


def header_scores(cells: DataFrame, first_rows: int = 12) -> DataFrame:
    """Header score of the first rows: filled cells, +5 metric, +4 organisation, +3 period, +3 word."""
    v = F.trim("value")
    score = (F.lit(1)
             + F.when(norm_metric(v).isNotNull(), 5).otherwise(0)
             + F.when(is_table_org(v), 4).otherwise(0)
             + F.when(norm_period(v).isNotNull(), 3).otherwise(0)
             + F.when(has_any(F.lower(v), dims.HEADER_WORDS), 3).otherwise(0))
    return (cells.filter((F.col("row_number") <= first_rows) & filled(F.col("value")))
            .groupBy(*SHEET, "row_number").agg(F.sum(score).alias("score")))


def detect_header(cells: DataFrame) -> DataFrame:
    """Header row per sheet: best score, first row on ties."""
    best = header_scores(cells).groupBy(*SHEET).agg(
        F.max(F.struct("score", (-F.col("row_number")).alias("neg"))).alias("b"))
    return best.select(*SHEET, (-F.col("b.neg")).alias("header_row"), F.col("b.score").alias("score"))


def name_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Data cells below the header row, named by it. Blank headers become Column_<letter>, repeats
    get _1, _2; fully empty rows are dropped."""
    h = cells.join(headers.select(*SHEET, "header_row"), SHEET)
    names = h.filter("row_number = header_row").select(
        *SHEET, "column_number",
        F.when(filled(F.col("value")), F.trim("value"))
        .otherwise(F.concat(F.lit("Column_"), a1_column(F.col("column_number")))).alias("name"))
    names = dedupe_headers(names).withColumnRenamed("name", "column_name")
    rows = drop_empty_rows(h.filter("row_number > header_row").drop("header_row", "column_name"))
    return rows.join(names, [*SHEET, "column_number"])


def dedupe_headers(names: DataFrame) -> DataFrame:
    """Second and later use of a header name gets a running suffix."""
    w = Window.partitionBy(*SHEET, "name").orderBy("column_number")
    n = F.row_number().over(w) - 1
    return (names.withColumn("_n", n)
            .withColumn("name", F.when(F.col("_n") > 0, F.concat_ws("_", "name", "_n"))
                        .otherwise(F.col("name"))).drop("_n"))


def drop_empty_rows(cells: DataFrame) -> DataFrame:
    kept = cells.filter(filled(F.col("value"))).select(*SHEET, "row_number").distinct()
    return cells.join(kept, [*SHEET, "row_number"], "left_semi")


def sheet_profile(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Rows, columns and used range per sheet."""
    g = cells.groupBy(*SHEET).agg(
        F.count_distinct("row_number").alias("row_count"),
        F.max("column_number").alias("column_count"), F.max("row_number").alias("last_row"),
        F.count_if(~filled(F.col("value"))).alias("empty_cells"))
    g = g.withColumn("used_range", F.concat(
        F.lit("A1:"), a1_column(F.col("column_count")), F.col("last_row").cast("string")))
    return g if headers is None else g.join(headers.select(*SHEET, "header_row"), SHEET, "left")


def csv_range(cells: DataFrame) -> DataFrame:
    """Range text of CSV tables, `R1C1:RnCm`."""
    return cells.groupBy(*SHEET).agg(
        F.max("row_number").alias("n"), F.max("column_number").alias("m")).select(
        *SHEET, F.concat(F.lit("R1C1:R"), F.col("n").cast("string"), F.lit("C"),
                         F.col("m").cast("string")).alias("used_range"))


def first_rows(cells: DataFrame, n: int) -> DataFrame:
    """Cells of the first n rows of every sheet that hold any cell.

    Distinct rows are ranked, which Spark cuts to n per map task before the shuffle."""
    rows = cells.select(*SHEET, "row_number").distinct()
    w = Window.partitionBy(*SHEET).orderBy("row_number")
    top = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return cells.join(top, [*SHEET, "row_number"], "left_semi")


def snapshot_tables(cells: DataFrame, n: int = 250) -> DataFrame:
    """Headers and the first n rows of a sheet as one nested row; bounded by n rows."""
    rows = first_rows(cells, n).groupBy(*SHEET, "row_number").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "value"))))
        .alias("row"))
    heads = cells.select(*SHEET, "column_number", "column_name").distinct().groupBy(*SHEET).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("column_number", "column_name"))),
                    lambda x: x["column_name"]).alias("headers"))
    data = rows.groupBy(*SHEET).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row_number", F.to_json("row").alias("j")))),
                    lambda x: x["j"]).alias("data"))
    return heads.join(data, SHEET)


def preview_pages(pages: DataFrame, key: str, k: int = 5, chars: int = 2000) -> DataFrame:
    return pages.filter(F.col("page_number") <= k).select(
        key, "page_number", F.substring("content", 1, chars).alias("content"))


def preview_text(documents: DataFrame, pages: DataFrame, cells: DataFrame, chunks: DataFrame, chars: int = 3000) -> DataFrame:
    """(document_id, text): the first chunk of documents that have neither pages nor sheets."""
    bare = documents.select("document_id").join(pages.select("document_id"), "document_id", "left_anti").join(
        cells.select("document_id"), "document_id", "left_anti")
    first = chunks.groupBy("document_id").agg(F.min_by("content", "chunk_index").alias("content"))
    return bare.join(first, "document_id").select("document_id", F.substring("content", 1, chars).alias("text"))


def preview_rows(cells: DataFrame, sheets: int = 3, rows: int = 10) -> DataFrame:
    """First rows of the first sheets of every document."""
    names = cells.select("document_id", "sheet_name").distinct()
    w = Window.partitionBy("document_id").orderBy("sheet_name")
    top = names.withColumn("_s", F.row_number().over(w)).filter(F.col("_s") <= sheets).drop("_s")
    return first_rows(cells.join(top, SHEET, "left_semi"), rows)


def surrounding_rows(cells: DataFrame, facts: DataFrame, k: int = 3) -> DataFrame:
    """Cells of the k rows before and after a fact's row: the rows wanted are listed per fact and met
    by an equi join, so no range join is needed."""
    wanted = facts.select("fact_id", *SHEET, F.col("row_number").alias("fact_row"), F.explode(
        F.sequence(F.greatest(F.col("row_number") - k, F.lit(1)), F.col("row_number") + k))
        .alias("row_number"))
    return cells.join(wanted, [*SHEET, "row_number"])


def table_quality(cells: DataFrame) -> DataFrame:
    from ledgerlake.functions.scoring import quality_label, table_quality_score

    g = cells.groupBy(*SHEET).agg(
        F.count_distinct("row_number").alias("n_rows"), F.max("column_number").alias("n_cols"),
        F.count_if(~filled(F.col("value"))).alias("n_empty"))
    s = g.withColumn("score", table_quality_score(F.col("n_rows"), F.col("n_cols"), F.col("n_empty")))
    return s.withColumn("label", quality_label(F.col("score")))
