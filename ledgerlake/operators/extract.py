"""Facts out of cell tables and out of text, and text chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions import scoring
from ledgerlake.functions.period import extract_period, norm_period
from ledgerlake.functions.text import any_of, blank_to_null, has_any, let, parse_number
from ledgerlake.functions.vocab import (
    default_unit, extract_entities, is_table_org, metric_name, norm_metric, norm_org, table_org, unit_or_null)
from ledgerlake.operators.cells import SHEET, gathered_rows
from ledgerlake.sources.folders import shared_folder


ROLES = ["metric", "value", "unit", "period", "org", "site"]


def header_roles(names: DataFrame) -> DataFrame:
    """Role of every column by its header: metric / value / unit / period / org / site, or NULL."""
    h = F.lower(F.trim("column_name"))
    role = (F.when(h.isin(*dims.ROLE_METRIC), "metric").when(h.isin(*dims.ROLE_VALUE), "value")
            .when(h.isin(*dims.ROLE_UNIT), "unit")
            .when(has_any(h, dims.ROLE_PERIOD_PART), "period")
            .when(has_any(h, dims.ROLE_ORG_PART), "org")
            .when(has_any(h, dims.ROLE_SITE_PART), "site"))
    return names.withColumn("role", role)


def column_roles(names: DataFrame) -> DataFrame:
    """Column per role and sheet; the last hit wins."""
    return (header_roles(names).filter("role IS NOT NULL").groupBy(*SHEET, "role")
            .agg(F.max(F.struct("column_number", "column_name")).alias("c"))
            .select(*SHEET, "role", "c.column_number", "c.column_name"))


def _layout_heads(rows: DataFrame) -> DataFrame:
    """Per sheet and layout: what each column says by its header, the places of the roles, and period and organisation
    of all headers of the sheet. Layouts repeat over rows, so the rows are only read for their distinct ones, and both
    tables are stored: the second is then known to be small where it is."""
    spark = rows.sparkSession
    rows.groupBy(*SHEET, "layout").agg(F.count("*").alias("n_rows")).write.parquet(folder := shared_folder(spark, "layouts"))
    layouts = spark.read.parquet(folder)
    names = header_roles(layouts.select(*SHEET, F.explode("layout").alias("c")).select(*SHEET, "c.*").distinct())
    last = names.groupBy(*SHEET).agg(*[
        F.max(F.when(F.col("role") == r, F.col("column_number"))).alias(f"last_{r}") for r in ROLES])
    is_last = any_of([F.coalesce((F.col("role") == r) & (F.col("column_number") == F.col(f"last_{r}")),
                                 F.lit(False)) for r in ROLES])
    name = F.col("column_name")
    cols = names.join(last, SHEET).select(
        *SHEET, "column_number", "column_name", F.when(is_last, F.col("role")).alias("role")).withColumns({
            "col_metric": norm_metric(name),
            "col_period": F.coalesce(extract_period(name), norm_period(name)),
            "col_unit": unit_or_null(name), "is_first": F.col("column_number") == 1,
            "period_like": has_any(F.lower(name), dims.ROW_PERIOD_PART)})
    text = F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("column_number", "column_name"))),
        lambda x: x["column_name"]), " ")
    sheets = names.groupBy(*SHEET).agg(
        text.alias("header_text"),
        F.min(F.when(is_table_org(name), F.struct("column_number", norm_org(name).alias("org")))).alias("t")).select(
        *SHEET, extract_period(F.col("header_text")).alias("table_period"),
        F.col("t.org").alias("table_org"))
    label = F.coalesce(F.col("role").isin("org", "period", "site", "unit"), F.lit(False)) | F.col("is_first")
    by_sheet = cols.withColumn("label", label).groupBy(*SHEET).agg(F.collect_list(F.struct(
        "column_number", "column_name", "role", "col_metric", "col_period", "col_unit", "is_first", "period_like", "label")).alias("cols"))
    heads = F.transform("layout", lambda c: F.get(F.filter("cols", lambda x: (x["column_number"] == c["column_number"])
                                                          & x["column_name"].eqNullSafe(c["column_name"])), 0))
    placed = layouts.join(by_sheet, SHEET).join(sheets, SHEET).select(
        *SHEET, "layout", "table_period", "table_org", heads.alias("heads"))

    def place(of, value) -> Column:  # -1 without one
        return (F.array_position(F.transform("heads", of), value) - 1).cast("int")

    placed.withColumns({f"at_{r}": place(lambda h: F.coalesce(h["role"], F.lit("")), r) for r in ROLES} | {
        "at_first": place(lambda h: h["is_first"], F.lit(True)),
        "period_like": F.array_compact(F.transform("heads", lambda h, i: F.when(h["period_like"], i))),
        "asks_first": F.exists("heads", lambda h: ~h["label"] & h["col_metric"].isNull()),
    }).write.parquet(folder := shared_folder(spark, "heads"))
    return spark.read.parquet(folder)


def facts_from_tables(cells: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Facts of cell tables with named columns, see `facts_from_rows`. Cells of one row are gathered (bounded by the
    width of the table), so the only shuffle of data cells is by row."""
    return facts_from_rows(gathered_rows(cells), context)


def facts_from_rows(rows: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Facts of tables whose rows hold their cells (`cells.rows_of`). `context`: document_id, g_period, g_org, g_site.

    Long tables (Metric | Value) give one fact per row, all others one per metric cell, the metric
    taken from the column header or else from the first cell of the row. Period, organisation and
    unit fall back from column to row to headers to document. Rows meet what the headers of their layout
    say; all facts of a row are worked out in the row, where only the cells in question are read.
    """
    rows = rows.join(_layout_heads(rows), [*SHEET, "layout"])
    if context is not None:
        rows = rows.join(context, "document_id", "left")
    else:
        rows = rows.withColumns({n: F.lit(None).cast("string") for n in ("g_period", "g_org", "g_site")})

    def val(place: str) -> Column:
        return F.trim(F.get("cells", F.col(place))["value"])

    def unit_of(v: Column) -> Column:
        return F.when(v != "", unit_or_null(v))

    def period_of(v: Column) -> Column:
        return F.coalesce(norm_period(v), extract_period(v))

    def leftmost(values: Column) -> Column:
        return F.get(F.array_compact(values), 0)

    rows = rows.select(
        *SHEET, "row_number", "cells", "heads", "at_metric", "at_value", "at_first", "asks_first",
        F.coalesce(period_of(val("at_period")),
                   leftmost(F.transform("period_like", lambda i: period_of(F.trim(F.get("cells", i)["value"])))),
                   ).alias("row_period"),
        F.coalesce(table_org(val("at_org")), leftmost(F.transform("cells", lambda c: table_org(c["value"]))),
                   F.col("table_org"), F.col("g_org")).alias("org"),
        F.coalesce(let(val("at_site"), lambda v: F.when(F.length(v) > 2, v)), F.col("g_site")).alias("site"),
        let(val("at_unit"), unit_of).alias("row_unit"), "table_period", "g_period")

    def fact(metric, name, number, unit, period, column, cell, mapped) -> Column:
        return F.struct(
            metric.alias("metric_code"), name.alias("raw_metric_name"), number.alias("numeric_value"), unit.alias("unit"),
            period.alias("col_period"), column.alias("column_name"), cell.alias("cell_reference"), mapped.alias("mapped"))

    def long_fact(n: Column) -> Column:
        unit = F.coalesce("row_unit", unit_of(val("at_value")), blank_to_null(default_unit(n["metric"])), F.lit("count"))
        return fact(F.coalesce(n["metric"], F.lit("UNMAPPED")), val("at_metric"), n["number"], unit, F.lit(None).cast("string"),
                    F.get("heads", F.col("at_value"))["column_name"], F.get("cells", F.col("at_value"))["cell_reference"],
                    n["metric"].isNotNull())

    def cell_fact(c: Column, h: Column, row_metric: Column) -> Column:
        def read(y: Column) -> Column:
            metric = F.coalesce(h["col_metric"], row_metric)
            name = F.when(h["col_metric"].isNotNull(), h["column_name"]).otherwise(val("at_first"))
            unit = F.coalesce("row_unit", unit_of(y["val"]), h["col_unit"], blank_to_null(default_unit(metric)))
            return F.when(y["number"].isNotNull() & ~year_like(y["number"], y["val"], metric), fact(
                metric, name, y["number"], unit, h["col_period"], h["column_name"], c["cell_reference"], F.lit(True)))

        v = F.trim(c["value"])
        wanted = (v != "") & (~h["label"] | h["col_metric"].isNotNull()) & (h["col_metric"].isNotNull() | row_metric.isNotNull())
        return F.when(wanted, let(F.struct(v.alias("val"), parse_number(v).alias("number")), read))

    def cell_facts(row_metric: Column) -> Column:
        return F.array_compact(F.transform("cells", lambda c, i: let(F.get("heads", i), lambda h: cell_fact(c, h, row_metric))))

    both = (F.col("at_metric") >= 0) & (F.col("at_value") >= 0)
    read = F.struct(F.when(both, norm_metric(val("at_metric"))).alias("metric"), F.when(both, parse_number(val("at_value"))).alias("number"))
    facts = let(read, lambda n: F.when(
        both & n["number"].isNotNull() & (n["metric"].isNotNull() | (F.length(val("at_metric")) > 1)), F.array(long_fact(n)))
        .otherwise(let(F.when(F.col("asks_first"), norm_metric(val("at_first"))), cell_facts)))
    out = rows.select(*SHEET, "row_number", "org", "site", "row_period", "table_period", "g_period", F.explode(facts).alias("x"))
    return score_facts(out.select(
        *SHEET, "row_number", "x.metric_code", "x.raw_metric_name", "x.numeric_value", "x.unit",
        F.coalesce("x.col_period", "row_period", "table_period", "g_period").alias("reporting_period"), "org", "site",
        "x.column_name", "x.cell_reference", "x.mapped"), "STRUCTURED_TABLE")


def year_like(number: Column, raw: Column, metric: Column) -> Column:
    """Whole numbers 1950-2050 are years, not values, unless the metric counts holes or metres."""
    return number.between(1950, 2050) & ~F.contains(raw, F.lit(".")) & ~metric.isin(*dims.YEAR_LIKE_METRICS)


def drop_year_like(facts: DataFrame, raw: Column) -> DataFrame:
    return facts.filter(~year_like(F.col("numeric_value"), raw, F.col("metric_code")))


def score_facts(facts: DataFrame, method: str, quality: Column | None = None) -> DataFrame:
    """Metric name, confidence, rationale-free status and method of extracted facts."""
    args = (F.lit(method), F.col("unit").isNotNull(), F.col("reporting_period").isNotNull(),
            F.col("org").isNotNull(), F.lit(1.0) if quality is None else quality,
            F.lit(None).cast("double"), F.lit(False), F.lit(True))
    ok = F.col("mapped")
    return facts.withColumns({
        "confidence_score": F.when(ok, scoring.fact_confidence(*args)).otherwise(0.65),
        "metric_name": F.when(ok, metric_name(F.col("metric_code"))).otherwise(
            F.concat(F.lit("Unmapped Metric: "), F.col("raw_metric_name"))),
        "extraction_method": F.lit(method),
    }).withColumn("validation_status", F.when(ok, scoring.initial_status(F.col("confidence_score")))
                  .otherwise("NEEDS_REVIEW")).drop("mapped")


TEXT_GROUPS = ["hit", "org_raw", "metric_raw", "num_raw", "unit_raw", "period_raw"]


def _read_hit(z: Column) -> Column:
    """Organisation, metric and number of one match. The organisation may also lead the metric text."""
    words = F.split(F.trim(z["metric_raw"]), r"\s+")

    def code(name: Column) -> Column:
        return let(norm_org(name), lambda o: F.when(o.isin(*dims.ORG_CODES), o))

    def with_orgs(o: Column) -> Column:
        lead_is_org = o["known"].isNull() & o["lead"].isNotNull()
        skip = F.when(F.lower(F.get(o["words"], 1)).isin(*dims.TEXT_FACT_VERBS), 3).otherwise(2)
        rest = F.array_join(F.slice(o["words"], skip, F.size(o["words"])), " ")
        name = F.trim(F.when(lead_is_org, rest).otherwise(z["metric_raw"]))
        return let(name, lambda n: F.struct(
            z["hit"].alias("hit"), z["num_raw"].alias("num_raw"), z["unit_raw"].alias("unit_raw"),
            z["period_raw"].alias("period_raw"),
            F.coalesce(o["known"], F.when(lead_is_org, o["lead"])).alias("text_org"),
            n.alias("raw_metric_name"), norm_metric(n).alias("metric_code"),
            parse_number(z["num_raw"]).alias("numeric_value")))

    return let(F.struct(words.alias("words"), code(z["org_raw"]).alias("known"),
                        code(F.get(words, 0)).alias("lead")), with_orgs)


def facts_from_text(pages: DataFrame, key: str = "document_id", text: str = "content",
                    context: DataFrame | None = None) -> DataFrame:
    """Facts of free text, several per page. `pages`: key, page_number, text."""
    t = F.col(text)
    groups = [F.regexp_extract_all(t, F.lit(dims.TEXT_FACT_PATTERN), i) for i in range(6)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, TEXT_GROUPS)])
    # hits are read and filtered inside the array, each name and number once, then exploded
    facts = F.filter(F.transform(zipped, _read_hit), lambda h: h["metric_code"].isNotNull()
                     & h["numeric_value"].isNotNull() & (h["numeric_value"] != 0))
    m = pages.select(key, "page_number", t.alias("_text"), F.posexplode(facts).alias("hit_no", "h"))
    m = m.select(key, "page_number", "_text", "hit_no", "h.*")
    m = drop_year_like(m, F.col("num_raw"))
    if context is not None:
        m = m.join(context, key, "left")
    else:
        m = m.withColumns({n: F.lit(None).cast("string") for n in ("g_period", "g_org", "g_site")})
    start = F.instr("_text", F.col("hit"))
    m = m.withColumns({
        "unit": F.when(F.col("unit_raw") != "", unit_or_null(F.col("unit_raw")))
        .otherwise(blank_to_null(default_unit(F.col("metric_code")))),
        "org": F.coalesce("text_org", "g_org"), "site": F.col("g_site"),
        "reporting_period": F.when(F.col("period_raw") != "", norm_period(F.col("period_raw")))
        .otherwise(F.col("g_period")),
        "source_context": let(start, lambda s: F.concat(
            F.lit("..."), F.trim(F.substr(
                F.col("_text"), F.greatest(s - 40, F.lit(1)),
                F.length("hit") + 40 + F.least(s - 1, F.lit(40)))), F.lit("..."))),
        "mapped": F.lit(True)})
    return score_facts(m.select(
        key, "page_number", "hit_no", "metric_code", "raw_metric_name", "numeric_value", "unit",
        "reporting_period", "org", "site", "source_context", "mapped"), "REGEX_PATTERN")


def document_context(docs: DataFrame, key: str, name: str, text: str, chars: int | None = None) -> DataFrame:
    """Organisation, period and site named in the file name or the text; with chars only in its first
    so many characters."""
    head = F.concat_ws(" ", name, text if chars is None else F.substring(text, 1, chars))
    return docs.select(key, extract_entities(head).alias("e")).select(
        key, F.col("e.org").alias("g_org"), F.col("e.period").alias("g_period"),
        F.col("e.site").alias("g_site"))


def all_facts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --- chunking ---


def slices(text: Column, size: int, overlap: int) -> Column:
    """Slices of `size` characters, each starting size - overlap after the one before."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substr(text, s, F.lit(size)))


def pack_paragraphs(text: Column, size: int = 1000, overlap: int = 150, separator: str = "\n\n"
                    ) -> Column:
    """Paragraphs packed up to `size` characters; a longer paragraph is sliced."""
    paras = F.filter(F.transform(F.split(text, separator), lambda p: F.regexp_replace(
        p, r"^\s+|\s+$", "")), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        done, cur = acc["done"], acc["cur"]
        fits = F.length(cur) + F.length(p) + 2 <= size
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        flushed = F.when(cur == "", done).otherwise(F.concat(done, F.array(cur)))
        long = F.length(p) > size
        return F.struct(
            F.when(fits, done).when(long, F.concat(flushed, slices(p, size, overlap)))
            .otherwise(flushed).alias("done"),
            F.when(fits, joined).when(long, F.lit("")).otherwise(p).alias("cur"))

    return F.aggregate(paras, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(
        F.concat(acc["done"], F.array(acc["cur"]))))


def chunk(docs: DataFrame, key: str, text: str = "text", size: int = 1000, overlap: int = 150,
          page_size: int = 3000, separator: str = "\n\n") -> DataFrame:
    """Chunks of every page with an index that runs over the pages of a document.

    Pages and chunks stay arrays in the document's row until one final explode: no shuffle, and the
    index is the array position."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(page_size))
    chunks = F.flatten(F.transform(starts, lambda s, i: F.transform(
        pack_paragraphs(F.substr(F.col(text), s + 1, F.lit(page_size)), size, overlap, separator),
        lambda c: F.struct((i + 1).alias("page_number"), c.alias("content")))))
    out = docs.select(key, F.posexplode(chunks).alias("chunk_index", "c"))
    return out.select(key, "chunk_index", "c.page_number", "c.content",
                      F.length("c.content").alias("char_count"))
