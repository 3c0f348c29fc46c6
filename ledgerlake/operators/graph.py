"""Entity graph: group -> company -> field -> site -> metric, and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def base_rollup(facts: DataFrame) -> DataFrame:
    return (facts.filter(F.col("org").isNotNull() & F.col("numeric_value").isNotNull())
            .withColumn("field", F.coalesce("field", F.concat("org", F.lit(" Operations"))))
            .groupBy("org", "field", "site", "metric_code")
            .agg(F.count("*").alias("n"), F.avg("numeric_value").alias("mean_value")))


def _id(*parts: str | Column) -> Column:
    return F.replace(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]),
                     F.lit(" "), F.lit("_"))


def org_id() -> Column:
    return _id("SUB_", F.col("org"))


def field_id() -> Column:
    return _id("CF_", F.col("org"), "_", F.col("field"))


def site_id() -> Column:
    return _id("MINE_", F.col("org"), "_", F.col("site"))


def metric_id() -> Column:
    return _id("METRIC_", F.col("metric_code"))


def capped_sites(base: DataFrame, max_sites: int | None = None) -> DataFrame:
    """The sites shown: all, or those with the most facts, then by name."""
    s = (base.filter("site IS NOT NULL").groupBy("org", "field", "site").agg(F.sum("n").alias("n")))
    return s if max_sites is None else s.orderBy(F.col("n").desc(), "org", "field", "site").limit(max_sites)


def nodes(base: DataFrame, root: str, max_sites: int | None = None, extra_orgs: DataFrame | None = None) -> DataFrame:
    """One row per node: id, label, type, level, size."""
    def node(df: DataFrame, i: Column, label: Column, kind: str, level: int, size: Column) -> DataFrame:
        return df.select(i.alias("node_id"), label.alias("label"), F.lit(kind).alias("type"),
                         F.lit(level).alias("level"), size.cast("double").alias("size"))
    spark = base.sparkSession
    top = node(spark.range(1), F.lit(root), F.lit(root), "GROUP", 0, F.lit(40))
    per_org = base.groupBy("org").agg(F.sum("n").alias("n"))
    orgs = node(per_org, org_id(), F.col("org"), "COMPANY", 1,
                F.greatest(F.lit(10.0), F.least(F.lit(30.0), F.col("n") / 10)))
    fields = node(base.select("org", "field").distinct(), field_id(), F.col("field"), "FIELD", 2,
                  F.lit(8))
    sites = node(capped_sites(base, max_sites), site_id(), F.col("site"), "SITE", 3, F.lit(5))
    metrics = node(base.select("metric_code").distinct(), metric_id(),
                   F.initcap(F.lower(F.replace("metric_code", F.lit("_"), F.lit(" ")))), "METRIC", 4,
                   F.lit(6))
    out = top.unionByName(orgs).unionByName(fields).unionByName(sites).unionByName(metrics)
    if extra_orgs is not None:
        missing = extra_orgs.join(per_org, "org", "left_anti")
        out = out.unionByName(node(missing, org_id(), F.col("org"), "COMPANY", 1, F.lit(10)))
    return out


def edges(base: DataFrame, root: str, max_sites: int | None = None) -> DataFrame:
    """OWNS, OPERATES, CONTAINS, REPORTS."""
    def edge(df: DataFrame, a: Column, b: Column, relation: str, weight: Column) -> DataFrame:
        return df.select(a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"),
                         weight.cast("double").alias("weight"))
    owns = edge(base.select("org").distinct(), F.lit(root), org_id(), "OWNS", F.lit(2.0))
    operates = edge(base.select("org", "field").distinct(), org_id(), field_id(), "OPERATES",
                    F.lit(1.5))
    shown = capped_sites(base, max_sites)
    contains = edge(shown, field_id(), site_id(), "CONTAINS", F.lit(1.0))
    per_site = base.join(shown.select("org", "field", "site"), ["org", "field", "site"], "left_semi")
    weight = F.round(F.col("n") / 10, 1)
    reports = edge(per_site, site_id(), metric_id(), "REPORTS", weight)
    # rows without a site report from their field
    loose = base.filter("site IS NULL").groupBy("org", "field", "metric_code").agg(F.sum("n").alias("n"))
    reports = reports.unionByName(edge(loose, field_id(), metric_id(), "REPORTS", weight))
    return owns.unionByName(operates).unionByName(contains).unionByName(reports)


def conflict_edges(conflicts: DataFrame, node_rows: DataFrame, k: int | None = None) -> DataFrame:
    """Company -> metric edges of the open conflicts whose ends are in the graph (the first k of them)."""
    first = (conflicts.filter("status = 'OPEN'")
             .select("created_at", "conflict_id", org_id().alias("source"), metric_id().alias("target")))
    ids = node_rows.select("node_id")
    shown = (first.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
             .join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi"))
    shown = shown if k is None else shown.orderBy("created_at", "conflict_id").limit(k)
    return (shown.select("source", "target", F.lit("CONFLICT").alias("relation"), F.lit(0.3).alias("weight")))


def graph_statistics(node_rows: DataFrame, edge_rows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Totals of the graph and, with the ledger, of its facts and documents."""
    n = node_rows.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "COMPANY").alias("companies"),
                      F.count_if(F.col("type") == "FIELD").alias("fields"),
                      F.count_if(F.col("type") == "SITE").alias("sites"))
    row = n.crossJoin(edge_rows.agg(F.count("*").alias("edges")))  # one-row frames
    if facts is None:
        return row
    return row.crossJoin(facts.agg(F.count("*").alias("facts"), F.count_distinct("document_id").alias("documents")))


def entity_panel(facts: DataFrame, k: int = 3) -> DataFrame:
    """Facts, distinct sites and the top k metrics per company."""
    g = facts.groupBy("org").agg(F.count("*").alias("fact_count"),
                                 F.countDistinct("site").alias("site_count"))
    c = facts.groupBy("org", "metric_code").agg(F.count("*").alias("n"))
    w = Window.partitionBy("org").orderBy(F.col("n").desc(), "metric_code")
    top = c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("org").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "metric_code", "n"))),
                    lambda x: F.concat_ws(":", x["metric_code"], x["n"].cast("string")))
        .alias("top_metrics"))
    return g.join(top, "org", "left")


def fact_paths(facts: DataFrame, documents: DataFrame, root: str) -> DataFrame:
    """Seven-level path of every fact from the group down to its document."""
    def step(kind: str, i: Column, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), i.alias("node_id"), label.alias("label"))
    field = F.coalesce("field", F.concat("org", F.lit(" Operations")))
    value = F.concat_ws(" ", F.col("numeric_value").cast("decimal(20,4)").cast("string"), "unit")
    j = facts.join(documents.select("document_id", "document_name"), "document_id", "left")
    path = F.array(
        step("GROUP", F.lit(root), F.lit(root)),
        step("COMPANY", org_id(), F.coalesce("org", F.lit("Unknown"))),
        step("FIELD", field_id(), field),
        step("SITE", site_id(), F.coalesce("site", F.lit("no site"))),
        step("METRIC", metric_id(), F.col("metric_code")),
        step("FACT", F.col("fact_id"), value),
        step("DOCUMENT", F.col("document_id"), F.coalesce("document_name", F.lit("Unknown"))))
    return j.select("fact_id", F.posexplode(path).alias("level", "s")).select(
        "fact_id", "level", "s.type", "s.node_id", "s.label")
