"""Pre-report gate, figures, evidence register, claims of a report, brief sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from ledgerlake.operators.analytics import metric_sum, ratio_pct, rounded, top
from ledgerlake.operators.provenance import fact_location
from ledgerlake.operators.scope import unit_mismatch


def gate(scopes: DataFrame, keys: list[str], facts: DataFrame, runs: DataFrame, figures: DataFrame, claims: DataFrame,
         links: DataFrame, conflicts: DataFrame, metrics: DataFrame, figure: str = "production",
         least_verified: int = 30, least_placed: int = 85, tolerance: float = 0.005) -> DataFrame:
    """Checks of a report, for every row of `scopes` (distinct keys), whether it has evidence or not.

    runs: keys, success, result of the calculation behind the figure. figures: keys and the figure. claims:
    claim_id, keys; links: claim_id, fact_id. conflicts: keys, status. No evidence, and a figure that its
    calculation does not give, block; everything else that fails is a warning."""
    place = F.coalesce(F.col("cell_reference"), F.col("page_number").cast("string"), F.col("row_number").cast("string"))
    seen = unit_mismatch(facts, metrics).groupBy(*keys).agg(
        F.count("*").alias("evidence"), F.count_if(F.col("validation_status") == "VERIFIED").alias("verified"),
        F.count(place).alias("placed"), F.count_if("is_demo").alias("demo"), F.count_if("unit_mismatch").alias("foreign_units"))
    sourced = claims.join(links.select("claim_id").distinct().withColumn("has_link", F.lit(True)), "claim_id", "left")
    bare = sourced.groupBy(*keys).agg(F.count_if(F.col("has_link").isNull()).alias("bare_claims"))
    open_ = conflicts.groupBy(*keys).agg(F.count_if(F.col("status") == "OPEN").alias("n_open"))
    run = runs.groupBy(*keys).agg(F.max("success").alias("run_ok"), F.max("result").alias("run_result"))
    g = scopes.select(*keys)
    for part in (seen, bare, open_, run, figures.select(*keys, F.col(figure).alias("figure"))):
        g = g.join(part, keys, "left")
    counts = ["evidence", "verified", "placed", "demo", "foreign_units", "bare_claims", "n_open"]
    g = g.fillna(0, subset=counts)
    n = F.col("evidence")
    off = F.abs(F.col("figure") - F.col("run_result"))
    checks = [
        ("open contradictions", F.col("n_open") == 0, "WARN"),
        ("calculation on record", F.coalesce("run_ok", F.lit(False)), "WARN"),
        ("figure as calculated", F.col("figure").isNull() | ~F.coalesce("run_ok", F.lit(False)) | (off <= tolerance), "BLOCK"),
        ("statements with source", F.col("bare_claims") == 0, "WARN"),
        ("units of the metric", F.col("foreign_units") == 0, "WARN"),
        ("any evidence", n > 0, "BLOCK"),
        ("reviewed evidence", F.col("verified") * 100 >= n * least_verified, "WARN"),
        ("evidence with a place", F.col("placed") * 100 >= n * least_placed, "WARN"),
        ("real or demo, not both", F.col("demo").isin(0) | (F.col("demo") == n), "WARN")]
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.when(good, "PASS").otherwise(bad).alias("status"))
                     for name, good, bad in checks])
    out = g.withColumn("checks", rows)
    has = lambda what: F.exists("checks", lambda c: c["status"] == what)
    return out.withColumn("status", F.when(has("BLOCK"), "BLOCKED").when(has("WARN"), "READY_WITH_WARNINGS").otherwise("READY"))


def gate_rows(gates: DataFrame, keys: list[str]) -> DataFrame:
    return gates.select(*keys, F.posexplode("checks").alias("p", "c")).select(
        *keys, (F.col("p") + 1).alias("check_no"), "c.name", "c.status")


def figures(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Report figures per scope in one pass; a missing target stays NULL."""
    g = facts.groupBy(*keys).agg(
        rounded(metric_sum("COAL_PRODUCTION"), 2).alias("production"),
        rounded(metric_sum("PRODUCTION_TARGET"), 2).alias("target"),
        rounded(metric_sum("COAL_OFFTAKE"), 2).alias("offtake"),
        rounded(metric_sum("OVERBURDEN_REMOVAL"), 2).alias("overburden"),
        rounded(metric_sum("DRILLING"), 2).alias("drilling"))
    return g.withColumn("achievement_pct", ratio_pct(F.col("production"), F.col("target"), 2))


def evidence_register(facts: DataFrame, k: int = 50) -> DataFrame:
    """The k largest facts with a running evidence id."""
    best = top(facts.filter(F.col("numeric_value").isNotNull()), k, "numeric_value", "fact_id")
    w = Window.orderBy(F.col("numeric_value").desc(), "fact_id")  # k rows
    return best.withColumn("place", F.row_number().over(w)).select(
        F.concat(F.lit("E-"), (F.col("place") + 1000).cast("string")).alias("evidence_id"), "fact_id",
        "metric_code", "numeric_value", "org", "reporting_period",
        fact_location().alias("location"), (F.col("validation_status") == "VERIFIED").alias("verified"))


def report_claims(figs: DataFrame, key: str) -> DataFrame:
    """Statements of a report, one per available figure."""
    def say(name: str, value: str, suffix: str):
        v = F.col(value)
        return F.when(v.isNotNull(), F.struct(
            F.lit(name).alias("kind"), v.alias("value"),
            F.concat(F.lit(label_of(name)), F.lit(" of "), F.col(key), F.lit(": "),
                     v.cast("decimal(20,2)").cast("string"), F.lit(suffix)).alias("statement")))
    parts = F.array_compact(F.array(say("PRODUCTION", "production", " MT"),
                                    say("ACHIEVEMENT", "achievement_pct", "%"),
                                    say("OFFTAKE", "offtake", " MT")))
    return figs.select(key, F.posexplode(parts).alias("p", "c")).select(
        F.concat_ws(":", key, "c.kind").alias("claim_id"), key, "c.kind", "c.value", "c.statement")


def label_of(name: str) -> str:
    return name.replace("_", " ").title()


def claim_links(claims: DataFrame, facts: DataFrame, key: str, per_claim: int = 5) -> DataFrame:
    """Evidence of a claim: the largest facts behind its metric, a bounded number per claim."""
    kind = (F.when(F.col("metric_code") == "COAL_PRODUCTION", F.array(F.lit("PRODUCTION"),
                                                                     F.lit("ACHIEVEMENT")))
            .when(F.col("metric_code") == "PRODUCTION_TARGET", F.array(F.lit("ACHIEVEMENT")))
            .when(F.col("metric_code") == "COAL_OFFTAKE", F.array(F.lit("OFFTAKE"))))
    w = Window.partitionBy(key, "kind").orderBy(F.col("numeric_value").desc(), "fact_id")
    f = (facts.select(key, "fact_id", "numeric_value", F.explode(kind).alias("kind"))
         .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_claim))
    return claims.select("claim_id", key, "kind").join(f, [key, "kind"]).select(
        "claim_id", "fact_id", F.col("r").alias("place"))


def claims_with_evidence(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Claims with their links nested; links per claim are bounded."""
    nested = links.groupBy("claim_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "fact_id"))), lambda x: x["fact_id"])
        .alias("evidence"))
    return claims.join(nested, "claim_id", "left")


def brief_sections(figs: DataFrame, key: str) -> DataFrame:
    """Direct answer, figures, sources and limits of a short brief as ordered text rows."""
    def num(c: str, unit: str):
        return F.coalesce(F.concat(F.col(c).cast("decimal(20,2)").cast("string"), F.lit(unit)),
                          F.lit("not recorded"))
    sections = F.array(
        F.struct(F.lit("Direct answer").alias("section"), F.concat(
            F.col(key), F.lit(" produced "), num("production", " MT"), F.lit(".")).alias("text")),
        F.struct(F.lit("Figures").alias("section"), F.concat(
            F.lit("Target "), num("target", " MT"), F.lit("; achievement "), num("achievement_pct", "%"),
            F.lit("; dispatch "), num("offtake", " MT")).alias("text")),
        F.struct(F.lit("Sources").alias("section"), F.lit("Evidence ledger").alias("text")),
        F.struct(F.lit("Limits").alias("section"), F.when(
            F.col("target").isNull(), "No target evidence.").otherwise("None noted.").alias("text")))
    return figs.select(key, F.posexplode(sections).alias("p", "s")).select(
        key, (F.col("p") + 1).alias("place"), "s.section", "s.text")


