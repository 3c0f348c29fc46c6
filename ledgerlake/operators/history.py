"""History of facts: review actions folded into validity intervals, look-up as of a time, closed conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.review import expand_decisions

#: action that decides a conflict -> status of the conflict row
CLOSING = {"RESOLVE_CONFLICT": "RESOLVED", "SUPERSEDE": "RESOLVED"}
STATE = ["numeric_value", "unit", "metric_code", "confidence_score", "validation_status", "human_verified", "reviewer"]


def fact_history(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per state of a fact: fact_id, decision_id, action, valid_from, valid_to and the STATE columns.

    The state of the ledger holds until the first decision (valid_from NULL), the state after a decision until
    the next one, the last for good (valid_to NULL). What a decision does not set stays as it was: a running
    last non-NULL value per fact, in the order of time and decision id. Decisions on facts that are not in
    the ledger are left out."""
    d = expand_decisions(decisions)
    act, role = F.col("action"), F.col("role")
    edit = act == "EDIT"
    verified = act.isin("APPROVE_ISSUE", "APPROVE", "EDIT") | (role == "WINNER")
    sets = {
        "numeric_value": F.when(edit | ((act == "RESOLVE_CONFLICT") & (role == "WINNER")), F.col("new_value")),
        "unit": F.when(edit, F.col("new_unit")), "metric_code": F.when(edit, F.col("new_metric")),
        "confidence_score": F.when(act.isin("APPROVE_ISSUE", "EDIT"), F.lit(1.0)),
        "validation_status": F.when(verified, "VERIFIED").when(act == "REJECT", "REJECTED").when(
            role == "LOSER", F.coalesce("loser_status", F.lit("SUPERSEDED"))),
        "human_verified": F.when(verified, F.lit(True)), "reviewer": F.col("reviewer")}
    changes = d.select("fact_id", "decision_id", "action", F.col("decided_at").alias("valid_from"), *[e.alias(f"c_{c}") for c, e in sets.items()])
    start = ledger.select("fact_id", *[F.lit(None).cast(t).alias(c) for c, t in (("decision_id", "string"), ("action", "string"), ("valid_from", "timestamp"))],
                          *[(F.col(c) if c in ledger.columns else F.lit(None).cast("string")).alias(f"c_{c}") for c in STATE], F.lit(True).alias("first"))
    known = changes.join(ledger.select("fact_id"), "fact_id", "left_semi").withColumn("first", F.lit(False))
    by = Window.partitionBy("fact_id").orderBy(F.col("first").desc(), "valid_from", "decision_id", "action")
    rows = start.unionByName(known)
    return rows.select(
        "fact_id", "decision_id", "action", "valid_from", F.lead("valid_from").over(by).alias("valid_to"),
        *[F.last(f"c_{c}", ignorenulls=True).over(by).alias(c) for c in STATE])


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The state of every fact at a time; decisions made at that very time count."""
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= at)
    return history.filter(begun & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def actions_of_facts(history: DataFrame) -> DataFrame:
    """Review actions per fact, newest first, with what they changed."""
    by = Window.partitionBy("fact_id").orderBy(F.col("valid_from").desc(), F.col("decision_id").desc(), F.col("action").desc())
    before = {c: F.lead(c).over(by) for c in ("numeric_value", "validation_status")}
    numbered = history.withColumns({f"old_{c}": e for c, e in before.items()} | {"place": F.row_number().over(by)})
    return numbered.filter("decision_id IS NOT NULL").select(
        "fact_id", "place", "decision_id", "action", F.col("valid_from").alias("acted_at"), "old_numeric_value",
        F.col("numeric_value").alias("new_numeric_value"), "old_validation_status", F.col("validation_status").alias("new_validation_status"), "reviewer")


def decided_actions(decisions: DataFrame) -> DataFrame:
    """The decision rows of `fact_history` with action, time and reviewer, without reading the ledger: decisions on facts
    that are not in it are there as well, and a ledger's own reviewers are not."""
    by = Window.partitionBy("fact_id").orderBy("decided_at", "decision_id", "action")
    return expand_decisions(decisions).select("fact_id", "decision_id", "action", F.col("decided_at").alias("valid_from"),
                                              F.last("reviewer", ignorenulls=True).over(by).alias("reviewer"))


def raw_part(facts: DataFrame) -> Column:
    return F.struct(
        F.col("numeric_value").alias("value"), "unit", "cell_reference", "row_number", "page_number",
        (F.col("source_context") if "source_context" in facts.columns else F.lit(None).cast("string")).alias("context")).alias("raw")


def close_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts after the decisions: one between two sides of an open conflict closes it, whichever is named
    first; the earliest counts. Adds closed_at and closed_by."""
    ends = [F.least("fact_id", "other_fact_id").alias("lo"), F.greatest("fact_id", "other_fact_id").alias("hi")]
    to = F.create_map(*[F.lit(x) for pair in CLOSING.items() for x in pair])
    d = decisions.filter(F.col("action").isin(*CLOSING) & F.col("other_fact_id").isNotNull()).select(
        *ends, F.struct(F.col("decided_at").alias("at"), "decision_id", to[F.col("action")].alias("status"), F.col("reviewer").alias("by")).alias("d"))
    first = d.groupBy("lo", "hi").agg(F.min("d").alias("d"))
    sides = [F.least("primary_fact_id", "conflicting_fact_id") == F.col("lo"), F.greatest("primary_fact_id", "conflicting_fact_id") == F.col("hi")]
    closes = (F.col("status") == "OPEN") & F.col("d").isNotNull()
    return conflicts.join(first, sides, "left").withColumns({
        "closed_at": F.when(closes, F.col("d.at")), "closed_by": F.when(closes, F.col("d.by")),
        "status": F.when(closes, F.col("d.status")).otherwise(F.col("status"))}).drop("lo", "hi", "d")


def full_dossiers(dossiers: DataFrame, facts: DataFrame, history: DataFrame, runs_of_facts: DataFrame, claims_of_facts: DataFrame) -> DataFrame:
    """Dossiers with the raw, review and usage parts. runs_of_facts: fact_id, run_id, run_at; claims_of_facts:
    fact_id, claim_id, report_id. Numbers and last values only, however often a fact was used. Dossiers that have
    their raw part meet no fact for it."""
    if "raw" not in dossiers.columns:
        dossiers = dossiers.join(facts.select("fact_id", raw_part(facts)), "fact_id", "left")
    done = history.filter("decision_id IS NOT NULL").groupBy("fact_id").agg(
        F.count("*").alias("actions"), F.max(F.struct("valid_from", "decision_id", "action", "reviewer")).alias("last"))
    review = done.select("fact_id", F.struct("actions", F.col("last.action").alias("last_action"), F.col("last.valid_from").alias("last_at"),
                                             F.col("last.reviewer").alias("last_by")).alias("review"))
    runs = runs_of_facts.groupBy("fact_id").agg(F.count_distinct("run_id").alias("runs"), F.max("run_at").alias("last_run_at"))
    claims = claims_of_facts.groupBy("fact_id").agg(F.count_distinct("claim_id").alias("claims"), F.count_distinct("report_id").alias("reports"))
    usage = runs.join(claims, "fact_id", "full_outer").select("fact_id", F.struct(
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "claims", "reports")], "last_run_at").alias("usage"))
    return dossiers.join(review, "fact_id", "left").join(usage, "fact_id", "left")
