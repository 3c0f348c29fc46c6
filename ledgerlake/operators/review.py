"""Review decisions applied to the ledger as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACT_ACTIONS = ["APPROVE_ISSUE", "APPROVE", "REJECT", "EDIT", "SUPERSEDE", "RESOLVE_CONFLICT"]


def effective_decisions(decisions: DataFrame, key: str = "fact_id") -> DataFrame:
    """One decision per key: the last by (decided_at, decision_id)."""
    w = Window.partitionBy(key).orderBy(F.col("decided_at").desc(), F.col("decision_id").desc())
    return (decisions.filter(F.col(key).isNotNull())
            .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"))


def expand_decisions(decisions: DataFrame) -> DataFrame:
    """Two-sided decisions (supersede, resolve conflict) become one row per fact.

    Roles: WINNER is verified, LOSER gets `loser_status`; one-sided decisions keep role SELF.
    """
    two = F.col("action").isin("SUPERSEDE", "RESOLVE_CONFLICT")
    # SUPERSEDE names the old fact in fact_id and the new one in other_fact_id
    loser_is_self = F.col("action") == "SUPERSEDE"
    win = F.when(loser_is_self, F.col("other_fact_id")).otherwise(F.col("fact_id"))
    lose = F.when(loser_is_self, F.col("fact_id")).otherwise(F.col("other_fact_id"))
    sides = F.when(two, F.array(
        F.struct(win.alias("fact_id"), F.lit("WINNER").alias("role"),
                 F.lit(None).cast("string").alias("successor")),
        F.struct(lose.alias("fact_id"), F.lit("LOSER").alias("role"), win.alias("successor")))
    ).otherwise(F.array(F.struct(
        F.col("fact_id"), F.lit("SELF").alias("role"), F.lit(None).cast("string").alias("successor"))))
    return (decisions.filter(F.col("action").isin(*FACT_ACTIONS)).withColumn("s", F.explode(sides))
            .withColumns({"fact_id": F.col("s.fact_id"), "role": F.col("s.role"),
                          "successor": F.col("s.successor")}).drop("s"))


def apply_decisions(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ledger after all decisions; untouched rows pass through.

    Joined on the fact id, which is unique on both sides, so no key can be hot.
    """
    d = effective_decisions(expand_decisions(decisions)).select(
        "fact_id", "action", "role", "successor", "new_value", "new_unit", "new_metric",
        F.col("reviewer").alias("d_reviewer"), "loser_status")
    j = ledger.join(d, "fact_id", "left")
    act, role = F.col("action"), F.col("role")
    edit = act == "EDIT"
    overrides_value = (edit | ((act == "RESOLVE_CONFLICT") & (role == "WINNER"))) & F.col(
        "new_value").isNotNull()
    verified = (act.isin("APPROVE_ISSUE", "APPROVE", "EDIT") | (role == "WINNER"))
    status = (F.when(verified, "VERIFIED").when(act == "REJECT", "REJECTED")
              .when(role == "LOSER", F.coalesce("loser_status", F.lit("SUPERSEDED")))
              .otherwise(F.col("validation_status")))
    full = act.isin("APPROVE_ISSUE", "EDIT")
    changed = {
        "original_numeric_value": F.when(
            overrides_value, F.coalesce("original_numeric_value", "numeric_value"))
        .otherwise(F.col("original_numeric_value")),
        "numeric_value": F.when(overrides_value, F.col("new_value")).otherwise(F.col("numeric_value")),
        "unit": F.when(edit, F.coalesce("new_unit", "unit")).otherwise(F.col("unit")),
        "metric_code": F.when(edit, F.coalesce("new_metric", "metric_code"))
        .otherwise(F.col("metric_code")),
        "confidence_score": F.when(full, 1.0).otherwise(F.col("confidence_score")),
        "validation_status": status,
        "human_verified": F.when(verified, True).otherwise(F.col("human_verified")),
        "reviewer": F.coalesce("d_reviewer", "reviewer"),
        "superseded_by": F.coalesce("successor", "superseded_by"),
    }
    return j.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in ledger.columns])


def review_actions(before: DataFrame, after: DataFrame, decisions: DataFrame) -> DataFrame:
    """Before/after delta of every fact a decision touched."""
    cols = ["numeric_value", "unit", "metric_code", "validation_status", "confidence_score"]
    d = effective_decisions(expand_decisions(decisions)).select(
        "fact_id", "decision_id", "action", F.col("reviewer").alias("by"))
    b = before.select("fact_id", *[F.col(c).alias(f"old_{c}") for c in cols])
    a = after.select("fact_id", *[F.col(c).alias(f"new_{c}") for c in cols])
    return d.join(b, "fact_id").join(a, "fact_id")


def close_issues(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issue table after the decisions: approvals by issue close that issue, all other fact decisions
    close every issue of the fact; assign, resolve and dismiss act on the issue itself."""
    by_fact = (effective_decisions(expand_decisions(decisions))
               .filter(F.col("action") != "APPROVE_ISSUE").select("fact_id").distinct()
               .withColumn("_f", F.lit(True)))
    by_issue = effective_decisions(decisions, "issue_id").select(
        "issue_id", F.col("action").alias("i_action"))
    j = issues.join(by_fact, "fact_id", "left").join(by_issue, "issue_id", "left")
    act = F.col("i_action")
    locked = F.col("issue_status") == "RESOLVED"
    status = (F.when(locked, F.col("issue_status"))
              .when(act.isin("APPROVE_ISSUE", "RESOLVE_ISSUE"), "RESOLVED")
              .when(act == "DISMISS_ISSUE", "SUPERSEDED").when(F.col("_f"), "RESOLVED")
              .when(act == "ASSIGN_ISSUE", "ASSIGNED").otherwise(F.col("issue_status")))
    return j.withColumn("issue_status", status).select(*issues.columns)


def refused_issue_decisions(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on issues that were resolved before."""
    done = issues.filter(F.col("issue_status") == "RESOLVED").select("issue_id")
    return (decisions.filter(F.col("action").isin("ASSIGN_ISSUE", "RESOLVE_ISSUE", "DISMISS_ISSUE"))
            .join(done, "issue_id", "left_semi")
            .select("decision_id", "issue_id", F.lit("ALREADY_RESOLVED").alias("reason")))
