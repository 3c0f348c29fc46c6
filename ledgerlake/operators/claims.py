"""Claims against the ledger, answers to a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import let

MONEY = "decimal(20,4)"


def verify_claims(claims: DataFrame, results: DataFrame, keys: list[str], mode: str = "absolute"
                  ) -> DataFrame:
    """Verdict per claim. `claims`: claim_id, keys, claimed; `results`: keys, result, success, used.

    absolute: gap <= 0.05 supported, <= 0.20 partially; relative: < 2 % supported, < 10 % partially.
    """
    r = results.select(*keys, F.when(F.col("success"), F.round("result", 2)).alias("recorded"))
    j = claims.join(r, keys, "left")
    small = (F.abs("claimed") < 1e13) & (F.abs("recorded") < 1e13)  # four decimals are kept as decimals
    near = F.abs(F.when(small, F.col("claimed").cast(MONEY)) - F.when(small, F.col("recorded").cast(MONEY)))
    c, rec = F.col("claimed"), F.col("recorded")
    gap = F.coalesce(near.cast("double"), F.abs(c - rec))
    # plain doubles here: a quotient of decimals is cut to a fixed scale before it is rounded
    pct = F.round(F.coalesce((near * 100).cast("double"), gap * 100) / F.greatest(rec, F.lit(0.0001)), 2)
    none = F.col("recorded").isNull() | F.col("claimed").isNull()
    if mode == "absolute":
        verdict = (F.when(none, "INSUFFICIENT_EVIDENCE").when(gap <= 0.05, "SUPPORTED")
                   .when(gap <= 0.20, "PARTIALLY_SUPPORTED").otherwise("CONTRADICTED"))
    else:
        verdict = (F.when(none, "INSUFFICIENT_EVIDENCE").when(pct < 2, "SUPPORTED")
                   .when(pct < 10, "PARTIALLY_SUPPORTED").otherwise("CONFLICTING"))
    return j.select("claim_id", "claimed", "recorded",
                    (F.signum(c - rec) * F.coalesce(F.round(near, 2).cast("double"), F.round(gap, 2))).alias("difference"),
                    F.when(~none, pct).alias("difference_pct"), verdict.alias("verdict"))


def route(tags: Column) -> Column:
    """Which branch answers a question with these tags (intent, metric_code, org)."""
    def pick(t: Column) -> Column:
        i = t["intent"]
        return (F.when(i.isin("GREETING", "HELP", "CAPABILITY_QUERY"), "GUIDE")
                .when(i == "FACT_VERIFICATION", "CLAIM").when(i == "CALCULATION", "ACHIEVEMENT")
                .when(i == "COMPARISON", "COMPARISON").when(i == "CONFLICT_QUERY", "CONFLICT")
                .when(t["metric_code"].isNotNull() & t["org"].isNotNull(), "LOOKUP")
                .otherwise("TEXT"))
    return let(tags, pick)


def with_verified_fallback(all_results: DataFrame, verified_results: DataFrame, keys: list[str]
                           ) -> DataFrame:
    """Verified-only results; where there are none, whether unverified evidence exists."""
    v = verified_results.select(*keys, F.col("result").alias("verified_result"),
                                F.col("success").alias("verified_ok"))
    j = all_results.join(v, keys, "left")
    ok = F.coalesce("verified_ok", F.lit(False))
    return j.select(*keys, F.when(ok, F.col("verified_result")).alias("result"),
                    F.when(ok, "VERIFIED").when(F.col("evidence_used") > 0, "UNVERIFIED_EVIDENCE_EXISTS")
                    .otherwise("NO_EVIDENCE").alias("note"))
