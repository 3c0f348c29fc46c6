"""Double-count protection: exact duplicates, group totals, annual rows versus their parts.

Nothing here gathers a group in one task. Winners of duplicate groups come from a row-number filter,
which Spark cuts to one row per key and map task before the shuffle; presence tests are
pre-aggregated key sets; labels are joined back, where adaptive skew handling may split a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions.period import fy_key, infer_grain, period_key
from ledgerlake.functions.text import let
from ledgerlake.sources.folders import shared_folder

EXACT, GROUP, TEMPORAL = "EXACT_DUPLICATE", "CONSOLIDATED_OVERLAP", "TEMPORAL_OVERLAP"


def unique(*names: str) -> list[str]:
    return list(dict.fromkeys(names))


DUP_KEYS = ["k_org", "metric_code", "k_period", "k_site", "k_value"]
YEAR_KEYS = ["k_org", "metric_code", "k_fy", "k_site"]


def upper_or_empty(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))


def with_period_keys(facts: DataFrame) -> DataFrame:
    """Keys that depend on period and grain only. Stored with the ledger, they are computed once at
    ingest; a frame that has them already is returned as it is. Else the text rules run once per distinct
    period text, and the facts meet that stored dictionary; a stream has no such pass and works them out row by row."""
    if "k_fy" in facts.columns:
        return facts
    keys = let(F.col("reporting_period"), lambda p: F.struct(
        period_key(p).alias("k_period"), fy_key(p).alias("k_fy"), infer_grain(p).alias("k_grain")))
    given = F.coalesce(F.col("temporal_grain"), F.lit("")) != ""
    if facts.isStreaming:
        keyed = facts.withColumn("_k", keys)
    else:
        # stored, so that the planner knows the size of the dictionary
        folder = shared_folder(facts.sparkSession, "periods")
        facts.select("reporting_period").distinct().select(
            F.col("reporting_period").alias("_text"), keys.alias("_k")).write.parquet(folder)
        keyed = facts.join(facts.sparkSession.read.parquet(folder), F.col("reporting_period").eqNullSafe(F.col("_text")), "left").drop("_text")
    return keyed.withColumns({
        "k_period": F.col("_k.k_period"), "k_fy": F.col("_k.k_fy"),
        "k_grain": F.when(given, F.upper("temporal_grain")).otherwise(F.col("_k.k_grain"))}).drop("_k")


def with_protection_keys(facts: DataFrame, group_codes: list[str] = dims.GROUP_TOTALS) -> DataFrame:
    """Adds the keys of the three rules."""
    org = upper_or_empty(F.col("org"))
    return with_period_keys(facts).withColumns({
        "k_org": org,
        "k_site": upper_or_empty(F.col("site")),
        "k_value": F.round("numeric_value", 3),
        "is_group": org.isin(*group_codes),
    })


def drop_exact_duplicates(keyed: DataFrame, scope_keys: list[str] = ()) -> DataFrame:
    """One row per duplicate key: verified first, then higher confidence, then first seen."""
    w = Window.partitionBy(*unique(*scope_keys, *DUP_KEYS)).orderBy(
        (F.upper("validation_status") == "VERIFIED").desc(), F.col("confidence_score").desc(),
        F.col("created_at"), F.col("fact_id"))
    return keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def company_presence(keyed: DataFrame, scope_keys: list[str]) -> DataFrame:
    """Per scope: is any company-level row present? One row per scope."""
    company = ~F.col("is_group") & (F.col("k_org") != "")
    return keyed.groupBy(*scope_keys).agg(F.max(company).alias("has_company"))


def same_key_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL equals NULL; keys of the right side are dropped."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, match, how).drop(*[f"_r_{k}" for k in keys])


def with_group_rule(rows: DataFrame, keyed: DataFrame, scope_keys: list[str], exclude_group: bool = True) -> DataFrame:
    """Adds `group_dropped`: a group total in a scope where the ledger has a company-level row."""
    if not exclude_group:
        return rows.withColumn("group_dropped", F.lit(False))
    presence = company_presence(keyed, scope_keys)
    rows = same_key_join(rows, presence, scope_keys) if scope_keys else rows.crossJoin(F.broadcast(presence))  # a single row
    return rows.withColumn("group_dropped", F.col("is_group") & F.col("has_company")).drop("has_company")


def label_exclusions(facts: DataFrame, scope_keys: list[str] = (), exclude_group: bool = True,
                     group_codes: list[str] = dims.GROUP_TOTALS) -> DataFrame:
    """Every fact with `exclusion_reason` (NULL = included) and, for duplicates, the kept fact.

    NULL values and NULL scope keys are keys like others; no fact is lost."""
    scope_keys = list(scope_keys)
    keyed = with_protection_keys(facts, group_codes)
    # the winners are read twice below with the same columns, so that their shuffle is reused
    winners = drop_exact_duplicates(keyed, scope_keys).select(
        *unique(*scope_keys, *DUP_KEYS), F.col("fact_id").alias("kept_fact_id"), "k_fy",
        F.col("k_grain").alias("kept_grain"), "is_group")
    winners = with_group_rule(winners, keyed, scope_keys, exclude_group).drop("is_group")
    annual = (winners.filter((F.col("kept_grain") == "ANNUAL") & ~F.col("group_dropped"))
              .select(*unique(*scope_keys, *YEAR_KEYS)).distinct().withColumn("has_annual", F.lit(True)))
    # year and grain are taken from the winner: the annual rule only concerns rows that are kept, and
    # those are their own winners
    labelled = same_key_join(keyed.drop("k_fy", "k_grain", "is_group"), winners, unique(*scope_keys, *DUP_KEYS))
    labelled = same_key_join(labelled, annual, unique(*scope_keys, *YEAR_KEYS), "left")
    is_part = F.col("kept_grain").isin("MONTHLY", "QUARTERLY")
    reason = (F.when(F.col("fact_id") != F.col("kept_fact_id"), EXACT)
              .when(F.col("group_dropped"), GROUP)
              .when(is_part & F.coalesce("has_annual", F.lit(False)), TEMPORAL))
    return (labelled.withColumn("exclusion_reason", reason)
            .withColumn("kept_fact_id", F.when(F.col("exclusion_reason") == EXACT,
                                               F.col("kept_fact_id")))
            .drop("group_dropped", "has_annual", "kept_grain", "k_fy",
                  *[k for k in DUP_KEYS if k != "metric_code"]))


def included(facts: DataFrame, scope_keys: list[str] = (), exclude_group: bool = True,
             group_codes: list[str] = dims.GROUP_TOTALS) -> DataFrame:
    """The facts that `label_exclusions` gives no reason. These are winners of their duplicates, so that only winners
    meet the annual keys, and no fact meets its winner."""
    scope_keys = list(scope_keys)
    keyed = with_protection_keys(facts, group_codes)
    kept = with_group_rule(drop_exact_duplicates(keyed, scope_keys), keyed, scope_keys, exclude_group).filter("NOT group_dropped")
    annual = kept.filter("k_grain = 'ANNUAL'").select(*unique(*scope_keys, *YEAR_KEYS)).distinct().withColumn("has_annual", F.lit(True))
    is_part = F.coalesce(F.col("k_grain").isin("MONTHLY", "QUARTERLY"), F.lit(False))
    rest = same_key_join(kept, annual, unique(*scope_keys, *YEAR_KEYS), "left").filter(~is_part | F.col("has_annual").isNull())
    none = F.lit(None).cast("string")
    return rest.drop("group_dropped", "has_annual", "k_grain", "k_fy", "is_group", *[k for k in DUP_KEYS if k != "metric_code"]).withColumns(
        {"kept_fact_id": none, "exclusion_reason": none})


def group_overlaps(facts: DataFrame, scope_keys: list[str] = (), group_codes: list[str] = dims.GROUP_TOTALS) -> DataFrame:
    """The facts that `label_exclusions` gives the reason GROUP. Duplicates of a group total are of the same
    organisation, so that no other fact but for the presence of companies is needed."""
    scope_keys = list(scope_keys)
    keyed = with_protection_keys(facts, group_codes)
    return with_group_rule(drop_exact_duplicates(keyed.filter("is_group"), scope_keys), keyed, scope_keys).filter("group_dropped").drop(
        "group_dropped", "k_grain", "k_fy", "is_group", *[k for k in DUP_KEYS if k != "metric_code"])


def exclusions(facts: DataFrame, **kwargs) -> DataFrame:
    """Exclusion ledger: fact, reason, kept fact."""
    scope_keys = list(kwargs.get("scope_keys", ()))
    return (label_exclusions(facts, **kwargs).filter("exclusion_reason IS NOT NULL")
            .select(*scope_keys, "fact_id", "exclusion_reason", "kept_fact_id"))


def value_conflicts(facts: DataFrame, keys: list[str] = ("metric_code", "org", "reporting_period")
                    ) -> DataFrame:
    """Keys with more than one distinct value (rounded to 2), with the number of values.

    Values are made distinct before they are counted per key, so a hot key is pre-aggregated."""
    keys = list(keys)
    distinct = facts.select(*keys, F.round("numeric_value", 2).alias("v")).distinct()
    return (distinct.groupBy(*keys).agg(F.count("v").alias("n_values"), F.min("v").alias("low"),
                                        F.max("v").alias("high")).filter("n_values > 1"))
