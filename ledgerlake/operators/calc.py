"""Protected calculations over one scope or over many scopes at once.

`calculate` never materialises the included set. After exact duplicates are gone the rows are summed
up per conflict bucket (map-side combined), then per fiscal-year key, then per scope; the group-total
and the annual-versus-parts rule are conditional sums on these small partial results. Four shuffles,
each smaller than the one before; facts without stored period keys are read once more for their period texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions.exact import WIDE, exact_sum, not_held, quotient
from ledgerlake.functions.text import is_valid_number
from ledgerlake.operators.protect import (
    DUP_KEYS, YEAR_KEYS, unique, upper_or_empty, with_period_keys, with_protection_keys)
from ledgerlake.operators.scope import apply_scopes

OPS = ["SUM", "AVG", "WAVG", "MIN", "MAX", "COUNT", "LATEST"]


# statistics each operation needs beside the counts; all of them merge by the aggregate given
_STATS = {
    "SUM": ["total", "n_large"], "AVG": ["total", "n_large"], "WAVG": ["total", "weighted", "weight", "n_large"], "MIN": ["low"],
    "MAX": ["high"], "COUNT": [], "LATEST": ["latest"]}


def _first_level(op: str, weight: Column | None) -> dict[str, Column]:
    v = F.col("numeric_value")
    ok = is_valid_number(v)
    w = F.lit(None).cast("double") if weight is None else weight
    return {
        "total": exact_sum(F.when(ok, v)),
        "weighted": exact_sum(F.when(ok, v * w)),
        "weight": exact_sum(F.when(ok, w)),
        "n_large": not_held(F.when(ok, v)),
        "low": F.min(F.when(ok, v)),
        "high": F.max(F.when(ok, v)),
        "latest": F.max(F.when(ok, F.struct("created_at", "fact_id", v.alias("value")))),
    } | {"n_valid": F.count_if(ok), "n": F.count("*"),
         "n_verified": F.count_if(F.col("validation_status") == "VERIFIED"),
         "n_demo": F.count_if(F.col("is_demo"))}


def _merge(names: list[str]) -> list[Column]:
    how = {"low": F.min, "high": F.max, "latest": F.max}
    return [how.get(n, F.sum)(n).alias(n) for n in names]


def scope_statistics(facts: DataFrame, scope_keys: list[str], op: str = "SUM",
                     exclude_group: bool = True, group_codes: list[str] = dims.GROUP_TOTALS,
                     weight: Column | None = None) -> DataFrame:
    """Per scope: statistics of the included facts plus a conflict flag.

    Four aggregations, each combined map-side and each smaller than the one before: duplicate key ->
    conflict bucket -> fiscal year -> scope. Documents are told apart by a 64-bit hash, so from the
    second level on all buffers are numbers and the aggregates are hash aggregates.
    """
    scope_keys = list(dict.fromkeys(scope_keys))
    names = [*_STATS.get(op, []), "n_valid", "n", "n_verified", "n_demo"]
    keyed = with_protection_keys(facts, group_codes).withColumns({
        "b_period": upper_or_empty(F.col("reporting_period")),
        "b_grain": upper_or_empty(F.col("temporal_grain"))})
    payload = ["document_id", "validation_status", "is_demo", "numeric_value", "b_period", "b_grain",
               "k_fy", "k_grain", "is_group"]
    if weight is not None:
        keyed = keyed.withColumn("weight_value", weight)
        payload.append("weight_value")
    best = F.struct(
        (F.upper("validation_status") != "VERIFIED").alias("o1"),
        (-F.col("confidence_score")).alias("o2"), F.col("created_at"), F.col("fact_id"), *payload)
    rows = (keyed.groupBy(*unique(*scope_keys, *DUP_KEYS))
            .agg(F.count("*").alias("n_copies"), F.min(best).alias("f"))
            .select(*unique(*scope_keys, *DUP_KEYS), "n_copies", "f.created_at", "f.fact_id",
                    *[F.col(f"f.{c}").alias(c) for c in payload]))
    first = _first_level(op, None if weight is None else F.col("weight_value"))
    doc, val = F.xxhash64("document_id"), F.round("numeric_value", 2)
    year_keys = unique(*scope_keys, *YEAR_KEYS, "is_group")
    buckets = (
        rows.groupBy(*year_keys, "k_grain", "b_period", "b_grain")
        .agg(*[first[n].alias(n) for n in names], F.sum("n_copies").alias("n_total"),
             F.min(doc).alias("d1"), F.max(doc).alias("d2"),
             F.min(val).alias("v1"), F.max(val).alias("v2"))
        .withColumn("conflict", (F.col("n") > 1) & (F.col("d1") != F.col("d2"))
                    & (F.col("v1") != F.col("v2"))))
    years = _either(
        buckets, year_keys, names, drop=F.col("k_grain").isin("MONTHLY", "QUARTERLY"),
        trigger=F.col("k_grain") == "ANNUAL")
    if not exclude_group:
        return years.groupBy(*scope_keys).agg(
            *_merge([*names, "n_total"]), F.max("conflict").alias("conflict"))
    return _either(years, scope_keys, names, drop=F.col("is_group"),
                   trigger=~F.col("is_group") & (F.col("k_org") != ""))


def _either(df: DataFrame, keys: list[str], names: list[str], drop: Column,
            trigger: Column) -> DataFrame:
    """Merges statistics per key; rows under `drop` only count where no row fires `trigger`.

    One aggregation with both sums instead of a window over the key.
    """
    how = {"low": F.min, "high": F.max, "latest": F.max, "conflict": F.max}
    aggs = []
    for n in [*names, "conflict"]:
        f = how.get(n, F.sum)
        aggs += [f(F.when(~drop, F.col(n))).alias(f"{n}_a"), f(F.when(drop, F.col(n))).alias(f"{n}_b")]
    merged = df.groupBy(*keys).agg(
        *aggs, F.sum("n_total").alias("n_total"), F.max(trigger).alias("fired"))
    out = []
    for n in [*names, "conflict"]:
        a, b = F.col(f"{n}_a"), F.when(~F.col("fired"), F.col(f"{n}_b"))
        if n in ("low",):
            both = F.least(a, b)
        elif n in ("high", "latest"):
            both = F.greatest(a, b)
        elif n == "conflict":
            both = F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
        else:
            both = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        out.append(both.alias(n))
    return merged.select(*keys, *out, "n_total")


def finish(stats: DataFrame, op: str, metrics: DataFrame) -> DataFrame:
    """Result, unit, status and evidence counts out of scope statistics."""
    dim = metrics.select("metric_code", "canonical_unit", "supports_sum")
    out = stats.join(dim, "metric_code", "left")
    sum_ok = F.coalesce("supports_sum", F.lit(True))
    valid = F.col("n_valid") > 0

    def mean() -> Column:
        few = F.abs("total") < 1e23
        return F.when(few, F.round(F.when(few, F.col("total").cast("decimal(30,6)")) / F.col("n_valid"), 4).cast("double")) \
            .otherwise(F.round(F.col("total").cast("double") / F.col("n_valid"), 4))

    def weighted_mean() -> Column:
        w = F.col("weighted").cast("double") / F.col("weight").cast("double")
        return F.coalesce(F.when(F.col("weight") != 0, w), mean())

    value = {
        "SUM": lambda: F.round("total", 4).cast("double"),
        "AVG": mean,
        "WAVG": lambda: F.round(weighted_mean(), 4),
        "MIN": lambda: F.round("low", 4), "MAX": lambda: F.round("high", 4),
        "COUNT": lambda: F.col("n").cast("double"),
        "LATEST": lambda: F.round(F.col("latest")["value"], 4),
    }
    if op not in value:
        result, error = F.lit(None).cast("double"), F.lit("UNSUPPORTED_OPERATION")
    else:
        error = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "INSUFFICIENT_EVIDENCE").when(
            F.col("conflict"), "CONFLICT")
        if op == "SUM":
            error = error.when(~sum_ok, "UNSUPPORTED_OPERATION")
        if "n_large" in _STATS[op]:
            error = error.when(F.col("n_large") > 0, "VALUE_OUT_OF_RANGE")
        if op != "COUNT":
            error = error.when(~valid, "INSUFFICIENT_EVIDENCE")
        result = value[op]()
    out = out.withColumn("error_code", error)
    warning = {"AVG": "SIMPLE_AVERAGE", "WAVG": "SIMPLE_AVERAGE"}.get(op)
    warn = F.lit(None).cast("string")
    if warning:
        warn = F.when(F.coalesce(F.col("weight"), F.lit(0)) == 0, warning) if op == "WAVG" else F.lit(
            warning)
    used, n_demo = F.col("n"), F.col("n_demo")
    return out.withColumns({
        "success": F.col("error_code").isNull(),
        "result": F.when(F.col("error_code").isNull(), result),
        "unit": F.lit("facts") if op == "COUNT" else F.coalesce(
            "canonical_unit", F.lit(dims.DEFAULT_UNIT)),
        "operation": F.lit(op),
        "evidence_total": F.col("n_total"),
        "evidence_used": used,
        "evidence_excluded": F.col("n_total") - used,
        "verified_count": F.col("n_verified"),
        "verified_pct": F.round(
            (F.col("n_verified") * 100).cast("decimal(20,6)")
            / F.greatest(used, F.lit(1)).cast("decimal(20,0)"), 1).cast("double"),
        "data_scope": (F.when(n_demo == 0, "REAL_UPLOADED_DATA")
                       .when(n_demo == used, "DEMO_DATA").otherwise("MIXED_WARNING")),
        "warning": warn,
    }).drop("canonical_unit", "supports_sum", "total", "n_valid", "n", "weighted", "weight", "low",
            "high", "latest", "n_verified", "n_demo", "n_large", "conflict", "n_total")


def calculate(facts: DataFrame, metrics: DataFrame, op: str = "SUM",
              scope_keys: list[str] = ("metric_code",), exclude_group: bool = True,
              group_codes: list[str] = dims.GROUP_TOTALS, weight: Column | None = None) -> DataFrame:
    """Protected aggregate per scope. `scope_keys` must determine the metric."""
    keys = list(scope_keys)
    if "metric_code" not in keys:
        keys.append("metric_code")
    return finish(scope_statistics(facts, keys, op, exclude_group, group_codes, weight), op, metrics)


def with_empty_scopes(results: DataFrame, scopes: DataFrame, demo_facts: DataFrame,
                      only_real: bool = True) -> DataFrame:
    """Adds scopes without evidence: error code, and whether demo facts exist for them."""
    probe = demo_facts.groupBy("scope_id").agg(F.lit(True).alias("demo_exists"))
    code = "NO_VERIFIED_EVIDENCE" if only_real else "INSUFFICIENT_EVIDENCE"
    out = (scopes.select("scope_id", F.col("metric_code").alias("s_metric"))
           .join(results, "scope_id", "left").join(probe, "scope_id", "left"))
    empty = F.col("operation").isNull()
    return out.withColumns({
        "metric_code": F.coalesce("metric_code", F.col("s_metric")),
        "error_code": F.when(empty, code).otherwise(F.col("error_code")),
        "success": F.coalesce("success", F.lit(False)),
        "evidence_used": F.coalesce("evidence_used", F.lit(0).cast("bigint")),
        "data_scope": F.when(empty & F.coalesce("demo_exists", F.lit(False)), "DEMO_DATA")
        .otherwise(F.coalesce("data_scope", F.lit("UNKNOWN"))),
        "warning": F.when(empty & F.coalesce("demo_exists", F.lit(False)), "DEMO_DATA_ONLY")
        .otherwise(F.col("warning")),
    }).drop("s_metric", "demo_exists")


def achievement(actual: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """actual / target * 100 per scope out of two `calculate` results; a target is never invented."""
    t = target.select(
        *keys, F.col("result").alias("t_result"), F.col("success").alias("t_success"),
        F.col("evidence_total").alias("t_total"), F.col("evidence_used").alias("t_used"),
        F.col("evidence_excluded").alias("t_excluded"), F.col("verified_count").alias("t_verified"))
    j = actual.join(t, keys, "left")
    error = (F.when(~F.col("success"), F.col("error_code"))
             .when(~F.coalesce("t_success", F.lit(False)), "MISSING_TARGET")
             .when(F.col("result").isNull() | F.col("t_result").isNull(), "INSUFFICIENT_EVIDENCE")
             .when(F.col("t_result") == 0, "ZERO_DENOMINATOR"))
    j = j.withColumn("err", error)
    ok = F.col("err").isNull()
    used = F.col("evidence_used") + F.when(ok, F.col("t_used")).otherwise(0)
    verified = F.col("verified_count") + F.when(ok, F.col("t_verified")).otherwise(0)
    return j.select(
        *keys, ok.alias("success"), F.col("err").alias("error_code"),
        F.col("result").alias("actual"), F.col("t_result").alias("target"),
        F.when(ok, quotient(F.col("result"), F.col("t_result"), 2, 100)).alias("achievement_pct"),
        F.when(ok, F.lit("%")).otherwise(F.col("unit")).alias("unit"),
        (F.col("evidence_total") + F.when(ok, F.col("t_total")).otherwise(0)).alias("evidence_total"),
        used.alias("evidence_used"),
        (F.col("evidence_excluded") + F.when(ok, F.col("t_excluded")).otherwise(0))
        .alias("evidence_excluded"),
        verified.alias("verified_count"))


def scope_warnings(a_org: Column, t_org: Column, a_period: Column, t_period: Column) -> Column:
    """Compatibility warnings of an actual and a target scope."""
    return F.concat_ws(
        " | ",
        F.when(~a_org.eqNullSafe(t_org), "SCOPE_MISMATCH org"),
        F.when(~a_period.eqNullSafe(t_period), "SCOPE_MISMATCH period"))


def by_entity(facts: DataFrame, metrics: DataFrame, companies: DataFrame | None = None,
              group_codes: list[str] = dims.GROUP_TOTALS) -> DataFrame:
    """Protected totals per organisation, best first; organisations without a result drop out."""
    res = calculate(facts, metrics, "SUM", ["metric_code", "org"], True, group_codes).filter("success")
    if companies is not None:
        res = res.join(companies, "org", "left_semi")
    w = Window.partitionBy("metric_code").orderBy(F.col("result").desc())
    return res.withColumn("place", F.rank().over(w))


def trend(facts: DataFrame, metrics: DataFrame, per_org: bool = False,
          group_codes: list[str] = dims.GROUP_TOTALS) -> DataFrame:
    """Protected total per fiscal period that occurs in the ledger, contains-matched.

    Scopes are the distinct `FY…` periods; group totals are excluded when no entity is given.
    """
    facts = with_period_keys(facts)  # before a fact falls into several scopes
    periods = facts.filter(F.col("reporting_period").like("FY%"))
    scopes = (periods.select("metric_code", F.col("reporting_period").alias("period")).distinct()
              .withColumn("scope_id", F.col("period")))
    named = apply_scopes(facts, scopes, kinds=("year", "text"))
    keys = ["metric_code", "scope_id"] + (["org"] if per_org else [])
    return (calculate(named, metrics, "SUM", keys, not per_org, group_codes)
            .filter("success").withColumnRenamed("scope_id", "period"))


def reconcile(entity_totals: DataFrame, group_codes: list[str], keys: list[str],
              tolerance_pct: float = 2.0) -> DataFrame:
    """Sum of the entities against the group total; passes when one side is missing."""
    is_group = upper_or_empty(F.col("org")).isin(*group_codes)
    sums = entity_totals.filter("success").groupBy(*keys).agg(
        exact_sum(F.when(~is_group, F.col("result"))).alias("parts"),
        exact_sum(F.when(is_group, F.col("result"))).alias("whole"))
    parts = F.round("parts", 3)
    both = F.col("parts").isNotNull() & F.col("whole").isNotNull()
    # divided by at least 0.001
    gap = quotient(F.abs(parts - F.col("whole")), F.greatest(F.col("whole"), F.lit("0.001").cast(WIDE)), 2, 100)
    return sums.select(
        *keys, parts.cast("double").alias("parts_total"),
        F.col("whole").cast("double").alias("group_total"),
        F.when(both, gap).alias("discrepancy_pct"),
        F.when(both, gap <= tolerance_pct).otherwise(True).alias("passed"))


def parts_versus_year(facts: DataFrame, group_codes: list[str] = dims.GROUP_TOTALS) -> DataFrame:
    """Sum of the monthly rows against the annual rows of the same entity and fiscal year."""
    keyed = with_protection_keys(facts, group_codes)
    v = F.col("numeric_value")
    sums = keyed.groupBy("org", "metric_code", F.col("k_fy").alias("fiscal_year")).agg(
        exact_sum(F.when(F.col("k_grain") == "MONTHLY", v)).alias("m"),
        exact_sum(F.when(F.col("k_grain") == "ANNUAL", v)).alias("a"))
    return sums.select(
        "org", "metric_code", "fiscal_year", F.col("m").cast("double").alias("monthly_total"),
        F.col("a").cast("double").alias("annual_total"),
        quotient(F.abs(F.col("m") - F.col("a")), F.greatest(F.col("a"), F.lit("0.001").cast(WIDE)), 2, 100)
        .alias("discrepancy_pct"))
