"""Evidence scopes: which facts a calculation runs over."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.sources.folders import shared_folder



@dataclass(frozen=True)
class Scope:
    metric_code: str
    org: str | None = None
    site: str | None = None
    period: str | None = None
    only_verified: bool = False
    only_real: bool = True
    only_demo: bool = False
    document_ids: list[str] | None = field(default=None, hash=False)
    exclude_group: bool = True


def period_matches(column: Column, period: Column | str) -> Column:
    """Case-insensitive contains of the period without `FY `, or equal. `FY 2024-25` therefore also
    takes `Q2 FY 2024-25`."""
    p = F.lit(period) if isinstance(period, str) else period
    bare = F.trim(F.replace(p, F.lit("FY "), F.lit("")))
    return F.contains(F.lower(column), F.lower(bare)) | (column == p)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def scope_condition(scope: Scope) -> Column:
    """The scope as one conjunctive filter; every part but the period is pushed to the scan."""
    parts = [F.col("metric_code") == scope.metric_code, F.col("numeric_value").isNotNull()]
    if scope.org:
        parts.append(F.col("org") == scope.org)
    if scope.site:
        parts.append(F.col("site") == scope.site)
    if scope.period:
        parts.append(period_matches(F.col("reporting_period"), scope.period))
    if scope.only_verified:
        parts.append(F.col("validation_status") == "VERIFIED")
    if scope.only_real:
        parts.append(~F.col("is_demo"))
    elif scope.only_demo:
        parts.append(F.col("is_demo"))
    if scope.document_ids:
        parts.append(F.col("document_id").isin(*scope.document_ids))
    return all_of(parts)


def apply_scope(ledger: DataFrame, scope: Scope) -> DataFrame:
    return ledger.filter(scope_condition(scope))


YEAR_SHAPE = r"^\d{4}-\d{2}$"


def _grams(text: Column) -> Column:
    """Pieces of up to three characters, the empty one included."""
    size = F.coalesce(F.length(text), F.lit(0))

    def of_length(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: i <= size - n + 1)
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *map(of_length, (1, 2, 3))))


def scopes_of_periods(periods: DataFrame, scopes: DataFrame, keys: list[str],
                      kinds: tuple[str, ...] = ("year", "any", "text")) -> DataFrame:
    """(keys, reporting_period, scope_id): which scopes a period text falls into. `periods`: distinct keys and
    reporting_period. Only equi joins: years by their pieces, other texts by their first characters."""
    bare = F.lower(F.trim(F.replace(F.col("period"), F.lit("FY "), F.lit(""))))
    s = scopes.select("scope_id", *keys, F.col("period").alias("s_period"), bare.alias("s_bare"))
    is_year, text = F.col("s_bare").rlike(YEAR_SHAPE), F.col("reporting_period")
    out = [*keys, "reporting_period", "scope_id"]
    branches = []
    if "year" in kinds:
        pieces = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?=(\d{4}-\d{2}))"), 1))
        branches.append(periods.withColumn("s_bare", F.explode(pieces)).join(s.filter(is_year), keys + ["s_bare"]).select(out))
    if "any" in kinds:
        branches.append(periods.join(s.filter(F.col("s_period").isNull()), keys).select(out))
    if "text" in kinds:
        others = s.filter(~is_year).withColumn("gram", F.left("s_bare", F.lit(3)))
        inside = (periods.withColumn("gram", F.explode(_grams(F.lower(text)))).join(others, keys + ["gram"])
                  .filter(F.contains(F.lower(text), F.col("s_bare"))).select(out))
        equal = periods.join(others.withColumn("reporting_period", F.col("s_period")), keys + ["reporting_period"]).select(out)
        branches.append(inside.unionByName(equal).distinct())
    return reduce(lambda x, y: x.unionByName(y), branches)


def apply_scopes(ledger: DataFrame, scopes: DataFrame, keys: list[str] = ("metric_code",),
                 kinds: tuple[str, ...] = ("year", "any", "text")) -> DataFrame:
    """Facts of many scopes at once. `scopes` has scope_id, the key columns and `period`
    (NULL = any); a fact may fall into several scopes.

    Scopes are matched with the distinct period texts of the ledger, once per text; the facts then meet
    that dictionary in one equi join on keys and text, which yields matches only. `kinds` leaves out
    branches the caller knows to be empty.
    """
    keys = list(keys)
    facts = ledger.filter(F.col("numeric_value").isNotNull())
    # stored, so that the ledger is read once for its texts and the planner knows the size of the dictionary
    spark, folder = ledger.sparkSession, shared_folder(ledger.sparkSession, "scopes")
    facts.select(*keys, "reporting_period").distinct().write.parquet(f"{folder}/texts")
    scopes_of_periods(spark.read.parquet(f"{folder}/texts"), scopes, keys, kinds).select(
        *[F.col(k).alias(f"s_{k}") for k in keys], F.col("reporting_period").alias("s_text"), "scope_id").write.parquet(f"{folder}/scopes")
    named = spark.read.parquet(f"{folder}/scopes")
    same = [F.col(k) == F.col(f"s_{k}") for k in keys] + [F.col("reporting_period").eqNullSafe(F.col("s_text"))]
    return facts.join(named, same).drop("s_text", *[f"s_{k}" for k in keys])


def optional_filters(df: DataFrame, **values: str | None) -> DataFrame:
    """Equality filters; None and "ALL" mean no filter. `period` matches by contains."""
    conds = []
    for name, value in values.items():
        if value is None or value == "ALL":
            continue
        conds.append(period_matches(F.col("reporting_period"), value) if name == "period"
                     else F.col(name) == value)
    return df.filter(all_of(conds))


def unit_mismatch(facts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Facts with a flag whether the unit lies outside the allowed units of the metric."""
    dim = metrics.select("metric_code", "allowed_units")
    flag = (F.col("unit").isNotNull() & (F.coalesce(F.size("allowed_units"), F.lit(0)) > 0)
            & ~F.array_contains("allowed_units", F.col("unit")))
    return (facts.join(dim, "metric_code", "left")
            .withColumn("unit_mismatch", F.coalesce(flag, F.lit(False))).drop("allowed_units"))
