import pytest
from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.operators import calc, protect, scope


def run(spark, facts, op="SUM", org=None, period=None, exclude_group=True, metric="COAL_PRODUCTION"):
    f = scope.apply_scope(facts, scope.Scope(metric, org=org, period=period))
    rows = calc.calculate(f, dims.metrics_frame(spark), op, exclude_group=exclude_group).collect()
    return rows[0] if rows else None


def test_single_fact(spark, ledger):
    r = run(spark, ledger({"numeric_value": 45.67}), org="SECL", period="FY 2024-25")
    assert (r.result, r.evidence_used, r.evidence_excluded, r.unit) == (45.67, 1, 0, "MT")


def test_many_facts_are_not_cut(spark, ledger):
    rows = [{"numeric_value": 1.0, "reporting_period": f"Month-{i:03d}"} for i in range(150)]
    r = run(spark, ledger(*rows), org="SECL")
    assert r.result == 150.0 and r.evidence_used == 150


def test_duplicate_keeps_the_surer_fact(spark, ledger):
    f = ledger({"numeric_value": 30.0, "confidence_score": .80},
               {"numeric_value": 30.0, "confidence_score": .95})
    r = run(spark, f, org="SECL")
    assert r.result == 30.0 and r.evidence_excluded == 1
    ex = protect.exclusions(f, scope_keys=["metric_code"]).collect()
    assert [(e.fact_id, e.exclusion_reason, e.kept_fact_id) for e in ex] == [
        ("f0000", "EXACT_DUPLICATE", "f0001")]


def test_verified_beats_confidence(spark, ledger):
    f = ledger({"numeric_value": 30.0, "confidence_score": .99, "validation_status": "NEEDS_REVIEW"},
               {"numeric_value": 30.0, "confidence_score": .60})
    kept = protect.included(f, scope_keys=["metric_code"]).collect()
    assert [k.fact_id for k in kept] == ["f0001"]


def test_annual_row_hides_its_months(spark, ledger):
    months = [{"numeric_value": 10.0, "reporting_period": p} for p in ("Apr-2024", "May-2024", "Jun-2024")]
    f = ledger({"numeric_value": 120.0}, *months)
    r = run(spark, f, org="SECL")
    assert r.result == 120.0 and r.evidence_excluded == 3


def test_group_total_hidden_by_companies(spark, ledger):
    f = ledger({"numeric_value": 800.0, "org": "CIL"}, {"numeric_value": 150.0})
    assert run(spark, f).result == 150.0
    assert run(spark, f, exclude_group=False).result == 950.0
    assert run(spark, ledger({"numeric_value": 800.0, "org": "CIL"})).result == 800.0


def test_foreign_unit_is_flagged(spark, ledger):
    f = ledger({"metric_code": "OVERBURDEN_REMOVAL", "numeric_value": 500.0, "unit": "BCM"},
               {"metric_code": "OVERBURDEN_REMOVAL", "numeric_value": 100.0, "unit": "MT"})
    got = {r.unit: r.unit_mismatch for r in scope.unit_mismatch(f, dims.metrics_frame(spark)).collect()}
    assert got == {"BCM": False, "MT": True}


def achieve(spark, f):
    res = calc.calculate(f, dims.metrics_frame(spark), "SUM", ["metric_code", "org"])
    return calc.achievement(res.filter("metric_code = 'COAL_PRODUCTION'"),
                            res.filter("metric_code = 'PRODUCTION_TARGET'"), ["org"]).collect()[0]


def test_achievement(spark, ledger):
    r = achieve(spark, ledger({"numeric_value": 95.0},
                              {"numeric_value": 100.0, "metric_code": "PRODUCTION_TARGET"}))
    assert (r.achievement_pct, r.unit, r.evidence_used) == (95.0, "%", 2)
    r = achieve(spark, ledger({"numeric_value": 186.5},
                              {"numeric_value": 190.0, "metric_code": "PRODUCTION_TARGET"}))
    assert r.achievement_pct == 98.16


def test_no_target_and_zero_target(spark, ledger):
    assert achieve(spark, ledger({"numeric_value": 95.0})).error_code == "MISSING_TARGET"
    r = achieve(spark, ledger({"numeric_value": 50.0},
                              {"numeric_value": 0.0, "metric_code": "PRODUCTION_TARGET"}))
    assert r.error_code == "ZERO_DENOMINATOR" and r.achievement_pct is None


def test_data_scope_and_demo_probe(spark, ledger):
    real = ledger({"numeric_value": 1.0})
    assert run(spark, real, org="SECL").data_scope == "REAL_UPLOADED_DATA"
    both = ledger({"numeric_value": 1.0}, {"numeric_value": 2.0, "is_demo": True,
                                           "reporting_period": "FY 2023-24"})
    assert run(spark, both, org="SECL").result == 1.0
    demo = ledger({"numeric_value": 999.0, "org": "ECL", "is_demo": True})
    assert run(spark, demo, org="ECL") is None
    scopes = spark.createDataFrame([("s", "COAL_PRODUCTION", "ECL", "FY 2024-25")],
                                   "scope_id string, metric_code string, org string, period string")
    scoped = scope.apply_scopes(demo, scopes, ["metric_code", "org"])
    res = calc.calculate(scoped.filter(~F.col("is_demo")), dims.metrics_frame(spark), "SUM",
                         ["scope_id", "metric_code"])
    r = calc.with_empty_scopes(res, scopes, scoped.filter("is_demo")).collect()[0]
    assert (r.success, r.error_code, r.data_scope, r.evidence_used) == (
        False, "NO_VERIFIED_EVIDENCE", "DEMO_DATA", 0)


def test_contradiction_refuses_the_sum(spark, ledger):
    f = ledger({"numeric_value": 100.0, "document_id": "d1", "temporal_grain": "ANNUAL"},
               {"numeric_value": 120.0, "document_id": "d2", "temporal_grain": "ANNUAL"})
    r = run(spark, f, org="SECL")
    assert not r.success and r.error_code == "CONFLICT" and r.result is None


def test_grains_do_not_mix(spark, ledger):
    f = ledger({"numeric_value": 150.0, "org": "WCL", "temporal_grain": "ANNUAL"},
               {"numeric_value": 12.5, "org": "WCL", "temporal_grain": "MONTHLY",
                "reporting_period": "Nov 2024"})
    assert run(spark, f, org="WCL", period="FY 2024-25").result == 150.0
    assert run(spark, f, org="WCL").result == 150.0


def test_stock_is_not_summed(spark, ledger):
    f = ledger({"metric_code": "COAL_STOCK", "numeric_value": 5.0},
               {"metric_code": "COAL_STOCK", "numeric_value": 7.0, "reporting_period": "FY 2025-26"})
    assert run(spark, f, metric="COAL_STOCK").error_code == "UNSUPPORTED_OPERATION"
    assert run(spark, f, "LATEST", metric="COAL_STOCK").result == 7.0
    assert run(spark, f, "MEDIAN", metric="COAL_STOCK").error_code == "UNSUPPORTED_OPERATION"


@pytest.mark.parametrize("values, gap, passed", [
    ([("CIL", 100.0), ("ECL", 60.0), ("SECL", 60.0), ("NCL", 60.0)], 80.0, False),
    ([("CIL", 100.0), ("SECL", 51.0), ("NCL", 50.0)], 1.0, True),
    ([("SECL", 51.0)], None, True)])
def test_reconciliation(spark, ledger, values, gap, passed):
    f = ledger(*[{"org": o, "numeric_value": v} for o, v in values])
    totals = calc.calculate(f, dims.metrics_frame(spark), "SUM", ["metric_code", "org"])
    r = calc.reconcile(totals, dims.GROUP_TOTALS, ["metric_code"]).collect()[0]
    assert (r.discrepancy_pct, r.passed) == (gap, passed)


def test_trend_takes_quarters_of_the_year(spark, ledger):
    f = ledger({"numeric_value": 5.0, "reporting_period": "FY 2023-24"},
               {"numeric_value": 9.0, "reporting_period": "FY 2024-25"},
               {"numeric_value": 2.0, "reporting_period": "Q2 FY 2023-24", "site": "x"})
    got = {r.period: r.result for r in calc.trend(f, dims.metrics_frame(spark)).collect()}
    assert got == {"FY 2023-24": 7.0, "FY 2024-25": 9.0}


def test_set_form_equals_scope_form_and_order_does_not_matter(spark):
    """Protected sums of a random ledger against a plain loop, in two row orders."""
    import datetime as dt
    import random

    rng = random.Random(7)
    rows = []
    for i in range(400):
        period = rng.choice(["FY 2023-24", "FY 2024-25", "Q1 FY 2024-25", "May 2024", "Jan 2024"])
        rows.append((f"f{i}", f"d{rng.randint(1, 3)}", "COAL_PRODUCTION",
                     rng.choice(["CIL", "SECL", "secl", "NCL", None]), rng.choice(["a", "b", None]),
                     period, None, float(rng.randint(1, 4)), rng.choice([.6, .8]),
                     rng.choice(["VERIFIED", "NEEDS_REVIEW"]), False,
                     dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randint(0, 50))))
    schema = ("fact_id string, document_id string, metric_code string, org string, site string, "
              "reporting_period string, temporal_grain string, numeric_value double, "
              "confidence_score double, validation_status string, is_demo boolean, created_at timestamp")
    grain = {"FY 2023-24": "ANNUAL", "FY 2024-25": "ANNUAL", "Q1 FY 2024-25": "QUARTERLY",
             "May 2024": "MONTHLY", "Jan 2024": "MONTHLY"}
    year = {"FY 2023-24": "2023-24", "FY 2024-25": "2024-25", "Q1 FY 2024-25": "2024-25",
            "May 2024": "2024-25", "Jan 2024": "2023-24"}
    dup_period = {"Q1 FY 2024-25": "FY 2024-25", "May 2024": "MAY 2024", "Jan 2024": "JAN 2024"}
    best = {}
    for r in sorted(rows, key=lambda r: (r[9] != "VERIFIED", -r[8], r[11], r[0])):
        key = ((r[3] or "").upper(), dup_period.get(r[5], r[5]), (r[4] or "").upper(), r[7])
        best.setdefault(key, r)
    kept = [r for r in best.values() if (r[3] or "").upper() != "CIL"]
    annual = {((r[3] or "").upper(), year[r[5]], (r[4] or "").upper()) for r in kept
              if grain[r[5]] == "ANNUAL"}
    kept = [r for r in kept if grain[r[5]] == "ANNUAL"
            or ((r[3] or "").upper(), year[r[5]], (r[4] or "").upper()) not in annual]
    for order in (rows, rows[::-1]):
        f = spark.createDataFrame(order, schema)
        got = {r.fact_id for r in protect.included(f, scope_keys=["metric_code"]).collect()}
        assert got == {r[0] for r in kept}
        stats = calc.scope_statistics(f, ["metric_code"]).collect()[0]
        assert float(stats.total) == sum(r[7] for r in kept)
        assert (stats.n, stats.n_total) == (len(kept), len(rows))
