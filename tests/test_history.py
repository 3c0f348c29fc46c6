"""History of facts, report gate, runs over time, pages of lists, further issue types."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.operators import conflicts, history, lineage, report, search

T0 = dt.datetime(2025, 1, 1)
DECISION = ("decision_id string, fact_id string, issue_id string, action string, new_value double, new_unit string, new_metric string, "
            "other_fact_id string, loser_status string, reviewer string, decided_at timestamp")


def test_state_of_a_fact_equals_a_replay(spark, ledger):
    rng = random.Random(6)
    ids = [f"f{i}" for i in range(6)]
    f = ledger(*[dict(fact_id=i, numeric_value=float(n), validation_status="EXTRACTED") for n, i in enumerate(ids)])
    rows = []
    for n in range(40):
        act = rng.choice(["APPROVE_ISSUE", "APPROVE", "REJECT", "EDIT", "SUPERSEDE", "RESOLVE_CONFLICT"])
        a, b = rng.sample(ids, 2)
        two = act in ("SUPERSEDE", "RESOLVE_CONFLICT")
        rows.append((f"d{n:02d}", a, None, act, rng.choice([None, 7.0 + n]), rng.choice([None, "BCM"]), None, b if two else None,
                     rng.choice([None, "DUPLICATE"]) if two else None, f"r{n % 3}", T0 + dt.timedelta(hours=rng.randint(1, 12))))
    d = spark.createDataFrame(rows, DECISION)
    h = history.fact_history(f, d).cache()

    def replay(at):
        state = {i: [float(n), "MT", "EXTRACTED"] for n, i in enumerate(ids)}
        for did, a, _, act, v, u, _, b, loser, _, when in sorted(rows, key=lambda r: (r[10], r[0])):
            if when > at:
                continue
            if act in ("APPROVE_ISSUE", "APPROVE"):
                state[a][2] = "VERIFIED"
            elif act == "REJECT":
                state[a][2] = "REJECTED"
            elif act == "EDIT":
                state[a] = [state[a][0] if v is None else v, u or state[a][1], "VERIFIED"]
            else:
                win, lose = (b, a) if act == "SUPERSEDE" else (a, b)
                state[win][2], state[lose][2] = "VERIFIED", loser or "SUPERSEDED"
                if act == "RESOLVE_CONFLICT" and v is not None:
                    state[win][0] = v
        return state

    for hours in (0, 3, 6, 9, 24):
        at = T0 + dt.timedelta(hours=hours)
        got = {r.fact_id: [r.numeric_value, r.unit, r.validation_status] for r in history.as_of(h, F.lit(at)).collect()}
        assert got == replay(at), hours
    actions = history.actions_of_facts(h).collect()
    assert len(actions) == sum(2 if r[7] else 1 for r in rows) and {r.place for r in actions} >= {1, 2}


def test_conflicts_are_closed_by_decisions_on_both_sides(spark):
    c = spark.createDataFrame([("a|b", "a", "b", "OPEN"), ("c|d", "c", "d", "OPEN"), ("e|f", "e", "f", "RESOLVED")],
                              "conflict_id string, primary_fact_id string, conflicting_fact_id string, status string")
    rows = [("2", "b", None, "RESOLVE_CONFLICT", None, None, None, "a", None, "late", T0 + dt.timedelta(1)),
            ("1", "a", None, "SUPERSEDE", None, None, None, "b", None, "early", T0), ("3", "c", None, "APPROVE", None, None, None, None, None, "x", T0)]
    got = {r.conflict_id: (r.status, r.closed_by) for r in history.close_conflicts(c, spark.createDataFrame(rows, DECISION)).collect()}
    assert got == {"a|b": ("RESOLVED", "early"), "c|d": ("OPEN", None), "e|f": ("RESOLVED", None)}


def test_gate_blocks_without_evidence_and_on_wrong_figures(spark, ledger):
    f = ledger(dict(org="A", row_number=1), dict(org="B", row_number=1), dict(org="B", row_number=2, is_demo=True), dict(org="D", row_number=4))
    scopes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "org string")
    runs = spark.createDataFrame([("A", True, 10.0), ("B", True, 10.0), ("D", False, None)], "org string, success boolean, result double")
    figs = spark.createDataFrame([("A", 10.0), ("B", 20.0), ("D", 10.0)], "org string, production double")
    claims = spark.createDataFrame([("A1", "A"), ("D1", "D")], "claim_id string, org string")
    links = spark.createDataFrame([("A1", "f0000")], "claim_id string, fact_id string")
    open_ = spark.createDataFrame([("D", "OPEN")], "org string, status string")
    g = report.gate(scopes, ["org"], f, runs, figs, claims, links, open_, dims.metrics_frame(spark))
    assert {r.org: r.status for r in g.collect()} == {"A": "READY", "B": "BLOCKED", "C": "BLOCKED", "D": "READY_WITH_WARNINGS"}
    bad = {(r.org, r["name"]) for r in report.gate_rows(g, ["org"]).filter("status <> 'PASS'").collect()}
    assert {("B", "figure as calculated"), ("B", "real or demo, not both"), ("C", "any evidence"), ("D", "open contradictions"),
            ("D", "statements with source"), ("D", "calculation on record")} <= bad


def test_last_ten_runs_by_time(spark, tmp_path):
    res = spark.createDataFrame([("M", "SUM", True, None, 1.0, "MT", 1, 1, 0, 100.0)], "metric_code string, operation string, success boolean, error_code string, "
                                "result double, unit string, evidence_total long, evidence_used long, evidence_excluded long, verified_pct double")
    lab = spark.createDataFrame([("f1", "d", "M", None, 1.0), ("f2", "d", "M", "EXACT_DUPLICATE", 1.0)],
                                "fact_id string, document_id string, metric_code string, exclusion_reason string, numeric_value double")
    for day in (*range(1, 15), 14):  # the last one twice, as after a failure
        at = F.lit(f"2025-01-{day:02d}").cast("timestamp")
        lineage.append_runs(lineage.run_rows(res, ["metric_code"], "t", at), lineage.input_rows(lab, ["metric_code"], run_at=at), str(tmp_path))
    runs, inputs = lineage.read_runs(spark, str(tmp_path))
    assert runs.count() == 14 and inputs.count() == 28
    got = [(r.fact_id, r.place, r.run_at.day) for r in lineage.where_used(inputs, runs).orderBy("place").collect()]
    assert got == [("f1", k + 1, 14 - k) for k in range(10)]


def test_pages_equal_slices_of_the_sorted_list(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(9)]), rng.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v int, k string")
    for falling in (True, False):
        null = (lambda v: (v is None, -(v or 0))) if falling else (lambda v: (v is not None, v or 0))
        want = [r[0] for r in sorted(rows, key=lambda r: (null(r[1]), r[0]))]
        for page, size in ((1, 20), (7, 30), (17, 30), (18, 30), (3, 200)):
            got = search.page_of(df, [("v", falling), ("id", False)], page, size).orderBy(
                *([F.desc("v")] if falling else ["v"]), "id").collect()
            assert [r.id for r in got] == want[(page - 1) * size:page * size]
            assert all(r.total == 500 for r in got)
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(100)], "name string")
    assert [r.name for r in search.page_of(names, [("name", False)], 4, 10).orderBy("name").collect()] == [f"n{i:03d}" for i in range(30, 40)]
    assert search.page_of(names.limit(0), [("name", False)]).count() == 0
    assert {r.id for r in search.lookup(df, spark.createDataFrame([(3,), (3,), (999,)], "id long")).collect()} == {3}


def test_dependency_and_duplicate_issues(spark, ledger):
    f = ledger(*[dict(fact_id=f"s{i}", site="S", org="A", row_number=i) for i in range(9)], dict(fact_id="odd", site="S", org="B"),
               *[dict(fact_id=f"t{i}", site="T", org="AB"[i % 2]) for i in range(4)], dict(fact_id="none", site=None, org="B"))
    got = conflicts.dependency_issues(f, "site", "org", "X").collect()
    assert [(r.fact_id, r.issue_id) for r in got] == [("odd", "odd:X")]
    keys = ["site", "org", "row_number", "numeric_value"]
    assert {r.fact_id for r in conflicts.duplicate_facts(f, keys).collect()} == {"t2", "t3"}
