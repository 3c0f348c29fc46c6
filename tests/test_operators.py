import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import conflicts, merge, provenance, retrieve, review, runs
from ledgerlake.streaming import jobs


def random_facts(ledger, n=250, seed=5):
    rng = random.Random(seed)
    rows = [dict(document_id=f"d{rng.randint(1, 4)}", org=rng.choice(["A", "B", None]),
                 numeric_value=float(rng.choice([0, 10, 10, 20, 30, 31])),
                 created_at=dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randint(0, 40)),
                 fact_id=f"f{i:03d}", reporting_period=rng.choice(["FY 2024-25", "FY 2023-24"]))
            for i in range(n)]
    return rows, ledger(*rows)


def expected_conflicts(rows):
    out = set()
    key = lambda r: (r["created_at"], r["fact_id"])
    for f in rows:
        if f["org"] is None:
            continue
        partners = [p for p in rows if p["org"] == f["org"] and p["reporting_period"] == f["reporting_period"]
                    and p["document_id"] != f["document_id"] and p["numeric_value"] != f["numeric_value"]
                    and key(p) < key(f)]
        if partners:
            p = min(partners, key=key)
            if p["numeric_value"] > 0 and abs(f["numeric_value"] - p["numeric_value"]) / p["numeric_value"] >= .05:
                out.add((p["fact_id"], f["fact_id"]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contradictions_against_loop(spark, ledger, seed):
    rows, f = random_facts(ledger, seed=seed)
    got = {(r.primary_fact_id, r.conflicting_fact_id) for r in conflicts.contradictions(f).collect()}
    assert got == expected_conflicts(rows)


def test_rules(spark, ledger):
    f = ledger({"unit": None}, {"reporting_period": None, "confidence_score": .5}, {"metric_code": "UNMAPPED"})
    got = {(r.fact_id, r.issue_type, r.severity) for r in conflicts.check_rules(f).collect()}
    assert got == {("f0000", "MISSING_UNIT", "MEDIUM"), ("f0001", "MISSING_PERIOD", "MEDIUM"),
                   ("f0001", "LOW_CONFIDENCE", "HIGH"), ("f0002", "UNMAPPED_METRIC", "LOW")}


UPDATED = ["numeric_value", "unit", "confidence_score", "validation_status"]


def test_upsert_is_idempotent_and_null_safe(spark, ledger):
    old = ledger({"fact_id": "a", "numeric_value": 1.0}, {"fact_id": "b", "org": "X"})
    new = ledger({"fact_id": "c", "numeric_value": 5.0}, {"fact_id": "d", "org": "Y"})
    once = merge.upsert_facts(old, new, UPDATED)
    twice = merge.upsert_facts(once, new, UPDATED)
    expect = {("a", 5.0), ("b", 10.0), ("d", 10.0)}
    assert {(r.fact_id, r.numeric_value) for r in once.collect()} == expect
    assert {(r.fact_id, r.numeric_value) for r in twice.collect()} == expect


def test_decisions(spark, ledger):
    f = ledger(*[{"fact_id": x, "numeric_value": 10.0, "validation_status": "NEEDS_REVIEW",
                  "confidence_score": .7} for x in "abcdefg"]).withColumns({
        "original_numeric_value": F.lit(None).cast("double"), "reviewer": F.lit(None).cast("string"),
        "superseded_by": F.lit(None).cast("string")})
    t = dt.datetime(2025, 2, 1)
    d = spark.createDataFrame([
        ("1", "a", "i1", "APPROVE_ISSUE", None, None, None, None, None, "r", t),
        ("2", "b", None, "APPROVE", None, None, None, None, None, "r", t),
        ("3", "c", None, "REJECT", None, None, None, None, None, "r", t),
        ("4", "d", None, "EDIT", 12.0, "Mm3", None, None, None, "r", t),
        ("5", "e", None, "SUPERSEDE", None, None, None, "f", None, "r", t),
        ("6", "g", None, "REJECT", None, None, None, None, None, "r", t),
        ("7", "g", None, "APPROVE", None, None, None, None, None, "s", t)],
        "decision_id string, fact_id string, issue_id string, action string, new_value double, "
        "new_unit string, new_metric string, other_fact_id string, loser_status string, reviewer string, "
        "decided_at timestamp")
    r = {x.fact_id: x for x in review.apply_decisions(f, d).collect()}
    assert (r["a"].validation_status, r["a"].confidence_score) == ("VERIFIED", 1.0)
    assert (r["b"].validation_status, r["b"].confidence_score) == ("VERIFIED", .7)
    assert r["c"].validation_status == "REJECTED"
    assert (r["d"].numeric_value, r["d"].original_numeric_value, r["d"].unit) == (12.0, 10.0, "Mm3")
    assert (r["e"].validation_status, r["e"].superseded_by, r["f"].validation_status) == (
        "SUPERSEDED", "f", "VERIFIED")
    assert (r["g"].validation_status, r["g"].reviewer) == ("VERIFIED", "s")


def score_by_loop(queries, chunks, limit=6):
    import re

    from ledgerlake.dims import STOPWORDS
    out = {}
    for qid, text, org, period in queries:
        words = [w for w in re.findall(r"\b\w{3,}\b", text.lower()) if w not in STOPWORDS]
        cands = [c for c in chunks if any(w in c[1].lower() for w in words[:6])
                 and (org is None or org.lower() in c[1].lower())]
        if not cands:
            continue
        mean = sum(len(c[1].split()) for c in cands) / len(cands)
        scored = []
        for cid, content in cands:
            low, s = content.lower(), 0.0
            n = len(low.split())
            for w in words:
                tf = low.count(w)
                s += tf * 2.5 / (tf + 1.5 * (.25 + .75 * n / max(1.0, mean))) if tf else 0
            s += 3 if len(words) >= 2 and " ".join(words[:2]) in low else 0
            s += 2 if org and org.lower() in low else 0
            s += 2 if period and period.lower() in low else 0
            if s > .5:
                scored.append((-s, cid))
        out[qid] = [(c, round(-s, 3)) for s, c in sorted(scored)[:limit]]
    return out


def test_ranking_against_loop(spark):
    rng = random.Random(11)
    vocab = ["coal", "coalfield", "mine", "mines", "output", "seam", "pit", "dust", "truck", "the"]
    chunks = [(f"c{i:02d}", " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40))).replace("pit", "Pit."))
              for i in range(60)]
    queries = [(1, "the coal mine output", None, None), (2, "coal coal seam of the pit", "dust", "truck"),
               (3, "zzz unknown", None, None)]
    q = spark.createDataFrame(queries, "query_id int, text string, org string, period string")
    c = spark.createDataFrame([(i, t, None, "file", "", False) for i, t in chunks],
                              "chunk_id string, content string, organization string, file_name string, "
                              "section string, is_demo boolean")
    got = {}
    for r in retrieve.rank_chunks(q, c).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    want = {k: v for k, v in score_by_loop(queries, chunks).items() if v}
    assert {k: [s for _, s in v] for k, v in got.items()} == {k: [s for _, s in v] for k, v in want.items()}


def test_retrieval_is_uncut_unless_asked(spark):
    text = "alpha bravo charlie delta echo foxtrot golf"
    q = spark.createDataFrame([(1, text, None, None)], "query_id int, text string, org string, period string")
    data = [("z", "golf course")] + [(f"c{i}", "alpha ground") for i in range(8)]
    c = spark.createDataFrame([(i, t, None, "file", "", False) for i, t in data],
                              "chunk_id string, content string, organization string, file_name string, "
                              "section string, is_demo boolean")

    def ids(df):
        return {r.chunk_id for r in df.collect()}
    assert ids(retrieve.rank_chunks(q, c, limit=20)) == {i for i, _ in data}
    assert ids(retrieve.rank_chunks(q, c, limit=20, first_terms=6)) == {i for i, _ in data} - {"z"}
    every = retrieve.keyword_chunks(q, c)
    assert ids(every) == {i for i, _ in data}
    assert retrieve.keyword_confidence(every).first().hits == 9
    assert ids(retrieve.keyword_chunks(q, c, 6, 4)) == {f"c{i}" for i in range(6)}
    # the golf chunk is the only one of its query, and reached through the seventh word alone
    only = retrieve.rank_chunks(q, c.filter("chunk_id = 'z'"))
    assert retrieve.extractive_answers(only, c).count() == 1


def test_related_against_loop(spark, ledger):
    rng = random.Random(2)
    rows = [dict(fact_id=f"f{i:02d}", metric_code=rng.choice(["COAL_PRODUCTION", "PRODUCTION_TARGET", "DRILLING"]),
                 org=rng.choice("AB"), document_id=rng.choice(["x", "y", "z"]),
                 confidence_score=rng.randint(60, 99) / 100) for i in range(60)]
    comp = {"COAL_PRODUCTION": provenance.COMPLEMENTARY["PROD"], "PRODUCTION_TARGET": provenance.COMPLEMENTARY["PROD"],
            "DRILLING": provenance.COMPLEMENTARY["DRILL"]}
    got = {}
    for r in provenance.related_facts(ledger(*rows), 4).orderBy("fact_id", "place").collect():
        got.setdefault(r.fact_id, []).append(r.related_fact_id)
    for f in rows:
        pool = [r for r in rows if r is not f and (
            (r["org"] == f["org"] and (r["metric_code"] == f["metric_code"] or r["metric_code"] in comp[f["metric_code"]]))
            or r["document_id"] == f["document_id"])]
        want = [r["fact_id"] for r in sorted(pool, key=lambda r: (-r["confidence_score"], r["fact_id"]))[:4]]
        assert got[f["fact_id"]] == want


def test_sessions_and_trailing_counts_against_loop(spark):
    rng = random.Random(9)
    ev = sorted((rng.choice("ab"), rng.randint(0, 400_000), i, rng.choice([None, None, float(i)])) for i in range(400))
    df = spark.createDataFrame(ev, "u string, s long, i int, v double")
    got = {r.i: (r.session_no, r.inherited) for r in runs.carry_session_values(
        df, "u", "s", "v", "i", bucket_seconds=7000).collect()}
    state = {}
    for u, s, i, v in sorted(ev, key=lambda e: (e[0], e[1], e[2])):
        last, no, val = state.get(u, (None, 0, None))
        if last is None or s - last > 1800:
            no, val = no + 1, None
        val = v if v is not None else val
        state[u] = (s, no, val)
        assert got[i] == (no, val), i
    t = df.withColumn("ts", F.timestamp_seconds("s"))
    counts = {r.i: r.attempts for r in runs.trailing_counts(t, "u", "ts", 900).collect()}
    for u, s, i, _ in ev:
        assert counts[i] == sum(1 for e in ev if e[0] == u and s - 900 <= e[1] <= s)


def test_ingest_in_batches_equals_batch(spark, ledger, tmp_path):
    rows, f = random_facts(ledger, 120, 4)
    f = f.withColumn("row_number", F.substring("fact_id", 2, 3).cast("int"))
    f = f.cache()
    src = tmp_path / "in"
    for k in range(3):
        f.filter(F.col("row_number") % 3 == k).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    job = jobs.ingest_stream(spark, stream, str(tmp_path / "out"), UPDATED)
    assert len(job.versions) == 3
    assert {r.fact_id for r in job.ledger().collect()} == {r["fact_id"] for r in rows}
    got = {(r.primary_fact_id, r.conflicting_fact_id) for r in job.conflicts().collect()}
    assert got == expected_conflicts(rows)
    assert job.issues().count() == conflicts.check_rules(f).count()
    before = job.ledger().count()
    job.process(f.filter(F.col("row_number") % 3 == 2), job.versions[-1])
    assert job.ledger().count() == before


class FakeSession:
    """Just the settings of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("C", (), {"master": master})()
        self.conf = type("S", (), {"get": staticmethod(lambda key, default=None: folder or default)})()


def test_shared_folder_follows_the_session(spark):
    assert jobs.shared_folder(FakeSession("yarn", "hdfs://x/y"), "n").startswith("hdfs://x/y/n-")
    assert "ledgerlake-" in jobs.shared_folder(FakeSession("local[2]"), "n")
    with pytest.raises(ValueError):
        jobs.shared_folder(FakeSession("yarn"), "n")


def test_label_exclusions_keeps_null_keys(spark, ledger):
    from ledgerlake.operators import protect
    facts = ledger(dict(site=None, numeric_value=None), dict(site=None, numeric_value=None), dict(site=None, numeric_value=5.0),
                   dict(site="S", numeric_value=5.0), dict(org=None, site=None, numeric_value=5.0))
    for keys in ([], ["site"], ["org", "site"]):
        assert protect.label_exclusions(facts, keys).count() == 5


def test_per_month_and_day_return_every_bucket(spark):
    from pyspark.sql import functions as F

    from ledgerlake.operators import analytics as an
    days = spark.range(800).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert an.per_month(days, "d").count() == 27 and an.per_day(days, "d").count() == 800


def test_sigma_outliers(spark, ledger):
    from ledgerlake.operators import analytics as an
    rows = [dict(site="S", numeric_value=10.0 + i % 3) for i in range(40)] + [dict(fact_id="far", site="S", numeric_value=99.0)]
    assert [r.fact_id for r in an.sigma_outliers(ledger(*rows), ["site", "metric_code"]).collect()] == ["far"]
