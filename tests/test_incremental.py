"""Ingest over restarts, exact sums, scopes by period dictionary, retrieval index."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions import exact
from ledgerlake.operators import calc, conflicts, retrieve, scope
from ledgerlake.operators import index as ix
from ledgerlake.streaming.ingest import IncrementalIngest

UPDATED = ["numeric_value", "unit", "confidence_score", "validation_status"]


def files_below(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_ingest_survives_restarts(spark, ledger, tmp_path):
    def batch(lo, hi, value):
        return ledger(*[dict(fact_id=f"f{i:03d}", document_id=f"d{i % 7}", org=["SECL", "NCL", "ECL", None][i % 4], row_number=i,
                             reporting_period=f"FY 20{10 + i % 9}-{11 + i % 9}", numeric_value=value(i)) for i in range(lo, hi)])
    first, second = batch(0, 97, lambda i: float(i % 5)), batch(97, 200, lambda i: float(i % 11))
    IncrementalIngest(spark, str(tmp_path), UPDATED, 8).process(first, 0)
    IncrementalIngest(spark, str(tmp_path), UPDATED, 8).process(second, 1)
    job = IncrementalIngest(spark, str(tmp_path), UPDATED, 8)
    assert job.versions == [0, 1] and job.ledger().count() == 200
    want = conflicts.contradictions(first.unionByName(second))
    rows = lambda df: sorted((r.conflict_id, r.discrepancy_percent) for r in df.collect())
    assert rows(job.conflicts()) == rows(want) != []
    hit = {r.conflicting_fact_id for r in want.collect()}
    assert {r.fact_id for r in job.ledger().filter("validation_status = 'CONFLICT'").collect()} == hit
    assert job.ingested().filter("validation_status = 'CONFLICT'").count() == 0
    before = files_below(tmp_path)
    job.process(second, 1)  # repeated: nothing is written
    assert files_below(tmp_path) == before

    # one key is corrected: its contradiction goes, its status comes back, other buckets keep their files
    one = batch(100, 101, lambda i: 2.0)
    key = one.first()
    held = {(r.kind, r.bucket): r.path for r in job.manifest().filter("version = 1").collect()}
    IncrementalIngest(spark, str(tmp_path), UPDATED, 8).process(one, 2)
    now = {(r.kind, r.bucket): r.path for r in job.manifest().filter("version = 2").collect()}
    moved = {b for (_, b), p in now.items() if p != held.get((_, b))}
    assert len(moved) == 1 and len({b for _, b in held}) > 1
    assert job.ledger().filter(F.col("fact_id") == key.fact_id).first().numeric_value == 2.0
    assert rows(job.conflicts()) == rows(conflicts.contradictions(job.ingested()))


def test_leftovers_of_a_failed_batch_are_not_read(spark, ledger, tmp_path):
    job = IncrementalIngest(spark, str(tmp_path), UPDATED, 4)
    assert job.version() is None
    job.process(ledger(dict(), dict(row_number=2)), 0)
    ledger(dict(row_number=9)).write.parquet(str(tmp_path / "ledger" / "batch=7" / "bucket=1"))
    assert job.ledger().count() == 2 and job.version() == 0
    job.process(ledger().limit(0), 1)
    assert job.ledger().count() == 2


def test_exact_sums_hold_small_beside_large(spark):
    for values in ([1e15, 1e25, 0.000001], [0.000001, -1e25, 1e25, 1e15], [0.1] * 10):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        r = df.agg(exact.exact_sum(F.col("v")).alias("s"), exact.not_held(F.col("v")).alias("n")).first()
        assert Fraction(r.s) == sum(Fraction(repr(v)) for v in values) and r.n == 0
    odd = spark.createDataFrame([(1e30,), (float("nan"),), (float("inf"),), (None,), (2.0,)], "v double")
    r = odd.agg(exact.exact_sum(F.col("v")).alias("s"), exact.not_held(F.col("v")).alias("n")).first()
    assert float(r.s) == 2.0 and r.n == 3
    q = spark.createDataFrame([(1.0, 3.0), (1e20, 4e20), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [x[0] for x in q.select(exact.quotient(F.col("a"), F.col("b"), 2, 100)).collect()] == [33.33, 25.0, None, None]


def test_large_values_do_not_stop_a_calculation(spark, ledger):
    m = dims.metrics_frame(spark)
    f = ledger(dict(numeric_value=1e15), dict(numeric_value=0.25, reporting_period="FY 2023-24"), dict(numeric_value=1e24, reporting_period="FY 2022-23"))
    r = calc.calculate(f, m, "SUM", ["metric_code"]).first()
    assert r.success and r.result == 1e24 + 1e15
    bad = f.unionByName(ledger(dict(fact_id="x", numeric_value=1e40, reporting_period="FY 2021-22")))
    r = calc.calculate(bad, m, "SUM", ["metric_code"]).first()
    assert not r.success and r.error_code == "VALUE_OUT_OF_RANGE" and r.result is None
    assert calc.calculate(bad, m, "MAX", ["metric_code"]).first().result == 1e40


def test_scopes_equal_a_pairwise_comparison(spark, ledger):
    texts = ["FY 2024-25", "Q2 FY 2024-25", "Apr 2024", "2023-24 and 2024-25", "x", "", None, "FY", "apr", "FY FY 2024-25"]
    f = ledger(*[dict(metric_code=m, reporting_period=t) for m in ("A", "B") for t in texts])
    periods = ["FY 2024-25", "2023-24", None, "Apr 2024", "pr", "q2", "FY ", "x", "FY FY 2024-25", "Q2 FY 2024-25", "nothing"]
    s = spark.createDataFrame([(f"{m}{i}", m, p) for m in ("A", "B") for i, p in enumerate(periods)], "scope_id string, metric_code string, period string")

    def fits(text, p):
        if p is None:
            return True
        return text is not None and (p.replace("FY ", "").strip().lower() in text.lower() or text == p)

    got = sorted((r.fact_id, r.scope_id) for r in scope.apply_scopes(f, s).collect())
    rows = f.collect()
    assert got == sorted((r.fact_id, f"{m}{i}") for r in rows for m in ("A", "B") for i, p in enumerate(periods)
                         if m == r.metric_code and fits(r.reporting_period, p))


def test_index_filters_and_rounds(spark):
    rng = random.Random(3)
    words = ["coal", "seam", "output", "drill", "stock", "rail", "mine", "port"]
    rows = [(f"c{i:03d}", f"d{i % 5}", " ".join(rng.choices(words, k=rng.randint(1, 30))), "Org SECL" if i % 3 else None,
             f"f{i}.pdf", rng.choice(["seam", None, "intro"]), i % 7 == 0) for i in range(150)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, content string, organization string, file_name string, section string, is_demo boolean")
    asked = [(1, "coal seam", None, None, None, None), (2, "drill rail stock output", "secl", "mine port", None, None), (3, "coal", None, None, ["d1", "d2"], None),
             (4, "seam mine", "seam mine", None, None, True), (5, "zzz", None, None, None, None), (6, "port coal coal", None, "rail", [], None)]
    queries = spark.createDataFrame(asked, "query_id long, text string, org string, period string, document_ids array<string>, include_demo boolean")
    index = ix.build_index(chunks, block=16)
    assert index.chunks.select("block").distinct().count() > 3

    def brute(q, limit):
        qid, text, org, period, docs, demo = q
        terms = text.split()
        cand = []
        for cid, doc, body, o, name, section, is_demo in rows:
            if (is_demo and not demo) or (docs is not None and doc not in docs) or not any(t in body for t in terms):
                continue
            if org and org not in (o or "").lower() and org not in name and org not in body:
                continue
            cand.append((cid, body, section))
        mean = sum(len(b.split()) for _, b, _ in cand) / max(1, len(cand))
        out = []
        for cid, body, section in cand:
            s = 0.0
            for t in terms:
                tf = body.count(t)
                if tf:
                    s += tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(body.split()) / max(1.0, mean)))
            s += 3 if len(terms) > 1 and f"{terms[0]} {terms[1]}" in body else 0
            s += (2 if org and org in body else 0) + (2 if period and period in body else 0)
            s += 1.5 if section and any(t in section for t in terms) else 0
            if s > 0.5:
                out.append((-round(s, 9), cid))
        return [(qid, c, k + 1) for k, (_, c) in enumerate(sorted(out)[:limit])], {(qid, c) for c, _, _ in cand}

    for limit in (3, 6):
        got = sorted((r.query_id, r.place, r.chunk_id) for r in retrieve.rank_chunks(queries, chunks, limit, index=index).collect())
        assert got == sorted((q, p, c) for a in asked for q, c, p in brute(a, limit)[0])
    spread_out = ix.best_chunks(index, queries, 6, most=2)  # several rounds
    assert {r.query_id for r in spread_out.collect()} == {1, 2, 3, 4}
    plain = [(a[0], a[1], None, None, None, None) for a in asked]
    pairs = retrieve.keyword_chunks(queries, chunks, index=index)
    assert {(r.query_id, r.chunk_id) for r in pairs.collect()} == {x for a in plain for x in brute(a, 1)[1]}
    counts = {r.query_id: r.hits for r in retrieve.keyword_counts(queries, chunks, index).collect()}
    assert counts == {a[0]: len(brute(a, 1)[1]) for a in plain if brute(a, 1)[1]}
