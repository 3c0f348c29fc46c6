"""Cases that only show on larger tables: many blocks or files in one task, one batch of many facts."""

from pyspark.sql import functions as F

from ledgerlake.functions import period
from ledgerlake.operators import index as ix
from ledgerlake.operators import conflicts, history, merge, protect, provenance, retrieve, search
from ledgerlake.plans import insight, streams
from ledgerlake.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def test_block_without_a_possible_member_of_the_result(spark):
    """The first block of a task has the best chunk; in the later ones no chunk comes near."""
    rows = [(f"c{i}", "d", "coal output", None, "f", "en", False) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, content string, organization string, file_name string, section string, is_demo boolean")
    first = chunks.orderBy(F.pmod(F.xxhash64("chunk_id"), F.lit(8)), "chunk_id").first()["chunk_id"]
    chunks = chunks.withColumn("content", F.when(F.col("chunk_id") == first, "coal coal coal coal 2024 output").otherwise("other coal")).withColumn(
        "section", F.when(F.col("chunk_id") == first, "coal").otherwise("en"))
    queries = spark.createDataFrame([(1, "coal output", None, "2024")], "query_id long, text string, org string, period string")
    index = ix.build_index(chunks, block=5)
    got = retrieve.rank_chunks(queries, chunks, limit=1, index=index).collect()
    assert [(r["chunk_id"], r["place"]) for r in got] == [(first, 1)]


def test_postings_of_a_block(spark):
    rows = [("a", "Coal  coal\x0bore\n"), ("b", ""), ("c", None), ("d", "ore x ore")]
    chunks = spark.createDataFrame([(c, t, None, "f", "s", False) for c, t in rows],
                                   "chunk_id string, content string, organization string, file_name string, section string, is_demo boolean")
    index = ix.build_index(chunks)
    got = {r["token"]: (r["slots"], r["counts"], r["most"]) for r in index.postings.collect()}
    assert got == {"coal": ([0], [2], 2), "ore": ([0, 3], [1, 1], 1), "ore x": ([3], [1], 1)}
    assert sorted(r[0] for r in index.vocabulary.collect()) == ["coal", "ore", "ore x"]


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    """A table may be a folder; it may also be one file beside those of other tables."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    rows.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = streams.stream_distinct_documents(spark, str(tmp_path))
    want = rows.select(F.sha2("text", 256)).distinct()
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())
    one = tmp_path / "one" / "documents.parquet"
    one.parent.mkdir()
    rows.toPandas().to_parquet(one)
    rows.write.parquet(str(tmp_path / "one" / "pages.parquet"))
    assert streams.stream_distinct_documents(spark, str(one.parent)).count() == 7


def test_upsert_in_one_shuffle(spark, ledger):
    """As the join does it: NULL keys meet, columns that are not updated stay, the last new row counts."""
    updated = ["numeric_value", "validation_status"]
    old = ledger(dict(fact_id="a", numeric_value=1.0, unit="t"), dict(fact_id="b", org=None, unit=None), dict(fact_id="c", row_number=3))
    new = ledger(dict(fact_id="d", numeric_value=2.0, unit="kg"), dict(fact_id="e", numeric_value=3.0), dict(fact_id="f", org=None, unit="kg"),
                 dict(fact_id="g", row_number=9, unit=None), dict(fact_id="h", row_number=9, numeric_value=None, unit="x"))
    got = sorted(map(str, merge.upsert_unique(old, new, updated).collect()))
    assert got == sorted(map(str, merge.upsert_facts(old, new, updated).collect())) and len(got) == 4
    plan = merge.upsert_unique(old, new, updated)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stored_witnesses(spark, ledger, tmp_path):
    """Contradictions by witnesses that are stored step by step equal those in one plan."""
    facts = ledger(*[dict(document_id=f"d{i % 3}", numeric_value=float(v), site=f"s{i}")
                     for i, v in enumerate([10, 10, 20, 30, 10, 20, 40, 10])],
                   dict(org=None, numeric_value=5.0), dict(numeric_value=None), dict(metric_code="UNMAPPED"))

    def store(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    marked = conflicts.with_partner(facts, conflicts.witnesses(facts, store=store))
    assert marked.count() == 11
    got = conflicts.partner_conflicts(marked.filter("partner IS NOT NULL"))
    want = conflicts.contradictions(facts)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_page_of_conflicts_works_them_out_once(spark, ledger):
    facts = ledger(*[dict(document_id=f"d{i}", numeric_value=10.0 * (i + 1)) for i in range(6)])
    found = conflicts.contradictions(facts)
    page = search.list_conflicts(found, org="SECL", page=2, size=2)
    want = [r["conflict_id"] for r in found.orderBy(F.col("created_at").desc(), "conflict_id").collect()]
    assert [(r["conflict_id"], r["total"]) for r in page.collect()] == [(c, 5) for c in want[2:4]]
    assert all("listed-" in f for f in page.inputFiles()) and page.inputFiles()


def test_tags_of_questions_are_worked_out_once(spark):
    """A filter on a tag reads the stored tags; the rules would else run once per filter and branch."""
    tagged = insight._tagged(spark, SMALL).filter("route = 'LOOKUP' AND metric_code IS NOT NULL")
    assert any("tags-" in f for f in tagged.inputFiles())
    assert "regex" not in tagged._jdf.queryExecution().optimizedPlan().toString().lower()


def test_period_rules_run_once_per_text(spark, ledger):
    """Keys come from a stored dictionary of the distinct texts; NULL has keys too, a given grain wins."""
    texts = ["FY 2024-25", "Q2 FY 2024-25", "Apr 2024", "", None, "2024–25", "x"]
    facts = ledger(*[dict(reporting_period=t, temporal_grain=g) for t in texts for g in (None, "", "monthly")])
    keyed = protect.with_period_keys(facts)
    assert any("periods-" in f for f in keyed.inputFiles())
    p = F.col("reporting_period")
    grain = F.when(F.coalesce("temporal_grain", F.lit("")) != "", F.upper("temporal_grain")).otherwise(period.infer_grain(p))
    want = facts.withColumns({"k_period": period.period_key(p), "k_fy": period.fy_key(p), "k_grain": grain})
    assert keyed.columns == want.columns
    assert sorted(map(str, keyed.collect())) == sorted(map(str, want.collect()))
    assert protect.with_period_keys(keyed) is keyed


def test_topics_read_a_chunk_once(spark):
    """Occurrences as replacing a keyword counts them, without one pass over the text per keyword."""
    texts = ["Power plants power plantsaaaa", "aaa aa", "", None, "coal COALücoal€", "none"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    topics = {"A": ["power plants", "plants", "aa"], "B": ["coal", "aa", "oal€"], "C": ["zzz"]}
    got = retrieve.topic_mentions(chunks, topics)
    count = {(i, t): sum((x or "").lower().count(w) for w in ws) for i, x in enumerate(texts) for t, ws in topics.items()}
    assert {(r.chunk_id, r.topic): r.n for r in got.collect()} == {k: n for k, n in count.items() if n}
    assert "replace" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_dossiers_meet_the_status_once(spark, ledger):
    facts = ledger(*[dict(document_id=f"d{i}", numeric_value=10.0 * (i + 1)) for i in range(4)], dict(document_id=None))
    documents = spark.createDataFrame([("d1", "one.pdf", "PDF")], "document_id string, document_name string, file_type string")
    status = conflicts.conflict_status(facts, conflicts.contradictions(facts))
    got = provenance.dossiers(status, documents)
    assert sorted(map(str, got.collect())) == sorted(map(str, provenance.dossiers(facts, documents, status).collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2  # documents and conflicts


def test_batch_of_new_periods_meets_no_old_rows(spark, ledger, tmp_path):
    """Only buckets with rows of the batch's periods are written again; a fact without a time arrived first."""
    job = ingest.IncrementalIngest(spark, str(tmp_path), ["numeric_value", "validation_status"])

    def batch(period, *values):
        return ledger(*[dict(reporting_period=period, document_id=f"d{v}", numeric_value=float(v), fact_id=f"{period}-{v}", org=o)
                        for v in values for o in ("SECL", "NCL")])
    old = batch("FY 2023-24", 10, 20)
    job.process(old, 0)
    held = {(r.kind, r.bucket): r.path for r in job.manifest().collect()}
    new = batch("FY 2024-25", 30, 40).withColumn("created_at", F.when(F.col("document_id") != "d40", F.col("created_at")))
    job.process(new, 1)
    now = {(r.kind, r.bucket): r.path for r in job.manifest().filter("version = 1").collect()}
    assert {k: now[k] for k in held} == held and {k for k, _ in now} == {"ledger", "witnesses"}
    assert sorted(map(str, job.conflicts().collect())) == sorted(map(str, conflicts.contradictions(old.unionByName(new)).collect())) != []
    assert job.issues().count() == conflicts.check_rules(old.unionByName(new)).count()


def test_contradictions_shuffle_no_facts(spark, ledger):
    """Facts lie in files when they meet the witnesses; ties in time and facts without a time count as before."""
    facts = ledger(*[dict(document_id=f"d{i % 4}", numeric_value=float(v), org=o) for o in ("SECL", "NCL") for i, v in enumerate([10, 10, 20, 30, 10, 20, 40, 10])])
    at = F.date_trunc("hour", "created_at")
    for when in (F.col("created_at"), at, F.when(F.col("numeric_value") != 20, at)):
        f = facts.withColumn("created_at", when)
        got = conflicts.contradictions(f)
        assert all("compared" in p or "/all/" in p for p in got.inputFiles())
        want = conflicts.with_partner(f, conflicts.witnesses(f)).filter("partner IS NOT NULL")
        assert sorted(map(str, got.collect())) == sorted(map(str, conflicts.partner_conflicts(want).collect())) != []
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


KEYWORD_TEXTS = ["Grün Kohle/abc coalfield", "kohle\u00a0grün", "COAL fiel\td", None, "", "x" * 90 + "coal", "demo coal", "coal" * 9]


def keyword_case(spark):
    chunks = spark.createDataFrame([(i, t, None, "f", "s", {6: True, 7: None}.get(i, False)) for i, t in enumerate(KEYWORD_TEXTS)],
                                   "chunk_id long, content string, organization string, file_name string, section string, is_demo boolean")
    asked = {"a": "coal field", "b": "Grün Kohle", "c": "abc", "d": "unknown words coal", "e": None, "f": "fiel coalfield"}
    terms = {"a": ["coal", "field"], "b": ["grün", "kohle"], "d": ["unknown", "words", "coal"], "f": ["fiel", "coalfield"]}
    want = {(q, i) for q, ts in terms.items() for i, x in enumerate(KEYWORD_TEXTS[:6]) for t in ts if t in (x or "").lower()}
    return spark.createDataFrame(list(asked.items()), "query_id string, text string"), chunks, want


def test_keywords_read_the_chunks_once(spark, monkeypatch):
    """No index is written for queries that are asked once; several rounds and forgotten tokens change nothing."""
    queries, chunks, want = keyword_case(spark)
    monkeypatch.setattr(ix, "build_index", None)
    got = retrieve.keyword_chunks(queries, chunks)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 8
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ix, "KNOWN", 1)
    assert sorted(map(tuple, ix.texts_asked(queries, chunks, None, 4, most=2)[0].collect())) == sorted(want)
    assert retrieve.keyword_chunks(queries.limit(0), chunks).collect() == []


def test_chunks_of_documents_are_not_joined(spark):
    """Pages keep the columns of their document; the text is shuffled by the spreading of the scan alone."""
    plan = insight.chunks(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_keyword_hits_are_counted_in_one_pass(spark, monkeypatch):
    queries, chunks, want = keyword_case(spark)
    monkeypatch.setattr(ix, "build_index", None)
    got = retrieve.keyword_counts(queries, chunks)
    assert {r.query_id: r.hits for r in got.collect()} == {q: sum(x == q for x, _ in want) for q, _ in want}
    assert retrieve.keyword_confidence(retrieve.keyword_counts(queries.limit(0), chunks)).collect() == []


def test_hits_of_a_block_are_one_row(spark):
    """What a round finds in a block is packed, tokens that hold one term added up; a block without hits has no row."""
    rows = [("a", "coal coals Coalx"), ("b", "ore"), ("c", "scoal ore"), ("d", None), ("e", "other")]
    chunks = spark.createDataFrame([(c, t, None, "f", "s", False) for c, t in rows],
                                   "chunk_id string, content string, organization string, file_name string, section string, is_demo boolean")
    hits = ix.term_postings(ix.build_index(chunks), {"coal": 7, "ore": 2, "zinc": 1}).collect()
    assert [sorted(zip(h["terms"], h["slots"], h["tfs"], strict=True)) for h in hits] == [[(2, 1, 1), (2, 2, 1), (7, 0, 3), (7, 2, 1)]]


def test_answers_read_the_texts_of_ranked_chunks_only(spark):
    """Sentences are sought in the chunks of a stored ranking, not in every chunk before they meet."""
    chunks = spark.createDataFrame([(f"c{i}", f"Sentence number {i} is here. Then comes more text. End.") for i in range(9)], "chunk_id string, content string")
    ranked = spark.createDataFrame([(1, f"c{i}", i) for i in (1, 2, 3, 4, 5)], "query_id long, chunk_id string, place int")
    answers = retrieve.extractive_answers(ranked, chunks)
    assert any("ranked-" in f for f in answers.inputFiles())
    assert answers.collect()[0]["answer"] == "\n\n".join(f"Sentence number {i} is here. Then comes more text." for i in (1, 2, 3, 4))


PROTECTED = [dict(site=s, org=o, reporting_period=p, numeric_value=v, validation_status=st, document_id=d)
             for s, d in ((None, "d1"), ("s1", "d2")) for o in ("SECL", "CIL", None) for p in ("FY 2024-25", "Q2 FY 2024-25", "Apr 2024", None)
             for v, st in ((1.0, "VERIFIED"), (1.0, "REVIEW_REQUIRED"), (None, "VERIFIED"))]


def test_included_and_group_totals_as_labelled(spark, ledger):
    """Facts without a reason, and those dropped as group totals, without joining facts with their winners."""
    facts = ledger(*PROTECTED, dict(metric_code="DRILLING", org="CIL"), dict(metric_code="DRILLING", org="CIL", numeric_value=2.0))
    for keys in ([], ["metric_code"], ["site"]):
        for group in (True, False):
            lab = protect.label_exclusions(facts, scope_keys=keys, exclude_group=group, group_codes=["CIL"])
            got, want = protect.included(facts, scope_keys=keys, exclude_group=group, group_codes=["CIL"]), lab.filter("exclusion_reason IS NULL")
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
        lab = protect.label_exclusions(facts, scope_keys=keys, group_codes=["CIL"]).filter(F.col("exclusion_reason") == protect.GROUP)
        got = protect.group_overlaps(facts, keys, ["CIL"])
        assert sorted(r["fact_id"] for r in got.collect()) == sorted(r["fact_id"] for r in lab.collect()) != []


def test_group_totals_shuffle_group_rows_only(spark):
    from ledgerlake.plans import calculation

    plan = calculation.group_overlap(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_" not in plan and "REBALANCE" not in plan
    assert plan.count("k_value") and "kept_fact_id" not in plan


def test_where_used_shares_the_winners(spark):
    """The shuffle of the winners is one, read for the facts and for their annual keys."""
    plan = insight.where_used(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" not in plan and "isnotnull(sha2" not in plan and "isnotnull(coalesce(sha2" not in plan


def test_sides_and_status_come_without_a_look_up(spark, ledger):
    """Conflicts bear what is asked of both sides; the status of a fact is known where it meets the witnesses."""
    facts = ledger(*[dict(document_id=f"d{i % 3}", numeric_value=float(v), unit=f"u{i}") for i, v in enumerate([10, 10, 20, 30, 10, 20, 40, 10])],
                   dict(org=None, numeric_value=5.0), dict(numeric_value=None), dict(metric_code="UNMAPPED"), dict(org="NCL"))
    plain, own = conflicts.contradictions(facts), conflicts.contradictions(facts, sides=["numeric_value", "unit"])
    columns = [*plain.columns, "primary_value", "primary_unit", "other_value", "other_unit"]
    got, want = (search.conflict_sides(c, facts).select(columns) for c in (own, plain))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    status = conflicts.facts_with_status(facts)
    assert sorted(map(str, status.collect())) == sorted(map(str, conflicts.conflict_status(facts, plain).collect()))
    assert "Exchange" not in status._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_related_facts_carry_no_lists(spark, ledger):
    """Lists are stored by organisation, metric and document; facts without one of them have theirs too."""
    facts = ledger(*[dict(org=o, document_id=d, metric_code=m, confidence_score=c) for o in ("SECL", None) for d in ("d1", "d2", None)
                     for m in ("COAL_PRODUCTION", "PRODUCTION_TARGET") for c in (0.9, 0.8, 0.8)])
    got = provenance.related_facts(facts, 3)
    assert any("related-" in f for f in got.inputFiles())
    rows = facts.collect()
    comp = {"COAL_PRODUCTION": provenance.COMPLEMENTARY["PROD"], "PRODUCTION_TARGET": provenance.COMPLEMENTARY["PROD"]}
    want = set()
    for f in rows:
        near = [r for r in rows if r.fact_id != f.fact_id and ((r.document_id == f.document_id and f.document_id is not None) or (
            f.org is not None and r.org == f.org and r.metric_code in (f.metric_code, *comp[f.metric_code])))]
        near.sort(key=lambda r: (-r.confidence_score, r.fact_id))
        want |= {(f.fact_id, i + 1, r.fact_id) for i, r in enumerate(near[:3])}
    assert {(r.fact_id, r.place, r.related_fact_id) for r in got.collect()} == want


def test_full_dossiers_meet_no_fact_again(spark, ledger):
    """The raw part is carried along; decided actions are the decision rows of the history."""
    from ledgerlake.plans import ledger_writes

    facts = ledger(dict(fact_id="a"), dict(fact_id="b", unit=None))
    docs = spark.createDataFrame([("doc-real-001", "x.xlsx", "XLSX")], "document_id string, document_name string, file_type string")
    status = conflicts.facts_with_status(facts)
    base, more = provenance.dossiers(status, docs), provenance.dossiers(status, docs, more=[history.raw_part(facts)])
    full = [history.full_dossiers(d, facts, spark.createDataFrame([], "fact_id string, decision_id string, action string, valid_from timestamp, reviewer string"),
                                  spark.createDataFrame([], "fact_id string, run_id string, run_at timestamp"),
                                  spark.createDataFrame([], "fact_id string, claim_id string, report_id string")) for d in (base, more)]
    assert sorted(map(str, full[0].collect())) == sorted(map(str, full[1].collect()))
    d = ledger_writes.decisions(spark, SMALL)
    cols = ["fact_id", "decision_id", "action", "valid_from", "reviewer"]
    want = history.fact_history(ledger_writes.review_ledger(spark, SMALL), d).filter("decision_id IS NOT NULL").select(cols)
    assert sorted(map(str, history.decided_actions(d).select(cols).collect())) == sorted(map(str, want.collect())) != []
