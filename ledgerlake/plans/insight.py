"""Queries: retrieval, topics, entity graph, claims, lineage, provenance, reports, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions import scoring, vocab
from ledgerlake.operators import analytics as an
from ledgerlake.operators import calc, claims, graph, lineage, protect, provenance, report, retrieve, search
from ledgerlake.operators import cells as ce
from ledgerlake.operators import conflicts as cf
from ledgerlake.operators import history, ranking
from ledgerlake.operators import index as ix
from ledgerlake.operators import runs as seq
from ledgerlake.plans.calculation import GROUPS, ORG_YEAR, ORG_YEAR_COLS, REAL, YEARLY, real, yearly
from ledgerlake.plans.dashboards import D, P, T, pct, r
from ledgerlake.plans.extraction import PAGES
from ledgerlake.plans.ledger_writes import (CONFLICTS, DECISIONS, ISSUE_STATE, ISSUES, decisions, issue_state)
from ledgerlake.plans.normalise import LOCATION, QUESTIONS, TERMS, intent_sql
from ledgerlake.plans.registry import query
from ledgerlake.plans.sqlparts import FACTS, protection, sum_result, values

from ledgerlake.sources import adapters as ad
from ledgerlake.sources.folders import shared_folder

ROOT = "GROUP"

# --- retrieval ---


def chunks(spark, sf):
    d = ad.documents(spark, sf).filter("doc_id IS NOT NULL")
    pages = ce.paginate(d, "doc_id", extra=("organization", "file_name", "is_demo", "lang"))
    return pages.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("page_number").cast("string"))
        .alias("chunk_id"), F.col("doc_id").alias("document_id"), "content", "organization",
        "file_name", F.col("lang").alias("section"), "is_demo")


def bench_queries(spark, sf):
    b = ad.read_table(spark, sf, "benchmark")
    k = F.col("item_id")
    return b.select(
        k.alias("query_id"), "text", F.when(k % 2 == 1, "en").alias("org"),
        F.when(k % 3 == 0, "tion").alias("period"))


CHUNKS = f"""{PAGES}, chunks AS (SELECT p.doc_id || ':' || page_number AS chunk_id, p.doc_id AS document_id, content,
  lower(content) AS body, CASE WHEN p.doc_id % 9 = 0 THEN NULL ELSE 'Org ' || lang END AS organization,
  list_element(['prod_', 'drill_log_', 'dispatch_', 'geol_', 'reserve_', 'misc_'], CAST(p.doc_id % 6 + 1 AS INTEGER))
    || source AS file_name, lang AS section FROM pages3 p JOIN documents d USING (doc_id) WHERE p.doc_id % 10 <> 3)"""
TERM_ROWS = f"""terms AS (SELECT item_id AS query_id, {TERMS.replace("(x)", "(text)")} AS words,
  CASE WHEN item_id % 2 = 1 THEN 'en' END AS org, CASE WHEN item_id % 3 = 0 THEN 'tion' END AS period FROM benchmark),
tr AS (SELECT query_id, i AS pos, words[i] AS term FROM terms, unnest(range(1, len(words) + 1)) u(i))"""
RANKED = f"""{CHUNKS}, {TERM_ROWS},
dt AS (SELECT DISTINCT term FROM tr),
hit AS (SELECT chunk_id, term, (length(body) - length(replace(body, term, ''))) // length(term) AS tf
  FROM chunks JOIN dt ON contains(body, term)),
per AS (SELECT query_id, chunk_id, list({{'pos': pos, 'tf': tf}}) AS tfs FROM tr JOIN hit USING (term)
  GROUP BY 1, 2),
cand AS (SELECT per.*, t.words, t.org, t.period, c.body, c.section,
  len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS len
  FROM per JOIN terms t USING (query_id) JOIN chunks c USING (chunk_id)
  WHERE org IS NULL OR contains(lower(coalesce(organization, '')), org) OR contains(file_name, org) OR contains(body, org)),
m AS (SELECT *, avg(len) OVER (PARTITION BY query_id) AS mean_len FROM cand),
s AS (SELECT query_id, chunk_id, list_sum(list_transform(tfs, lambda x: x.tf * 2.5::DOUBLE /
    (x.tf + 1.5 * (0.25 + 0.75 * len / greatest(1.0, mean_len)))))
  + CASE WHEN len(words) >= 2 AND contains(body, words[1] || ' ' || words[2]) THEN 3 ELSE 0 END
  + CASE WHEN contains(body, org) THEN 2 ELSE 0 END + CASE WHEN contains(body, period) THEN 2 ELSE 0 END
  + CASE WHEN len(list_filter(words, lambda w: contains(section, w))) > 0 THEN 1.5 ELSE 0 END AS score FROM m),
ranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place,
  round(score, 3) AS score FROM s WHERE score > 0.5)"""


@query("rank_chunks", f"WITH {RANKED} SELECT query_id, chunk_id, place, score FROM ranked WHERE place <= 6")
def rank_chunks(spark, sf):
    out = retrieve.rank_chunks(bench_queries(spark, sf), chunks(spark, sf))
    return out.withColumn("place", F.col("place").cast("bigint"))


KEYWORD = f"""{CHUNKS}, {TERM_ROWS},
k4 AS (SELECT DISTINCT query_id, term FROM tr WHERE length(term) >= 4),
b AS (SELECT term, chunk_id FROM chunks JOIN (SELECT DISTINCT term FROM k4) t ON contains(body, term)),
matched AS (SELECT DISTINCT query_id, chunk_id FROM k4 JOIN b USING (term))"""


@query("keyword_chunks", f"WITH {KEYWORD} SELECT query_id, chunk_id FROM matched")
def keyword_chunks(spark, sf):
    return retrieve.keyword_chunks(bench_queries(spark, sf), chunks(spark, sf))


@query("keyword_confidence", f"""WITH {KEYWORD} SELECT query_id, count(*) AS hits,
  least(0.85, 0.5 + 0.05 * count(*))::DOUBLE AS confidence FROM matched GROUP BY 1""")
def keyword_confidence(spark, sf):
    return retrieve.keyword_confidence(retrieve.keyword_counts(bench_queries(spark, sf), chunks(spark, sf)))


@query("extractive_answers", f"""WITH {RANKED}, e AS (SELECT query_id, place, list_filter(list_transform(string_split(
  regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 10) AS l
  FROM ranked JOIN chunks USING (chunk_id) WHERE place <= 4)
SELECT query_id, string_agg(array_to_string(list_slice(l, 1, 2), ' '), chr(10) || chr(10) ORDER BY place) AS answer FROM e
WHERE len(l) > 0 GROUP BY 1""")
def extractive_answers(spark, sf):
    index = ix.build_index(chunks(spark, sf))
    ranked = retrieve.rank_chunks(bench_queries(spark, sf), index.chunks, index=index)
    return retrieve.extractive_answers(ranked, index.chunks)


# topics: test text is invented, so the vocabulary is made of its word parts
TOPICS = {"Endings": ["tion", "ment", "ing"], "Articles": ["the", "der", "les", "una"],
          "Links": ["and", "und", "est", "con"]}
TOPIC_ROWS = values([(t, w, i) for t, ws in TOPICS.items() for i, w in enumerate(ws)], "topic, keyword, position")
MENTIONS = f"""{CHUNKS}, tk AS {TOPIC_ROWS}, mentions AS (SELECT chunk_id, topic,
  sum((length(body) - length(replace(body, keyword, ''))) // length(keyword))::BIGINT AS n
  FROM chunks JOIN tk ON contains(body, keyword) GROUP BY 1, 2),
counts AS (SELECT topic, sum(n)::BIGINT AS mentions, count(*) AS chunks FROM mentions GROUP BY 1)"""


def mentions(spark, sf):
    return retrieve.topic_mentions(chunks(spark, sf).filter("NOT is_demo"), TOPICS)


@query("topic_mentions", f"WITH {MENTIONS} SELECT chunk_id, topic, n FROM mentions")
def topic_mentions(spark, sf):
    return mentions(spark, sf)


@query("topic_counts", f"WITH {MENTIONS} SELECT topic, mentions, chunks FROM counts")
def topic_counts(spark, sf):
    return retrieve.topic_counts(mentions(spark, sf))


@query("topic_list", f"""WITH {MENTIONS} SELECT topic, any_value(mentions) AS mentions, any_value(chunks) AS chunks,
  array_to_string(list_slice(list(keyword ORDER BY position), 1, 5), ',') AS keywords,
  CASE WHEN any_value(mentions) > 300 THEN 'GROWING' ELSE 'STABLE' END AS trend FROM tk JOIN counts USING (topic) GROUP BY 1""")
def topic_list(spark, sf):
    return retrieve.topic_list(retrieve.topic_counts(mentions(spark, sf)),
                               dims.topics_frame(spark, TOPICS))


@query("word_cloud", f"""WITH {MENTIONS} SELECT topic, keyword, greatest(10, mentions // (count(*) OVER (PARTITION BY topic)))
  AS value FROM tk JOIN counts USING (topic) ORDER BY 3 DESC, 1, 2 LIMIT 40""")
def word_cloud(spark, sf):
    return retrieve.word_cloud(retrieve.topic_counts(mentions(spark, sf)),
                               dims.topics_frame(spark, TOPICS))


@query("topic_detail", f"""WITH {MENTIONS}, d AS (SELECT topic, chunk_id, place, document_id, content, file_name FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, chunk_id) AS place FROM mentions)
JOIN chunks USING (chunk_id) WHERE place <= 25),
a AS (SELECT topic, chunk_id, min(strpos(lower(content), keyword)) AS pos FROM d JOIN tk USING (topic)
  WHERE contains(lower(content), keyword) GROUP BY 1, 2)
SELECT topic, chunk_id, place, document_id, file_name, substr(content, greatest(pos - 80, 1), 160) AS snippet FROM d JOIN a USING (topic, chunk_id)""")
def topic_detail(spark, sf):
    c = chunks(spark, sf)
    return retrieve.topic_detail(mentions(spark, sf), c, dims.topics_frame(spark, TOPICS), files_of(c)).select(
        "topic", "chunk_id", F.col("place").cast("bigint").alias("place"), "document_id", "file_name", "snippet")


def files_of(c):
    return c.select("document_id", F.regexp_replace("file_name", r"_\d+\.\w+$", "").alias("file_name")).distinct()


@query("topic_documents", f"""WITH {MENTIONS} SELECT topic, document_id, any_value(file_name) AS file_name, sum(n)::BIGINT AS n
FROM mentions JOIN chunks USING (chunk_id) GROUP BY 1, 2""")
def topic_documents(spark, sf):
    c = chunks(spark, sf)
    return retrieve.topic_documents(mentions(spark, sf), c, files_of(c))


@query("topic_list_filtered", f"""WITH {MENTIONS} SELECT topic, any_value(mentions) AS mentions FROM tk JOIN counts USING (topic)
WHERE topic IN ('Endings', 'Links') AND topic ILIKE '%in%' GROUP BY 1""")
def topic_list_filtered(spark, sf):
    t = dims.topics_frame(spark, TOPICS).withColumn("category", F.when(F.col("topic") == "Articles", "words").otherwise("parts"))
    return retrieve.topic_list(retrieve.topic_counts(mentions(spark, sf)), t, category="parts", search=" in ").select("topic", "mentions")


MINING = values([(t, w) for t, ws in dims.TOPICS.items() for w in ws], "topic, keyword")


@query("topic_mentions_mining", f"""WITH {CHUNKS}, tk AS {MINING}, m AS (SELECT chunk_id, topic,
  sum((length(body) - length(replace(body, keyword, ''))) // length(keyword))::BIGINT AS n FROM chunks JOIN tk ON contains(body, keyword) GROUP BY 1, 2)
SELECT topic, sum(n)::BIGINT AS mentions, count(*) AS chunks FROM m GROUP BY 1""")
def topic_mentions_mining(spark, sf):
    """The default vocabulary over the same chunks."""
    return retrieve.topic_counts(retrieve.topic_mentions(chunks(spark, sf).filter("NOT is_demo"), dims.TOPICS))


NAMES = values([(c, n) for c, n, _ in dims.METRICS], "code, metric_name")


@query("suggested_questions", f"""WITH {FACTS}, t AS (SELECT org, metric_code AS m, reporting_period AS p, count(*) AS n FROM facts
WHERE NOT is_demo GROUP BY 1, 2, 3 ORDER BY n DESC, org, metric_code, reporting_period LIMIT 10)
SELECT n, org || ': ' || lower(coalesce(metric_name, m)) || ' in ' || p || '?' AS question FROM t LEFT JOIN {NAMES} ON code = m""")
def suggested_questions(spark, sf):
    return retrieve.suggested_questions(ad.facts(spark, sf))


# --- graph ---

BASE = """base AS (SELECT org, coalesce(field, org || ' Operations') AS field, site, metric_code, count(*) AS n,
  avg(numeric_value) AS mean_value FROM facts WHERE org IS NOT NULL GROUP BY 1, 2, 3, 4),
shown AS (SELECT org, field, site, sum(n) AS n FROM base GROUP BY 1, 2, 3 ORDER BY n DESC, org, field, site)"""
SITE_ID = "replace('MINE_' || org || '_' || site, ' ', '_')"
FIELD_ID = "replace('CF_' || org || '_' || field, ' ', '_')"
NODES = f"""nodes AS (SELECT '{ROOT}' AS node_id, '{ROOT}' AS label, 'GROUP' AS type, 0 AS level, 40.0::DOUBLE AS size
UNION ALL SELECT 'SUB_' || org, org, 'COMPANY', 1, greatest(10, least(30, sum(n) / 10)) FROM base GROUP BY org
UNION ALL SELECT DISTINCT {FIELD_ID}, field, 'FIELD', 2, 8 FROM base
UNION ALL SELECT {SITE_ID}, site, 'SITE', 3, 5 FROM shown
UNION ALL SELECT DISTINCT 'METRIC_' || metric_code, metric_code, 'METRIC', 4, 6 FROM base
UNION ALL SELECT 'SUB_' || n_name, n_name, 'COMPANY', 1, 10 FROM nation WHERE n_name NOT IN (SELECT org FROM base))"""
EDGES = f"""edges AS (SELECT DISTINCT '{ROOT}' AS source, 'SUB_' || org AS target, 'OWNS' AS relation, 2.0::DOUBLE AS weight FROM base
UNION ALL SELECT DISTINCT 'SUB_' || org, {FIELD_ID}, 'OPERATES', 1.5 FROM base
UNION ALL SELECT {FIELD_ID}, {SITE_ID}, 'CONTAINS', 1 FROM shown
UNION ALL SELECT {SITE_ID}, 'METRIC_' || metric_code, 'REPORTS', round(n / 10.0, 1) FROM base
  WHERE (org, field, site) IN (SELECT (org, field, site) FROM shown))"""


def base(spark, sf):
    return graph.base_rollup(ad.facts(spark, sf))


def orgs(spark, sf):
    return ad.read_table(spark, sf, "nation").select(F.col("n_name").alias("org"))


@query("graph_base", f"WITH {FACTS}, {BASE} SELECT org, field, site, metric_code, n, round(mean_value, 6) AS mean_value FROM base")
def graph_base(spark, sf):
    return base(spark, sf).withColumn("mean_value", F.round("mean_value", 6))


@query("graph_nodes", f"WITH {FACTS}, {BASE}, {NODES} SELECT node_id, type, level, size FROM nodes")
def graph_nodes(spark, sf):
    return graph.nodes(base(spark, sf), ROOT, None, orgs(spark, sf)).drop("label")


@query("graph_edges", f"WITH {FACTS}, {BASE}, {EDGES} SELECT * FROM edges")
def graph_edges(spark, sf):
    return graph.edges(base(spark, sf), ROOT)


@query("graph_conflict_edges", f"""WITH {FACTS}, {CONFLICTS} SELECT 'SUB_' || org AS source, 'METRIC_' || metric_code AS target,
  'CONFLICT' AS relation, 0.3::DOUBLE AS weight FROM conflicts""")
def graph_conflict_edges(spark, sf):
    nodes = graph.nodes(base(spark, sf), ROOT)
    return graph.conflict_edges(cf.contradictions(ad.facts(spark, sf)), nodes)


@query("graph_statistics", f"""WITH {FACTS}, {BASE}, {NODES}, {EDGES} SELECT * FROM (SELECT count(*) AS nodes,
  count(*) FILTER (type = 'COMPANY') AS companies, count(*) FILTER (type = 'FIELD') AS fields,
  count(*) FILTER (type = 'SITE') AS sites FROM nodes), (SELECT count(*) AS edges FROM edges),
  (SELECT count(*) AS facts, count(DISTINCT document_id) AS documents FROM facts)""")
def graph_statistics(spark, sf):
    b = base(spark, sf)
    return graph.graph_statistics(graph.nodes(b, ROOT, None, orgs(spark, sf)), graph.edges(b, ROOT), ad.facts(spark, sf))


@query("entity_panel", f"""WITH {FACTS}, c AS (SELECT org, metric_code, count(*) AS n FROM facts GROUP BY 1, 2),
t AS (SELECT org, array_to_string(list(metric_code || ':' || n ORDER BY rn), ' ') AS top_metrics FROM (
  SELECT *, row_number() OVER (PARTITION BY org ORDER BY n DESC, metric_code) AS rn FROM c) WHERE rn <= 3 GROUP BY 1)
SELECT org, count(*) AS fact_count, count(DISTINCT site) AS site_count, any_value(top_metrics) AS top_metrics
FROM facts JOIN t USING (org) GROUP BY 1""")
def entity_panel(spark, sf):
    return graph.entity_panel(ad.facts(spark, sf)).withColumn(
        "top_metrics", F.array_join("top_metrics", " "))


@query("fact_paths", f"""WITH {FACTS} SELECT fact_id, level, CASE level WHEN 0 THEN '{ROOT}' WHEN 1 THEN 'SUB_' || org
  WHEN 2 THEN {FIELD_ID} WHEN 3 THEN {SITE_ID} WHEN 4 THEN 'METRIC_' || metric_code WHEN 5 THEN fact_id
  ELSE document_id END AS node_id FROM facts, range(7) r(level)""")
def fact_paths(spark, sf):
    return graph.fact_paths(ad.facts(spark, sf), ad.report_documents(spark, sf), ROOT).select(
        "fact_id", F.col("level").cast("bigint").alias("level"), "node_id")


# --- claims and answers ---


CLAIMS_SQL = """claims AS (SELECT org || '|' || fiscal_year || '|' || s AS claim_id, org, fiscal_year,
  CASE s WHEN 0 THEN t WHEN 1 THEN t + 0.07 WHEN 2 THEN t * 1.05 + 3 ELSE t * 2 + 1 END AS claimed
  FROM (SELECT org, fiscal_year, sum(numeric_value) FILTER (metric_code = 'COAL_PRODUCTION' AND
    validation_status = 'VERIFIED') AS t FROM {src} GROUP BY 1, 2), range(4) r(s) WHERE t IS NOT NULL)"""


def yearly_claims(spark, sf):
    t = (yearly(spark, sf).filter((F.col("metric_code") == "COAL_PRODUCTION")
                                  & (F.col("validation_status") == "VERIFIED"))
         .groupBy("org", "fiscal_year").agg(F.sum("numeric_value").alias("t")))
    v = F.col("t")
    c = t.select("org", "fiscal_year", F.posexplode(
        F.array(v, v + 0.07, v * 1.05 + 3, v * 2 + 1)).alias("s", "claimed"))
    return c.withColumn("claim_id", F.concat_ws("|", "org", "fiscal_year", F.col("s").cast("string"))).drop("s")


def production_results(spark, sf):
    f = yearly(spark, sf).filter(F.col("metric_code") == "COAL_PRODUCTION")
    return calc.calculate(f, dims.metrics_frame(spark), "SUM", ["org", "metric_code", "fiscal_year"],
                          group_codes=GROUPS)


def claims_sql(verdict: str) -> str:
    return f"""WITH {FACTS}, {sum_result(YEARLY, ORG_YEAR_COLS, ORG_YEAR)}, {CLAIMS_SQL.format(src=YEARLY)},
j AS (SELECT claim_id, claimed, round(result, 2) AS recorded FROM claims LEFT JOIN (SELECT * FROM calc
  WHERE metric_code = 'COAL_PRODUCTION' AND success) c USING (org, fiscal_year)),
g AS (SELECT *, abs(CAST(claimed AS DECIMAL(20,4)) - CAST(recorded AS DECIMAL(20,4))) AS gap,
  round(CAST(abs(CAST(claimed AS DECIMAL(20,4)) - CAST(recorded AS DECIMAL(20,4))) * 100 AS DOUBLE)
    / greatest(recorded, 0.0001), 2) AS pct FROM j)
SELECT claim_id, claimed, recorded, CAST(round(CAST(claimed AS DECIMAL(20,4)) - CAST(recorded AS DECIMAL(20,4)), 2) AS DOUBLE)
  AS difference, pct AS difference_pct, CASE WHEN recorded IS NULL THEN 'INSUFFICIENT_EVIDENCE' {verdict} END AS verdict FROM g"""


@query("verify_claims", claims_sql("WHEN gap <= 0.05 THEN 'SUPPORTED' WHEN gap <= 0.2 THEN 'PARTIALLY_SUPPORTED' ELSE 'CONTRADICTED'"))
def verify_claims(spark, sf):
    return claims.verify_claims(yearly_claims(spark, sf), production_results(spark, sf),
                                ["org", "fiscal_year"]).drop("org", "fiscal_year")


@query("verify_claims_relative", claims_sql("WHEN pct < 2 THEN 'SUPPORTED' WHEN pct < 10 THEN 'PARTIALLY_SUPPORTED' ELSE 'CONFLICTING'"))
def verify_claims_relative(spark, sf):
    return claims.verify_claims(yearly_claims(spark, sf), production_results(spark, sf),
                                ["org", "fiscal_year"], "relative").drop("org", "fiscal_year")


def answer_base(spark, sf):
    f = yearly(spark, sf)
    docs = f.groupBy("org", "metric_code", "fiscal_year").agg(
        F.countDistinct("document_id").alias("documents"))
    res = calc.calculate(f, dims.metrics_frame(spark), "COUNT", ["org", "metric_code", "fiscal_year"],
                         group_codes=GROUPS)
    return res.join(docs, ["org", "metric_code", "fiscal_year"])


@query("answer_confidence", f"""WITH {FACTS}, {sum_result(YEARLY, ORG_YEAR_COLS, ORG_YEAR, agg="count(*)", refuse=False)},
d AS (SELECT org, metric_code, fiscal_year, count(DISTINCT document_id) AS documents FROM {YEARLY} GROUP BY 1, 2, 3),
s AS (SELECT org, metric_code, fiscal_year, greatest(0.1, least(1, CAST(round(
  CASE WHEN metric_code = 'COAL_STOCK' THEN 0.85 WHEN metric_code = 'DRILLING' THEN least(0.75, 0.5 + 0.05 * evidence_used) ELSE 0.9 END
  + CASE WHEN verified_count = evidence_used THEN 0.10 WHEN verified_count * 2 >= evidence_used THEN 0.05 ELSE 0 END
  + CASE WHEN documents >= 2 THEN 0.05 ELSE 0 END - CASE WHEN error_code = 'CONFLICT' THEN 0.3 ELSE 0 END
  - CASE WHEN fiscal_year < '2017' THEN 0.1 ELSE 0 END - CASE WHEN org = '{ad.GROUP}' THEN 0.05 ELSE 0 END, 2) AS DOUBLE))) AS score
  FROM calc JOIN d USING (org, metric_code, fiscal_year))
SELECT *, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""")
def answer_confidence(spark, sf):
    m = F.col("metric_code")
    s = answer_base(spark, sf).select("org", "metric_code", "fiscal_year", scoring.answer_confidence(
        ~m.isin("COAL_STOCK", "DRILLING"), m == "COAL_STOCK", F.col("evidence_used"),
        F.col("verified_count"), F.col("documents"),
        F.coalesce(F.col("error_code") == "CONFLICT", F.lit(False)),
        F.col("fiscal_year") >= "2017", F.col("org") != ad.GROUP).alias("score"))
    return s.withColumn("level", scoring.answer_level(F.col("score")))


@query("lookup_confidence", f"""WITH {FACTS} SELECT org, metric_code, least(0.99, greatest(0.85, round(
  avg(round(confidence_score * 100)) / 100 * 0.7 + count(*) FILTER (human_verified) / count(*) * 0.3, 4))) AS confidence
FROM facts GROUP BY 1, 2""")
def lookup_confidence(spark, sf):
    g = ad.facts(spark, sf).groupBy("org", "metric_code").agg(
        (F.avg(F.round(F.col("confidence_score") * 100)) / 100).alias("m"),
        (F.count_if("human_verified") / F.count("*")).alias("v"))
    return g.select("org", "metric_code", scoring.lookup_confidence(F.col("m"), F.col("v"))
                    .alias("confidence"))


@query("verified_fallback", f"""WITH {FACTS}, a AS (SELECT site, metric_code, count(*) AS n,
  sum(numeric_value) FILTER (validation_status = 'VERIFIED') AS v FROM facts GROUP BY 1, 2)
SELECT site, metric_code, CASE WHEN v IS NOT NULL THEN 'VERIFIED' WHEN n > 0 THEN 'UNVERIFIED_EVIDENCE_EXISTS'
  ELSE 'NO_EVIDENCE' END AS note FROM a""")
def verified_fallback(spark, sf):
    f, m = ad.facts(spark, sf), dims.metrics_frame(spark)
    keys = ["site", "metric_code"]
    everything = calc.calculate(f, m, "COUNT", keys, group_codes=GROUPS)
    verified = calc.calculate(f.filter(F.col("validation_status") == "VERIFIED"), m, "COUNT", keys,
                              group_codes=GROUPS)
    # a conflict refuses a total but does not make the evidence unverified
    verified = verified.withColumn("success", F.lit(True))
    return claims.with_verified_fallback(everything, verified, keys).drop("result")


@query("entity_comparison", f"""WITH {FACTS}, {sum_result(REAL, "org, metric_code", "org || '|' || metric_code")}
SELECT n_name AS org, result, coalesce(evidence_used, 0) AS evidence_used, CASE WHEN result IS NULL THEN 'not recorded'
  ELSE 'recorded' END AS note FROM nation LEFT JOIN (SELECT * FROM calc WHERE metric_code = 'DRILLING' AND success) c ON org = n_name""")
def entity_comparison(spark, sf):
    f = real(spark, sf).filter(F.col("metric_code") == "DRILLING")
    res = calc.by_entity(f, dims.metrics_frame(spark), group_codes=GROUPS)
    return ranking.compared(res, orgs(spark, sf))


@query("question_routes", f"""WITH {QUESTIONS}, d AS (SELECT DISTINCT question FROM questions),
t AS (SELECT question, {intent_sql("d")} FROM d)
SELECT intent, CASE WHEN intent IN ('GREETING', 'HELP', 'CAPABILITY_QUERY') THEN 'GUIDE' WHEN intent = 'FACT_VERIFICATION' THEN 'CLAIM'
  WHEN intent = 'CALCULATION' THEN 'ACHIEVEMENT' WHEN intent = 'COMPARISON' THEN 'COMPARISON' WHEN intent = 'CONFLICT_QUERY' THEN 'CONFLICT'
  ELSE 'LOOKUP_OR_TEXT' END AS route, count(*) AS n FROM questions JOIN t USING (question) GROUP BY 1, 2""")
def question_routes(spark, sf):
    tagged = _tagged(spark, sf)
    route = F.col("route")
    return tagged.groupBy("intent", F.when(route.isin("LOOKUP", "TEXT"), "LOOKUP_OR_TEXT")
                          .otherwise(route).alias("route")).agg(F.count("*").alias("n"))


def _tagged(spark, sf):
    """Questions with intent, entities, period and route; each distinct text is worked out once and stored, or
    every filter on a tag and every branch below would work all tags out again."""
    qs = ad.questions(spark, sf).select("question_id", "question")
    folder = shared_folder(spark, "tags")
    # few bytes but much work: spread by number, not by size
    pieces = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (qs.select("question").distinct().repartition(pieces).withColumn("tags", vocab.question_tags(F.col("question")))
     .withColumn("route", claims.route(F.col("tags"))).write.parquet(folder))
    return qs.join(spark.read.parquet(folder), "question").select("question_id", "question", "tags.*", "route")


@query("answer_questions")
def answer_questions(spark, sf):
    """Questions answered in bulk: every distinct (metric, organisation, period) asked about is one
    scope of one calculation; claims and lookups read the same result."""
    from ledgerlake.operators import scope

    tagged = _tagged(spark, sf)
    # the ledger's organisations stand in for the organisations asked about
    codes = F.array(*[F.lit(c) for c in dims.ORG_CODES])
    n = F.array_position(codes, F.col("org")).cast("int")
    asked = tagged.withColumn("ledger_org", F.when(n > 0, F.concat(F.lit("NATION_"), n.cast("string"))))
    scopes = (asked.filter(F.col("route").isin("LOOKUP", "CLAIM") & F.col("ledger_org").isNotNull()
                           & F.col("metric_code").isNotNull())
              .select("metric_code", F.col("ledger_org").alias("org"), "period").distinct()
              .withColumn("scope_id", F.concat_ws("|", "metric_code", "org",
                                                  F.coalesce("period", F.lit("*")))))
    scoped = scope.apply_scopes(protect.with_period_keys(real(spark, sf)), scopes, ["metric_code", "org"])
    res = calc.calculate(scoped, dims.metrics_frame(spark), "SUM", ["scope_id", "metric_code"],
                         group_codes=GROUPS).select("scope_id", "result", "error_code", "evidence_used")
    key = F.when(F.col("route").isin("LOOKUP", "CLAIM"), F.concat_ws(
        "|", "metric_code", "ledger_org", F.coalesce("period", F.lit("*"))))
    out = asked.withColumn("scope_id", key).join(res, "scope_id", "left")
    gap = F.abs(F.col("claimed") - F.round("result", 2))
    return out.select(
        "question_id", "intent", "route", "metric_code", "org", "period", "result",
        F.when(F.col("route") == "CLAIM", F.when(F.col("result").isNull() | F.col("claimed").isNull(),
                                                 "INSUFFICIENT_EVIDENCE")
               .when(gap <= 0.05, "SUPPORTED").when(gap <= 0.20, "PARTIALLY_SUPPORTED")
               .otherwise("CONTRADICTED")).alias("verdict"))


# --- lineage and provenance ---


def runs_and_inputs(spark, sf):
    f, keys = protect.with_period_keys(real(spark, sf)), ["metric_code"]
    res = calc.calculate(f, dims.metrics_frame(spark), "SUM", keys, group_codes=GROUPS)
    lab = protect.label_exclusions(f, scope_keys=keys, group_codes=GROUPS)
    return lineage.run_rows(res, keys, "batch"), lineage.input_rows(lab, keys)


RUN_ID = "sha256('SUM|' || metric_code)"


@query("calculation_runs", f"""WITH {FACTS}, {sum_result(REAL, "metric_code", "metric_code")}
SELECT {RUN_ID} AS run_id, metric_code, success, error_code, result, evidence_used, 'batch' AS initiated_by FROM calc""")
def calculation_runs(spark, sf):
    return runs_and_inputs(spark, sf)[0].select(
        "run_id", "metric_code", "success", "error_code", "result", "evidence_used", "initiated_by")


@query("calculation_inputs", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT {RUN_ID} AS run_id, fact_id, CASE WHEN reason IS NULL THEN 'INCLUDED' ELSE 'EXCLUDED' END AS role,
  reason AS exclusion_reason, numeric_value AS value FROM lab""")
def calculation_inputs(spark, sf):
    return runs_and_inputs(spark, sf)[1].drop("document_id")


@query("run_input_counts", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT {RUN_ID} AS run_id, count(*) FILTER (reason IS NULL) AS included, count(*) FILTER (reason IS NOT NULL) AS excluded
FROM lab GROUP BY metric_code""")
def run_input_counts(spark, sf):
    runs, inputs = runs_and_inputs(spark, sf)
    return lineage.run_input_counts(runs, inputs).select("run_id", "included", "excluded")


@query("evidence_bundle", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT {RUN_ID} AS run_id, 'report_' || (CAST(document_id AS BIGINT) % 100000) || CASE WHEN CAST(document_id AS BIGINT) >= 100000
  THEN '_rev' ELSE '' END || '.xlsx' AS document_name, CASE WHEN reason IS NULL THEN 'INCLUDED' ELSE 'EXCLUDED' END AS role,
  count(*) AS n FROM lab GROUP BY metric_code, 2, 3""")
def evidence_bundle(spark, sf):
    runs, inputs = runs_and_inputs(spark, sf)
    return lineage.evidence_bundle(runs, inputs, ad.report_documents(spark, sf)).groupBy(
        "run_id", "document_name", "role").agg(F.count("*").alias("n"))


@query("where_used", f"""WITH {FACTS}, {protection(REAL, "metric_code")}
SELECT fact_id, {RUN_ID} AS run_id FROM lab WHERE reason IS NULL""")
def where_used(spark, sf):
    f, keys = protect.with_period_keys(real(spark, sf)), ["metric_code"]
    runs, _ = runs_and_inputs(spark, sf)
    used = lineage.input_rows(protect.included(f, scope_keys=keys, group_codes=GROUPS), keys)
    return lineage.where_used(used, runs).select("fact_id", "run_id")


RUN_DAYS = [f"{y}-{m:02d}-01" for y in (1995, 1996, 1997) for m in (1, 4, 7, 10)]


def run_log(spark, sf):
    """Twelve runs over the drilling facts known at their time, worked out at once."""
    days = F.array(*[F.lit(d).cast("timestamp") for d in RUN_DAYS])
    known = protect.with_period_keys(real(spark, sf).filter("metric_code = 'DRILLING'")).withColumn(
        "run_at", F.explode(F.filter(days, lambda d: d > F.col("created_at"))))
    keys = ["metric_code", "run_at"]
    runs = lineage.run_rows(calc.calculate(known, dims.metrics_frame(spark), "SUM", keys, group_codes=GROUPS), keys, "batch")
    return runs, lineage.input_rows(protect.label_exclusions(known, scope_keys=keys, group_codes=GROUPS), keys)


RUN_TIMES = values([(d,) for d in RUN_DAYS], "day")
RUN_SOURCE = f"""(SELECT facts.*, day FROM facts JOIN {RUN_TIMES} d ON created_at < CAST(day AS TIMESTAMP)
  WHERE NOT is_demo AND metric_code = 'DRILLING')"""


@query("last_runs_of_facts", f"""WITH {FACTS}, {protection(RUN_SOURCE, "day")}
SELECT fact_id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY day DESC) AS INTEGER) AS place, day FROM lab WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY day DESC) <= 10""")
def last_runs_of_facts(spark, sf):
    runs, inputs = run_log(spark, sf)
    return lineage.where_used(inputs, runs).select("fact_id", "place", F.date_format("run_at", "yyyy-MM-dd").alias("day"))


CITED = """CASE WHEN CAST(document_id AS BIGINT) >= 100000 THEN 'report_' || (CAST(document_id AS BIGINT) - 100000) || '_rev.xlsx'
  ELSE 'report_' || document_id || '.xlsx' END"""


@query("citations", f"""WITH {FACTS} SELECT fact_id, {CITED} AS document_name, {LOCATION} AS location, confidence_score,
  human_verified FROM facts""")
def citations(spark, sf):
    return provenance.citations(ad.facts(spark, sf), ad.report_documents(spark, sf)).select(
        "fact_id", "document_name", "location", "confidence_score", "human_verified")


@query("fact_dossiers", f"""WITH {FACTS}, {CONFLICTS}, ends AS (SELECT primary_fact_id AS id FROM conflicts UNION
  SELECT conflicting_fact_id FROM conflicts)
SELECT fact_id, {CITED} AS document_name, coalesce({LOCATION}, 'Precise coordinates tracked in Evidence Ledger') AS summary,
  CASE WHEN cell_reference IS NOT NULL THEN 'Deterministic Table / Cell Parser' ELSE 'Structured Layout Extractor' END AS parser,
  CASE WHEN id IS NULL THEN 'NONE' ELSE 'OPEN' END AS conflict_status FROM facts LEFT JOIN ends ON id = fact_id""")
def fact_dossiers(spark, sf):
    status = cf.facts_with_status(ad.facts(spark, sf))
    return provenance.dossiers(status, ad.report_documents(spark, sf)).select(
        "fact_id", "source.document_name", "location.summary", "extraction.parser",
        "validation.conflict_status")


@query("review_history", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
FROM events WHERE event_type <> 'view'""")
def review_history(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return ad.read_table(spark, sf, "events").filter("event_type <> 'view'").select(
        "user_id", "event_id", F.row_number().over(w).cast("bigint").alias("place"))


COMP = values([("COAL_PRODUCTION", c) for c in provenance.COMPLEMENTARY["PROD"]]
              + [("PRODUCTION_TARGET", c) for c in provenance.COMPLEMENTARY["PROD"]]
              + [("COAL_OFFTAKE", c) for c in provenance.COMPLEMENTARY["OFFTAKE"]]
              + [("DRILLING", c) for c in provenance.COMPLEMENTARY["DRILL"]], "m1, m2")


@query("related_facts", f"""WITH {FACTS}, comp AS {COMP},
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org, metric_code ORDER BY confidence_score DESC, fact_id) AS r
  FROM facts) WHERE r <= 4),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence_score DESC, fact_id) AS r
  FROM facts) WHERE r <= 4),
c AS (SELECT f.fact_id, g.fact_id AS rid FROM facts f JOIN g ON g.org = f.org AND g.metric_code = f.metric_code
UNION SELECT f.fact_id, g.fact_id FROM facts f JOIN comp ON m1 = f.metric_code JOIN g ON g.org = f.org AND g.metric_code = m2
UNION SELECT f.fact_id, d.fact_id FROM facts f JOIN d USING (document_id)),
t AS (SELECT f.fact_id, r.fact_id AS related_fact_id, CASE WHEN (f.metric_code, r.metric_code) IN (SELECT (m1, m2) FROM comp)
    THEN 'COMPLEMENTARY_METRIC' WHEN r.metric_code = f.metric_code AND r.reporting_period = f.reporting_period THEN 'SAME_PERIOD_PEER'
    WHEN r.document_id = f.document_id THEN 'SAME_SOURCE_DOCUMENT' ELSE 'ADJACENT_PERIOD' END AS relationship_type,
  row_number() OVER (PARTITION BY f.fact_id ORDER BY r.confidence_score DESC, r.fact_id) AS place
  FROM c JOIN facts f ON f.fact_id = c.fact_id JOIN facts r ON r.fact_id = c.rid WHERE c.rid <> c.fact_id)
SELECT * FROM t WHERE place <= 3""")
def related_facts(spark, sf):
    return provenance.related_facts(ad.facts(spark, sf), 3).withColumn(
        "place", F.col("place").cast("bigint"))


# --- reports ---


PROD = "(SELECT * FROM facts WHERE NOT is_demo AND metric_code = 'COAL_PRODUCTION')"


def gates(spark, sf):
    """Organisations, and region names, which have no evidence as organisations."""
    f, keys, m = ad.facts(spark, sf), ["org"], dims.metrics_frame(spark)
    names = [ad.read_table(spark, sf, "nation").select(F.col("n_name").alias("org")),
             ad.read_table(spark, sf, "region").select(F.col("r_name").alias("org"))]
    prod = f.filter("NOT is_demo AND metric_code = 'COAL_PRODUCTION'")
    runs = calc.calculate(prod, m, "SUM", ["metric_code", *keys], group_codes=GROUPS)
    figs = report.figures(f, keys)
    # every third organisation reports the calculated figure, the others the raw one
    raw = (F.substring("org", -1, 1).cast("int") % 3 > 0)
    figs = figs.join(runs.select("org", "result"), "org", "left").withColumn(
        "production", F.when(raw, F.col("production")).otherwise(F.round("result", 2))).drop("result")
    c = report.report_claims(figs, "org")
    links = report.claim_links(c, f, "org")
    return report.gate(names[0].unionByName(names[1]), keys, f, runs, figs, c, links, cf.contradictions(f), m)


GATES = f"""{{FIGS}}, {sum_result(PROD, "org", "org")},
fig AS (SELECT f.* REPLACE (CASE WHEN TRY_CAST(right(org, 1) AS INTEGER) % 3 > 0 THEN production ELSE round(result, 2) END AS production),
  result, success FROM figs2 f LEFT JOIN calc USING (org)),
allowed AS {values([(m, u) for m, s in dims.METRIC_SEMANTICS.items() for u in s[1]], "m, u")},
g AS (SELECT org, count(*) AS n, count(*) FILTER (validation_status = 'VERIFIED') AS v,
  count(*) FILTER (cell_reference IS NOT NULL OR page_number IS NOT NULL OR row_number IS NOT NULL) AS p, count(*) FILTER (is_demo) AS d,
  count(*) FILTER (unit IS NOT NULL AND metric_code IN (SELECT m FROM allowed) AND NOT EXISTS (SELECT 1 FROM allowed
    WHERE m = metric_code AND u = unit)) AS x FROM facts GROUP BY 1),
o AS (SELECT org, count(*) AS c FROM conflicts GROUP BY 1),
s AS (SELECT n_name AS org FROM nation UNION ALL SELECT r_name FROM region),
has AS (SELECT DISTINCT org, unnest(CASE metric_code WHEN 'COAL_PRODUCTION' THEN ['PRODUCTION', 'ACHIEVEMENT']
  WHEN 'PRODUCTION_TARGET' THEN ['ACHIEVEMENT'] WHEN 'COAL_OFFTAKE' THEN ['OFFTAKE'] END) AS kind FROM facts),
said AS (SELECT org, unnest([CASE WHEN production IS NOT NULL THEN 'PRODUCTION' END, CASE WHEN achievement_pct IS NOT NULL THEN 'ACHIEVEMENT' END,
  CASE WHEN offtake IS NOT NULL THEN 'OFFTAKE' END]) AS kind FROM fig),
bare AS (SELECT org, count(*) AS b FROM said ANTI JOIN has USING (org, kind) WHERE kind IS NOT NULL GROUP BY 1),
k AS (SELECT s.org, coalesce(n, 0) AS n, coalesce(v, 0) AS verified, [
  CASE WHEN coalesce(c, 0) = 0 THEN 'PASS' ELSE 'WARN' END, CASE WHEN coalesce(success, FALSE) THEN 'PASS' ELSE 'WARN' END,
  CASE WHEN production IS NULL OR NOT coalesce(success, FALSE) OR abs(production - result) <= 0.005 THEN 'PASS' ELSE 'BLOCK' END,
  CASE WHEN coalesce(b, 0) = 0 THEN 'PASS' ELSE 'WARN' END, CASE WHEN coalesce(x, 0) = 0 THEN 'PASS' ELSE 'WARN' END,
  CASE WHEN coalesce(n, 0) > 0 THEN 'PASS' ELSE 'BLOCK' END,
  CASE WHEN coalesce(v, 0) * 100 >= coalesce(n, 0) * 30 THEN 'PASS' ELSE 'WARN' END,
  CASE WHEN coalesce(p, 0) * 100 >= coalesce(n, 0) * 85 THEN 'PASS' ELSE 'WARN' END,
  CASE WHEN coalesce(d, 0) IN (0, coalesce(n, 0)) THEN 'PASS' ELSE 'WARN' END] AS checks, coalesce(c, 0) AS n_open
  FROM s LEFT JOIN g USING (org) LEFT JOIN o USING (org) LEFT JOIN fig USING (org) LEFT JOIN bare USING (org))"""


OB, DR = (f"sum(CAST(numeric_value AS DECIMAL(20,6))) FILTER (metric_code = '{c}')"
          for c in ("OVERBURDEN_REMOVAL", "DRILLING"))
FIGURES = f"""figs AS (SELECT org, {r(P, 2)} AS production, {r(T, 2)} AS target, {r(D, 2)} AS offtake, {r(OB, 2)} AS overburden,
  {r(DR, 2)} AS drilling FROM facts GROUP BY 1), figs2 AS (SELECT *, {pct("production", "target", 2)} AS achievement_pct FROM figs)"""


def figures(spark, sf):
    return report.figures(ad.facts(spark, sf), ["org"])


GATES = f"WITH {FACTS}, {CONFLICTS}, {GATES.replace('{FIGS}', FIGURES)}"


@query("report_gate", f"""{GATES} SELECT org, n AS evidence, verified, n_open, CASE WHEN list_contains(checks, 'BLOCK') THEN 'BLOCKED'
  WHEN list_contains(checks, 'WARN') THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS status FROM k""")
def report_gate(spark, sf):
    return gates(spark, sf).select("org", "evidence", "verified", "n_open", "status")


@query("report_gate_checks", f"""{GATES} SELECT org, i AS check_no, checks[i] AS status FROM k, range(1, 10) r(i)""")
def report_gate_checks(spark, sf):
    return report.gate_rows(gates(spark, sf), ["org"]).select(
        "org", F.col("check_no").cast("bigint").alias("check_no"), "status")


@query("report_figures", f"WITH {FACTS}, {FIGURES} SELECT * FROM figs2")
def report_figures(spark, sf):
    return figures(spark, sf)


@query("evidence_register", f"""WITH {FACTS}, t AS (SELECT *, row_number() OVER (ORDER BY numeric_value DESC, fact_id) AS p FROM facts)
SELECT 'E-' || (1000 + p) AS evidence_id, fact_id, metric_code, numeric_value, {LOCATION} AS location,
  validation_status = 'VERIFIED' AS verified FROM t WHERE p <= 50""")
def evidence_register(spark, sf):
    return report.evidence_register(ad.facts(spark, sf)).drop("org", "reporting_period")


REPORT_CLAIMS = f"""rc AS (SELECT org || ':PRODUCTION' AS claim_id, org, 'PRODUCTION' AS kind, production AS value FROM figs2 WHERE production IS NOT NULL
UNION ALL SELECT org || ':ACHIEVEMENT', org, 'ACHIEVEMENT', achievement_pct FROM figs2 WHERE achievement_pct IS NOT NULL
UNION ALL SELECT org || ':OFFTAKE', org, 'OFFTAKE', offtake FROM figs2 WHERE offtake IS NOT NULL)"""
LINKS = """links AS (SELECT claim_id, fact_id, r AS place FROM rc JOIN (SELECT *, row_number() OVER (PARTITION BY org, kind
  ORDER BY numeric_value DESC, fact_id) AS r FROM (SELECT org, fact_id, numeric_value, unnest(CASE metric_code
    WHEN 'COAL_PRODUCTION' THEN ['PRODUCTION', 'ACHIEVEMENT'] WHEN 'PRODUCTION_TARGET' THEN ['ACHIEVEMENT']
    WHEN 'COAL_OFFTAKE' THEN ['OFFTAKE'] END) AS kind FROM facts)) l USING (org, kind) WHERE r <= 5)"""


@query("report_claims", f"""WITH {FACTS}, {FIGURES}, {REPORT_CLAIMS}
SELECT claim_id, kind, value FROM rc""")
def report_claims(spark, sf):
    return report.report_claims(figures(spark, sf), "org").select("claim_id", "kind", "value")


def claim_links(spark, sf):
    c = report.report_claims(figures(spark, sf), "org")
    return c, report.claim_links(c, ad.facts(spark, sf), "org")


@query("claim_evidence", f"""WITH {FACTS}, {FIGURES}, {REPORT_CLAIMS}, {LINKS}
SELECT claim_id, array_to_string(list(fact_id ORDER BY place), ',') AS evidence FROM links GROUP BY 1""")
def claim_evidence(spark, sf):
    c, links = claim_links(spark, sf)
    return report.claims_with_evidence(c, links).filter("evidence IS NOT NULL").select(
        "claim_id", F.array_join("evidence", ",").alias("evidence"))


@query("fact_usage", f"""WITH {FACTS}, {FIGURES}, {REPORT_CLAIMS}, {LINKS}
SELECT fact_id, claim_id, org AS report_id FROM links JOIN rc USING (claim_id)""")
def fact_usage(spark, sf):
    c, links = claim_links(spark, sf)
    claims_of = c.select("claim_id", F.col("org").alias("report_id"))
    reports = c.select(F.col("org").alias("report_id")).distinct()
    return lineage.claim_usage(links, claims_of, reports).select("fact_id", "claim_id", "report_id")


@query("full_dossiers", f"""WITH {FACTS}, {DECISIONS}, r AS (SELECT fact_id, count(*) AS actions FROM exp GROUP BY 1),
{FIGURES}, {REPORT_CLAIMS}, {LINKS}, c AS (SELECT fact_id, count(DISTINCT claim_id) AS claims FROM links GROUP BY 1),
{protection(RUN_SOURCE, "day")}, u AS (SELECT fact_id, count(*) AS runs, max(day) AS last_run FROM lab WHERE reason IS NULL GROUP BY 1)
SELECT fact_id, numeric_value AS raw_value, coalesce(actions, 0) AS actions, coalesce(runs, 0) AS runs, coalesce(claims, 0) AS claims, last_run
FROM facts LEFT JOIN r USING (fact_id) LEFT JOIN u USING (fact_id) LEFT JOIN c USING (fact_id)""")
def full_dossiers(spark, sf):
    f = ad.facts(spark, sf)
    base = provenance.dossiers(cf.facts_with_status(f), ad.report_documents(spark, sf), more=[history.raw_part(f)])
    runs, inputs = run_log(spark, sf)
    used = inputs.filter("role = 'INCLUDED'").join(runs.select("run_id", "run_at"), "run_id")
    c, links = claim_links(spark, sf)
    claimed = links.join(c.select("claim_id", F.col("org").alias("report_id")), "claim_id")
    full = history.full_dossiers(base, f, history.decided_actions(decisions(spark, sf)), used, claimed)
    n = {x: F.coalesce(x, F.lit(0)) for x in ("review.actions", "usage.runs", "usage.claims")}
    return full.select("fact_id", F.col("raw.value").alias("raw_value"), *[e.alias(x.split(".")[1]) for x, e in n.items()],
                       F.date_format("usage.last_run_at", "yyyy-MM-dd").alias("last_run"))


@query("brief_sections", f"""WITH {FACTS}, {FIGURES} SELECT org, place, CASE place WHEN 1 THEN org || ' produced ' || coalesce(
  CAST(CAST(production AS DECIMAL(20,2)) AS VARCHAR) || ' MT', 'not recorded') || '.' WHEN 2 THEN 'Target ' || coalesce(CAST(CAST(target AS DECIMAL(20,2)) AS VARCHAR)
  || ' MT', 'not recorded') || '; achievement ' || coalesce(CAST(CAST(achievement_pct AS DECIMAL(20,2)) AS VARCHAR) || '%', 'not recorded') || '; dispatch ' ||
  coalesce(CAST(CAST(offtake AS DECIMAL(20,2)) AS VARCHAR) || ' MT', 'not recorded') WHEN 3 THEN 'Evidence ledger' ELSE
  CASE WHEN target IS NULL THEN 'No target evidence.' ELSE 'None noted.' END END AS text FROM figs2, range(1, 5) r(place)""")
def brief_sections(spark, sf):
    return report.brief_sections(figures(spark, sf), "org").select(
        "org", F.col("place").cast("bigint").alias("place"), "text")


# --- search and look-up ---


@query("search_ledger", f"""WITH {FACTS}, m AS (SELECT facts.* FROM facts LEFT JOIN {NAMES} ON code = metric_code WHERE (metric_code ILIKE '%ion 1%'
  OR site ILIKE '%ion 1%' OR field ILIKE '%ion 1%' OR coalesce(metric_name, metric_code) ILIKE '%ion 1%'
  OR org || ' production ' || numeric_value::BIGINT ILIKE '%ion 1%') AND confidence_score >= 0.8 AND validation_status = 'VERIFIED'),
t AS (SELECT count(*) FILTER (validation_status = 'VERIFIED') AS verified_count, count(*) FILTER (validation_status IN
  ('NEEDS_REVIEW', 'REVIEW_REQUIRED')) AS review_count FROM facts)
SELECT fact_id, verified_count, review_count, (SELECT count(*) FROM m) AS total FROM m, t ORDER BY created_at DESC, fact_id LIMIT 50""")
def search_ledger(spark, sf):
    f = ad.facts(spark, sf).withColumns({"metric_name": vocab.metric_name(F.col("metric_code")), "source_context": F.concat(
        "org", F.lit(" production "), F.col("numeric_value").cast("bigint").cast("string"))})
    return search.search_ledger(f, text="ion 1", status="VERIFIED",
                                min_confidence=0.8).select(
        "fact_id", "verified_count", "review_count", "total")


SEVERITY = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


@query("search_issues", f"""WITH {FACTS}, {ISSUES}, {ISSUE_STATE} SELECT issue_id, severity FROM state
WHERE issue_status = 'OPEN' AND org = 'NATION_3' ORDER BY {SEVERITY} DESC, created_at DESC, issue_id LIMIT 50""")
def search_issues(spark, sf):
    return search.search_issues(issue_state(spark, sf), issue_status="OPEN", org="NATION_3").select(
        "issue_id", "severity")


@query("list_conflicts", f"""WITH {FACTS}, {CONFLICTS} SELECT conflict_id, status FROM conflicts WHERE status = 'OPEN'
ORDER BY created_at DESC, conflict_id""")
def list_conflicts(spark, sf):
    return search.list_conflicts(cf.contradictions(ad.facts(spark, sf)), status="OPEN").select("conflict_id", "status")


@query("conflicts_page", f"""WITH {FACTS}, {CONFLICTS} SELECT conflict_id, count(*) OVER () AS total FROM conflicts WHERE org = 'NATION_3'
ORDER BY created_at DESC, conflict_id LIMIT 25 OFFSET 50""")
def conflicts_page(spark, sf):
    return search.list_conflicts(cf.contradictions(ad.facts(spark, sf)), org="NATION_3", page=3, size=25).select("conflict_id", "total")


@query("list_documents", """SELECT doc_id FROM documents WHERE source ILIKE '%src1%' AND CAST(doc_id % 7 AS INTEGER) IN (0, 1, 2)
AND doc_id % 9 <> 0 AND lang = 'en'""")
def list_documents(spark, sf):
    return search.list_documents(ad.documents(spark, sf), name="src1", status="READY",
                                 organization="Org en").select("doc_id")


@query("documents_page", """SELECT doc_id, count(*) OVER () AS total FROM documents WHERE CAST(doc_id % 6 AS INTEGER) IN (0, 2)
ORDER BY CAST(doc_id % 540 AS INTEGER) DESC, doc_id LIMIT 20 OFFSET 100""")
def documents_page(spark, sf):
    docs = ad.documents(spark, sf).withColumn("category", F.element_at(F.split("file_name", "_"), 1))
    return search.list_documents(docs, category=["prod", "dispatch"], sort=[("uploaded_on", True), ("doc_id", False)],
                                 page=6, size=20).select("doc_id", "total")


@query("list_audit", """SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 3 = 0""")
def list_audit(spark, sf):
    return search.list_audit(ad.audit(spark, sf), action="click", entity_type="fact").select("event_id")


@query("audit_page", """SELECT event_id, count(*) OVER () AS total FROM events WHERE event_id % 3 = 1
ORDER BY ts DESC, event_id LIMIT 30 OFFSET 90""")
def audit_page(spark, sf):
    return search.list_audit(ad.audit(spark, sf), entity_type="document", page=4, size=30).select("event_id", "total")


@query("point_lookup", f"""WITH {FACTS} SELECT fact_id, document_id, numeric_value FROM facts WHERE fact_id = (SELECT min(fact_id) FROM facts)""")
def point_lookup(spark, sf):
    f = ad.facts(spark, sf)
    return search.lookup(f, f.agg(F.min("fact_id").alias("fact_id"))).select("fact_id", "document_id", "numeric_value")


@query("chunk_documents_join", f"""WITH {CHUNKS} SELECT chunk_id, document_id, file_name FROM chunks""")
def chunk_documents_join(spark, sf):
    return chunks(spark, sf).filter("NOT is_demo").select(
        "chunk_id", "document_id", F.regexp_replace("file_name", r"_\d+\.\w+$", "").alias("file_name"))


@query("issue_worklist", f"""WITH {FACTS}, {ISSUES} SELECT i.issue_id, f.metric_code, f.numeric_value, {CITED.replace("document_id", "i.document_id")} AS document_name
FROM issues i LEFT JOIN facts f USING (fact_id)""")
def issue_worklist(spark, sf):
    f = ad.facts(spark, sf)
    return search.issue_worklist(cf.check_rules(f), f, ad.report_documents(spark, sf)).select(
        "issue_id", "metric_code", "numeric_value", "document_name")


@query("conflict_sides", f"""WITH {FACTS}, {CONFLICTS} SELECT conflict_id, a.numeric_value AS primary_value, b.numeric_value AS other_value
FROM conflicts LEFT JOIN facts a ON a.fact_id = primary_fact_id LEFT JOIN facts b ON b.fact_id = conflicting_fact_id""")
def conflict_sides(spark, sf):
    f = ad.facts(spark, sf)
    return search.conflict_sides(cf.contradictions(f, sides=["numeric_value", "unit"]), f).select(
        "conflict_id", "primary_value", "other_value")


@query("export_rows", f"""WITH {FACTS}, t AS (SELECT *, row_number() OVER (ORDER BY numeric_value DESC, fact_id) AS p FROM facts)
SELECT fact_id, metric_code, CAST(NULL AS VARCHAR) AS metric_name, numeric_value, cell_reference FROM t WHERE p <= 50""")
def export_rows(spark, sf):
    from ledgerlake.sources import files

    f = ad.facts(spark, sf)
    return files.export_frame(f, report.evidence_register(f)).select(
        "fact_id", "metric_code", "metric_name", "numeric_value", "cell_reference")


# --- sequences ---


@query("session_context", """WITH e AS (SELECT *, epoch(ts) AS s, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events),
g AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 1800 THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ses FROM g)
SELECT event_id, ses::BIGINT AS session_no, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, ses ORDER BY ts, event_id) AS inherited FROM n""")
def session_context(spark, sf):
    e = ad.read_table(spark, sf, "events").select(
        "event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return seq.carry_session_values(e, "user_id", "s", "v", "event_id").select(
        "event_id", F.col("session_no").cast("bigint").alias("session_no"), "inherited")


@query("attempt_alerts", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING
  AND CURRENT ROW) AS attempts FROM events""")
def attempt_alerts(spark, sf):
    """Ten-minute window, as test events are sparse."""
    e = ad.read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    return seq.trailing_counts(e, "user_id", "ts", 600).select("event_id", "attempts")


@query("running_evidence_ids", f"""WITH {FACTS} SELECT document_id, reporting_period, row_number() OVER (PARTITION BY document_id
  ORDER BY reporting_period) AS position FROM (SELECT DISTINCT document_id, reporting_period FROM facts)""")
def running_evidence_ids(spark, sf):
    periods = ad.facts(spark, sf).select("document_id", "reporting_period").distinct()
    return ranking.numbered(periods, ["document_id"], ["reporting_period"]).withColumn("position", F.col("position").cast("bigint"))
