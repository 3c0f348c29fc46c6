"""Queries: normalisers and text scalars over columns of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions import period as P
from ledgerlake.functions import scoring, text, vocab
from ledgerlake.plans.registry import query
from ledgerlake.plans.sqlparts import FACTS, FY_KEY, GRAIN, PERIOD_KEY, lst, values
from ledgerlake.plans.sqlparts import text as q
from ledgerlake.sources import adapters as ad


def pick(items: list[str], step: str) -> str:
    return f"list_element({lst(items)}, CAST({step} % {len(items)} + 1 AS INTEGER))"


QUESTIONS = f"""q0 AS (
SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS asked_on, {pick(ad.Q_ORGS, "o_custkey")} AS org_text,
  {pick(ad.Q_METRICS, "o_orderkey")} AS metric_text, CAST(year(o_orderdate) + 20 AS VARCHAR) AS ys,
  lpad(CAST((year(o_orderdate) + 21) % 100 AS VARCHAR), 2, '0') AS sh,
  CAST(floor(o_totalprice / 1000) AS BIGINT) || '.' || (o_orderkey % 10) AS number_text FROM orders),
q1 AS (SELECT *, list_element(['FY ' || ys || '-' || sh, ys || '-' || sh, ys || '/' || sh,
  'FY' || (CAST(ys AS INTEGER) + 1), 'Financial Year ' || ys || '-' || sh,
  'Q' || quarter(asked_on) || ' FY ' || ys || '-' || sh, strftime(asked_on, '%B') || ' ' || ys,
  'last year'], CAST(c % 8 + 1 AS INTEGER)) AS period_text FROM q0),
questions AS (SELECT k AS question_id, c AS user_id, asked_on, org_text, metric_text, period_text, number_text,
  list_element([
  'What was ' || org_text || ' ' || metric_text || ' in ' || period_text || '?',
  'Verify claim: ' || org_text || ' ' || metric_text || ' was ' || number_text || ' MT in ' || period_text,
  'Compare ' || metric_text || ' across all subsidiaries in ' || period_text,
  'Show the ' || metric_text || ' trend of ' || org_text || ' over time',
  'What percentage of its target did ' || org_text || ' achieve in ' || period_text || '?',
  org_text || ' produced ' || number_text || ' MT in ' || period_text,
  'Any conflicts in ' || metric_text || ' of ' || org_text || '?',
  'Why did ' || org_text || ' miss it? Who stopped the October plan',
  'hello there', 'Summarize the report of ' || org_text,
  'Prepare a Lok Sabha answer on ' || metric_text,
  'Where does this figure come from: ' || number_text], CAST(k % 12 + 1 AS INTEGER)) AS question FROM q1)"""

ORG_ROWS = values([(a, c) for a, c, _ in dims.ORGS] + [
    (c.lower(), c) for c in dims.ORG_CODES if c.lower() not in {a for a, _, _ in dims.ORGS}],
    "alias, code")
FULL = values(list({c.upper(): (c.upper(), f) for _, c, f in reversed(dims.ORGS)}.values()),
              "code, full_name")
ALIASES = values(dims.metric_alias_rows(), "alias, code, pos")
METRICS = values(dims.METRICS, "code, name, unit")
LEGACY = values(list(dims.LEGACY_CODES.items()), "old_code, new_code")


def metric_of(x: str) -> str:
    """Metric code of a text, as a scalar subquery."""
    return f"""coalesce(
  (SELECT code FROM {ALIASES} a WHERE a.alias = lower(trim({x}))),
  (SELECT code FROM {ALIASES} a WHERE a.alias = replace(replace(lower(trim({x})), '_', ' '), '-', ' ')),
  (SELECT arg_max(code, length(alias) * 1000 - pos) FROM {ALIASES} a WHERE contains(lower(trim({x})), a.alias)))"""


@query("norm_org", f"""WITH {QUESTIONS} SELECT question_id, org_text, coalesce(code, trim(org_text)) AS org
FROM questions LEFT JOIN {ORG_ROWS} o ON alias = lower(trim(org_text))""")
def norm_org(spark, sf):
    return ad.questions(spark, sf).select(
        "question_id", "org_text", vocab.norm_org(F.col("org_text")).alias("org"))


@query("org_by_join", f"""WITH {QUESTIONS} SELECT code AS org, count(*) AS n
FROM questions JOIN {ORG_ROWS} o ON alias = lower(trim(org_text)) GROUP BY 1""")
def org_by_join(spark, sf):
    """The same dictionary as an equi join with a dimension of fixed size."""
    dim = spark.createDataFrame([(a, c) for a, c, _ in dims.ORGS], "alias string, org string")
    qs = ad.questions(spark, sf).select(F.lower(F.trim("org_text")).alias("alias"))
    return qs.join(F.broadcast(dim), "alias").groupBy("org").agg(F.count("*").alias("n"))


@query("org_full_name", f"""WITH {QUESTIONS} SELECT question_id, full_name FROM questions
LEFT JOIN {ORG_ROWS} o ON alias = lower(trim(org_text))
LEFT JOIN {FULL} f ON f.code = upper(o.code)""")
def org_full_name(spark, sf):
    return ad.questions(spark, sf).select("question_id", vocab.org_full_name(
        vocab.norm_org(F.col("org_text"))).alias("full_name"))


@query("norm_metric", f"""WITH {QUESTIONS}, t AS (SELECT DISTINCT metric_text FROM questions),
m AS (SELECT metric_text, {metric_of("metric_text")} AS metric_code FROM t)
SELECT question_id, metric_text, metric_code FROM questions JOIN m USING (metric_text)""")
def norm_metric(spark, sf):
    return ad.questions(spark, sf).select(
        "question_id", "metric_text", vocab.norm_metric(F.col("metric_text")).alias("metric_code"))


@query("legacy_codes", f"""WITH src AS (SELECT p_partkey, list_element(['COAL_DISPATCH',
  'GEOLOGICAL_RESERVE', 'COAL_QUALITY_GCV', 'DRILLING'], CAST(p_size % 4 + 1 AS INTEGER)) AS code FROM part)
SELECT p_partkey, coalesce(new_code, src.code) AS metric_code, m.name AS metric_name, m.unit AS default_unit
FROM src LEFT JOIN {LEGACY} l ON old_code = src.code
LEFT JOIN {METRICS} m ON m.code = coalesce(new_code, src.code)""")
def legacy_codes(spark, sf):
    codes = F.array(*[F.lit(c) for c in ("COAL_DISPATCH", "GEOLOGICAL_RESERVE", "COAL_QUALITY_GCV",
                                         "DRILLING")])
    src = ad.read_table(spark, sf, "part").select(
        "p_partkey", F.element_at(codes, F.col("p_size") % 4 + 1).alias("code"))
    c = F.col("code")
    return src.select("p_partkey", vocab.resolve_legacy(c).alias("metric_code"),
                      vocab.metric_name(c).alias("metric_name"),
                      vocab.default_unit(c).alias("default_unit"))


UNITS = ["million tonnes", "MT", "tonnes", "MTPA", "metres", "ha", "%", "Mm3", "INR Cr", "BCM",
         "m3/t", "sq km", "kcal/kg", "nos", "Rs. lakh", "kWh/t", "000 t", "km", "parsec", " mt "]


def unit_sql(strict: bool) -> str:
    patterns = list(dims.UNIT_PATTERNS)
    if not strict:
        patterns = ([p for p in patterns if p[1] in ("m3/t", "sq km", "kcal/kg")]
                    + [(r"\b(kwh\s*/\s*t)\b", "kWh/t")] + patterns)
    whens = " ".join(
        f"WHEN regexp_matches(trim(raw), {q('(?i)' + p.replace('(?!' + chr(92) + 's*t)', ''))}) THEN {q(u)}"
        for p, u in patterns)
    return f"""WITH s AS (SELECT p_partkey, {pick(UNITS, "p_partkey")} AS raw FROM part)
SELECT p_partkey, raw, CASE {whens} ELSE '' END AS unit FROM s"""


def _units(spark, sf, strict):
    raw = F.element_at(F.array(*[F.lit(u) for u in UNITS]),
                       (F.col("p_partkey") % len(UNITS) + 1).cast("int"))
    return ad.read_table(spark, sf, "part").select("p_partkey", raw.alias("raw")).withColumn(
        "unit", vocab.norm_unit(F.col("raw"), strict))


@query("norm_unit", unit_sql(False))
def norm_unit(spark, sf):
    return _units(spark, sf, False)


@query("norm_unit_strict", unit_sql(True))
def norm_unit_strict(spark, sf):
    return _units(spark, sf, True)


RANGE = r"'(\d{4})[-/](\d{2,4})'"
# the question texts hold at most one period each
PERIOD_SQL = """CASE
  WHEN regexp_matches(x, '(?i)\\bq[1-4]\\s+(fy\\s*)?\\d{4}') THEN
    upper(regexp_extract(x, '(?i)\\b(q[1-4])\\s+(?:fy\\s*)?(\\d{4})-(\\d{2})', 1)) || ' FY ' ||
    regexp_extract(x, '(?i)\\b(q[1-4])\\s+(?:fy\\s*)?(\\d{4})-(\\d{2})', 2) || '-' ||
    regexp_extract(x, '(?i)\\b(q[1-4])\\s+(?:fy\\s*)?(\\d{4})-(\\d{2})', 3)
  WHEN regexp_matches(x, '\\b\\d{4}[-/]\\d{2}\\b') THEN 'FY ' || regexp_extract(x, '\\b(\\d{4})[-/](\\d{2})\\b', 1)
    || '-' || regexp_extract(x, '\\b(\\d{4})[-/](\\d{2})\\b', 2)
  WHEN regexp_matches(x, '(?i)\\bfy\\d{4}\\b') THEN 'FY ' ||
    (CAST(regexp_extract(x, '(?i)\\bfy(\\d{4})\\b', 1) AS INTEGER) - 1) || '-' ||
    right(regexp_extract(x, '(?i)\\bfy(\\d{4})\\b', 1), 2)
  WHEN regexp_matches(x, '(?i)\\b(january|february|march|april|may|june|july|august|september|october|november|december)\\s+\\d{4}\\b')
    THEN upper(regexp_extract(x, '(?i)\\b(j|f|m|a|s|o|n|d)(anuary|ebruary|arch|pril|ay|une|uly|ugust|eptember|ctober|ovember|ecember)\\s+(\\d{4})\\b', 1))
    || lower(left(regexp_extract(x, '(?i)\\b(j|f|m|a|s|o|n|d)(anuary|ebruary|arch|pril|ay|une|uly|ugust|eptember|ctober|ovember|ecember)\\s+(\\d{4})\\b', 2), 2))
    || ' ' || regexp_extract(x, '(?i)\\b(j|f|m|a|s|o|n|d)(anuary|ebruary|arch|pril|ay|une|uly|ugust|eptember|ctober|ovember|ecember)\\s+(\\d{4})\\b', 3)
  END"""


@query("norm_period", f"""WITH {QUESTIONS} SELECT question_id, period_text,
{PERIOD_SQL.replace("(x,", "(period_text,")} AS period FROM questions""")
def norm_period(spark, sf):
    return ad.questions(spark, sf).select(
        "question_id", "period_text", P.norm_period(F.col("period_text")).alias("period"))


@query("extract_period", f"""WITH {QUESTIONS} SELECT question_id,
{PERIOD_SQL.replace("(x,", "(question,")} AS period,
CASE WHEN {PERIOD_SQL.replace("(x,", "(question,")} IS NULL THEN 0
  WHEN {PERIOD_SQL.replace("(x,", "(question,")} LIKE 'Q%' THEN 2 ELSE 1 END AS n FROM questions""")
def extract_period(spark, sf):
    ps = ad.questions(spark, sf).select(
        "question_id", P.extract_periods(F.col("question")).alias("ps"))
    return ps.select("question_id", F.get("ps", 0).alias("period"),
                     F.size("ps").cast("int").alias("n"))


@query("question_period", f"""WITH {QUESTIONS}, p AS (SELECT question_id,
{PERIOD_SQL.replace("(x,", "(question,")} AS period FROM questions)
SELECT question_id, period, CASE WHEN period LIKE '%Q%' THEN 'QUARTER_FY' WHEN period LIKE 'FY%'
  THEN 'ANNUAL_FY' WHEN period IS NOT NULL THEN 'OTHER' END AS period_type FROM p""")
def question_period(spark, sf):
    return ad.questions(spark, sf).select(
        "question_id", P.question_period(F.col("question")).alias("p")).select("question_id", "p.*")


@query("period_keys", f"""WITH {FACTS} SELECT reporting_period, {PERIOD_KEY} AS period_key, {GRAIN} AS grain,
  {FY_KEY} AS fiscal_year, count(*) AS n FROM facts GROUP BY 1, 2, 3, 4""")
def period_keys(spark, sf):
    p = F.col("reporting_period")
    return ad.facts(spark, sf).groupBy("reporting_period").agg(F.count("*").alias("n")).select(
        "reporting_period", P.period_key(p).alias("period_key"), P.infer_grain(p).alias("grain"),
        P.fy_key(p).alias("fiscal_year"), "n")


NUMBER_RAW = """CASE CAST(o_orderkey % 6 AS INTEGER) WHEN 0 THEN '₹ ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
  || ' Cr' WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.125 MT'
  WHEN 2 THEN '-' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '%' WHEN 3 THEN 'n/a'
  WHEN 4 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '99999999 t' ELSE '' END"""


@query("parse_number", f"""WITH s AS (SELECT o_orderkey, {NUMBER_RAW} AS raw FROM orders),
p AS (SELECT *, TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace(trim(raw), '^[₹$€£\\s]+', ''),
  '(\\d),', '\\1', 'g'), '[-+]?[0-9]*\\.?[0-9]+'), '') AS DOUBLE) AS v FROM s)
SELECT o_orderkey, raw, CASE WHEN abs(v) <= 1e12 THEN round(v, 4) END AS value FROM p""")
def parse_number(spark, sf):
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    raw = (F.when(k % 6 == 0, F.concat(F.lit("₹ "), F.format_number(v, 0), F.lit(" Cr")))
           .when(k % 6 == 1, F.concat(v.cast("string"), F.lit(".125 MT")))
           .when(k % 6 == 2, F.concat(F.lit("-"), v.cast("string"), F.lit("%")))
           .when(k % 6 == 3, "n/a")
           .when(k % 6 == 4, F.concat(v.cast("string"), F.lit("99999999 t"))).otherwise(""))
    return ad.read_table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn(
        "value", text.parse_number(F.col("raw")))


STEMS = "(?:s|es|ed|ing|er|ers)?\\b"


def identify_sql() -> str:
    whens = []
    for words, code in dims.QUESTION_METRICS:
        cond = f"regexp_matches(lower(question), {q(chr(92) + 'b(?:' + '|'.join(words) + ')' + STEMS)})"
        if code == "PRODUCTION_TARGET":
            cond += f" AND NOT regexp_matches(lower(question), {q(chr(92) + 'bachievement' + STEMS)})"
        if code == "COAL_PRODUCTION":
            cond += " OR contains(lower(question), 'total coal')"
        whens.append(f"WHEN {cond} THEN {q(code)}")
    return "CASE " + " ".join(whens) + " END"


@query("identify_metric", f"""WITH {QUESTIONS} SELECT question_id, {identify_sql()} AS metric_code
FROM questions""")
def identify_metric(spark, sf):
    return ad.questions(spark, sf).select(
        "question_id", vocab.identify_metric(F.col("question")).alias("metric_code"))


@query("period_and_org", f"""WITH {QUESTIONS}, s AS (SELECT question_id, question, upper(regexp_extract(question,
  '(?i)(FY\\s*20\\d{{2}}[-–]\\d{{2,4}}|FY\\s*\\d{{2}}[-–]\\d{{2}}|20\\d{{2}}[-–]\\d{{2,4}})', 1)) AS raw FROM questions)
SELECT question_id, CASE WHEN raw = '' THEN NULL WHEN raw LIKE 'FY%' THEN raw ELSE 'FY ' || raw END AS period,
  CASE {" ".join(f"WHEN regexp_matches(question, '(?i){chr(92)}b{c}{chr(92)}b') THEN '{c}'" for c in dims.QUESTION_ORG_CODES)}
  END AS org FROM s""")
def period_and_org(spark, sf):
    return ad.questions(spark, sf).select(
        "question_id", vocab.period_and_org(F.col("question")).alias("p")).select("question_id", "p.*")


@query("claimed_number", f"""WITH {QUESTIONS} SELECT question_id, TRY_CAST(coalesce(
  nullif(regexp_extract(question, '(?i)\\b(\\d+(?:\\.\\d+)?)\\s*(?:mt|bcm|mm3|m|%|inr|cr|crore)\\b', 1), ''),
  nullif(regexp_extract(question, '(?i)\\b(?:was|is|reached|achieved|stands at|produced|drilled|of)\\s*(\\d+(?:\\.\\d+)?)', 1), ''),
  nullif(regexp_extract(question, '\\b(\\d+(?:\\.\\d+)?)\\b', 1), '')) AS DOUBLE) AS claimed FROM questions""")
def claimed_number(spark, sf):
    return ad.questions(spark, sf).select(
        "question_id", vocab.claimed_number(F.col("question")).alias("claimed"))


def word(w: str) -> str:
    return q(chr(92) + "b" + text.regex_escape(w) + chr(92) + "b")


def resolve_sql() -> str:
    names: dict[str, list[str]] = {}
    for alias, code, _ in dims.ORGS:
        names.setdefault(code, []).append(alias)
    orgs = ", ".join(
        "CASE WHEN " + " OR ".join(f"regexp_matches(lower(question), {word(a)})" for a in al)
        + f" THEN {q(c)} END" for c, al in names.items())
    sites = " ".join(f"WHEN regexp_matches(lower(question), {word(s)}) THEN {q(s.title())}"
                     for s in dims.SITES)
    owners = " ".join(f"WHEN regexp_matches(lower(question), {word(s)}) THEN {q(o)}"
                      for s, o in dims.SITES.items())
    metric = " ".join(
        f"WHEN regexp_matches(lower(question), {word(a)}) THEN {q(c)}"
        for a, c, _ in sorted(dims.metric_alias_rows(), key=lambda r: (-len(r[0]), r[2])))
    return f"""WITH {QUESTIONS}, d AS (SELECT DISTINCT question FROM questions),
r AS (SELECT question, list_filter([{orgs}], lambda x: x IS NOT NULL) AS orgs,
  CASE {sites} ELSE nullif(regexp_extract(question,
    '(?i)\\b([A-Za-z0-9-]+\\s+(?:OCP|UG|OC|Colliery|Mine|Block))\\b', 1), '') END AS site,
  CASE {owners} END AS owner,
  coalesce(CASE {metric} END, {metric_of("question")}) AS metric_code,
  regexp_matches(lower(question), '\\b(?:all\\s+subsidiaries|across\\s+subsidiaries|each\\s+subsidiary|subsidiary\\s+wise)\\b')
    AS all_entities FROM d)
SELECT question_id, coalesce(orgs[1], owner) AS org, array_to_string(orgs, ',') AS orgs, site, metric_code,
  all_entities FROM questions JOIN r USING (question)"""


@query("resolve_entities", resolve_sql())
def resolve_entities(spark, sf):
    """Entities of every question. Phrasings repeat, so each distinct text is resolved once."""
    qs = ad.questions(spark, sf).select("question_id", "question")
    t = F.col("question")
    done = (qs.select("question").distinct()
            .withColumns({"o": vocab.question_orgs(t), "s": vocab.question_site(t),
                          "metric_code": vocab.question_metric(t),
                          "all_entities": vocab.all_entities_flag(t)}))
    return qs.join(done, "question").select(
        "question_id", F.coalesce(F.get("o", 0), F.col("s.owner")).alias("org"),
        F.array_join("o", ",").alias("orgs"), F.col("s.site").alias("site"), "metric_code",
        "all_entities")


def intent_sql(source: str) -> str:
    t = "lower(trim(question))"
    n_words = f"len(regexp_extract_all({t}, '\\b(\\w+)\\b'))"
    intent, conf = [], []
    for name, patterns in dims.INTENTS.items():
        cond = "(" + " OR ".join(f"regexp_matches({t}, {q(p)})" for p in patterns) + ")"
        if name == "GREETING":
            cond += f" AND {n_words} <= 3"
        if name == "HELP":
            cond += f" AND {n_words} <= 6"
        intent.append(f"WHEN {cond} THEN {q(name)}")
        conf.append(f"WHEN {cond} THEN {dims.INTENT_CONFIDENCE[name]}")
    claim = (f"regexp_matches({t}, {q(dims.CLAIM_VERB_PATTERN)}) AND "
             f"regexp_matches({t}, {q(dims.CLAIM_NUMBER_PATTERN)})")
    lookup = ("(" + " OR ".join(f"contains({t}, {q(w)})" for w in dims.LOOKUP_WORDS)
              + f" OR EXISTS (SELECT 1 FROM {ALIASES} a WHERE contains({t}, a.alias)))")
    return f"""CASE {" ".join(intent)} WHEN {claim} THEN 'FACT_VERIFICATION' WHEN {lookup}
  THEN 'METRIC_LOOKUP' ELSE 'UNKNOWN' END AS intent,
  CAST(CASE {" ".join(conf)} WHEN {claim} THEN 0.85 WHEN {lookup} THEN 0.85 ELSE 0.4 END AS DOUBLE) AS confidence"""


@query("tag_intent", f"""WITH {QUESTIONS}, d AS (SELECT DISTINCT question FROM questions),
t AS (SELECT question, {intent_sql("d")} FROM d)
SELECT question_id, intent, confidence FROM questions JOIN t USING (question)""")
def tag_intent(spark, sf):
    return ad.questions(spark, sf).select(
        "question_id", vocab.tag_intent(F.col("question")).alias("i")).select("question_id", "i.*")


@query("extract_entities", f"""WITH {QUESTIONS}, s AS (SELECT question_id, 'Seam XII top of ' || org_text ||
  ' North Pit ' || 'OCP, Area ' || (question_id % 7) || '. ' || question AS t FROM questions)
SELECT question_id, (SELECT arg_min(code, (p, ord)) FROM (SELECT code, ord,
    length(regexp_extract(t, '(?is)^(.*?)\\b' || code || '\\b', 1)) AS p FROM {values(
      [(c, i) for i, c in enumerate(dims.ORG_CODES)], "code, ord")} c
    WHERE regexp_matches(t, '(?i)\\b' || code || '\\b'))) AS org,
  'Seam XII' AS seam, 'Area ' || (question_id % 7) AS area FROM s""")
def extract_entities(spark, sf):
    t = F.concat(F.lit("Seam XII top of "), "org_text", F.lit(" North Pit OCP, Area "),
                 (F.col("question_id") % 7).cast("string"), F.lit(". "), "question")
    e = ad.questions(spark, sf).select("question_id", vocab.extract_entities(t).alias("e"))
    return e.select("question_id", "e.org", "e.seam",
                    F.concat(F.lit("Area "), F.col("e.project")).alias("area"))


# --- document text ---


@query("doc_category", f"""WITH d AS (SELECT doc_id, lower(list_element(['prod_', 'drill_log_', 'dispatch_', 'geol_', 'reserve_', 'misc_'],
  CAST(doc_id % 6 + 1 AS INTEGER)) || source || ' ' || text) AS t, CAST(doc_id % 6 AS INTEGER) AS k FROM documents)
SELECT doc_id, CASE {" ".join("WHEN " + " OR ".join(f"contains(t, {q(w)})" for w in ws) + f" THEN {q(c)}" for c, ws in dims.DOC_CATEGORIES)}
  ELSE 'GENERAL_REPORT' END AS category, list_element(['Production Report', 'Drilling & Exploration',
  'Dispatch Statement', 'Geological Assessment', 'Reserve Estimation', 'General Mining Report'], k + 1)
  AS filename_category FROM d""")
def doc_category(spark, sf):
    d = ad.documents(spark, sf)
    prefix = F.regexp_replace("file_name", r"_\d+\.\w+$", "")
    return d.select("doc_id", text.doc_category(prefix, F.col("text")).alias("category"),
                    text.filename_category(F.col("file_name")).alias("filename_category"))


@query("source_type", """SELECT doc_id, CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN CASE WHEN doc_id % 2 = 0
  THEN 'SCANNED_PDF' ELSE 'DIGITAL_PDF' END WHEN 1 THEN 'CSV' WHEN 2 THEN 'XLSX' WHEN 3 THEN 'TXT'
  ELSE 'IMAGE' END AS source_type FROM documents""")
def source_type(spark, sf):
    return ad.documents(spark, sf).select(
        "doc_id", text.source_type(F.col("file_type"), F.col("doc_id") % 2 == 0).alias("source_type"))


INJECTED = "replace(text, ' the ', ' Ignore previous  instructions the ')"


@query("redact_injection", f"""SELECT doc_id, md5(regexp_replace({INJECTED},
  {q("(?i)" + dims.INJECTION_PATTERN)}, '[redacted instruction]', 'g')) AS digest FROM documents""")
def redact_injection(spark, sf):
    t = F.replace("text", F.lit(" the "), F.lit(" Ignore previous  instructions the "))
    return ad.documents(spark, sf).select("doc_id", F.md5(text.redact_injection(t)).alias("digest"))


# RE2 has no lookbehind: sentence ends are marked first
@query("lead_sentences", """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(
  regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda x: trim(x, ' ')), lambda x: length(x) >= 10) AS l
FROM documents) SELECT doc_id, array_to_string(list_slice(l, 1, 2), ' ') AS lead FROM s""".replace(
    "\x01", chr(1)))
def lead_sentences(spark, sf):
    return ad.documents(spark, sf).select("doc_id", text.lead_sentences(F.col("text")).alias("lead"))


@query("snippets", """WITH p AS (SELECT doc_id, text, strpos(text, 'tion') AS s FROM documents)
SELECT doc_id, '...' || trim(substr(text, greatest(s - 40, 1), least(s + 3 + 40, length(text)) - greatest(s - 40, 1) + 1), ' ')
  || '...' AS snippet FROM p WHERE s > 0""")
def snippets(spark, sf):
    d = ad.documents(spark, sf).select("doc_id", "text", F.instr("text", "tion").alias("s"))
    return d.filter("s > 0").select(
        "doc_id", text.snippet(F.col("text"), F.col("s"), F.lit(4)).alias("snippet"))


@query("labels_of_codes", f"""WITH {FACTS} SELECT metric_code, list_element(['Coal Production',
  'Production Target', 'Overburden Removal', 'Coal Offtake', 'Coal Stock', 'Drilling'],
  list_position(['COAL_PRODUCTION', 'PRODUCTION_TARGET', 'OVERBURDEN_REMOVAL', 'COAL_OFFTAKE',
  'COAL_STOCK', 'DRILLING'], metric_code)) AS label, count(*) AS n FROM facts GROUP BY 1, 2""")
def labels_of_codes(spark, sf):
    return ad.facts(spark, sf).groupBy(
        "metric_code", text.label(F.col("metric_code")).alias("label")).agg(F.count("*").alias("n"))


LOCATION = """nullif(concat_ws(' · ', 'Sheet: ' || sheet_name, 'Cell: ' || cell_reference, 'Row: ' || row_number,
  'Page: ' || page_number), '')"""


@query("fact_location", f"""WITH {FACTS} SELECT fact_id, {LOCATION} AS location FROM facts""")
def fact_location(spark, sf):
    return ad.facts(spark, sf).select("fact_id", text.location(
        F.col("sheet_name"), F.col("cell_reference"), F.col("row_number"),
        F.lit(None).cast("string"), F.col("page_number")).alias("location"))


@query("chunk_hash", """SELECT doc_id, left(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 16) AS chunk_hash,
  length(text) // 4 AS tokens FROM documents""")
def chunk_hash(spark, sf):
    return ad.documents(spark, sf).select(
        "doc_id", text.chunk_hash(F.col("text")).alias("chunk_hash"),
        text.token_estimate(F.col("text")).alias("tokens"))


@query("word_bounded", """SELECT doc_id, regexp_matches(text, '(?i)\\bthe\\b') AS has_the,
  regexp_matches(text, '(?i)\\btop\\b') AS has_top FROM documents""")
def word_bounded(spark, sf):
    return ad.documents(spark, sf).select(
        "doc_id", text.has_word(F.col("text"), "the").alias("has_the"),
        text.has_word(F.col("text"), "top").alias("has_top"))


TERMS = f"""CASE WHEN len(list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]{{3,}}'),
  lambda w: NOT list_contains({lst(dims.STOPWORDS)}, w))) > 0
  THEN list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda w: NOT list_contains({lst(dims.STOPWORDS)}, w))
  ELSE list_filter(regexp_extract_all(lower(x), '\\b[a-z]{{2,}}\\b'), lambda w: NOT list_contains({lst(dims.STOPWORDS)}, w)) END"""


@query("query_terms", f"""SELECT item_id, array_to_string({TERMS.replace("(x)", "(text)")}, ' ') AS terms FROM benchmark
UNION ALL SELECT conv_id * 1000 + turn + 1000000, array_to_string({TERMS.replace("(x)", "(text)")}, ' ')
FROM conversations""")
def query_terms(spark, sf):
    b = ad.read_table(spark, sf, "benchmark").select("item_id", "text")
    c = ad.read_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1000000).alias("item_id"), "text")
    return b.unionByName(c).select(
        "item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


# --- scores ---

CONF_SQL = """greatest(0.10, least(0.99, CAST(round(
  CASE extraction_method WHEN 'STRUCTURED_TABLE' THEN 0.92 WHEN 'REGEX_PATTERN' THEN 0.75
    ELSE 0.55 + CAST(round(0.25 * CAST(ocr AS DECIMAL(10,4)), 4) AS DECIMAL(10,4)) END
  + CASE WHEN unit IS NOT NULL THEN 0.04 ELSE -0.05 END + 0.04 + 0.04
  - CASE WHEN qual < 0.75 THEN CAST(round((0.75 - CAST(qual AS DECIMAL(10,4))) * 0.35, 2) AS DECIMAL(10,4)) ELSE 0 END
  - CASE WHEN is_demo THEN 0.10 ELSE 0 END, 2) AS DOUBLE)))"""


@query("fact_confidence", f"""WITH {FACTS}, s AS (SELECT *, (numeric_value / 10 + 1) / 12 AS ocr0,
  CAST(numeric_value / 10 AS INTEGER) AS lvl FROM facts),
t AS (SELECT *, CAST(lvl * 0.08 AS DOUBLE) AS qual, CAST(lvl * 0.1 AS DOUBLE) AS ocr FROM s),
c AS (SELECT fact_id, {CONF_SQL} AS confidence FROM t)
SELECT *, CASE WHEN confidence >= 0.9 THEN 'HIGH_CONFIDENCE' WHEN confidence >= 0.7 THEN 'NEEDS_REVIEW'
  ELSE 'REVIEW_REQUIRED' END AS status FROM c""")
def fact_confidence(spark, sf):
    lvl = (F.col("numeric_value") / 10).cast("int")
    c = ad.facts(spark, sf).select("fact_id", scoring.fact_confidence(
        F.col("extraction_method"), F.col("unit").isNotNull(), F.col("reporting_period").isNotNull(),
        F.col("org").isNotNull(), (lvl * F.lit(0.08).cast("decimal(3,2)")).cast("double"),
        (lvl * F.lit(0.1).cast("decimal(2,1)")).cast("double"), F.col("is_demo"), F.lit(True))
        .alias("confidence"))
    return c.withColumn("status", scoring.initial_status(F.col("confidence")))


@query("confidence_rationale", f"""WITH {FACTS} SELECT extraction_method, CASE extraction_method
  WHEN 'STRUCTURED_TABLE' THEN 'table cell (+0.88) | spreadsheet (+0.04)'
  WHEN 'REGEX_PATTERN' THEN 'pattern in text (+0.75)'
  ELSE 'recognised text, 70% sure (+0.73)' END || ' | ' || CASE WHEN unit IS NULL
  THEN 'no unit (-0.05)' ELSE 'unit known (+0.04)' END ||
  ' | period known (+0.04) | organisation known (+0.04)' ||
  ' | quality of the source (-0.09)' AS rationale, count(*) AS n FROM facts GROUP BY 1, 2""")
def confidence_rationale(spark, sf):
    rationale = scoring.confidence_rationale(
        F.col("extraction_method"), F.col("unit").isNotNull(), F.col("reporting_period").isNotNull(),
        F.col("org").isNotNull(), F.lit(0.5), F.lit(None).cast("double"), F.lit(False), F.lit(True))
    return ad.facts(spark, sf).groupBy("extraction_method", rationale.alias("rationale")).agg(
        F.count("*").alias("n"))


@query("text_quality", """SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 WHEN length(text) < 100 THEN 0.6
  ELSE 0.95 END::DOUBLE AS score, CASE WHEN length(text) = 0 THEN 'UNREADABLE' WHEN length(text) < 100 THEN 'FAIR'
  ELSE 'EXCELLENT' END AS label FROM documents""")
def text_quality(spark, sf):
    s = ad.documents(spark, sf).select(
        "doc_id", scoring.text_quality_score(F.length("text")).alias("score"))
    return s.withColumn("label", scoring.quality_label(F.col("score")))
