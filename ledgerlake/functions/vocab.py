"""Organisation, metric and unit vocabularies as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions.text import first_match, let, regex_escape


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value for a key out of a small constant map, NULL if absent."""
    return F.try_element_at(
        F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())]), key)


def norm_org(name: Column) -> Column:
    """Organisation code for a name; an unknown name comes back trimmed."""
    codes = {a: c for a, c, _ in dims.ORGS} | {c.lower(): c for c in dims.ORG_CODES}
    return let(F.trim(name), lambda clean: F.when(
        clean != "", F.coalesce(_lookup(codes, F.lower(clean)), clean)))


def table_org(name: Column) -> Column:
    """norm_org of a name where that is one of the organisations of tables, else NULL."""
    codes = {a: c for a, c, _ in dims.ORGS} | {c.lower(): c for c in dims.ORG_CODES}
    known = {a: c for a, c in codes.items() if c in dims.TABLE_ORG_CODES}
    return let(F.lower(F.trim(name)), lambda low: F.when(low.isin(*known), _lookup(known, low)))


def is_table_org(name: Column) -> Column:
    return F.coalesce(norm_org(name).isin(*dims.TABLE_ORG_CODES), F.lit(False))


def org_full_name(code: Column) -> Column:
    names: dict[str, str] = {}
    for _, c, full in dims.ORGS:
        names.setdefault(c.upper(), full)
    return _lookup(names, F.upper(code))


def resolve_legacy(code: Column) -> Column:
    return F.coalesce(_lookup(dims.LEGACY_CODES, code), code)


def metric_name(code: Column) -> Column:
    return F.coalesce(_lookup({c: n for c, n, _ in dims.METRICS}, resolve_legacy(code)), code)


def default_unit(code: Column) -> Column:
    return F.coalesce(_lookup({c: u for c, _, u in dims.METRICS}, resolve_legacy(code)), F.lit(""))


def norm_metric(name: Column) -> Column:
    """Metric code: exact alias, alias after `_` and `-` became blanks, else the longest alias
    contained in the text (listing order on ties). NULL if none."""
    rows = dims.metric_alias_rows()
    exact = {a: c for a, c, _ in rows}
    ordered = sorted(rows, key=lambda r: (-len(r[0]), r[2]))
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("code"))
                      for a, c, _ in ordered])

    def look_up(low: Column) -> Column:
        contained = F.get(F.filter(table, lambda r: F.contains(low, r["alias"])), 0)["code"]
        return F.coalesce(_lookup(exact, low), _lookup(exact, F.translate(low, "_-", "  ")), contained)

    return let(F.lower(F.trim(name)), look_up)


def norm_unit(raw: Column, strict: bool = False) -> Column:
    """Canonical unit, '' when unknown. Compound units (`m3/t`, `sq km`, `kWh/t`) are tested before
    their parts; strict=True keeps the original order, in which `m3/t` reads as `T`."""
    ordered = list(dims.UNIT_PATTERNS)
    if not strict:
        compound = [p for p in ordered if p[1] in ("m3/t", "sq km", "kcal/kg")]
        ordered = compound + [(r"\b(kwh\s*/\s*t)\b", "kWh/t")] + ordered
    return let(F.trim(raw), lambda t: first_match(
        [(t.rlike("(?i)" + p), F.lit(u)) for p, u in ordered], F.lit("")))


def unit_or_null(raw: Column, strict: bool = False) -> Column:
    return F.nullif(norm_unit(raw, strict), F.lit(""))


def earliest_org(text: Column) -> Column:
    """Organisation code that appears first in a text."""
    spots = F.array(*[
        F.when(text.rlike(rf"(?i)\b{c}\b"),
               F.struct(F.regexp_instr(text, F.lit(rf"(?i)\b{c}\b")).alias("pos"),
                        F.lit(i).alias("ord"), F.lit(c).alias("code")))
        for i, c in enumerate(dims.ORG_CODES)])
    return F.array_min(F.array_compact(spots))["code"]


def identify_metric(question: Column) -> Column:
    """Metric code a question is about, by word stems in fixed precedence."""
    low = F.lower(question)

    def stem(words: list[str]) -> Column:
        alternatives = "|".join(regex_escape(w) for w in words)
        return low.rlike(rf"\b(?:{alternatives})(?:s|es|ed|ing|er|ers)?\b")

    rules = []
    for words, code in dims.QUESTION_METRICS:
        cond = stem(words)
        if code == "PRODUCTION_TARGET":
            cond = cond & ~stem(["achievement"])
        if code == "COAL_PRODUCTION":
            cond = cond | F.contains(low, F.lit("total coal"))
        rules.append((cond, F.lit(code)))
    return first_match(rules)


def question_metric(text: Column) -> Column:
    """Longest metric alias that stands in the text as whole words; else norm_metric."""
    ordered = sorted(dims.metric_alias_rows(), key=lambda r: (-len(r[0]), r[2]))
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(rf"\b{regex_escape(a)}\b").alias("p"),
                               F.lit(c).alias("code")) for a, c, _ in ordered])

    def worded(low: Column) -> Column:
        # the plain contains goes first, so that few patterns are run
        return F.get(F.filter(table, lambda r: F.contains(low, r["alias"])
                              & F.regexp_like(low, r["p"])), 0)["code"]

    return F.coalesce(let(F.lower(text), worded), norm_metric(text))


def question_orgs(text: Column) -> Column:
    """All organisation codes a text names, in vocabulary order."""
    names: dict[str, list[str]] = {}
    for alias, code, _ in dims.ORGS:
        names.setdefault(code, []).append(alias)
    low = F.lower(text)
    hits = F.array(*[
        F.when(low.rlike(r"\b(?:" + "|".join(aliases) + r")\b"), F.lit(code))
        for code, aliases in names.items()])
    return F.array_compact(hits)


def question_site(text: Column) -> Column:
    """struct(site, owner): a known site, else a word before OCP / UG / Colliery / Mine / Block."""
    low = F.lower(text)
    known = F.get(F.array_compact(F.array(*[
        F.when(low.rlike(rf"\b{s}\b"), F.struct(F.lit(s.title()).alias("site"),
                                               F.lit(o).alias("owner")))
        for s, o in dims.SITES.items()])), 0)
    named = F.nullif(F.regexp_extract(
        text, r"(?i)\b([A-Za-z0-9-]+\s+(?:OCP|UG|OC|Colliery|Mine|Block))\b", 1), F.lit(""))
    return F.struct(F.coalesce(known["site"], named).alias("site"), known["owner"].alias("owner"))


def all_entities_flag(text: Column) -> Column:
    return F.lower(text).rlike(
        r"\b(?:all\s+subsidiaries|across\s+subsidiaries|each\s+subsidiary|subsidiary\s+wise)\b")


def question_tags(text: Column) -> Column:
    """struct(intent, org, metric_code, period, claimed) of a question, worked out once per text."""
    from ledgerlake.functions.period import question_period

    return let(text, lambda t: F.struct(
        tag_intent(t)["intent"].alias("intent"), F.get(question_orgs(t), 0).alias("org"),
        question_metric(t).alias("metric_code"), question_period(t)["period"].alias("period"),
        claimed_number(t).alias("claimed")))


def period_and_org(question: Column) -> Column:
    """struct(period, org) as written in a question."""
    raw = F.upper(F.regexp_extract(
        question, r"(?i)(FY\s*20\d{2}[-–]\d{2,4}|FY\s*\d{2}[-–]\d{2}|20\d{2}[-–]\d{2,4})", 1))
    period = F.when(raw != "", F.replace(
        F.when(F.startswith(raw, F.lit("FY")), raw).otherwise(F.concat(F.lit("FY "), raw)),
        F.lit("–"), F.lit("-")))
    org = first_match([(question.rlike(rf"(?i)\b{c}\b"), F.lit(c))
                       for c in dims.QUESTION_ORG_CODES])
    return F.struct(period.alias("period"), org.alias("org"))


def claimed_number(text: Column) -> Column:
    """Number claimed by a sentence: before a unit, else after a verb, else any."""
    patterns = [
        r"(?i)\b(\d+(?:\.\d+)?)\s*(?:mt|bcm|mm3|m|%|inr|cr|crore)\b",
        r"(?i)\b(?:was|is|reached|achieved|stands at|produced|drilled|of)\s*(\d+(?:\.\d+)?)",
        r"\b(\d+(?:\.\d+)?)\b"]
    return F.coalesce(*[
        F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for p in patterns])


def extract_entities(text: Column) -> Column:
    """struct(org, period, seam, site, project) found in a text by patterns."""
    from ledgerlake.functions.period import extract_period

    seam = F.regexp_extract(
        text, r"(?i)\b(?:seam\s*[-–:]?\s*([IVXLCDM\d]+[A-Z]?|top|bottom|middle|comb(?:ined)?))\b", 1)
    # tried once per run of site characters, from its first word on: linear in the text
    site = F.trim(F.regexp_extract(
        text, r"(?i)(?<![A-Za-z0-9\s-])(?>[A-Za-z0-9\s-]*?\b)([A-Za-z0-9\s-]+?\s(?:OCP|UG|OC|Colliery|Mine|Block))\b", 1))
    project = F.trim(F.regexp_extract(
        text, r"(?i)\b(?:Project|Area|Division)\s*[-–:]?\s*([A-Za-z0-9\s-]+)\b", 1))

    def short(c: Column) -> Column:
        return F.when((c != "") & (F.size(F.split(c, r"\s+")) <= 4), c)

    return F.struct(
        earliest_org(text).alias("org"), extract_period(text).alias("period"),
        F.when(seam != "", F.concat(F.lit("Seam "), F.upper(seam))).alias("seam"),
        short(site).alias("site"), short(project).alias("project"))


def tag_intent(question: Column) -> Column:
    """struct(intent, confidence); rules are tried in vocabulary order, the first hit wins."""
    return let(F.lower(F.trim(F.coalesce(question, F.lit("")))), _tag_lowered)


def _tag_lowered(t: Column) -> Column:
    words = F.size(F.regexp_extract_all(t, F.lit(r"\b(\w+)\b"), 1))

    def tag(name: str, conf: float) -> Column:
        return F.struct(F.lit(name).alias("intent"), F.lit(conf).alias("confidence"))

    rules = [(t == "", tag("UNKNOWN", 0.0))]
    for name, patterns in dims.INTENTS.items():
        cond = t.rlike("|".join(f"(?:{p})" for p in patterns))
        if name == "GREETING":
            cond = cond & (words <= 3)
        if name == "HELP":
            cond = cond & (words <= 6)
        rules.append((cond, tag(name, dims.INTENT_CONFIDENCE[name])))
    rules.append((t.rlike(dims.CLAIM_VERB_PATTERN) & t.rlike(dims.CLAIM_NUMBER_PATTERN),
                  tag("FACT_VERIFICATION", 0.85)))
    has_lookup = F.exists(F.array(*[F.lit(w) for w in dims.LOOKUP_WORDS]),
                          lambda w: F.contains(t, w))
    rules.append((has_lookup | norm_metric(t).isNotNull(), tag("METRIC_LOOKUP", 0.85)))
    return first_match(rules, tag("UNKNOWN", 0.40))
