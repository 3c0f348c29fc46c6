"""Reporting periods: normalisation, extraction, grain and fiscal-year keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake import dims
from ledgerlake.functions.text import first_match, let

def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _two(text: Column) -> Column:
    return F.right(text, F.lit(2))


def _written(kind: str, t: Column, pattern: str) -> Column:
    """The canonical form of what a pattern of dims.PERIOD_FORMS finds first in a text."""
    one, two = _part(t, pattern, 1), _part(t, pattern, 2)
    if kind == "RANGE":
        return F.concat(F.lit("FY "), one, F.lit("-"), _two(two))
    if kind == "END":
        end = one.try_cast("int")
        return F.concat(F.lit("FY "), (end - 1).cast("string"), F.lit("-"), _two(one))
    if kind == "QUARTER":
        last = _part(t, pattern, 3)
        return F.concat(F.upper(one), F.lit(" FY "), F.concat_ws("-", two, F.nullif(_two(last), F.lit(""))))
    return F.concat_ws(" ", F.initcap(F.lower(F.left(one, F.lit(3)))), two)


def norm_period(raw: Column) -> Column:
    """Canonical `FY 2024-25`, `Q2 FY 2024-25` or `Apr 2024`; NULL when nothing is recognised."""
    return let(F.trim(raw), lambda t: first_match([(t.rlike(p), _written(kind, t, p)) for kind, p in dims.PERIOD_FORMS]))


def extract_periods(text: Column, quarter_first: bool = True) -> Column:
    """All distinct periods of a text, form by form.

    quarter_first=False tests full years before quarters, so `Q2 FY 2024-25` reads as the year.
    """
    place = {"QUARTER": 0 if quarter_first else 2, "MONTH": 3}
    forms = sorted(dims.PERIOD_FORMS, key=lambda f: place.get(f[0], 1))
    hits = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for _, p in forms])
    return F.array_distinct(F.array_compact(F.transform(hits, lambda h: norm_period(h))))


def extract_period(text: Column, quarter_first: bool = True) -> Column:
    return F.get(extract_periods(text, quarter_first), 0)


def period_key(period: Column) -> Column:
    """Key under which periods count as the same one in duplicate detection."""
    t = F.replace(F.upper(F.trim(F.coalesce(period, F.lit("")))), F.lit("–"), F.lit("-"))
    hit = F.regexp_extract(t, r"20\d{2}[-/]\d{2,4}", 0)
    return F.when(hit == "", t).otherwise(
        F.concat(F.lit("FY "), F.left(hit, F.lit(4)), F.lit("-"), F.right(hit, F.lit(2))))


def infer_grain(period: Column, grain: Column | None = None, strict: bool = False) -> Column:
    """Given grain, else QUARTERLY / MONTHLY / ANNUAL / ANY from the period text.

    A full `FY dddd-dd` is annual before month numbers are looked for (`FY 2005-06`);
    strict=True keeps the original order, in which `-06` reads as June.
    """
    p = F.upper(period)
    rules = [
        (period.isNull() | (period == ""), F.lit("ANY")),
        (p.rlike("Q[1-4]|QUARTER"), F.lit("QUARTERLY"))]
    if not strict:
        rules.append((p.rlike(r"^\s*FY\s*\d{4}-\d{2}\s*$"), F.lit("ANNUAL")))
    rules += [
        (p.rlike("|".join(dims.MONTHS) + "|-0[1-6]"), F.lit("MONTHLY")),
        (p.rlike(r"FY|ANNUAL|20\d{2}-\d{2}"), F.lit("ANNUAL"))]
    inferred = first_match(rules, F.lit("ANY"))
    if grain is None:
        return inferred
    return F.when(F.coalesce(grain, F.lit("")) != "", F.upper(grain)).otherwise(inferred)


def fy_key(period: Column, strict: bool = False) -> Column:
    """Fiscal year (April start) a period belongs to, as `2024-25`.

    `20dd-dd` counts as a fiscal year only when the second year follows the first;
    strict=True takes any `20dd-dd`.
    """
    p = F.coalesce(period, F.lit(""))
    up = F.upper(p)
    hit = F.regexp_extract(p, r"20\d{2}[-–]\d{2,4}", 0)
    y1, y2 = F.substring(hit, 3, 2), F.right(hit, F.lit(2))
    direct = hit != ""
    if not strict:
        direct = direct & ((y1.cast("int") + 1) % 100 == y2.cast("int"))
    year = _part(p, r"(20\d{2})", 1).try_cast("int")
    named = first_match([(F.contains(up, F.lit(m)), F.lit(i + 1)) for i, m in enumerate(dims.MONTHS)])
    numeric = _part(p, r"(?:^|[^\d])(0?[1-9]|1[0-2])(?:[^\d]|$)", 1).try_cast("int")
    month = F.coalesce(named, numeric)
    start = F.when(month >= 4, year).otherwise(year - 1)
    from_month = F.concat(
        start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))
    return first_match([
        (p == "", F.lit("")),
        (direct, F.concat(F.left(hit, F.lit(4)), F.lit("-"), y2)),
        (year.isNotNull() & month.isNotNull(), from_month),
        (up.rlike(r"FY\s*\d{4}-\d{2,4}"),
         F.replace(_part(up, r"(FY\s*\d{4}-\d{2,4})", 1), F.lit(" "), F.lit(""))),
    ], up)


def question_period(text: Column) -> Column:
    """struct(period, period_type) named by a question."""
    custom = r"(?i)\b(q[1-4])\s*(?:of\s*)?(?:fy\s*)?(\d{2,4})(?:[-/](\d{2,4}))?\b"
    y1, y2 = _part(text, custom, 2), _part(text, custom, 3)
    long_y1 = F.when(F.length(y1) == 4, y1).otherwise(F.concat(F.lit("20"), y1))
    fallback = F.when(text.rlike(custom), F.concat(
        F.upper(_part(text, custom, 1)), F.lit(" FY "),
        F.when(y2 == "", y1).otherwise(F.concat(long_y1, F.lit("-"), F.right(y2, F.lit(2))))))
    period = F.coalesce(extract_period(text), fallback, norm_period(text))
    kind = first_match([
        (period.isNull(), F.lit(None).cast("string")),
        (F.contains(period, F.lit("Q")), F.lit("QUARTER_FY")),
        (F.startswith(period, F.lit("FY")), F.lit("ANNUAL_FY"))], F.lit("OTHER"))
    return F.struct(period.alias("period"), kind.alias("period_type"))
