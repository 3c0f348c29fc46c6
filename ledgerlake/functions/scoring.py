"""Confidence, status and quality scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.text import first_match

DEC = "decimal(10,4)"


def _dec(x: float) -> Column:
    return F.lit(str(x)).cast(DEC)


def fact_confidence(method: Column, has_unit: Column, has_period: Column, has_org: Column,
                    quality: Column, ocr: Column, approximate: Column,
                    spreadsheet: Column) -> Column:
    """Confidence of an extracted fact, 0.10-0.99. Added up in decimals, so no binary drift."""
    ocr_part = F.round(F.coalesce(ocr, F.lit(0.7)).cast(DEC) * _dec(0.25), 4)
    base = first_match([
        (method == "STRUCTURED_TABLE", _dec(0.88) + F.when(spreadsheet, _dec(0.04)).otherwise(_dec(0))),
        (method == "REGEX_PATTERN", _dec(0.75) + _dec(0)),
        (method == "OCR_BLOCK", _dec(0.55) + ocr_part.cast(DEC))], _dec(0.65) + _dec(0))
    q = quality.cast(DEC)
    penalty = F.when(q < _dec(0.75), F.round((_dec(0.75) - q) * _dec(0.35), 2)).otherwise(_dec(0))
    score = (base
             + F.when(has_unit, _dec(0.04)).otherwise(_dec(-0.05))
             + F.when(has_period, _dec(0.04)).otherwise(_dec(-0.05))
             + F.when(has_org, _dec(0.04)).otherwise(_dec(0))
             - penalty
             - F.when(approximate, _dec(0.10)).otherwise(_dec(0)))
    return F.greatest(F.lit(0.10), F.least(F.lit(0.99), F.round(score, 2).cast("double")))


def confidence_rationale(method: Column, has_unit: Column, has_period: Column, has_org: Column,
                         quality: Column, ocr: Column, approximate: Column,
                         spreadsheet: Column) -> Column:
    """Readable reasons behind fact_confidence, joined by ` | `."""
    pct = F.coalesce(ocr, F.lit(0.7)) * 100
    ocr_text = F.format_string("recognised text, %.0f%% sure (+%.2f)",
                               pct, F.lit(0.55) + pct / 400)
    penalty = F.round((F.lit("0.75").cast(DEC) - quality.cast(DEC)) * F.lit("0.35").cast(DEC), 2)
    return F.concat_ws(
        " | ",
        first_match([
            (method == "STRUCTURED_TABLE",
             F.lit("table cell (+0.88)")),
            (method == "REGEX_PATTERN",
             F.lit("pattern in text (+0.75)")),
            (method == "OCR_BLOCK", ocr_text)],
            F.lit("other reading (+0.65)")),
        F.when((method == "STRUCTURED_TABLE") & spreadsheet,
               "spreadsheet (+0.04)"),
        F.when(has_unit, "unit known (+0.04)")
        .otherwise("no unit (-0.05)"),
        F.when(has_period, "period known (+0.04)")
        .otherwise("no period (-0.05)"),
        F.when(has_org, "organisation known (+0.04)"),
        F.when(quality < 0.75, F.concat(
            F.lit("quality of the source (-"),
            penalty.cast("decimal(10,2)").cast("string"), F.lit(")"))),
        F.when(approximate, "an estimate (-0.10)"))


def initial_status(confidence: Column) -> Column:
    return (F.when(confidence >= 0.90, "HIGH_CONFIDENCE")
            .when(confidence >= 0.70, "NEEDS_REVIEW").otherwise("REVIEW_REQUIRED"))


def quality_label(score: Column) -> Column:
    return (F.when(score >= 0.85, "EXCELLENT").when(score >= 0.70, "GOOD")
            .when(score >= 0.50, "FAIR").when(score >= 0.30, "POOR").otherwise("UNREADABLE"))


def table_quality_score(rows: Column, cols: Column, nulls: Column) -> Column:
    """1 - 0.4 * share of empty cells, less 0.15 for a single column; 0.1 for no rows."""
    ratio = (nulls.cast("decimal(20,0)") / F.greatest(rows * cols, F.lit(1)).cast("decimal(20,0)"))
    score = F.lit(1).cast("decimal(20,10)") - ratio.cast("decimal(20,10)") * F.lit("0.4").cast("decimal(10,1)")
    score = score - F.when(cols < 2, F.lit("0.15").cast("decimal(10,2)")).otherwise(
        F.lit(0).cast("decimal(10,2)"))
    clamped = F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.round(score, 2).cast("double")))
    return F.when(rows == 0, F.lit(0.1)).otherwise(clamped)


def text_quality_score(chars: Column) -> Column:
    return F.when(chars == 0, 0.0).when(chars < 100, 0.6).otherwise(0.95)


def answer_confidence(is_calc: Column, is_lookup: Column, used: Column, verified: Column,
                      documents: Column, conflict: Column, has_period: Column,
                      has_entity: Column) -> Column:
    """Confidence of an answer, 0 without evidence, else 0.10-1.0."""
    text_base = F.least(_dec(0.75), (_dec(0.50) + used.cast("decimal(10,0)") * _dec(0.05)).cast(DEC))
    base = F.when(is_calc, _dec(0.90)).when(is_lookup, _dec(0.85)).otherwise(text_base)
    score = (base
             + F.when(verified == used, _dec(0.10))
             .when(verified * 2 >= used, _dec(0.05)).otherwise(_dec(0))
             + F.when(documents >= 2, _dec(0.05)).otherwise(_dec(0))
             - F.when(conflict, _dec(0.30)).otherwise(_dec(0))
             - F.when(has_period, _dec(0)).otherwise(_dec(0.10))
             - F.when(has_entity, _dec(0)).otherwise(_dec(0.05)))
    final = F.greatest(F.lit(0.10), F.least(F.lit(1.0), F.round(score, 2).cast("double")))
    return F.when(used == 0, 0.0).otherwise(final)


def answer_level(score: Column) -> Column:
    return F.when(score >= 0.85, "HIGH").when(score >= 0.60, "MEDIUM").otherwise("LOW")


def lookup_confidence(mean_confidence: Column, verified_share: Column) -> Column:
    raw = mean_confidence * 0.7 + verified_share * 0.3
    return F.least(F.lit(0.99), F.greatest(F.lit(0.85), F.round(raw, 4)))
