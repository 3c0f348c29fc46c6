"""Text scalars as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake import dims


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value bound once.

    Long rule chains that use their input many times stay small in generated code this way (methods
    above the JIT limit would run interpreted), and the input is not computed per use.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_match(rules: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Value of the first rule whose condition holds."""
    out = F.when(*rules[0])
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def regex_escape(word: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in word)


def has_word(text: Column, word: str) -> Column:
    """Whole-word, case-insensitive contains ("top" is not in "stopped")."""
    return text.rlike(rf"(?i)\b{regex_escape(word)}\b")


def has_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def redact_injection(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + dims.INJECTION_PATTERN, "[redacted instruction]")


def lead_sentences(text: Column, n: int = 2, min_chars: int = 10) -> Column:
    """First n sentences of at least min_chars that carry no instruction-like phrase."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    kept = F.filter(
        parts,
        lambda s: (F.length(s) >= min_chars) & ~s.rlike("(?i)" + dims.INJECTION_PATTERN))
    return F.array_join(F.slice(kept, 1, n), " ")


def snippet(text: Column, start: Column, length: Column, around: int = 40) -> Column:
    """Text round a match; start is 1-based."""
    begin = F.greatest(start - around, F.lit(1))
    end = F.least(start + length - 1 + around, F.length(text))
    return F.concat(F.lit("..."), F.trim(F.substr(text, begin, end - begin + 1)), F.lit("..."))


def label(code: Column) -> Column:
    return F.initcap(F.lower(F.replace(code, F.lit("_"), F.lit(" "))))


def location(sheet: Column, cell: Column, row: Column, column: Column, page: Column) -> Column:
    """`Sheet: a · Cell: B2 · Row: 2 · Col: x · Page: 3`, absent parts left out, NULL if none."""
    text = F.concat_ws(
        " · ",
        F.concat(F.lit("Sheet: "), sheet), F.concat(F.lit("Cell: "), cell),
        F.concat(F.lit("Row: "), row.cast("string")), F.concat(F.lit("Col: "), column),
        F.concat(F.lit("Page: "), page.cast("string")))
    return blank_to_null(text)


def chunk_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(text, r"^\s+|\s+$", ""), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def query_terms(text: Column) -> Column:
    """Words of three or more characters without stopwords, in order, repeats kept;
    if none is left, letters-only words of two or more."""
    low = F.lower(text)
    stop = F.array(*[F.lit(w) for w in dims.STOPWORDS])
    long_words = F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]{3,})"), 1),
                          lambda w: ~F.array_contains(stop, w))
    short_words = F.filter(F.regexp_extract_all(low, F.lit(r"\b([a-z]{2,})\b"), 1),
                           lambda w: ~F.array_contains(stop, w))
    return F.when(F.size(long_words) > 0, long_words).otherwise(short_words)


def parse_number(text: Column) -> Column:
    """First signed number after currency signs and thousands commas are gone; round 4.
    NULL above 1e12."""
    clean = F.regexp_replace(F.trim(text), r"^[₹$€£\s]+", "")
    clean = F.regexp_replace(clean, r"(?<=\d),(?=\d)", "")
    digits = F.regexp_extract(clean, r"([-+]?[0-9]*\.?[0-9]+)", 1)
    value = F.nullif(digits, F.lit("")).try_cast("double")
    return F.when(F.abs(value) <= 1e12, F.round(value, 4))


def is_valid_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def a1_column(index: Column) -> Column:
    """1-based column number to letters, two letters beyond Z (up to ZZ)."""
    zero = index - 1
    one = F.char(F.lit(65) + zero % 26)
    return F.when(index <= 26, one).otherwise(
        F.concat(F.char(F.lit(64) + F.floor(zero / 26)), one))


def doc_category(name: Column, preview: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, preview))
    return first_match(
        [(has_any(text, words), F.lit(cat)) for cat, words in dims.DOC_CATEGORIES],
        F.lit(dims.DEFAULT_DOC_CATEGORY))


def filename_category(name: Column, current: Column | None = None) -> Column:
    low = F.lower(name)
    guess = first_match(
        [(F.contains(low, F.lit(w)), F.lit(cat)) for w, cat in dims.FILENAME_CATEGORIES],
        F.lit(dims.DEFAULT_FILENAME_CATEGORY))
    if current is None:
        return guess
    return F.when(current != dims.DEFAULT_FILENAME_CATEGORY, current).otherwise(guess)


def source_type(extension: Column, scanned: Column) -> Column:
    ext = F.upper(extension)
    return first_match(
        [((ext == "PDF") & scanned, F.lit("SCANNED_PDF")),
         (ext == "PDF", F.lit("DIGITAL_PDF")),
         (ext.isin("XLSX", "XLS", "CSV", "TXT"), ext),
         (ext.isin("PNG", "JPG", "JPEG"), F.lit("IMAGE"))],
        F.lit("UNKNOWN"))
