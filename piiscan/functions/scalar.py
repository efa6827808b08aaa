"""Column -> Column functions. All run inside the JVM; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENTITY_FAMILY, HIGH_SENSITIVITY_TYPES
from .regexes import NON_BLANK, SEPARATORS


# --- validators ----------------------------------------------------------------------------------


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{Nd}]", "")


def ssn_valid(value: Column) -> Column:
    """Nine digits whose area, group and serial numbers can be issued."""
    digits = digits_of(value)
    area = F.substring(digits, 1, 3)
    return (
        (F.length(digits) == 9)
        & (area != "000")
        & (area != "666")
        & (area < "900")
        & (F.substring(digits, 4, 2) != "00")
        & (F.substring(digits, 6, 4) != "0000")
    )


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits, separators ignored, with a correct check digit."""
    digits = digits_of(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


# --- values and contexts -------------------------------------------------------------------------


def normalize_value(value: Column) -> Column:
    """Lower case without separators: the key for comparing values."""
    return F.regexp_replace(F.lower(value), SEPARATORS, "")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u212a"
_LOWER = "abcdefghijklmnopqrstuvwxyzk"


def is_test_value(value: Column, literals: list[str]) -> Column:
    """Equal, after normalising, to one of the known example values.

    The literals are ASCII, and these are the only characters whose lower case is ASCII, so a
    translation table replaces ``lower`` (whose first call loads the ICU data in every executor).
    """
    if not literals:
        return F.lit(False)
    keys = list(dict.fromkeys(_normalize_literal(v) for v in literals))
    lowered = F.translate(value, _UPPER, _LOWER)
    return F.regexp_replace(lowered, SEPARATORS, "").isin(keys)


def _normalize_literal(value: str) -> str:
    return "".join(c for c in value.lower() if c not in "-.()" and not c.isspace())


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(NON_BLANK), F.lit(True))


def redact(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2)))
    )


def token(entity_type: Column) -> Column:
    return F.concat(F.lit("["), F.upper(entity_type), F.lit("]"))


def anonymize_context(context: Column, value: Column, entity_type: Column) -> Column:
    """Every occurrence of the value becomes its token (literal replacement, not a pattern)."""
    return F.replace(context, value, token(entity_type))


def context_bounds(start: Column, end: Column, text: Column, width: int = 50) -> tuple[Column, Column]:
    """First and one-past-last offset of the window around a span, clamped to the text."""
    return F.greatest(start - width, F.lit(0)), F.least(F.length(text), end + width)


def context_window(text: Column, start: Column, end: Column, width: int = 50) -> Column:
    begin = F.greatest(start - width, F.lit(0))
    return F.substring(text, begin + 1, end + width - begin)


def anonymize_span(text: Column, start: Column, end: Column, entity_type: Column, width: int = 50) -> Column:
    """Context window with only the span itself replaced, by position."""
    begin = F.greatest(start - width, F.lit(0))
    return F.concat(
        F.substring(text, begin + 1, start - begin),
        token(entity_type),
        F.substring(text, end + 1, F.lit(width)),
    )


# --- classification of types and scores ----------------------------------------------------------


def confidence_level(score: Column) -> Column:
    return (
        F.when(score >= 0.95, "very_high").when(score >= 0.85, "high").when(score >= 0.70, "medium").otherwise("low")
    )


def confidence_pct(score: Column) -> Column:
    return (score * 100).cast("int")


def entity_family(entity_type: Column) -> Column:
    pairs = [F.lit(x) for kv in ENTITY_FAMILY.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), entity_type)


def is_high_sensitivity(entity_type: Column) -> Column:
    return entity_type.isin(HIGH_SENSITIVITY_TYPES)


# --- names and labels ----------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def file_type(path: Column) -> Column:
    """Suffix of the last path component, case kept; empty for dotfiles and trailing dots."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def display_name(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def truncate_path(path: Column, limit: int = 80) -> Column:
    return F.when(F.length(path) <= limit, path).otherwise(
        F.concat(F.lit("..."), F.right(path, F.lit(limit - 3)))
    )


def badge(label: Column) -> Column:
    label = F.coalesce(label, F.lit("none"))
    return (
        F.when(label.contains("highly") | label.contains("confidential"), "high")
        .when(label == "internal", "medium")
        .otherwise("low")
    )


def duration_seconds(started: Column, completed: Column) -> Column:
    micros = F.unix_micros(completed) - F.unix_micros(started)
    return F.coalesce(micros / F.lit(1_000_000.0), F.lit(0.0))


def is_guid(label: Column) -> Column:
    return (F.length(label) == 36) & (F.regexp_count(label, F.lit("-")) == 4)


def normalize_label_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def label_key(name: Column) -> Column:
    """Label names compared without case, blanks or underscores."""
    return F.replace(normalize_label_name(name), F.lit("_"), F.lit(""))
