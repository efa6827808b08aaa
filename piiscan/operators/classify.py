"""Document classification: detect, merge, resolve, flag, label. One narrow stage."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.scalar import is_blank, is_high_sensitivity
from .detect import candidate_spans, to_matches
from .patterns import PatternSpec
from .spans import resolve_spans


def real_matches(matches: Column) -> Column:
    return F.filter(matches, lambda m: ~m["is_test_data"])


def has_sensitive_data(matches: Column) -> Column:
    return F.exists(matches, lambda m: ~m["is_test_data"])


def recommend_label(matches: Column) -> Column:
    """Label from the real matches: their types and the best confidence among all of them."""

    def choose(real: Column) -> Column:
        best = F.array_max(F.transform(real, lambda m: m["confidence"]))
        high = F.exists(real, lambda m: is_high_sensitivity(m["entity_type"]))
        return (
            F.when(F.size(real) == 0, F.lit(None).cast("string"))
            .when(high & (best >= 0.85), "highly_confidential")
            .when(high, "confidential")
            .when(best >= 0.70, "internal")
            .otherwise("public")
        )

    return let(real_matches(matches), choose)


def match_column(
    text: Column,
    patterns: list[PatternSpec] | None = None,
    annotation_spans: Column | None = None,
) -> Column:
    """Resolved matches of a text; annotation spans rank after the rules."""
    candidates = candidate_spans(text, patterns)
    if annotation_spans is not None:
        candidates = F.concat(candidates, annotation_spans)
    return let(
        candidates,
        lambda spans: let(resolve_spans(spans), lambda kept: to_matches(text, kept)),
    )


@lru_cache(maxsize=32)
def _default_match_column(text_col: str, annotation_col: str | None) -> Column:
    """The default rules over named columns: building the expression costs a second, so keep it."""
    return match_column(F.col(text_col), None, F.col(annotation_col) if annotation_col else None)


def classify(
    df: DataFrame,
    text_col: str = "text",
    patterns: list[PatternSpec] | None = None,
    annotation_col: str | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Add ``matches`` and ``label_recommendation``. The text itself is dropped unless asked for,
    so nothing downstream shuffles document bodies."""
    drop = {annotation_col} | (set() if keep_text else {text_col})
    if patterns is None:
        matches = _default_match_column(text_col, annotation_col)
    else:
        matches = match_column(F.col(text_col), patterns, F.col(annotation_col) if annotation_col else None)
    kept = [c for c in df.columns if c not in drop]
    # The generator is a fence: a filter on the matches above it stays there instead of being pushed
    # down as a second copy of the whole detection, while filters on the other columns still reach
    # the scan.
    scanned = df.select(*kept, F.explode(F.array(matches)).alias("matches"))
    return scanned.withColumn("label_recommendation", recommend_label(F.col("matches")))


def scan_documents(
    df: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    patterns: list[PatternSpec] | None = None,
    source: str = "filesystem",
) -> DataFrame:
    """Documents -> file results (``schema.FILE_RESULT`` shape), ready for rollups and the store.

    ``size_bytes``, ``modified``, ``current_label`` and ``error`` are taken from the input if present.
    """
    have = set(df.columns)

    def given(name: str, default: Column, dtype: str) -> Column:
        return (F.col(name) if name in have else default).cast(dtype).alias(name)

    base = df.select(
        F.col(path_col).alias("path"),
        given("source", F.lit(source), "string"),
        given("size_bytes", F.octet_length(F.col(text_col)), "long"),
        given("modified", F.lit(None), "timestamp"),
        given("current_label", F.lit(None), "string"),
        given("error", F.lit(None), "string"),
        F.when(~is_blank(F.col(text_col)), F.col(text_col)).alias("text"),
    )
    return classify(base, "text", patterns).select(
        "path", "source", "size_bytes", "modified", "matches", "label_recommendation",
        "current_label", "error", F.lit(0).alias("scan_time_ms"),
    )
