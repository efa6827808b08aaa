"""Accuracy against known truth: by file and by span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollup import ratio


def categorize_path(relative_path: Column) -> Column:
    """Category of a corpus file from its first directory; files at the root are unknown."""
    parts = F.split(relative_path, "/")
    top = F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))
    return (
        F.when(top.isin("hr", "finance", "medical"), "sensitive")
        .when(top == "test_data", "test_data")
        .when(top == "general", "clean")
        .otherwise("unknown")
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add precision, recall, F1 and, where true negatives are known, the false-positive rate."""
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    out = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1_score", ratio(2 * p * r, p + r))
    if "true_negatives" in counts.columns:
        out = out.withColumn("false_positive_rate", ratio(fp, fp + F.col("true_negatives")))
    return out


def file_confusion(scored: DataFrame, *keys: str) -> DataFrame:
    """Confusion over files with ``category`` and ``has_sensitive_data``; test files do not count."""
    sensitive, clean = F.col("category") == "sensitive", F.col("category") == "clean"
    hit = F.col("has_sensitive_data")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(sensitive).alias("files_with_planted_data"),
        F.count_if(clean).alias("files_clean"),
        F.count_if(F.col("category") == "test_data").alias("files_test_data"),
        F.count_if(sensitive & hit).alias("true_positives"),
        F.count_if(clean & hit).alias("false_positives"),
        F.count_if(sensitive & ~hit).alias("false_negatives"),
        F.count_if(clean & ~hit).alias("true_negatives"),
    )


def span_overlaps(found: DataFrame, planted: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Both span sets as rows, each telling whether a span of the other set of its type overlaps it.

    Both frames have (doc_key, entity_type, start_pos, end_pos), spans of one set being disjoint.
    """
    cols = [doc_key, "entity_type", "start_pos", "end_pos"]
    both = found.select(*cols, F.lit("found").alias("side")).unionByName(
        planted.select(*cols, F.lit("planted").alias("side"))
    )
    return sweep_overlaps(both, doc_key)


def document_overlaps(scored: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The same for documents that carry ``matches`` (real ones count) and ``planted`` spans: one pass."""

    def tagged(column: str, side: str) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(
                s["entity_type"].alias("entity_type"), s["start"].alias("start_pos"), s["end"].alias("end_pos"),
                F.lit(side).alias("side"),
            ),
        )

    real = scored.withColumn("_real", F.filter("matches", lambda m: ~m["is_test_data"]))
    spans = F.concat(tagged("_real", "found"), tagged("planted", "planted"))
    return sweep_overlaps(real.select(doc_key, F.inline(spans)), doc_key)


def sweep_overlaps(both: DataFrame, doc_key: str) -> DataFrame:
    """In one sweep per document and type, the nearest span of the other side before (by end) and after
    (by start) decides, so no pairs are formed."""
    w = Window.partitionBy(doc_key, "entity_type")
    # looking ahead is a second running frame in reverse order: frames open at the end are quadratic
    before = w.orderBy("start_pos", "side").rowsBetween(Window.unboundedPreceding, -1)
    after = w.orderBy(F.desc("start_pos"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)

    def other(side: str, name: str, fn, frame) -> Column:
        return fn(F.when(F.col("side") != side, F.col(name))).over(frame)

    def touched(side: str) -> Column:
        ends = other(side, "end_pos", F.max, before)
        starts = other(side, "start_pos", F.min, after)
        return (F.coalesce(ends > F.col("start_pos"), F.lit(False))) | (
            F.coalesce(starts < F.col("end_pos"), F.lit(False))
        )

    return both.withColumn(
        "overlaps", F.when(F.col("side") == "found", touched("found")).otherwise(touched("planted"))
    )


def entity_confusion(overlaps: DataFrame) -> DataFrame:
    """Per type: planted spans found / missed, and found spans without a planted one."""
    planted, hit = F.col("side") == "planted", F.col("overlaps")
    return overlaps.groupBy("entity_type").agg(
        F.count_if(planted & hit).alias("true_positives"),
        F.count_if(~planted & ~hit).alias("false_positives"),
        F.count_if(planted & ~hit).alias("false_negatives"),
    )


def compare_metrics(runs: DataFrame, base: str, other: str) -> DataFrame:
    """Two runs side by side with the relative F1 change of ``base`` over ``other`` in percent."""
    side = lambda run, suffix: runs.filter(F.col("run") == run).select(
        F.lit(1).alias("one"), *[F.col(c).alias(f"{c}_{suffix}") for c in ("precision", "recall", "f1_score")]
    )
    both = side(base, "a").join(side(other, "b"), "one").drop("one")
    a, b = F.col("f1_score_a"), F.col("f1_score_b")
    return both.withColumn("f1_change_pct", F.when((a > 0) & (b > 0), (a - b) / b * 100))
