"""Aggregates over files and findings. Group keys are few, so every shuffle is a handful of partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import has_sensitive_data, real_matches


def file_rollup(files: DataFrame) -> DataFrame:
    """Per file, without a shuffle: sensitive?, best confidence (0 if none), types, real match count."""
    m = F.col("matches")
    return files.select(
        "path",
        has_sensitive_data(m).alias("has_sensitive_data"),
        F.coalesce(F.array_max(F.transform(m, lambda x: x["confidence"])), F.lit(0.0)).alias("highest_confidence"),
        F.array_sort(F.array_distinct(F.transform(m, lambda x: x["entity_type"]))).alias("entity_types_found"),
        F.size(real_matches(m)).alias("real_match_count"),
    )


def scan_summary(files: DataFrame, *keys: str) -> DataFrame:
    """Totals of a scan (or of each group of ``keys``) in one pass; matches counts real ones only."""
    per_file = files.select(
        *keys,
        has_sensitive_data(F.col("matches")).alias("hit"),
        F.col("error").isNotNull().alias("failed"),
        F.size(real_matches(F.col("matches"))).alias("n"),
    )
    return per_file.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("hit").alias("files_with_matches"),
        F.count_if("failed").alias("files_errored"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_matches"),
    )


def entity_totals(findings: DataFrame) -> DataFrame:
    """Real matches per type, most frequent first."""
    return (
        findings.filter(~F.col("is_test_data"))
        .groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "entity_type")
    )


def label_totals(files: DataFrame) -> DataFrame:
    return (
        files.filter(F.col("label_recommendation").isNotNull())
        .groupBy("label_recommendation")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .orderBy(F.desc("n_files"), "label_recommendation")
    )


def entity_breakdown(findings: DataFrame, *keys: str) -> DataFrame:
    """Per type: all, real and test matches."""
    return findings.groupBy(*keys, "entity_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_test_data")).alias("real"),
        F.count_if("is_test_data").alias("test_data"),
    )


def store_statistics(scans: DataFrame, files: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: scans, files, matches, real, test, and a map of real matches by type.

    Matches are read once: the per-type breakdown also yields the totals.
    """
    by_type = entity_breakdown(matches)
    totals = by_type.agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("matches"),
        F.coalesce(F.sum("real"), F.lit(0)).cast("bigint").alias("real_matches"),
        F.coalesce(F.sum("test_data"), F.lit(0)).cast("bigint").alias("test_data_matches"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("real") > 0, F.struct("entity_type", "real"))))
        ).alias("by_entity_type"),
    )
    counts = (
        scans.agg(F.count(F.lit(1)).alias("n")).select(F.lit("scans").alias("k"), "n")
        .unionByName(files.agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("k"), "n"))
        .agg(
            F.max(F.when(F.col("k") == "scans", F.col("n"))).alias("scans"),
            F.max(F.when(F.col("k") == "files", F.col("n"))).alias("files"),
        )
    )
    # one row beside one row
    one = F.lit(1).alias("one")
    return counts.select(one, "*").join(totals.select(one, "*"), "one").drop("one")


def audit_statistics(entries: DataFrame, *keys: str) -> DataFrame:
    """Entries, failures, first and last time; grouped by action, user, ... when keys are given."""
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(~F.col("success")).alias("errors"),
        F.min("timestamp").alias("first_entry"),
        F.max("timestamp").alias("last_entry"),
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 when undefined."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def verdict_statistics(verdicts: DataFrame, *keys: str) -> DataFrame:
    v = F.col("verdict")
    counted = verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v == "TP").alias("true_positives"),
        F.count_if(v == "FP").alias("false_positives"),
    )
    return counted.withColumn("accuracy", ratio(F.col("true_positives"), F.col("total")))


def session_statistics(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Review session: every queued sample counts, only TP and FP are reviewed."""
    v = F.col("verdict")
    counted = verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(v.isin("TP", "FP")).alias("reviewed"),
        F.count_if(v == "TP").alias("correct"),
        F.count_if(v == "FP").alias("wrong"),
        F.count_if(v == "skip").alias("skipped"),
    )
    return counted.withColumn("accuracy", ratio(F.col("correct"), F.col("reviewed")))


def column_profile(cell_findings: DataFrame, totals: DataFrame) -> DataFrame:
    """Per table column and type: rows with at least one real match and their share of all rows.

    Findings are rows (column_name, row_key, entity_type, ...); ``totals`` has (column_name, n_rows).
    Rows are de-duplicated per (column, type, row), a high-cardinality key, before counting.
    """
    hits = (
        cell_findings.filter(~F.col("is_test_data"))
        .select("column_name", "entity_type", "row_key")
        .distinct()
        .groupBy("column_name", "entity_type")
        .agg(F.count(F.lit(1)).alias("rows_with_entity"))
    )
    return hits.join(totals, "column_name").withColumn(
        "share", ratio(F.col("rows_with_entity"), F.col("n_rows"))
    )


def chart_rows(totals: DataFrame, key: str = "entity_type", count: str = "n") -> DataFrame:
    """Share of the largest bar. The window spans the already aggregated rows (one per type)."""
    return totals.withColumn("percent", F.col(count) * 100.0 / F.max(count).over(Window.partitionBy()))


def recent(scans: DataFrame, limit: int = 100) -> DataFrame:
    """Latest scans first (top-k per task, then one merge)."""
    return scans.orderBy(F.desc("started_at"), "scan_id").limit(limit)


def last_files_with_matches(files: DataFrame, order_col: str, limit: int = 3) -> DataFrame:
    """The last files with sensitive data and up to three of their types."""
    return (
        files.filter(has_sensitive_data(F.col("matches")))
        .orderBy(F.desc(order_col))
        .limit(limit)
        .select(
            order_col,
            "path",
            F.transform(F.slice(real_matches(F.col("matches")), 1, 3), lambda m: m["entity_type"]).alias("types"),
        )
    )
