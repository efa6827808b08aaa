"""Report tables and exports. Rendering is left to the reader of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import badge, confidence_level, confidence_pct, display_name, redact, truncate_path
from ..session import cut_lineage
from .classify import has_sensitive_data, real_matches
from .rollup import chart_rows, entity_totals

_ROW_BITS = 33


def number_rows(df: DataFrame, order_col: str, name: str) -> DataFrame:
    """Consecutive numbers in the order of a (unique) column, without a single-task window.

    Rows are range-partitioned, sorted and written once to the checkpoint folder; a number is then the
    position within the partition plus the rows of the partitions before it. Only the per-partition
    counts (one row per partition) are ranked globally.
    """
    ranged = cut_lineage(
        df.repartitionByRange(F.col(order_col)).sortWithinPartitions(order_col)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part, offset = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return (
        ranged.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(name, F.col("_start") + offset + 1)
        .drop("_at", "_part", "_start")
    )


def entity_chart(findings: DataFrame) -> DataFrame:
    rows = chart_rows(entity_totals(findings))
    return rows.withColumn("display", display_name(F.col("entity_type")))


def file_rows(files: DataFrame, numbered: bool = True) -> DataFrame:
    """One row per sensitive file: number, path, label, badge, types and real match count."""
    real = real_matches(F.col("matches"))
    label = F.coalesce("label_recommendation", F.lit("none"))
    rows = files.filter(has_sensitive_data(F.col("matches"))).select(
        "path",
        truncate_path(F.col("path")).alias("path_display"),
        label.alias("label"),
        display_name(label).alias("label_display"),
        badge(label).alias("badge"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(real, lambda m: m["entity_type"]))), ",").alias("entities"),
        F.size(real).alias("match_count"),
    )
    return number_rows(rows, "path", "file_number") if numbered else rows


def match_rows(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("is_test_data")).select(
        "path",
        display_name(F.col("entity_type")).alias("type_display"),
        redact(F.col("value")).alias("value_redacted"),
        confidence_pct(F.col("confidence")).alias("confidence_pct"),
        "start_pos",
    )


def scan_trend(scans: DataFrame) -> DataFrame:
    """Scans of one source in time order with the change since its previous scan."""
    w = Window.partitionBy("source_path").orderBy("started_at", "scan_id")
    return scans.select(
        "source_path", "scan_id", "started_at", "total_files", "files_with_matches", "total_matches",
        (F.col("total_matches") - F.lag("total_matches").over(w)).alias("matches_change"),
        (F.col("files_with_matches") - F.lag("files_with_matches").over(w)).alias("files_change"),
    )


def export_files_json(files: DataFrame) -> DataFrame:
    """One JSON document per file (values redacted). ``export_header_json`` gives the scan's own row."""
    match = F.transform(
        "matches",
        lambda m: F.struct(
            m["entity_type"].alias("entity_type"),
            redact(m["value"]).alias("value"),
            m["confidence"].alias("confidence"),
            confidence_level(m["confidence"]).alias("confidence_level"),
            m["detector"].alias("detector"),
            m["is_test_data"].alias("is_test_data"),
            m["model_version"].alias("model_version"),
        ),
    )
    body = F.struct(
        "path",
        "size_bytes",
        "modified",
        has_sensitive_data(F.col("matches")).alias("has_sensitive_data"),
        "label_recommendation",
        "error",
        match.alias("matches"),
    )
    return files.select("path", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def export_header_json(scans: DataFrame) -> DataFrame:
    """Scan rows as JSON with their totals nested under ``summary``."""
    summary = F.struct("total_files", "files_with_matches", "files_errored", "total_matches")
    body = F.struct("scan_id", "started_at", "completed_at", "source_path", "source_type", summary.alias("summary"))
    return scans.select("scan_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
