"""Predicates over findings (one row per match) and file results (one row per document)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import confidence_level, redact
from .classify import has_sensitive_data
from .detect import explode_findings


def flatten_findings(files: DataFrame) -> DataFrame:
    """File results -> one row per match with ``start_pos``/``end_pos``, redacted value and band."""
    rows = explode_findings(files)
    return (
        rows.withColumnRenamed("start", "start_pos")
        .withColumnRenamed("end", "end_pos")
        .withColumn("value_redacted", redact(F.col("value")))
        .withColumn("confidence_level", confidence_level(F.col("confidence")))
    )


def filter_findings(
    findings: DataFrame,
    scan_id: str | None = None,
    entity_type: str | None = None,
    min_confidence: float = 0.0,
    include_test_data: bool = False,
) -> DataFrame:
    """Conjunction of the given conditions; all of them reach the Parquet scan."""
    keep: Column = F.col("confidence") >= min_confidence
    if scan_id:
        keep = keep & (F.col("scan_id") == scan_id)
    if entity_type:
        keep = keep & (F.col("entity_type") == entity_type)
    if not include_test_data:
        keep = keep & ~F.col("is_test_data")
    return findings.filter(keep)


def with_file(matches: DataFrame, files: DataFrame) -> DataFrame:
    """Matches with the path and source of their file (equi-join on scan and file id)."""
    f = files.select(
        "scan_id",
        F.col("id").alias("file_id"),
        F.col("path").alias("file_path"),
        F.col("source").alias("file_source"),
    )
    return matches.join(f, ["scan_id", "file_id"], "inner")


def filter_files(
    files: DataFrame,
    path_contains: str | None = None,
    label: str | None = None,
    entity_type: str | None = None,
) -> DataFrame:
    """Report filters: part of the path (case-insensitive), exact label, contained entity type."""
    if path_contains:
        files = files.filter(F.contains(F.lower("path"), F.lit(path_contains.lower())))
    if label:
        files = files.filter(F.coalesce(F.col("label_recommendation"), F.lit("none")) == label)
    if entity_type:
        files = files.filter(
            F.exists("matches", lambda m: ~m["is_test_data"] & (m["entity_type"] == entity_type))
        )
    return files


def sensitive_files(files: DataFrame) -> DataFrame:
    return files.filter(has_sensitive_data(F.col("matches")))


def compare_runs(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that appeared or disappeared between two runs, with the number of copies.

    One signed count per finding replaces two multiset differences: both runs are partially
    aggregated on the map side and shuffled once.
    """
    signed = before.select(*keys, F.lit(-1).alias("sign")).unionByName(after.select(*keys, F.lit(1).alias("sign")))
    net = signed.groupBy(*keys).agg(F.sum("sign").alias("net")).filter(F.col("net") != 0)
    return net.select(
        *keys,
        F.when(F.col("net") > 0, "appeared").otherwise("disappeared").alias("change"),
        F.abs("net").alias("copies"),
    )


def rebuild_files(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Files with their matches nested again, in offset order; files without matches keep an empty array.

    The group is one document's matches, and document bodies are not part of either side.
    """
    fields = [
        "entity_type", "value", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"),
        "confidence", "detector", "context", "is_test_data", "model_version",
    ]
    nested = matches.groupBy("scan_id", "file_id").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("start_pos").alias("at"), F.struct(*fields).alias("m")))
        ).alias("ordered")
    )
    joined = files.withColumnRenamed("id", "file_id").join(nested, ["scan_id", "file_id"], "left")
    return joined.withColumn(
        "matches", F.coalesce(F.transform("ordered", lambda x: x["m"]), F.array())
    ).drop("ordered")
