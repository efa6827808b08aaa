"""Review queues, verdicts and balanced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import anonymize_context, confidence_pct, file_type
from .findings import filter_findings

REVIEW_THRESHOLD = 0.85
HARD_NEGATIVE_CONFIDENCE = 0.9
_SALTS = 64


def review_queue(
    findings: DataFrame,
    scan_id: str | None = None,
    max_confidence: float = REVIEW_THRESHOLD,
    limit: int | None = None,
) -> DataFrame:
    """Real findings strictly below the threshold, least certain first. ``limit`` 0 or None means all."""
    rows = filter_findings(findings, scan_id=scan_id).filter(F.col("confidence") < max_confidence)
    rows = rows.withColumn("file_type", file_type(F.col("file_path"))).withColumn(
        "confidence_pct", confidence_pct(F.col("confidence"))
    )
    rows = rows.orderBy("confidence", "id")
    return rows.limit(limit) if limit else rows


def count_reviewable(
    findings: DataFrame, scan_id: str | None = None, max_confidence: float = REVIEW_THRESHOLD
) -> DataFrame:
    rows = filter_findings(findings, scan_id=scan_id).filter(F.col("confidence") < max_confidence)
    return rows.agg(F.count(F.lit(1)).alias("reviewable"))


def apply_verdicts(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reviewed samples in training shape: skipped ones dropped, the value replaced by its token.

    ``verdicts`` has (id, verdict, timestamp).
    """
    decided = verdicts.filter(F.col("verdict").isin("TP", "FP")).select("id", "verdict", "timestamp")
    return queue.join(decided, "id").select(
        "entity_type",
        anonymize_context(F.col("context"), F.col("value"), F.col("entity_type")).alias("context"),
        "confidence",
        "detector",
        "verdict",
        "file_type",
        "timestamp",
    )


def hard_negatives(
    findings: DataFrame, verdicts: DataFrame, min_confidence: float = HARD_NEGATIVE_CONFIDENCE
) -> DataFrame:
    """Findings rejected by a reviewer although the detector was sure."""
    wrong = verdicts.filter(F.col("verdict") == "FP").select("id")
    return findings.filter(F.col("confidence") > min_confidence).join(wrong, "id", "left_semi")


def balanced_sample(findings: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """The ``quota`` least certain real findings of each type.

    Types are few and one may own most rows, so ranking happens twice: within (type, salt), spread
    over many tasks, then within the type over what is left, at most quota x salts rows.
    """
    if not quotas:
        return findings.limit(0)
    quota = F.coalesce(*[F.when(F.col("entity_type") == k, F.lit(v)) for k, v in quotas.items()])
    order = [F.col("confidence"), F.col("id")]
    rows = (
        findings.filter(~F.col("is_test_data") & F.col("entity_type").isin(list(quotas)))
        .withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    )
    partial = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("entity_type", "_salt").orderBy(*order))
    ).filter((F.col("_rank") <= max(quotas.values())) & (F.col("_rank") <= quota))
    return (
        partial.withColumn("sample_rank", F.row_number().over(Window.partitionBy("entity_type").orderBy(*order)))
        .filter(F.col("sample_rank") <= quota)
        .drop("_salt", "_rank")
    )
