"""Append-only audit trail as JSON lines."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import audit_statistics
from ..schema import AUDIT, AUDIT_ACTIONS


def filter_entries(
    entries: DataFrame,
    since: datetime | str | None = None,
    action: str | None = None,
    scan_id: str | None = None,
    limit: int | None = None,
    newest_first: bool = False,
) -> DataFrame:
    """Entries from ``since`` on, all of them or the oldest ``limit`` (the newest with ``newest_first``).

    Entries of one moment follow their other columns, so a limit always keeps the same rows.
    """
    if since is not None:
        entries = entries.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if action is not None:
        entries = entries.filter(F.col("action") == action)
    if scan_id is not None:
        entries = entries.filter(F.col("scan_id") == scan_id)
    ties = [c for c in entries.columns if c != "timestamp"]
    entries = entries.orderBy(F.desc("timestamp") if newest_first else F.asc("timestamp"), *ties)
    return entries.limit(limit) if limit is not None else entries


class AuditLog:
    """One small file per entry under a folder; concurrent writers never touch each other's files."""

    def __init__(self, spark: SparkSession, path: str, user: str = "unknown"):
        self.spark, self.path, self.user = spark, path, user

    def log(
        self,
        action: str,
        details: dict | None = None,
        record_count: int = 0,
        scan_id: str | None = None,
        success: bool = True,
        error: str | None = None,
    ) -> None:
        if action not in AUDIT_ACTIONS:
            raise ValueError(f"unknown audit action: {action}")
        now = datetime.now(timezone.utc)
        row = (now, action, self.user, json.dumps(details or {}), record_count, scan_id, success, error)
        self.spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").json(self.path)

    def entries(self) -> DataFrame:
        """All well-formed entries; an absent log is empty."""
        location = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not location.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(location):
            return self.spark.createDataFrame([], AUDIT)
        rows = self.spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(self.path)
        known = F.col("action").isin(AUDIT_ACTIONS) & F.col("timestamp").isNotNull() & F.col("user").isNotNull()
        return rows.filter(known).fillna({"success": True, "record_count": 0})

    def query(self, **filters) -> DataFrame:
        return filter_entries(self.entries(), **filters)

    def statistics(self, *keys: str) -> DataFrame:
        return audit_statistics(self.entries(), *keys)
