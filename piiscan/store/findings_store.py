"""Findings store: three Parquet tables partitioned by scan, sensitive fields encrypted, every use audited."""

from __future__ import annotations

import hashlib
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import confidence_level, redact
from ..operators.classify import has_sensitive_data
from ..operators.detect import explode_findings
from ..operators.findings import filter_findings, rebuild_files, with_file
from ..operators.rollup import recent, scan_summary, store_statistics
from ..schema import FILES, MATCHES, SCANS
from .audit import AuditLog
from .crypto import decrypt, encrypt, reencrypt

_SAFE_ID = re.compile(r"[A-Za-z0-9_.-]+")


def seal_matches(files: DataFrame, key: bytes) -> DataFrame:
    """File results whose matches carry values and contexts as ciphertext only."""
    return files.withColumn(
        "matches",
        F.transform(
            "matches",
            lambda m: F.struct(
                m["entity_type"].alias("entity_type"),
                encrypt(m["value"], key).alias("value_encrypted"),
                redact(m["value"]).alias("value_redacted"),
                m["start"].alias("start_pos"),
                m["end"].alias("end_pos"),
                m["confidence"].alias("confidence"),
                confidence_level(m["confidence"]).alias("confidence_level"),
                m["detector"].alias("detector"),
                encrypt(m["context"], key).alias("context_encrypted"),
                m["is_test_data"].alias("is_test_data"),
                m["model_version"].alias("model_version"),
            ),
        ),
    )


class FindingsStore:
    """``root/{scans,files,matches}`` partitioned by ``scan_id`` and ``batch_id``.

    Writing a (scan, batch) again replaces exactly its partitions, so a retried batch does not
    duplicate. ``matches`` lives in a numbered version folder: rotating the key writes a new version
    and then switches a pointer, and no path is overwritten while it is read.
    """

    def __init__(self, spark: SparkSession, root: str, key: bytes, user: str = "unknown"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.audit = AuditLog(spark, f"{self.root}/audit", user)

    # -- layout -----------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _version(self) -> int:
        """Highest switched-on version of the matches table."""
        p, fs = self._fs(f"{self.root}/matches_current")
        if not fs.exists(p):
            return 1
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(p)), default=1)

    def _check_key(self, claim: bool = False) -> None:
        """Refuse to seal or open with another key than the one the current version was written with.

        The version's marker names a digest of its key. A store opened before a rotation would otherwise mix keys in one
        table. ``claim`` marks an unmarked version with this store's key.
        """
        marker = f"{self.root}/matches_keys/v{self._version()}"
        p, fs = self._fs(marker)
        own = hashlib.sha256(b"findings key" + self.key).hexdigest()[:16]
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        if names and own not in names:
            raise ValueError("the store has another key by now; open it again with the current one")
        if claim and not names:
            fs.mkdirs(self._fs(f"{marker}/{own}")[0])

    def _path(self, table: str) -> str:
        return f"{self.root}/matches_v{self._version()}" if table == "matches" else f"{self.root}/{table}"

    def table(self, name: str) -> DataFrame:
        schema = {"scans": SCANS, "files": FILES, "matches": MATCHES}[name]
        path = self._path(name)
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        partitioned = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema if f.name != 'scan_id')}, scan_id string, batch_id bigint"
        return self.spark.read.schema(partitioned).parquet(path).select(*schema.fieldNames())

    def _write(self, df: DataFrame, name: str, scan_id: str, batch_id: int) -> None:
        """Replace the (scan, batch) partition; a batch that now has no rows leaves none behind."""
        self._remove(f"{self._path(name)}/scan_id={scan_id}/batch_id={batch_id}")
        (
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("scan_id", "batch_id").parquet(self._path(name))
        )

    # -- writing ----------------------------------------------------------------------------------

    def store_scan(
        self,
        files: DataFrame,
        source_path: str,
        source_type: str = "filesystem",
        scan_id: str | None = None,
        started_at: datetime | None = None,
        batch_id: int = 0,
    ) -> str:
        """Store file results (``schema.FILE_RESULT`` shape); returns the scan id.

        The classified frame is written once, as a nested staging table, and read for each of the
        three tables, so the detection itself runs a single time.
        """
        scan_id = scan_id or uuid.uuid4().hex[:8]
        if not _SAFE_ID.fullmatch(scan_id):
            raise ValueError("scan ids may hold letters, digits, '_', '.' and '-'")
        self._check_key(claim=True)
        started = started_at or datetime.now(timezone.utc)
        staging = f"{self.root}/_staging/{scan_id}_{batch_id}"
        # the staged copy carries ciphertext only
        seal_matches(files, self.key).write.mode("overwrite").parquet(staging)
        staged = self.spark.read.parquet(staging).select(
            F.lit(scan_id).alias("scan_id"), F.lit(batch_id).cast("bigint").alias("batch_id"), "*"
        )
        file_id = F.md5(F.concat_ws("\x1f", "scan_id", "path"))
        file_rows = staged.select(
            file_id.alias("id"), "scan_id", "path", "source", "size_bytes", "modified",
            has_sensitive_data(F.col("matches")).alias("has_sensitive_data"),
            "label_recommendation", "current_label", "error", "scan_time_ms", "batch_id",
        )
        self._write(file_rows, "files", scan_id, batch_id)
        counted = Observation()
        match_rows = (
            explode_findings(staged.select("scan_id", "batch_id", "path", file_id.alias("file_id"), "matches"))
            .withColumn("id", F.md5(F.concat_ws("\x1f", "file_id", F.col("start_pos").cast("string"), "entity_type")))
            .observe(counted, F.count(F.lit(1)).alias("n"))
        )
        self._write(match_rows.select(*MATCHES.fieldNames(), "batch_id"), "matches", scan_id, batch_id)
        summary = scan_summary(staged).select(
            F.lit(scan_id).alias("scan_id"),
            F.lit(started).cast("timestamp").alias("started_at"),
            F.current_timestamp().alias("completed_at"),
            F.lit(source_path).alias("source_path"),
            F.lit(source_type).alias("source_type"),
            "total_files", "files_with_matches", "files_errored", "total_matches",
            F.lit(None).cast("string").alias("metadata"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
        )
        self._write(summary.coalesce(1), "scans", scan_id, batch_id)
        self._remove(staging)
        self.audit.log(
            "finding_store", {"source_path": source_path, "batch_id": batch_id},
            record_count=int(counted.get["n"]), scan_id=scan_id,
        )
        return scan_id

    def _remove(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    # -- reading ----------------------------------------------------------------------------------

    def scans(self) -> DataFrame:
        """One row per scan; the batches of a streamed scan are added up."""
        return self.table("scans").groupBy("scan_id").agg(
            F.min("started_at").alias("started_at"),
            F.max("completed_at").alias("completed_at"),
            F.max("source_path").alias("source_path"),
            F.max("source_type").alias("source_type"),
            *[F.sum(c).alias(c) for c in ("total_files", "files_with_matches", "files_errored", "total_matches")],
            F.max("metadata").alias("metadata"),
        )

    def get_scan(self, scan_id: str) -> DataFrame:
        """The scan's row, or no row."""
        found = self.scans().filter(F.col("scan_id") == scan_id)
        self.audit.log("finding_read", {"scan_id": scan_id, "type": "scan_metadata"}, record_count=found.count(), scan_id=scan_id)
        return found

    def list_scans(self, limit: int | None = None) -> DataFrame:
        """Scans, newest first; all of them unless a limit is asked for."""
        return self.scans().orderBy(F.desc("started_at"), "scan_id") if limit is None else recent(self.scans(), limit)

    def get_files(self, scan_id: str, only_with_matches: bool = False) -> DataFrame:
        rows = self.table("files").filter(F.col("scan_id") == scan_id)
        if only_with_matches:
            rows = rows.filter("has_sensitive_data")
        return rows.withColumnRenamed("path", "file_path").orderBy("file_path")

    def _opened(self, rows: DataFrame, decrypted: bool) -> DataFrame:
        if decrypted:
            self._check_key()
            rows = rows.withColumn("value", decrypt(F.col("value_encrypted"), self.key)).withColumn(
                "context", F.coalesce(decrypt(F.col("context_encrypted"), self.key), F.lit(""))
            )
        return rows.drop("value_encrypted", "context_encrypted")

    def get_findings(
        self,
        scan_id: str | None = None,
        entity_type: str | None = None,
        min_confidence: float = 0.0,
        include_test_data: bool = False,
        decrypted: bool = True,
    ) -> DataFrame:
        """Findings with their file; filters reach the scan, decryption follows them.

        Reading is lazy, so the entry is logged when the frame is handed out, with the number of findings it holds.
        """
        matches = filter_findings(self.table("matches"), scan_id, entity_type, min_confidence, include_test_data)
        files = self.table("files")
        if scan_id:
            files = files.filter(F.col("scan_id") == scan_id)
        filters = {"scan_id": scan_id, "entity_type": entity_type, "min_confidence": min_confidence}
        found = with_file(matches, files)
        self.audit.log("finding_read", {"filters": filters, "decrypted": decrypted}, record_count=found.count(), scan_id=scan_id)
        return self._opened(found, decrypted)

    def get_findings_by_file(self, file_path: str, decrypted: bool = True, include_test_data: bool = True) -> DataFrame:
        files = self.table("files").filter(F.col("path") == file_path)
        matches = self.table("matches")
        if not include_test_data:
            matches = matches.filter(~F.col("is_test_data"))
        found = with_file(matches, files)
        self.audit.log("finding_read", {"file_path": file_path, "decrypted": decrypted}, record_count=found.count())
        return self._opened(found, decrypted)

    def load_scan(self, scan_id: str) -> DataFrame:
        """File results of a stored scan, matches nested again (errors and test matches included)."""
        matches = self.table("matches").filter(F.col("scan_id") == scan_id)
        self.audit.log("finding_read", {"scan_id": scan_id, "type": "load_scan"}, record_count=matches.count(), scan_id=scan_id)
        opened = self._opened(matches, True).drop("id")
        files = self.table("files").filter(F.col("scan_id") == scan_id)
        return rebuild_files(files, opened).select(
            "path", "source", "size_bytes", "modified", "matches", "label_recommendation", "current_label",
            "error", "scan_time_ms",
        )

    def statistics(self) -> DataFrame:
        return store_statistics(self.scans(), self.table("files"), self.table("matches"))

    def export_findings(self, path: str, scan_id: str | None = None, decrypted: bool = False) -> int:
        """Write findings as JSON lines; returns their number (counted while writing)."""
        counted = Observation()
        rows = self.get_findings(scan_id, include_test_data=True, decrypted=decrypted)
        rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
        n = int(counted.get["n"])
        self.audit.log("finding_export", {"path": path, "decrypted": decrypted}, record_count=n, scan_id=scan_id)
        return n

    # -- removing and re-keying --------------------------------------------------------------------

    def delete_scan(self, scan_id: str) -> int:
        """Drop the scan's partitions; returns the number of matches removed (0 for an unknown scan)."""
        n = self.table("matches").filter(F.col("scan_id") == scan_id).count()
        for name in ("matches", "files", "scans"):
            self._remove(f"{self._path(name)}/scan_id={scan_id}")
        self.audit.log("finding_delete", {"scan_id": scan_id}, record_count=n, scan_id=scan_id)
        return n

    def purge_all(self) -> int:
        n = self.table("matches").count()
        for name in ("matches", "files", "scans"):
            self._remove(self._path(name))
        self.audit.log("finding_delete", {"action": "purge_all"}, record_count=n)
        return n

    def rotate_key(self, new_key: bytes) -> int:
        """Re-encrypt all stored values into a new version, then switch to it; returns its row count."""
        self._check_key()
        version, old = self._version(), self._path("matches")
        counted = Observation()
        if self._exists(old):
            schema = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}" for f in MATCHES if f.name != "scan_id"
            )
            rows = self.spark.read.schema(f"{schema}, scan_id string, batch_id bigint").parquet(old)
            for c in ("value_encrypted", "context_encrypted"):
                rows = rows.withColumn(c, reencrypt(F.col(c), self.key, new_key))
            rows = rows.observe(counted, F.count(F.lit(1)).alias("n"))
            rows.write.mode("overwrite").partitionBy("scan_id", "batch_id").parquet(f"{self.root}/matches_v{version + 1}")
            digest = hashlib.sha256(b"findings key" + new_key).hexdigest()[:16]
            for folder in (f"matches_keys/v{version + 1}/{digest}", f"matches_current/v{version + 1}"):
                pointer, fs = self._fs(f"{self.root}/{folder}")
                fs.mkdirs(pointer)
            self._remove(old)
            n = int(counted.get["n"])
        else:
            n = 0
        self.key = new_key
        self.audit.log("key_rotate", {"version": version + 1}, record_count=n)
        return n
