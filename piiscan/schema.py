"""Declared schemas and enumerations. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: entity types by family, label recommendations, audit actions -----------------

ENTITY_FAMILY = {
    "ssn": "PII",
    "name": "PII",
    "email": "PII",
    "phone": "PII",
    "address": "PII",
    "date_of_birth": "PII",
    "medical_record_number": "PHI",
    "health_plan_id": "PHI",
    "diagnosis": "PHI",
    "medication": "PHI",
    "credit_card": "PCI",
    "cvv": "PCI",
    "expiration_date": "PCI",
    "api_key": "secret",
    "password": "secret",
    "private_key": "secret",
}

HIGH_SENSITIVITY_TYPES = [
    "ssn",
    "credit_card",
    "medical_record_number",
    "health_plan_id",
    "cvv",
    "private_key",
]

LABEL_RECOMMENDATIONS = ["public", "internal", "confidential", "highly_confidential"]

AUDIT_ACTIONS = [
    "db_create",
    "db_open",
    "db_close",
    "scan_start",
    "scan_complete",
    "finding_store",
    "finding_read",
    "finding_delete",
    "finding_export",
    "review_start",
    "review_verdict",
    "key_create",
    "key_rotate",
    "key_delete",
    "report_generate",
    "data_export",
]

# --- Row shapes ----------------------------------------------------------------------------------

MATCH = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("detector", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("is_test_data", T.BooleanType()),
        T.StructField("model_version", T.StringType()),
    ]
)

#: Result of scanning one document (the unit every rollup works on).
FILE_RESULT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("matches", T.ArrayType(MATCH)),
        T.StructField("label_recommendation", T.StringType()),
        T.StructField("current_label", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("scan_time_ms", T.IntegerType()),
    ]
)

SCANS = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("total_files", T.LongType()),
        T.StructField("files_with_matches", T.LongType()),
        T.StructField("files_errored", T.LongType()),
        T.StructField("total_matches", T.LongType()),
        T.StructField("metadata", T.StringType()),
    ]
)

#: ``id`` / ``file_id`` are 128-bit digests of (scan, path[, span]): stable across retries, no central counter.
FILES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("scan_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("has_sensitive_data", T.BooleanType()),
        T.StructField("label_recommendation", T.StringType()),
        T.StructField("current_label", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("scan_time_ms", T.IntegerType()),
    ]
)

MATCHES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("scan_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("value_encrypted", T.StringType()),
        T.StructField("value_redacted", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
        T.StructField("end_pos", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("confidence_level", T.StringType()),
        T.StructField("detector", T.StringType()),
        T.StructField("context_encrypted", T.StringType()),
        T.StructField("is_test_data", T.BooleanType()),
        T.StructField("model_version", T.StringType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("action", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("scan_id", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

VERDICTS = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("detector", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

TRAINING = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

ANNOTATED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("value", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

LABEL_MAPPING = T.StructType(
    [
        T.StructField("recommendation", T.StringType()),
        T.StructField("label_id", T.StringType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("skip", T.BooleanType()),
    ]
)

DRIVE_ITEM_JSON = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("lastModifiedDateTime", T.StringType()),
        T.StructField("webUrl", T.StringType()),
        T.StructField("parentReference", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("path", T.StringType()),
        ])),
        T.StructField("folder", T.MapType(T.StringType(), T.StringType())),
        T.StructField("file", T.StructType([T.StructField("mimeType", T.StringType())])),
    ]
)
