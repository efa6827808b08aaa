"""Registered queries: every operator over the given tables, with the checking SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import annotations as ann
from ..operators import evaluate as ev
from ..operators import findings as fi
from ..operators import labeling as lab
from ..operators import report as rep
from ..operators import review as rev
from ..operators import rollup as ro
from ..operators import training as tr
from ..operators.classify import classify, has_sensitive_data, real_matches
from ..operators.detect import SPAN_DDL, detect, explode_findings
from ..operators.patterns import DEFAULT_PATTERNS, PatternSpec
from ..operators.spans import mask_text, resolve_spans
from ..session import ensure_checkpoint_dir, local_rows, spread_small
from ..sources import assemble as asm
from ..sources import drive
from ..sources.columns import profile_columns
from ..sources.files import extension, format_kind, is_excluded
from ..sources.synth import corpus_manifest
from ..store import crypto
from ..store.audit import filter_entries
from ..streaming import incremental as inc
from . import derive as dv
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- frames shared by the queries -----------------------------------------------------------------


def customer_files(spark: SparkSession, sf: str) -> DataFrame:
    return classify(dv.customer_documents(spark, sf)).withColumn("error", F.lit(None).cast("string"))


def with_id(findings: DataFrame) -> DataFrame:
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start_pos").cast("string"), "entity_type")
    return findings.withColumn("id", F.md5(key))


def customer_findings(spark: SparkSession, sf: str, files: DataFrame | None = None) -> DataFrame:
    files = customer_files(spark, sf) if files is None else files
    rows = with_id(fi.flatten_findings(files.drop("error")))
    return rows.withColumn("file_path", F.col("path"))


def document_findings(spark: SparkSession, sf: str) -> DataFrame:
    return with_id(fi.flatten_findings(classify(dv.documents(spark, sf))))


CUST = o.classified(o.CUSTOMERS)
DOCS = o.classified(o.DOCUMENTS)
CORP = o.classified(o.CORPUS)

# --- detection ------------------------------------------------------------------------------------

for _spec in DEFAULT_PATTERNS:

    def _detect_one(spark, sf, spec=_spec):
        docs = dv.customer_documents(spark, sf)
        rows = explode_findings(docs.select("doc_id", detect(F.col("text"), [spec]).alias("matches")))
        return rows.select(
            "doc_id", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "confidence", "is_test_data"
        )

    register(
        f"detect_{_spec.entity_type}",
        f"WITH base AS ({o.CUSTOMERS}), cand AS ({o.candidates('base', [_spec.entity_type])})"
        " SELECT doc_id, value, start_pos, end_pos, confidence, is_test_data FROM cand",
    )(_detect_one)


@register(
    "match_offsets_context",
    f"WITH base AS ({o.DOCUMENTS}), cand AS ({o.candidates()}) SELECT c.doc_id, entity_type, value, start_pos, end_pos, "
    f"confidence, is_test_data, {o.context()} AS context FROM cand c JOIN base b ON b.doc_id = c.doc_id",
)
def match_offsets_context(spark, sf):
    docs = dv.documents(spark, sf)
    return explode_findings(docs.select("doc_id", detect(F.col("text")).alias("matches"))).select(
        "doc_id", "entity_type", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"),
        "confidence", "is_test_data", "context",
    )


_BADGE = PatternSpec(
    "customer_badge", "api_key", r"\bCustomer#\d{9}\b", 0.60, validator=lambda v: ~v.endswith("5"), test_values=["Customer#000000001"]
)


@register(
    "custom_pattern",
    f"SELECT doc_id, value, value = 'Customer#000000001' AS is_test_data FROM (SELECT doc_id, "
    f"unnest(regexp_extract_all(text, '\\bCustomer#\\d{{9}}\\b')) AS value FROM ({o.CUSTOMERS})) WHERE value NOT LIKE '%5'",
)
def custom_pattern(spark, sf):
    docs = dv.customer_documents(spark, sf)
    rows = explode_findings(docs.select("doc_id", detect(F.col("text"), [_BADGE]).alias("matches")))
    return rows.select("doc_id", "value", "is_test_data")


_SSN_TEXT = (
    "lpad(CAST(o_orderkey * 7 % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0')"
    " || CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '-' END || lpad(CAST(o_orderkey * 3 % 2500 * 4 AS STRING), 4, '0')"
    " || CASE WHEN o_orderkey % 11 = 0 THEN '7' ELSE '' END"
)


@register("ssn_validity", f"SELECT o_orderkey, value, {o._SSN_OK} AS valid FROM (SELECT o_orderkey, {_SSN_TEXT} AS value FROM orders)")
def ssn_validity(spark, sf):
    rows = dv.table(spark, sf, "orders").select("o_orderkey", F.expr(_SSN_TEXT).alias("value"))
    return rows.withColumn("valid", S.ssn_valid(F.col("value")))


_CARD_TEXT = "CAST(4000000000000 + l_orderkey * 9973 + l_partkey * 31 + l_linenumber AS STRING) || CASE WHEN l_suppkey % 3 = 0 THEN '-' || CAST(l_suppkey AS STRING) ELSE '' END"


@register(
    "luhn_validity",
    f"SELECT valid, count(*) AS n, sum(CAST(l_linenumber AS BIGINT))::BIGINT AS lines FROM (SELECT l_linenumber, {o.luhn_ok(o._DIGITS)} AS valid"
    f" FROM (SELECT l_linenumber, {_CARD_TEXT} AS value FROM lineitem)) GROUP BY valid",
)
def luhn_validity(spark, sf):
    rows = dv.table(spark, sf, "lineitem").select("l_linenumber", F.expr(_CARD_TEXT).alias("value"))
    return (
        rows.groupBy(S.luhn_valid(F.col("value")).alias("valid"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"))
    )


@register(
    "test_value_flags",
    CUST + f" SELECT entity_type, {o.NORMALIZED} AS normalized, is_test_data, count(*) AS n FROM findings GROUP BY ALL",
)
def test_value_flags(spark, sf):
    rows = customer_findings(spark, sf)
    return rows.groupBy("entity_type", S.normalize_value(F.col("value")).alias("normalized"), "is_test_data").agg(
        F.count(F.lit(1)).alias("n")
    )


_SPAN_COLS = (
    "l_orderkey AS doc_id, CAST(l_partkey % 50 AS INT) AS start_pos, CAST(l_partkey % 50 + 1 + l_suppkey % 20 AS INT) AS end_pos,"
    " l_discount AS confidence, CAST(l_linenumber AS INT) AS ord, CAST(l_extendedprice AS STRING) AS value"
)


@register(
    "span_resolution",
    f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, -confidence, ord, end_pos, value) AS rn
FROM (SELECT {_SPAN_COLS} FROM lineitem)),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, -1 AS last_end, false AS keep FROM (SELECT DISTINCT doc_id FROM ranked)
UNION ALL SELECT r.doc_id, r.rn, CASE WHEN r.start_pos >= w.last_end THEN r.end_pos ELSE w.last_end END, r.start_pos >= w.last_end
FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1)
SELECT r.doc_id, r.start_pos, r.end_pos, r.confidence, r.ord FROM ranked r JOIN walk w ON r.doc_id = w.doc_id AND r.rn = w.rn AND w.keep""",
)
def span_resolution(spark, sf):
    rows = dv.table(spark, sf, "lineitem").selectExpr(*_split_columns(_SPAN_COLS))
    span = F.struct(
        F.col("start_pos").alias("start"), (-F.col("confidence")).alias("rank"), "ord", F.col("end_pos").alias("end"),
        F.lit("x").alias("entity_type"), "value", "confidence", F.lit("regex").alias("detector"), F.lit(False).alias("is_test_data"),
    )
    spans = rows.groupBy("doc_id").agg(F.collect_list(span.cast(SPAN_DDL)).alias("spans"))
    return spans.select("doc_id", F.inline(resolve_spans(F.col("spans")))).select(
        "doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "confidence", "ord"
    )


def _split_columns(sql: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, current = [], 0, ""
    for c in sql:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(current.strip())
            current = ""
        else:
            current += c
    return [*out, current.strip()]


def _label_query(frame):
    def run(spark, sf):
        files = classify(frame(spark, sf))
        return files.select(
            "doc_id",
            "label_recommendation",
            F.size("matches").alias("n_matches"),
            F.size(real_matches(F.col("matches"))).alias("n_real"),
        )

    return run


_LABEL_SELECT = " SELECT doc_id, label_recommendation, CAST(n_matches AS INT) AS n_matches, CAST(n_real AS INT) AS n_real FROM files"
register("classify_documents", DOCS + _LABEL_SELECT)(_label_query(dv.documents))
register("classify_customer_documents", CUST + _LABEL_SELECT)(_label_query(dv.customer_documents))
register("classify_corpus", CORP + _LABEL_SELECT)(_label_query(dv.corpus))
register("html_pages_scan", o.classified(o.PAGES) + _LABEL_SELECT)(_label_query(dv.pages))


@register("blank_documents", f"SELECT doc_id, path FROM ({o.CUSTOMERS}) WHERE NOT regexp_matches(text, '\\S')")
def blank_documents(spark, sf):
    return dv.customer_documents(spark, sf).filter(S.is_blank(F.col("text"))).select("doc_id", "path")


_MASK = CUST + """, pieces AS (SELECT f.doc_id, string_agg(substring(b.text, prev_end + 1, start_pos - prev_end) || '[' || upper(entity_type) || ']', '' ORDER BY start_pos) AS head, max(end_pos) AS last_end
FROM (SELECT *, lag(end_pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY start_pos) AS prev_end FROM findings) f JOIN base b ON b.doc_id = f.doc_id GROUP BY f.doc_id)
SELECT b.doc_id, coalesce(p.head || substring(b.text, p.last_end + 1), b.text) AS masked FROM base b LEFT JOIN pieces p ON p.doc_id = b.doc_id"""


@register("masked_text", _MASK)
def masked_text(spark, sf):
    files = classify(dv.customer_documents(spark, sf), keep_text=True)
    return files.select("doc_id", mask_text(F.col("text"), F.col("matches")).alias("masked"))


# --- annotations of outside recognisers -----------------------------------------------------------

_ANN_MAPPED = f"""SELECT doc_id, start_pos, end_pos, score, CASE entity_type WHEN 'PERSON' THEN 'name' WHEN 'LOCATION' THEN 'address'
 WHEN 'IP_ADDRESS' THEN 'api_key' END AS mapped FROM ({o.ANNOTATIONS}) WHERE score >= 0.5"""
_ANN_VALUE = "substring(b.text, start_pos + 1, end_pos - start_pos)"


@register(
    "annotations_to_matches",
    f"WITH base AS ({o.DOCUMENTS}), a AS ({_ANN_MAPPED}) SELECT a.doc_id, mapped AS entity_type, {_ANN_VALUE} AS value, start_pos,"
    f" end_pos, round(score, 6) AS confidence, 'presidio' AS detector FROM a JOIN base b ON b.doc_id = a.doc_id WHERE mapped IS NOT NULL",
)
def annotations_to_matches(spark, sf):
    docs = ann.annotation_spans(dv.documents(spark, sf), dv.annotations(spark, sf))
    return docs.select("doc_id", F.inline("annotation_spans")).select(
        "doc_id", "entity_type", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"),
        F.round("confidence", 6).alias("confidence"), "detector",
    )


@register(
    "classify_with_annotations",
    o.classified(
        o.DOCUMENTS,
        f"""UNION ALL SELECT a.doc_id, 1000 + row_number() OVER (PARTITION BY a.doc_id ORDER BY start_pos, -score, end_pos) AS ord, mapped, score,
 {_ANN_VALUE}, start_pos, end_pos, false, 'presidio' FROM ({_ANN_MAPPED}) a JOIN base b ON b.doc_id = a.doc_id WHERE mapped IS NOT NULL""",
    )
    + " SELECT doc_id, entity_type, value, start_pos, end_pos, round(confidence, 6) AS confidence, detector, context FROM findings",
)
def classify_with_annotations(spark, sf):
    files = ann.classify_with_annotations(dv.documents(spark, sf), dv.annotations(spark, sf))
    return explode_findings(files).select(
        "doc_id", "entity_type", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"),
        F.round("confidence", 6).alias("confidence"), "detector", "context",
    )


# --- scalar functions over findings and paths -----------------------------------------------------


@register(
    "redacted_findings",
    CUST + f" SELECT doc_id, start_pos, {o.REDACT} AS value_redacted, {o.BAND} AS confidence_level, CAST(trunc(confidence * 100) AS INT) AS pct FROM findings",
)
def redacted_findings(spark, sf):
    rows = customer_findings(spark, sf)
    return rows.select("doc_id", "start_pos", "value_redacted", "confidence_level", S.confidence_pct(F.col("confidence")).alias("pct"))


@register(
    "entity_families",
    CUST + f""" SELECT CASE WHEN entity_type IN ('ssn', 'email', 'phone') THEN 'PII' WHEN entity_type = 'credit_card' THEN 'PCI' ELSE 'PHI' END AS family,
 entity_type IN {o.HIGH} AS high, count(*) AS n FROM findings GROUP BY ALL""",
)
def entity_families(spark, sf):
    t = F.col("entity_type")
    return customer_findings(spark, sf).groupBy(S.entity_family(t).alias("family"), S.is_high_sensitivity(t).alias("high")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "anonymized_contexts",
    CUST + """ SELECT doc_id, start_pos, replace(f.context, f.value, '[' || upper(f.entity_type) || ']') AS every_occurrence,
 substring(b.text, greatest(start_pos - 50, 0) + 1, start_pos - greatest(start_pos - 50, 0)) || '[' || upper(f.entity_type) || ']'
 || substring(b.text, end_pos + 1, 50) AS span_only FROM findings f JOIN base b USING (doc_id)""",
)
def anonymized_contexts(spark, sf):
    files = classify(dv.customer_documents(spark, sf), keep_text=True)
    rows = explode_findings(files)
    return rows.select(
        "doc_id",
        F.col("start").alias("start_pos"),
        S.anonymize_context(F.col("context"), F.col("value"), F.col("entity_type")).alias("every_occurrence"),
        S.anonymize_span(F.col("text"), F.col("start"), F.col("end"), F.col("entity_type")).alias("span_only"),
    )


_PATH_TEXT = (
    "'/data/' || lower(o_orderpriority) || CASE o_orderkey % 7 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/distribution' WHEN 2 THEN '/x.egg-info'"
    " ELSE '/' || o_orderstatus END || '/' || CASE o_orderkey % 5 WHEN 0 THEN 'Report_' || CAST(o_orderkey AS STRING) || '.TXT' WHEN 1 THEN '.profile'"
    " WHEN 2 THEN 'archive.tar.Md' WHEN 3 THEN 'notes' ELSE 'a_very_long_file_name_that_goes_on_and_on_' || CAST(o_orderkey AS STRING) || '_for_this_one.png' END"
)
_NAME = "regexp_extract(path, '([^/]+)/*$', 1)"
_SUFFIX = f"regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)"


@register(
    "path_functions",
    f"""SELECT o_orderkey, {_SUFFIX} AS file_type,
 CASE WHEN {_SUFFIX} = '' AND {_NAME} LIKE '.%' THEN lower({_NAME}) ELSE lower({_SUFFIX}) END AS ext,
 CASE WHEN length(path) <= 80 THEN path ELSE '...' || right(path, 77) END AS shown,
 CASE WHEN lower({_SUFFIX}) IN ('.txt', '.md') THEN 'text' END AS kind,
 len(list_filter(string_split(path, '/'), lambda c: contains(c, 'node_modules') OR contains(c, '.git') OR contains(c, '__pycache__') OR contains(c, 'venv')
   OR contains(c, '.env') OR contains(c, '.tox') OR contains(c, '.pytest_cache') OR contains(c, '.mypy_cache') OR contains(c, 'dist') OR contains(c, 'build')
   OR suffix(c, '.egg-info'))) > 0 AS excluded
FROM (SELECT o_orderkey, {_PATH_TEXT} AS path FROM orders)""",
)
def path_functions(spark, sf):
    rows = dv.table(spark, sf, "orders").select("o_orderkey", F.expr(_PATH_TEXT).alias("path"))
    p = F.col("path")
    return rows.select(
        "o_orderkey",
        S.file_type(p).alias("file_type"),
        extension(p).alias("ext"),
        S.truncate_path(p).alias("shown"),
        format_kind(p).alias("kind"),
        is_excluded(p).alias("excluded"),
    )


@register(
    "label_names",
    CUST + f""" SELECT coalesce(label_recommendation, 'none') AS label, {o.title("coalesce(label_recommendation, 'none')")} AS shown,
 CASE WHEN label_recommendation LIKE '%confidential%' THEN 'high' WHEN label_recommendation = 'internal' THEN 'medium' ELSE 'low' END AS badge,
 replace(lower(coalesce(label_recommendation, 'none')), '_', '') AS key, count(*) AS n FROM files GROUP BY ALL""",
)
def label_names(spark, sf):
    label = F.coalesce("label_recommendation", F.lit("none"))
    return customer_files(spark, sf).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
        "label", S.display_name(F.col("label")).alias("shown"), S.badge(F.col("label")).alias("badge"),
        S.label_key(F.col("label")).alias("key"), "n",
    )


_GUID_TEXT = "CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE md5(CAST(o_orderkey AS STRING)) END"
_GUID = f"CASE o_orderkey % 3 WHEN 1 THEN substring({_GUID_TEXT}, 1, 8) || '-' || substring({_GUID_TEXT}, 9, 4) || '-' || substring({_GUID_TEXT}, 13, 4) || '-' || substring({_GUID_TEXT}, 17, 4) || '-' || substring({_GUID_TEXT}, 21, 12) ELSE {_GUID_TEXT} END"


@register(
    "guid_and_duration",
    f"""SELECT o_orderkey, length(label) = 36 AND length(label) - length(replace(label, '-', '')) = 4 AS guid,
 coalesce(date_diff('second', started, completed), 0)::DOUBLE AS seconds
FROM (SELECT o_orderkey, {_GUID} AS label, o_orderdate::TIMESTAMP AS started, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE TIMESTAMP '2003-01-01 00:00:00' END AS completed FROM orders)""",
)
def guid_and_duration(spark, sf):
    rows = dv.table(spark, sf, "orders")
    done = F.when(F.col("o_orderstatus") != "O", F.lit("2003-01-01 00:00:00").cast("timestamp"))
    return rows.select(
        "o_orderkey",
        S.is_guid(F.expr(_GUID)).alias("guid"),
        S.duration_seconds(F.col("o_orderdate").cast("timestamp"), done).alias("seconds"),
    )


# --- findings: filters and joins ------------------------------------------------------------------


def stored_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The files and matches tables of a store, before encryption."""
    files = customer_files(spark, sf)
    file_rows = files.select(
        F.md5(F.col("doc_id").cast("string")).alias("id"), "scan_id", "path", F.lit("filesystem").alias("source"),
        has_sensitive_data(F.col("matches")).alias("has_sensitive_data"), "label_recommendation", "error",
    )
    matches = with_id(fi.flatten_findings(files.select("doc_id", "scan_id", "matches"))).withColumn(
        "file_id", F.md5(F.col("doc_id").cast("string"))
    )
    return file_rows, matches


@register(
    "findings_filtered",
    CUST + " SELECT id, path AS file_path, entity_type, confidence, value FROM findings WHERE scan_id = 'scan_3' AND confidence >= 0.7 AND NOT is_test_data",
)
def findings_filtered(spark, sf):
    files, matches = stored_tables(spark, sf)
    kept = fi.filter_findings(matches, scan_id="scan_3", min_confidence=0.7)
    return fi.with_file(kept, files).select("id", "file_path", "entity_type", "confidence", "value")


@register(
    "findings_of_type",
    CUST + " SELECT id, path AS file_path, is_test_data, value FROM findings WHERE entity_type = 'credit_card'",
)
def findings_of_type(spark, sf):
    files, matches = stored_tables(spark, sf)
    kept = fi.filter_findings(matches, entity_type="credit_card", include_test_data=True)
    return fi.with_file(kept, files).select("id", "file_path", "is_test_data", "value")


@register(
    "findings_by_file",
    CUST + " SELECT id, entity_type, value, is_test_data FROM findings WHERE path LIKE '%/customer_4.csv' OR path LIKE '%/customer_11.docx'",
)
def findings_by_file(spark, sf):
    files, matches = stored_tables(spark, sf)
    wanted = files.filter(F.col("path").endswith("/customer_4.csv") | F.col("path").endswith("/customer_11.docx"))
    return fi.with_file(matches, wanted).select("id", "entity_type", "value", "is_test_data")


@register(
    "files_of_scan",
    CUST + " SELECT path AS file_path, label_recommendation FROM files WHERE scan_id = 'scan_7' AND sensitive ORDER BY path",
)
def files_of_scan(spark, sf):
    files, _ = stored_tables(spark, sf)
    kept = files.filter((F.col("scan_id") == "scan_7") & F.col("has_sensitive_data"))
    return kept.select(F.col("path").alias("file_path"), "label_recommendation").orderBy("file_path")


@register(
    "report_filter",
    CUST + " SELECT doc_id, path FROM files WHERE contains(lower(path), 'furn') AND label_recommendation = 'highly_confidential' AND contains(types, 'credit_card')",
)
def report_filter(spark, sf):
    files = fi.filter_files(customer_files(spark, sf), "FURN", "highly_confidential", "credit_card")
    return files.select("doc_id", "path")


@register(
    "rebuilt_scan",
    CUST + """ SELECT f.path, f.label_recommendation, coalesce(string_agg(g.entity_type || ':' || g.start_pos || ':' || g.value, ';' ORDER BY g.start_pos), '') AS matches
 FROM files f LEFT JOIN findings g ON g.doc_id = f.doc_id GROUP BY f.doc_id, f.path, f.label_recommendation""",
)
def rebuilt_scan(spark, sf):
    files, matches = stored_tables(spark, sf)
    rebuilt = fi.rebuild_files(files, matches)
    text = F.transform("matches", lambda m: F.concat_ws(":", m["entity_type"], m["start"].cast("string"), m["value"]))
    return rebuilt.select("path", "label_recommendation", F.array_join(text, ";").alias("matches"))


@register(
    "duplicate_values",
    CUST + f" SELECT entity_type, {o.NORMALIZED} AS normalized, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM findings WHERE NOT is_test_data GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_values(spark, sf):
    rows = customer_findings(spark, sf).filter(~F.col("is_test_data"))
    return (
        rows.groupBy("entity_type", S.normalize_value(F.col("value")).alias("normalized"), "doc_id").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("entity_type", "normalized").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n") > 1)
    )


@register(
    "compare_runs",
    o.classified(o.CUSTOMERS) + """, before AS (SELECT doc_id, entity_type, value FROM findings WHERE confidence < 0.88),
 after AS (SELECT doc_id, entity_type, value FROM findings WHERE confidence > 0.68 AND NOT is_test_data)
 SELECT doc_id, entity_type, value, 'appeared' AS change, count(*) AS copies FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before) GROUP BY ALL
 UNION ALL SELECT doc_id, entity_type, value, 'disappeared', count(*) FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after) GROUP BY ALL""",
)
def compare_runs(spark, sf):
    rows = customer_findings(spark, sf)
    before = rows.filter(F.col("confidence") < 0.88)
    after = rows.filter((F.col("confidence") > 0.68) & ~F.col("is_test_data"))
    return fi.compare_runs(before, after, ["doc_id", "entity_type", "value"])


# --- rollups --------------------------------------------------------------------------------------


@register(
    "file_rollup",
    CUST + " SELECT path, sensitive AS has_sensitive_data, best_any AS highest_confidence, types_any AS entity_types_found, CAST(n_real AS INT) AS real_match_count FROM files",
)
def file_rollup(spark, sf):
    rows = ro.file_rollup(customer_files(spark, sf))
    return rows.withColumn("entity_types_found", F.array_join("entity_types_found", ","))


_SUMMARY = "count(*) AS total_files, count(*) FILTER (sensitive) AS files_with_matches, CAST(0 AS BIGINT) AS files_errored, CAST(sum(n_real) AS BIGINT) AS total_matches"


@register("scan_summary", CUST + f" SELECT scan_id, {_SUMMARY} FROM files GROUP BY scan_id")
def scan_summary(spark, sf):
    return ro.scan_summary(customer_files(spark, sf), "scan_id")


@register("scan_by_id", CUST + f" SELECT scan_id, {_SUMMARY} FROM files WHERE scan_id = 'scan_5' GROUP BY scan_id")
def scan_by_id(spark, sf):
    return ro.scan_summary(customer_files(spark, sf), "scan_id").filter(F.col("scan_id") == "scan_5")


@register("entity_totals", DOCS + " SELECT entity_type, count(*) AS n FROM findings WHERE NOT is_test_data GROUP BY 1")
def entity_totals(spark, sf):
    return ro.entity_totals(document_findings(spark, sf))


@register("top_entities", CUST + " SELECT entity_type, count(*) AS n FROM findings WHERE NOT is_test_data GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 5")
def top_entities(spark, sf):
    return ro.entity_totals(customer_findings(spark, sf)).limit(5)


@register("label_totals", CORP + " SELECT label_recommendation, count(*) AS n_files FROM files WHERE label_recommendation IS NOT NULL GROUP BY 1")
def label_totals(spark, sf):
    return ro.label_totals(classify(dv.corpus(spark, sf).drop("planted")))


@register(
    "entity_real_test",
    CORP + " SELECT entity_type, count(*) AS total, count(*) FILTER (NOT is_test_data) AS real, count(*) FILTER (is_test_data) AS test_data FROM findings GROUP BY 1",
)
def entity_real_test(spark, sf):
    return ro.entity_breakdown(explode_findings(classify(dv.corpus(spark, sf).drop("planted"))))


@register(
    "store_statistics",
    CUST + """ SELECT (SELECT count(DISTINCT scan_id) FROM base) AS scans, (SELECT count(*) FROM base) AS files, count(*) AS matches,
 count(*) FILTER (NOT is_test_data) AS real_matches, count(*) FILTER (is_test_data) AS test_data_matches,
 (SELECT string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) FROM (SELECT entity_type, count(*) AS n FROM findings WHERE NOT is_test_data GROUP BY 1)) AS by_entity_type FROM findings""",
)
def store_statistics(spark, sf):
    _, matches = stored_tables(spark, sf)
    documents = dv.customer_documents(spark, sf)
    stats = ro.store_statistics(documents.select("scan_id").distinct(), documents, matches)
    pairs = F.transform(F.map_entries("by_entity_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stats.withColumn("by_entity_type", F.array_join(pairs, ","))


def audit_entries(spark, sf):
    e = dv.table(spark, sf, "events")
    return e.select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("user"),
        F.concat(F.lit("scan_"), (F.col("user_id") % 20).cast("string")).alias("scan_id"),
        (F.col("event_type") != "error").alias("success"), "event_id",
    )


@register(
    "audit_stats",
    "SELECT event_type AS action, count(*) AS entries, count(*) FILTER (event_type = 'error') AS errors, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1",
)
def audit_stats(spark, sf):
    rows = ro.audit_statistics(audit_entries(spark, sf), "action")
    return rows.select("action", "entries", "errors", F.unix_micros(F.col("first_entry").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_entry").cast("timestamp")).alias("last_us"))


@register(
    "audit_filter",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND event_type = 'error' AND user_id % 20 = 7",
)
def audit_filter(spark, sf):
    return filter_entries(audit_entries(spark, sf), "2024-01-05 00:00:00", "error", "scan_7").select("event_id")


_VERDICT = "CASE doc_id % 4 WHEN 0 THEN 'TP' WHEN 1 THEN 'FP' WHEN 2 THEN 'skip' ELSE 'TP' END"


def verdicts(spark, sf, files=None):
    rows = customer_findings(spark, sf, files).filter(~F.col("is_test_data"))
    return rows.select("id", "entity_type", F.expr(_VERDICT).alias("verdict"), F.lit("2024-01-01T00:00:00").alias("timestamp"))


_V = f"(SELECT *, {_VERDICT} AS verdict FROM findings WHERE NOT is_test_data)"


@register(
    "verdict_stats",
    CUST + f" SELECT entity_type, count(*) AS total, count(*) FILTER (verdict = 'TP') AS true_positives, count(*) FILTER (verdict = 'FP') AS false_positives,"
    f" round(count(*) FILTER (verdict = 'TP') / count(*), 6) AS accuracy FROM {_V} WHERE verdict <> 'skip' GROUP BY 1",
)
def verdict_stats(spark, sf):
    rows = ro.verdict_statistics(verdicts(spark, sf).filter(F.col("verdict") != "skip"), "entity_type")
    return rows.withColumn("accuracy", F.round("accuracy", 6))


@register(
    "session_stats",
    CUST + f" SELECT count(*) AS total_samples, count(*) FILTER (verdict <> 'skip') AS reviewed, count(*) FILTER (verdict = 'TP') AS correct, count(*) FILTER (verdict = 'FP') AS wrong,"
    f" count(*) FILTER (verdict = 'skip') AS skipped, round(count(*) FILTER (verdict = 'TP') / count(*) FILTER (verdict <> 'skip'), 6) AS accuracy FROM {_V}",
)
def session_stats(spark, sf):
    return ro.session_statistics(verdicts(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


_CELLS = (
    "SELECT c_custkey AS doc_id, c_custkey, 'c_name' AS column_name, c_name AS text FROM customer UNION ALL"
    " SELECT c_custkey + 1000000000, c_custkey, 'note', text FROM (SELECT doc_id AS c_custkey, text FROM ({})) UNION ALL"
    " SELECT c_custkey + 2000000000, c_custkey, 'c_mktsegment', c_mktsegment FROM customer"
).format(o.CUSTOMERS)


@register(
    "column_pii_profile",
    o.classified(_CELLS) + """ SELECT column_name, entity_type, count(DISTINCT c_custkey) AS rows_with_entity, (SELECT count(*) FROM customer) AS n_rows,
 round(count(DISTINCT c_custkey) / (SELECT count(*) FROM customer), 6) AS share FROM findings WHERE NOT is_test_data GROUP BY 1, 2""",
)
def column_pii_profile(spark, sf):
    note = dv.customer_documents(spark, sf).select(F.col("doc_id").alias("c_custkey"), F.col("text").alias("note"))
    wide = dv.table(spark, sf, "customer").join(note, "c_custkey")
    return profile_columns(wide, "c_custkey").withColumn("share", F.round("share", 6))


# --- ordering, limits, windows --------------------------------------------------------------------


def scans_table(spark, sf):
    """One row per scan with its totals and start."""
    files = customer_files(spark, sf)
    starts = F.col("started")
    return ro.scan_summary(files, "scan_id", "source_path", "started").withColumn("started_at", starts)


_SCANS = f"scans AS (SELECT scan_id, source_path, started, {_SUMMARY} FROM files GROUP BY ALL)"


@register("recent_scans", CUST + f", {_SCANS} SELECT scan_id, total_files, total_matches FROM scans ORDER BY started DESC, scan_id LIMIT 5")
def recent_scans(spark, sf):
    return ro.recent(scans_table(spark, sf), 5).select("scan_id", "total_files", "total_matches")


@register(
    "report_trend",
    CUST + f""", {_SCANS} SELECT source_path, scan_id, total_files, files_with_matches, total_matches,
 total_matches - lag(total_matches) OVER (PARTITION BY source_path ORDER BY started, scan_id) AS matches_change,
 files_with_matches - lag(files_with_matches) OVER (PARTITION BY source_path ORDER BY started, scan_id) AS files_change FROM scans""",
)
def report_trend(spark, sf):
    return rep.scan_trend(scans_table(spark, sf)).drop("started_at")


@register(
    "review_queue",
    CUST + f" SELECT id, entity_type, value, confidence, CAST(trunc(confidence * 100) AS INT) AS confidence_pct, {_SUFFIX} AS file_type FROM findings"
    " WHERE scan_id = 'scan_2' AND NOT is_test_data AND confidence < 0.85 ORDER BY confidence, id LIMIT 20",
)
def review_queue(spark, sf):
    queue = rev.review_queue(customer_findings(spark, sf), "scan_2", limit=20)
    return queue.select("id", "entity_type", "value", "confidence", "confidence_pct", "file_type")


@register("reviewable_count", CUST + " SELECT count(*) AS reviewable FROM findings WHERE NOT is_test_data AND confidence < 0.85")
def reviewable_count(spark, sf):
    return rev.count_reviewable(customer_findings(spark, sf))


@register(
    "balanced_review",
    CUST + """ SELECT id, entity_type, CAST(sample_rank AS INT) AS sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY confidence, id) AS sample_rank,
 CASE entity_type WHEN 'ssn' THEN 12 WHEN 'email' THEN 7 WHEN 'phone' THEN 9 END AS quota FROM findings WHERE NOT is_test_data) WHERE sample_rank <= quota""",
)
def balanced_review(spark, sf):
    sample = rev.balanced_sample(customer_findings(spark, sf), {"ssn": 12, "email": 7, "phone": 9})
    return sample.select("id", "entity_type", "sample_rank")


@register(
    "apply_verdicts",
    CUST + f" SELECT entity_type, replace(context, value, '[' || upper(entity_type) || ']') AS context, confidence, detector, verdict, {_SUFFIX} AS file_type"
    f" FROM {_V} WHERE confidence < 0.85 AND verdict <> 'skip'",
)
def apply_verdicts(spark, sf):
    queue = rev.review_queue(customer_findings(spark, sf))
    return rev.apply_verdicts(queue, verdicts(spark, sf)).drop("timestamp")


@register("hard_negatives", CUST + f" SELECT id, entity_type, value FROM {_V} WHERE verdict = 'FP' AND confidence > 0.8")
def hard_negatives(spark, sf):
    return rev.hard_negatives(customer_findings(spark, sf), verdicts(spark, sf), 0.8).select("id", "entity_type", "value")


@register(
    "last_files",
    CUST + " SELECT doc_id, path FROM files WHERE sensitive ORDER BY doc_id DESC LIMIT 3",
)
def last_files(spark, sf):
    return ro.last_files_with_matches(customer_files(spark, sf), "doc_id").select("doc_id", "path")


_FILE_ROW = f"""path, CASE WHEN length(path) <= 80 THEN path ELSE '...' || right(path, 77) END AS path_display, coalesce(label_recommendation, 'none') AS label,
 {o.title("coalesce(label_recommendation, 'none')")} AS label_display,
 CASE WHEN label_recommendation LIKE '%confidential%' THEN 'high' WHEN label_recommendation = 'internal' THEN 'medium' ELSE 'low' END AS badge,
 types AS entities, CAST(n_real AS INT) AS match_count"""


@register("report_files", CUST + f" SELECT row_number() OVER (ORDER BY path) AS file_number, {_FILE_ROW} FROM files WHERE sensitive")
def report_files(spark, sf):
    return rep.file_rows(customer_files(spark, sf))


@register(
    "report_matches",
    CUST + f" SELECT path, {o.title('entity_type')} AS type_display, {o.REDACT} AS value_redacted, CAST(trunc(confidence * 100) AS INT) AS confidence_pct, start_pos FROM findings WHERE NOT is_test_data",
)
def report_matches(spark, sf):
    return rep.match_rows(customer_findings(spark, sf))


@register(
    "report_chart",
    CUST + f""" SELECT entity_type, n, round(n * 100.0 / max(n) OVER (), 6)::DOUBLE AS percent, {o.title('entity_type')} AS display
 FROM (SELECT entity_type, count(*) AS n FROM findings WHERE NOT is_test_data GROUP BY 1)""",
)
def report_chart(spark, sf):
    return rep.entity_chart(customer_findings(spark, sf)).withColumn("percent", F.round("percent", 6))


@register(
    "export_json",
    CUST + f""", m AS (SELECT doc_id AS key, list({{'entity_type': entity_type, 'value': {o.REDACT}, 'confidence': confidence, 'confidence_level': {o.BAND},
 'detector': detector, 'is_test_data': is_test_data, 'model_version': CAST(NULL AS STRING)}} ORDER BY start_pos) AS matches FROM findings GROUP BY doc_id)
 SELECT path, CAST(to_json({{'path': path, 'size_bytes': doc_id, 'modified': NULL, 'has_sensitive_data': sensitive, 'label_recommendation': label_recommendation,
 'error': NULL, 'matches': coalesce(matches, [])}}) AS STRING) AS json FROM files f LEFT JOIN m ON m.key = f.doc_id""",
)
def export_json(spark, sf):
    files = customer_files(spark, sf).withColumn("size_bytes", F.col("doc_id")).withColumn("modified", F.lit(None).cast("timestamp"))
    return rep.export_files_json(files)


# --- labels ---------------------------------------------------------------------------------------

_TENANT = [
    ("guid-1", "Highly Confidential"), ("guid-2", "Confidential"), ("guid-3", "Internal Use"), ("guid-4", "public"), ("guid-5", "Legal"),
]
_TENANT_SQL = "(VALUES " + ", ".join(f"('{i}', '{n}')" for i, n in _TENANT) + ") AS t(id, name)"


def tenant(spark):
    return local_rows(spark, _TENANT, "id string, name string")


_MAPPED_CASE = "CASE label_recommendation WHEN 'highly_confidential' THEN 'guid-1' WHEN 'confidential' THEN 'guid-2' WHEN 'public' THEN 'guid-4' END"


@register(
    "label_mapping",
    CUST + f" SELECT label_recommendation, {_MAPPED_CASE} AS label_id, count(*) AS n FROM files WHERE label_recommendation IS NOT NULL GROUP BY ALL",
)
def label_mapping(spark, sf):
    mapping = lab.auto_map(spark, tenant(spark))
    counted = ro.label_totals(customer_files(spark, sf))
    joined = counted.join(F.broadcast(mapping), counted["label_recommendation"] == mapping["recommendation"], "left")
    return joined.select("label_recommendation", "label_id", F.col("n_files").alias("n"))


_WANTED = f"CASE o_orderkey % 6 WHEN 0 THEN {_GUID} WHEN 1 THEN 'CONFIDENTIAL' WHEN 2 THEN 'legal' WHEN 3 THEN 'internal' WHEN 4 THEN 'Public' ELSE 'nothing' END"


@register(
    "resolve_labels",
    f"""SELECT label_id, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, CASE WHEN length(label) = 36 AND length(label) - length(replace(label, '-', '')) = 4 THEN 'a guid'
 WHEN lower(label) = 'confidential' THEN 'mapped-2' WHEN lower(label) = 'legal' THEN 'guid-5' WHEN lower(label) = 'public' THEN 'guid-4' END AS label_id
 FROM (SELECT o_orderkey, {_WANTED} AS label FROM orders)) GROUP BY 1""",
)
def resolve_labels(spark, sf):
    wanted = dv.table(spark, sf, "orders").select("o_orderkey", F.expr(_WANTED).alias("label"))
    mapping = lab.mapping_from_dict(spark, {"confidential": "mapped-2"})
    rows = lab.resolve_labels(wanted, mapping, tenant(spark))
    shown = F.when(S.is_guid(F.col("label_id")), "a guid").otherwise(F.col("label_id"))
    return rows.groupBy(shown.alias("label_id")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


def cloud_files(spark, sf):
    files = customer_files(spark, sf)
    return files.withColumn("item_id", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("item-"), F.col("doc_id").cast("string"))))


def current_labels(spark, sf):
    rows = dv.table(spark, sf, "customer").filter("c_custkey % 5 = 0")
    return rows.select(
        F.concat(F.lit("item-"), F.col("c_custkey").cast("string")).alias("item_id"), F.lit("guid-5").alias("label_id"), F.lit("Legal").alias("label_name")
    )


_PLAN = CUST + f""", plan AS (SELECT path, CASE WHEN doc_id % 7 <> 0 THEN 'item-' || doc_id END AS item_id, label_recommendation AS recommendation,
 CASE WHEN doc_id % 7 = 0 THEN 'skipped' WHEN {_MAPPED_CASE} IS NULL THEN 'error' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'labeled' END AS status,
 CASE WHEN doc_id % 7 = 0 THEN 'Not a cloud file (missing item id)' WHEN {_MAPPED_CASE} IS NULL THEN 'Could not resolve label for: ' || label_recommendation
   WHEN doc_id % 5 = 0 THEN 'Already labeled: Legal' ELSE 'Would label' END AS reason,
 CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN 'guid-5' END AS previous_label, CASE WHEN doc_id % 7 <> 0 THEN {_MAPPED_CASE} END AS new_label,
 CASE WHEN doc_id % 7 <> 0 THEN CASE label_recommendation WHEN 'highly_confidential' THEN 'Highly Confidential' WHEN 'confidential' THEN 'Confidential' WHEN 'public' THEN 'public' END END AS new_label_name
 FROM files WHERE sensitive AND label_recommendation IS NOT NULL)"""


def _label_plan(spark, sf):
    return lab.plan_labels(cloud_files(spark, sf), lab.auto_map(spark, tenant(spark)), tenant(spark), current_labels(spark, sf))


register("label_plan", _PLAN + " SELECT * FROM plan")(_label_plan)


@register(
    "label_summary",
    _PLAN + " SELECT status, CASE WHEN status = 'labeled' THEN coalesce(new_label_name, recommendation, 'unknown') END AS label, count(*) AS n_files FROM plan GROUP BY ALL",
)
def label_summary(spark, sf):
    return lab.label_summary(_label_plan(spark, sf))


@register(
    "label_plan_local",
    CUST + f""" SELECT path, label_recommendation AS recommendation, CASE WHEN lower({_SUFFIX}) IN ('.docx', '.pdf') AND {_MAPPED_CASE} IS NOT NULL THEN 'labeled' ELSE 'skipped' END AS status,
 CASE WHEN lower({_SUFFIX}) NOT IN ('.docx', '.pdf') THEN 'unsupported type' WHEN {_MAPPED_CASE} IS NULL THEN 'no label mapping for ' || label_recommendation ELSE 'Would label' END AS reason,
 CASE WHEN lower({_SUFFIX}) IN ('.docx', '.pdf') THEN {_MAPPED_CASE} END AS new_label
 FROM files WHERE sensitive AND label_recommendation IS NOT NULL""",
)
def label_plan_local(spark, sf):
    return lab.plan_local_labels(customer_files(spark, sf), lab.auto_map(spark, tenant(spark))).drop("new_label_name")


_SUBTREE = f"""WITH RECURSIVE tree AS ({o.TREE}), sub AS (SELECT id FROM tree WHERE parent_id = 'r1' UNION ALL SELECT t.id FROM tree t JOIN sub s ON t.parent_id = s.id)
SELECT t.id, t.path FROM tree t JOIN sub s ON s.id = t.id WHERE NOT t.is_folder"""


@register("expand_folder", _SUBTREE)
def expand_folder(spark, sf):
    return drive.expand_folder(dv.drive_tree(spark, sf), "r1").select("id", "path")


@register("list_folder", f"SELECT id, path, is_folder FROM ({o.TREE}) WHERE parent_id = 'n3'")
def list_folder(spark, sf):
    return drive.list_folder(dv.drive_tree(spark, sf), "n3").select("id", "path", "is_folder")


@register(
    "label_plan_folder",
    f"SELECT path, id AS item_id, 'labeled' AS status, 'Would label' AS reason, CAST(NULL AS STRING) AS previous_label, 'guid-2' AS new_label FROM ({_SUBTREE})",
)
def label_plan_folder(spark, sf):
    files = drive.expand_folder(dv.drive_tree(spark, sf), "r1")
    mapping = lab.auto_map(spark, tenant(spark))
    return lab.plan_folder(files, "Confidential", mapping, tenant(spark))


@register(
    "needs_labeling",
    "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey % 5 <> 0",
)
def needs_labeling(spark, sf):
    items = dv.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("item-"), F.col("c_custkey").cast("string")).alias("id"))
    return lab.needs_labeling(items, current_labels(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


_ITEM_JSON = (
    "'{\"id\":\"i' || CAST(o_orderkey AS STRING) || '\",\"name\":\"order ' || CAST(o_orderkey AS STRING) || '.pdf\",\"size\":' || CAST(o_custkey AS STRING)"
    " || CASE WHEN o_orderkey % 3 = 0 THEN ',\"folder\":{\"childCount\":\"2\"}' ELSE ',\"file\":{\"mimeType\":\"application/pdf\"}' END"
    " || ',\"lastModifiedDateTime\":\"2024-03-0' || CAST(1 + o_orderkey % 9 AS STRING) || 'T10:00:00Z\"'"
    " || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',\"parentReference\":{\"id\":\"p' || CAST(o_custkey AS STRING) || '\",\"path\":\"/drive/root:/dept/' || o_orderstatus || '\"}' END || '}'"
)


@register(
    "drive_items",
    """SELECT 'i' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'dept/' || o_orderstatus || '/' END || 'order ' || o_orderkey || '.pdf' AS path,
 o_custkey AS size_bytes, o_orderkey % 3 = 0 AS is_folder, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'application/pdf' END AS mime_type,
 epoch(CAST('2024-03-0' || (1 + o_orderkey % 9) || ' 10:00:00' AS TIMESTAMP))::BIGINT AS modified_s FROM orders""",
)
def drive_items(spark, sf):
    raw = dv.table(spark, sf, "orders").select(F.expr(_ITEM_JSON).alias("value"))
    items = drive.parse_items(raw, F.lit("site"), F.lit("drive"))
    return items.select("id", "path", "size_bytes", "is_folder", "mime_type", F.unix_seconds("modified").alias("modified_s"))


# --- assembled documents --------------------------------------------------------------------------

_PAGE_TEXT = "CASE WHEN l_linenumber % 4 = 3 THEN '  ' ELSE l_returnflag || ' ' || l_linestatus || ' part ' || CAST(l_partkey AS STRING) END"
_ORDERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM {lineitem}"


def ordered_lines(spark, sf):
    return dv.run_shared(spark, sf, _ORDERED, "lineitem")


_ORDERED_SQL = _ORDERED.format(lineitem="lineitem")


@register(
    "assemble_pages",
    f"""SELECT l_orderkey AS doc, string_agg('[Page ' || rn || ']' || chr(10) || t, chr(10) ORDER BY rn) AS text
 FROM (SELECT l_orderkey, rn, {_PAGE_TEXT} AS t FROM ({_ORDERED_SQL})) WHERE trim(t) <> '' GROUP BY 1""",
)
def assemble_pages(spark, sf):
    rows = ordered_lines(spark, sf).select(F.col("l_orderkey").alias("doc"), F.col("rn").alias("page"), F.expr(_PAGE_TEXT).alias("text"))
    return asm.assemble_pages(rows).select("doc", "text")


@register(
    "assemble_sheets",
    f"""SELECT doc, string_agg(line, chr(10) ORDER BY sheet_no, rn) AS text FROM (
 SELECT l_orderkey AS doc, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS sheet_no, rn, CAST(l_partkey AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' | ' || l_returnflag END || ' | ' || l_linestatus AS line
   FROM ({_ORDERED_SQL}) WHERE l_linenumber % 5 <> 0
 UNION ALL SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END, -1, CASE WHEN l_linenumber % 2 = 0 THEN '[Sheet: even]' ELSE '[Sheet: odd]' END FROM lineitem) GROUP BY doc""",
)
def assemble_sheets(spark, sf):
    even = F.col("l_linenumber") % 2 == 0
    empty = F.col("l_linenumber") % 5 == 0
    cell = lambda c, v: F.struct(F.lit(c).alias("col"), F.when(~empty, v).alias("value"))
    rows = ordered_lines(spark, sf).select(
        F.col("l_orderkey").alias("doc"),
        F.when(even, 2).otherwise(1).alias("sheet_no"),
        F.when(even, "even").otherwise("odd").alias("sheet"),
        F.col("rn").alias("row"),
        F.inline(F.array(
            cell(0, F.col("l_partkey").cast("string")),
            cell(1, F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag"))),
            cell(2, F.col("l_linestatus")),
        )),
    )
    return asm.assemble_sheets(rows).select("doc", "text")


@register(
    "assemble_slides",
    f"""SELECT doc, string_agg(t, chr(10) ORDER BY slide, part, seq) AS text FROM (
 SELECT l_orderkey AS doc, 1 + l_linenumber % 2 AS slide, CASE WHEN l_linenumber % 4 = 2 THEN 2 ELSE 1 END AS part, rn AS seq,
   CASE WHEN l_linenumber % 4 = 2 THEN '[Notes]' || chr(10) || ' ' || l_returnflag || ' ' ELSE l_returnflag || ' part ' || l_partkey END AS t
   FROM ({_ORDERED_SQL}) WHERE l_linenumber % 7 <> 6
 UNION ALL SELECT DISTINCT l_orderkey, 1 + l_linenumber % 2, 0, 0, '[Slide ' || (1 + l_linenumber % 2) || ']' FROM lineitem) GROUP BY doc""",
)
def assemble_slides(spark, sf):
    n = F.col("l_linenumber")
    notes = n % 4 == 2
    text = F.when(n % 7 == 6, " ").when(notes, F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).otherwise(
        F.concat(F.lit("  "), "l_returnflag", F.lit(" part "), F.col("l_partkey").cast("string"), F.lit("\n "))
    )
    rows = ordered_lines(spark, sf).select(
        F.col("l_orderkey").alias("doc"), (1 + n % 2).alias("slide"), F.col("rn").alias("seq"),
        F.when(notes, "notes").otherwise("text").alias("kind"), text.alias("text"),
    )
    return asm.assemble_slides(rows).select("doc", "text")


@register(
    "assemble_messages",
    """SELECT o_orderkey, 'From: clerk' || o_custkey || '@shop.com' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'To: buyer@home.org' || chr(10) ELSE '' END
 || CASE WHEN o_orderkey % 3 = 0 THEN 'CC: ' || o_orderpriority || chr(10) ELSE '' END || 'Subject: order ' || o_orderkey || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE chr(10) || 'Status ' || o_orderstatus END
 || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || chr(10) || '[Attachments]' || chr(10) || '- a.pdf' || chr(10) || '- ' || o_orderkey || '.xlsx' ELSE '' END AS text FROM orders""",
)
def assemble_messages(spark, sf):
    k = F.col("o_orderkey")
    rows = dv.table(spark, sf, "orders")
    return rows.select(
        "o_orderkey",
        asm.message_text(
            F.concat(F.lit("clerk"), F.col("o_custkey").cast("string"), F.lit("@shop.com")),
            F.when(k % 2 == 0, "buyer@home.org"),
            F.when(k % 3 == 0, F.col("o_orderpriority")),
            F.concat(F.lit("order "), k.cast("string")),
            F.lit(None).cast("string"),
            F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Status "), "o_orderstatus")),
            F.when(k % 4 == 0, F.array(F.lit("a.pdf"), F.lit(None), F.concat(k.cast("string"), F.lit(".xlsx")))),
        ).alias("text"),
    )


@register(
    "assemble_conversations",
    "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1",
)
def assemble_conversations(spark, sf):
    return asm.assemble_turns(dv.table(spark, sf, "conversations")).select("conv_id", "text")


# --- training -------------------------------------------------------------------------------------


def annotated_corpus(spark, sf):
    names = {"ssn": "SOCIAL_SECURITY_NUMBER", "phone": "PHONE_NUMBER", "medical_record_number": "MRN", "name": "LAST_NAME"}
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    rename = lambda t: F.coalesce(F.try_element_at(F.create_map(*pairs), t), F.upper(t))
    return dv.corpus(spark, sf).select(
        "doc_id",
        "text",
        F.transform(
            "planted",
            lambda p: F.struct(rename(p["entity_type"]).alias("type"), p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("value")),
        ).alias("entities"),
    )


_EXAMPLES = f"""SELECT p.doc_id, substring(c.text, greatest(start_pos - 50, 0) + 1, start_pos - greatest(start_pos - 50, 0)) || '[' || upper(entity_type) || ']' || substring(c.text, end_pos + 1, 50) AS text,
 1 AS label, entity_type, 'corpus' AS source FROM ({o.PLANTED}) p JOIN ({o.CORPUS}) c ON c.doc_id = p.doc_id"""


@register("training_examples", f"{_EXAMPLES} WHERE entity_type IN ('ssn', 'medical_record_number', 'name')")
def training_examples(spark, sf):
    return tr.examples_from_corpus(annotated_corpus(spark, sf), ["ssn", "medical_record_number", "name"], keys=["doc_id"])


def _fp_sql() -> str:
    parts = []
    for i, (kind, sentences) in enumerate(tr.FALSE_POSITIVE_SENTENCES.items()):
        options = " ".join(f"WHEN {j} THEN '{s.replace(chr(39), chr(39) * 2)}'" for j, s in enumerate(sentences))
        mixed = f"((c_custkey % 2147483648) * 1103515245 + {12345 * (i + 1)}) % 2147483648"
        parts.append(
            f"SELECT c_custkey, CASE (({mixed}) // 65536) % {len(sentences)} {options} END AS text, 0 AS label, '{kind}' AS entity_type, 'synthetic_fp' AS source FROM customer"
        )
    return " UNION ALL ".join(parts)


@register("synthetic_false_positives", _fp_sql())
def synthetic_false_positives(spark, sf):
    return tr.synthetic_false_positives(spread_small(dv.table(spark, sf, "customer").select("c_custkey")), "c_custkey")


def _training_set(spark, sf, shuffle=True, files=None):
    examples = tr.examples_from_corpus(annotated_corpus(spark, sf), ["ssn", "phone", "email"])
    negatives = tr.synthetic_false_positives(spread_small(dv.table(spark, sf, "customer").select("c_custkey")), "c_custkey")
    queue = rev.review_queue(customer_findings(spark, sf, files))
    reviewed = rev.apply_verdicts(queue, verdicts(spark, sf, files))
    return tr.prepare_dataset(examples, negatives, reviewed, shuffle)


_TRAINING = CUST + f""", train AS (SELECT text, label, entity_type, source FROM ({_EXAMPLES} WHERE entity_type IN ('ssn', 'phone', 'email'))
 UNION ALL SELECT text, label, entity_type, source FROM ({_fp_sql()})
 UNION ALL SELECT replace(context, value, '[' || upper(entity_type) || ']'), CASE verdict WHEN 'TP' THEN 1 ELSE 0 END, entity_type, 'user_feedback' FROM {_V} WHERE confidence < 0.85 AND verdict <> 'skip')"""

register("training_union", _TRAINING + " SELECT * FROM train")(_training_set)


@register("training_balance", _TRAINING + " SELECT source, label, count(*) AS n FROM train GROUP BY ROLLUP (source, label)")
def training_balance(spark, sf):
    return tr.training_balance(_training_set(spark, sf))


@register(
    "tpfp_filter",
    CUST + " SELECT entity_type, count(*) AS n, true AS flags_only_added, true AS versioned, true AS accurate, md5(string_agg(value || '@' || start_pos, ',' ORDER BY doc_id, start_pos)) AS values_md5"
    " FROM findings GROUP BY 1",
)
def tpfp_filter(spark, sf):
    """Train on the training set, then flag and relabel the findings of the customer documents.

    Which matches are flagged is the model's affair; that no match is lost or moved, that flags are only added and that held-out
    accuracy is above 0.9 can be checked.
    """
    scanned = customer_files(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)  # read by the queue, the verdicts and the model
    model, metrics = tr.train_classifier(_training_set(spark, sf, shuffle=False, files=scanned), max_iter=10, num_features=1 << 12)
    was = F.transform("matches", lambda m: m["is_test_data"]).alias("was")
    files = tr.apply_classifier(scanned.withColumn("was", was), model, threshold=0.5)
    rows = files.select("doc_id", F.explode(F.arrays_zip("matches", "was")).alias("x")).select("doc_id", "x.matches.*", "x.was")
    order = F.sort_array(F.collect_list(F.struct("doc_id", "start", F.concat("value", F.lit("@"), F.col("start").cast("string")).alias("v"))))
    return rows.groupBy("entity_type").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("is_test_data") | ~F.col("was")).alias("flags_only_added"),
        F.bool_and(F.col("model_version").isNotNull()).alias("versioned"),
        F.lit(metrics["accuracy"] > 0.9).alias("accurate"),
        F.md5(F.array_join(F.transform(order, lambda x: x["v"]), ",")).alias("values_md5"),
    )


# --- corpus and evaluation ------------------------------------------------------------------------


@register("generated_corpus", f"SELECT doc_id, category, path, text FROM ({o.CORPUS})")
def generated_corpus(spark, sf):
    return dv.corpus(spark, sf).drop("planted")


@register("planted_entities", f"SELECT doc_id, entity_type, value, start_pos, end_pos FROM ({o.PLANTED})")
def planted_entities(spark, sf):
    return _planted(dv.corpus(spark, sf)).select("doc_id", "entity_type", "value", "start_pos", "end_pos")


def _planted(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", F.inline("planted")).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@register(
    "corpus_manifest",
    f"SELECT category, 'documents' AS item, count(*) AS n FROM ({o.CORPUS}) GROUP BY 1 UNION ALL SELECT category, entity_type, count(*) FROM ({o.PLANTED}) GROUP BY ALL",
)
def corpus_manifest_query(spark, sf):
    return corpus_manifest(dv.corpus(spark, sf))


_CATEGORY = "CASE split_part(path, '/', 1) WHEN 'general' THEN 'clean' WHEN 'test_data' THEN 'test_data' ELSE 'sensitive' END"
_CONFUSION = f"""count(*) AS total_files, count(*) FILTER (category2 = 'sensitive') AS files_with_planted_data, count(*) FILTER (category2 = 'clean') AS files_clean,
 count(*) FILTER (category2 = 'test_data') AS files_test_data, count(*) FILTER (category2 = 'sensitive' AND sensitive) AS true_positives,
 count(*) FILTER (category2 = 'clean' AND sensitive) AS false_positives, count(*) FILTER (category2 = 'sensitive' AND NOT sensitive) AS false_negatives,
 count(*) FILTER (category2 = 'clean' AND NOT sensitive) AS true_negatives"""
_CONF_CTE = f", conf AS (SELECT {_CONFUSION} FROM (SELECT *, {_CATEGORY} AS category2 FROM files))"
_PRF = """round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) AS precision, round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) AS recall,
 round(coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) AS f1_score"""


def _corpus_scores(spark, sf):
    files = classify(dv.corpus(spark, sf).drop("planted"))
    return files.select(
        "doc_id", ev.categorize_path(F.col("path")).alias("category"), has_sensitive_data(F.col("matches")).alias("has_sensitive_data")
    )


def _rounded(df: DataFrame) -> DataFrame:
    for c in ("precision", "recall", "f1_score", "false_positive_rate", "f1_change_pct"):
        if c in df.columns:
            df = df.withColumn(c, F.round(c, 6))
    return df


@register("benchmark_confusion", CORP + _CONF_CTE + " SELECT * FROM conf")
def benchmark_confusion(spark, sf):
    return ev.file_confusion(_corpus_scores(spark, sf))


@register(
    "benchmark_prf",
    CORP + _CONF_CTE + f" SELECT {_PRF}, round(coalesce(false_positives / nullif(false_positives + true_negatives, 0), 0), 6) AS false_positive_rate FROM conf",
)
def benchmark_prf(spark, sf):
    rows = ev.with_metrics(ev.file_confusion(_corpus_scores(spark, sf)))
    return _rounded(rows.select("precision", "recall", "f1_score", "false_positive_rate"))


_OVERLAP = f""", truth AS (SELECT * FROM ({o.PLANTED})), planted_hits AS (SELECT t.entity_type, EXISTS (SELECT 1 FROM findings f WHERE f.doc_id = t.doc_id AND f.entity_type = t.entity_type
 AND NOT f.is_test_data AND f.start_pos < t.end_pos AND t.start_pos < f.end_pos) AS hit FROM truth t),
 found_hits AS (SELECT f.entity_type, EXISTS (SELECT 1 FROM truth t WHERE f.doc_id = t.doc_id AND f.entity_type = t.entity_type AND f.start_pos < t.end_pos AND t.start_pos < f.end_pos) AS hit
 FROM findings f WHERE NOT is_test_data),
 econf AS (SELECT entity_type, sum(tp)::BIGINT AS true_positives, sum(fp)::BIGINT AS false_positives, sum(fn)::BIGINT AS false_negatives FROM (
 SELECT entity_type, CAST(hit AS INT) AS tp, 0 AS fp, 1 - CAST(hit AS INT) AS fn FROM planted_hits UNION ALL SELECT entity_type, 0, 1 - CAST(hit AS INT), 0 FROM found_hits) GROUP BY 1)"""


@register("benchmark_entity_prf", CORP + _OVERLAP + f" SELECT entity_type, true_positives, false_positives, false_negatives, {_PRF} FROM econf")
def benchmark_entity_prf(spark, sf):
    scored = classify(dv.corpus(spark, sf))
    return _rounded(ev.with_metrics(ev.entity_confusion(ev.document_overlaps(scored))))


_RUNS = f""", runs AS (SELECT 'all' AS run, count(*) FILTER (c = 'sensitive' AND s) AS tp, count(*) FILTER (c = 'clean' AND s) AS fp, count(*) FILTER (c = 'sensitive' AND NOT s) AS fn FROM (SELECT {_CATEGORY} AS c, sensitive AS s FROM files)
 UNION ALL SELECT 'sure', count(*) FILTER (c = 'sensitive' AND s), count(*) FILTER (c = 'clean' AND s), count(*) FILTER (c = 'sensitive' AND NOT s) FROM (SELECT {_CATEGORY} AS c,
 EXISTS (SELECT 1 FROM findings g WHERE g.doc_id = f.doc_id AND NOT g.is_test_data AND g.confidence >= 0.85) AS s FROM files f)),
 met AS (SELECT run, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * tp / (2 * tp + fp + fn) AS f FROM runs)"""


@register(
    "benchmark_compare",
    CORP + _RUNS + """ SELECT round(a.p, 6) AS precision_a, round(a.r, 6) AS recall_a, round(a.f, 6) AS f1_score_a, round(b.p, 6) AS precision_b, round(b.r, 6) AS recall_b,
 round(b.f, 6) AS f1_score_b, round((a.f - b.f) / b.f * 100, 6) AS f1_change_pct FROM met a, met b WHERE a.run = 'all' AND b.run = 'sure'""",
)
def benchmark_compare(spark, sf):
    files = classify(dv.corpus(spark, sf).drop("planted"))
    sure = F.exists("matches", lambda m: ~m["is_test_data"] & (m["confidence"] >= 0.85))
    both = files.select(
        ev.categorize_path(F.col("path")).alias("category"),
        F.inline(F.array(
            F.struct(F.lit("all").alias("run"), has_sensitive_data(F.col("matches")).alias("has_sensitive_data")),
            F.struct(F.lit("sure").alias("run"), sure.alias("has_sensitive_data")),
        )),
    )
    rows = ev.compare_metrics(ev.with_metrics(ev.file_confusion(both, "run")), "all", "sure")
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@register("categorized_paths", f"SELECT {_CATEGORY} AS category, count(*) AS n FROM ({o.CORPUS}) GROUP BY 1")
def categorized_paths(spark, sf):
    return dv.corpus(spark, sf).groupBy(ev.categorize_path(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# --- encryption -----------------------------------------------------------------------------------

_KEY_A, _KEY_B = bytes(range(32)), bytes(range(32, 64))


@register(
    "encryption_round_trip",
    CUST + " SELECT id, value, true AS hidden, context AS reopened, true AS wrong_key_is_null FROM findings",
)
def encryption_round_trip(spark, sf):
    rows = customer_findings(spark, sf)
    sealed = rows.select("id", "value", crypto.encrypt(F.col("value"), _KEY_A).alias("sealed"), crypto.encrypt(F.col("context"), _KEY_A).alias("c"))
    return sealed.select(
        "id",
        crypto.decrypt(F.col("sealed"), _KEY_A).alias("value"),
        (~F.contains("sealed", "value")).alias("hidden"),
        crypto.decrypt(crypto.reencrypt(F.col("c"), _KEY_A, _KEY_B), _KEY_B).alias("reopened"),
        crypto.try_decrypt(F.col("sealed"), _KEY_B).isNull().alias("wrong_key_is_null"),
    )


# --- streaming ------------------------------------------------------------------------------------


def _document_stream(spark, sf):
    docs = inc.stream_table(spark, f"{sf}/documents.parquet", dv.table(spark, sf, "documents").schema)
    return docs.select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text"
    )


def _work_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("stream_scan", DOCS + " SELECT path, label_recommendation, CAST(n_matches AS INT) AS n_matches FROM files")
def stream_scan(spark, sf):
    """Drain the documents as a stream into a table and read it back."""
    target = _work_folder(spark, "stream-scan")
    inc.write_results(inc.scan_stream(_document_stream(spark, sf)), f"{target}/out", f"{target}/checkpoint", _KEY_A).awaitTermination()
    return spark.read.parquet(f"{target}/out").select("path", "label_recommendation", F.size("matches").alias("n_matches"))


@register("stream_entity_counts", DOCS + " SELECT entity_type, count(*) AS n FROM findings WHERE NOT is_test_data GROUP BY 1")
def stream_entity_counts(spark, sf):
    counts = inc.live_entity_counts(inc.scan_stream(_document_stream(spark, sf)))
    return inc.drain_complete(counts, "live_entities_" + uuid.uuid4().hex[:8], _work_folder(spark, "stream-entities"))


@register("stream_scan_counts", DOCS + " SELECT count(*) AS scanned, count(*) FILTER (sensitive) AS with_matches, CAST(0 AS BIGINT) AS errors FROM files")
def stream_scan_counts(spark, sf):
    counts = inc.live_scan_counts(inc.scan_stream(_document_stream(spark, sf)))
    return inc.drain_complete(counts, "live_scan_" + uuid.uuid4().hex[:8], _work_folder(spark, "stream-counts"))
