"""Registered queries of the findings store, of files on disk and of long documents, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.annotations import annotate_with_model, usable_annotations
from ..operators.classify import scan_documents
from ..operators.labeling import auto_map, mapping_checks
from ..sources import assemble as asm
from ..sources.files import scan_directory
from ..store.findings_store import FindingsStore
from ..streaming import incremental as inc
from . import derive as dv
from . import oracle as o
from .queries import _KEY_A, _KEY_B, CUST, DOCS, _document_stream, _work_folder, register

_FOUND = "entity_type, value, start_pos, is_test_data"


def _store(spark, name: str) -> FindingsStore:
    return FindingsStore(spark, _work_folder(spark, name), _KEY_A, user="query")


def _customer_results(spark, sf):
    return scan_documents(dv.customer_documents(spark, sf))


def _stored(spark, sf, name: str) -> FindingsStore:
    store = _store(spark, name)
    store.store_scan(_customer_results(spark, sf), "/customers", scan_id="s1")
    return store


def _found(rows):
    return rows.select("file_path", "entity_type", "value", F.col("start_pos").cast("long").alias("start_pos"), "is_test_data")


_ALL = CUST + f" SELECT path AS file_path, entity_type, value, CAST(start_pos AS BIGINT) AS start_pos, is_test_data FROM findings"


@register("store_round_trip", _ALL)
def store_round_trip(spark, sf):
    return _found(_stored(spark, sf, "store").get_findings("s1", include_test_data=True))


@register("store_replace", CUST + " SELECT path AS file_path, entity_type, value, CAST(start_pos AS BIGINT) AS start_pos, is_test_data FROM findings WHERE path LIKE '%1%'")
def store_replace(spark, sf):
    """A batch stored again with less to find replaces what was there."""
    store = _stored(spark, sf, "replace")
    store.store_scan(_customer_results(spark, sf).filter("path LIKE '%1%'"), "/customers", scan_id="s1")
    return _found(store.get_findings("s1", include_test_data=True))


@register("store_delete", CUST + " SELECT (SELECT count(*) FROM findings) AS removed, CAST(0 AS BIGINT) AS left_over, (SELECT count(*) FROM findings WHERE NOT is_test_data) AS others")
def store_delete(spark, sf):
    store = _stored(spark, sf, "delete")
    store.store_scan(_customer_results(spark, sf), "/customers", scan_id="s2")
    removed = store.delete_scan("s1")
    left = store.get_findings("s1", include_test_data=True).agg(F.count("*").alias("left_over"))
    others = store.get_findings("s2").agg(F.count("*").alias("others"))
    return left.crossJoin(others).select(F.lit(removed).cast("long").alias("removed"), "left_over", "others")  # one row each


@register("store_rotate", _ALL)
def store_rotate(spark, sf):
    store = _stored(spark, sf, "rotate")
    store.rotate_key(_KEY_B)
    return _found(FindingsStore(spark, store.root, _KEY_B).get_findings("s1", include_test_data=True))


@register("store_export", CUST + f" SELECT path AS file_path, entity_type, {o.REDACT} AS value_redacted FROM findings")
def store_export(spark, sf):
    store = _stored(spark, sf, "export")
    store.export_findings(f"{store.root}/out", "s1")
    return spark.read.json(f"{store.root}/out").select("file_path", "entity_type", "value_redacted")


@register("load_scan", CUST + " SELECT path, CAST(n_matches AS INT) AS n_matches, label_recommendation FROM files")
def load_scan(spark, sf):
    return _stored(spark, sf, "load").load_scan("s1").select("path", F.size("matches").alias("n_matches"), "label_recommendation")


@register(
    "audit_of_store",
    CUST + " SELECT 'finding_store' AS action, count(*) AS record_count FROM findings UNION ALL SELECT 'finding_read', count(*) FROM findings WHERE NOT is_test_data"
    " UNION ALL SELECT 'finding_delete', count(*) FROM findings",
)
def audit_of_store(spark, sf):
    store = _stored(spark, sf, "audited")
    store.get_findings("s1")
    store.delete_scan("s1")
    return store.audit.entries().select("action", "record_count")


@register("stream_to_store", DOCS + " SELECT path AS file_path, entity_type, value, CAST(start_pos AS BIGINT) AS start_pos, is_test_data FROM findings")
def stream_to_store(spark, sf):
    store = _store(spark, "streamed")
    results = inc.scan_stream(_document_stream(spark, sf))
    inc.store_stream(results, store, "live", "/documents", f"{store.root}/progress").awaitTermination()
    return _found(store.get_findings("live", include_test_data=True))


@register(
    "assemble_long_documents",
    f"""WITH lines AS (SELECT l_suppkey AS doc, l_orderkey, l_linenumber, l_partkey, 'line ' || l_orderkey || ' of 078-05-1120, call 212-555-' || lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') AS t FROM lineitem),
 placed AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines)
 SELECT doc, 'ssn' AS entity_type, '078-05-1120' AS value, CAST(pos + strpos(t, '078-05-1120') - 1 AS BIGINT) AS start_pos FROM placed
 UNION ALL SELECT doc, 'phone', t[-12:], CAST(pos + length(t) - 12 AS BIGINT) FROM placed""",
)
def assemble_long_documents(spark, sf):
    """Line items of a supplier as one long document, read in small segments: the offsets are those of the whole."""
    line = "concat('line ', l_orderkey, ' of 078-05-1120, call 212-555-', lpad(cast(l_partkey % 10000 AS string), 4, '0'))"
    pieces = dv.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), "l_orderkey", "l_linenumber", "l_partkey", F.expr(line).alias("piece"))
    parts = asm.segments(pieces, ["doc"], ["l_orderkey", "l_linenumber", "l_partkey"], chars=500)
    return asm.findings_of_segments(parts, ["doc"]).select("doc", "entity_type", "value", F.col("start").cast("long").alias("start_pos"))


@register(
    "assemble_documents",
    """SELECT doc, string_agg(t, chr(10) ORDER BY part, seq) AS text FROM (
 SELECT o_custkey AS doc, 0 AS part, o_orderkey AS seq, 'Order ' || o_orderkey AS t FROM orders WHERE o_orderkey % 3 <> 0
 UNION ALL SELECT o_custkey, 1, o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ' | ' || o_orderpriority ELSE '' END FROM orders
 UNION ALL SELECT DISTINCT o_custkey, 2, 0, 'Customer ' || o_custkey FROM orders UNION ALL SELECT DISTINCT o_custkey, 3, 0, 'end' FROM orders) GROUP BY doc""",
)
def assemble_documents(spark, sf):
    """Word-processor parts: paragraphs (some blank), table cells (some blank, some padded), headers and footers."""
    orders = dv.table(spark, sf, "orders")
    part = lambda kind, row, col, text: F.struct(F.lit(kind).alias("kind"), F.lit(row).alias("row"), F.lit(col).alias("col"), text.alias("text"))
    key = F.col("o_orderkey").cast("string")
    body = orders.select(
        F.col("o_custkey").alias("doc"),
        F.col("o_orderkey").alias("seq"),
        F.inline(F.array(
            part("paragraph", 0, 0, F.when(F.col("o_orderkey") % 3 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("Order "), key))),
            part("cell", 1, 0, F.concat(F.lit("  "), F.col("o_orderstatus"))),
            part("cell", 1, 1, F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderpriority", F.lit("\t"))).otherwise(F.lit("  "))),
        )),
    )
    ends = orders.select(F.col("o_custkey").alias("doc")).distinct().select(
        "doc",
        F.lit(0).cast(body.schema["seq"].dataType).alias("seq"),
        F.inline(F.array(
            part("footer", 0, 0, F.lit("end")), part("header", 0, 0, F.concat(F.lit("Customer "), F.col("doc").cast("string")))
        )),
    )
    return asm.assemble_document(body.unionByName(ends)).select("doc", "text")


@register(
    "scan_written_files",
    CUST + " SELECT 'customers' AS what, CAST(sum(n_matches) AS BIGINT) AS n, count(*) > 0 AS readable FROM files UNION ALL SELECT 'word', (SELECT count(*) FROM nation), true"
    " UNION ALL SELECT 'unread', CAST(0 AS BIGINT), false",
)
def scan_written_files(spark, sf):
    """Texts written as files with Windows line ends, one to a partition, and read back; a word-processor file comes with its parts."""
    root = _work_folder(spark, "files")
    texts = dv.customer_documents(spark, sf).select(F.concat("text", F.lit("\r")).alias("value"))
    texts.write.text(f"{root}/customers.txt")
    dv.table(spark, sf, "region").select(F.lit("binary").alias("value")).coalesce(1).write.text(f"{root}/node_modules/skipped.txt")
    dv.table(spark, sf, "region").select(F.lit("binary").alias("value")).coalesce(1).write.option("compression", "none").text(f"{root}/word")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/word")
    fs = fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    written = [s.getPath() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("part-")][0]
    for name in ("with.docx", "without.docx"):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, written, fs, target, False, spark._jsparkSession.sessionState().newHadoopConf())
    plain = f"/{root.split(':', 1)[-1].lstrip('/')}"
    paragraphs = dv.table(spark, sf, "nation").select(
        F.lit(f"{plain}/with.docx").alias("path"), F.lit("paragraph").alias("kind"), F.col("n_nationkey").alias("seq"), F.lit(0).alias("row"), F.lit(0).alias("col"),
        F.concat(F.lit("SSN 078-05-1120 of "), "n_name").alias("text"),
    )
    parts = asm.assemble_document(paragraphs, "path")
    results = scan_directory(spark, root, exclude=["node_modules", "word/"], parts=parts).filter("path NOT LIKE '%/word/%'")
    kind = F.when(F.col("path").endswith("with.docx"), "word").when(F.col("path").endswith(".docx"), "unread").otherwise("customers")
    n = F.coalesce(F.sum(F.size("matches")), F.lit(0)).cast("long")
    return results.groupBy(kind.alias("what")).agg(n.alias("n"), F.bool_and(F.col("error").isNull()).alias("readable"))


@register("mapping_checked", "SELECT true AS has_label_mappings, CAST(0 AS BIGINT) AS skipped")
def mapping_checked(spark, sf):
    names = F.element_at(F.array(*[F.lit(x) for x in ("Highly Confidential", "confidential", "Internal", "Public")]), F.col("p_partkey").cast("int") % 4 + 1)
    labels = dv.table(spark, sf, "part").select(F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("id"), names.alias("name"))
    return mapping_checks(auto_map(spark, labels))


@register(
    "model_annotations",
    "SELECT doc_id, CAST(strpos(text, 'the ') - 1 AS INT) AS start_pos FROM documents WHERE strpos(text, 'the ') > 0",
)
def model_annotations(spark, sf):
    """A recogniser of the caller's over all documents; here one that marks the first 'the '."""

    def load():
        return lambda texts: [[("PERSON", t.index("the "), t.index("the ") + 3, 0.9)] if "the " in t else [] for t in texts]

    rows = annotate_with_model(dv.documents(spark, sf), load)
    return usable_annotations(rows).select("doc_id", F.col("start").alias("start_pos"))
