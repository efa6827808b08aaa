"""Findings store, encryption, audit and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from piiscan.operators.classify import scan_documents
from piiscan.session import ensure_checkpoint_dir
from piiscan.store import crypto
from piiscan.store.audit import AuditLog
from piiscan.store.findings_store import FindingsStore
from piiscan.streaming import incremental as inc

KEY, OTHER = bytes(range(32)), bytes(range(1, 33))
DOCS = [
    ("/d/a.txt", "SSN: 078-05-1120 and a.b@mail.com"),
    ("/d/b.txt", "sample 123-45-6789"),
    ("/d/c.txt", "nothing"),
    ("/d/d.txt", "call 212-555-1234"),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "path string, text string")


@pytest.fixture()
def store(spark, tmp_path):
    return FindingsStore(spark, str(tmp_path / "store"), KEY, user="tester")


def test_store_and_query(spark, store, tmp_path):
    store.store_scan(scan_documents(docs(spark)), "/d", scan_id="s1")
    store.store_scan(scan_documents(docs(spark).limit(1)), "/d", scan_id="s2")
    scan = store.get_scan("s1").first()
    assert (scan.total_files, scan.files_with_matches, scan.files_errored, scan.total_matches) == (4, 2, 0, 3)
    assert store.get_scan("nope").isEmpty()
    assert [r.scan_id for r in store.list_scans().collect()] == ["s2", "s1"]
    assert [r.file_path for r in store.get_files("s1", only_with_matches=True).collect()] == ["/d/a.txt", "/d/d.txt"]
    found = store.get_findings("s1").orderBy("file_path", "start_pos").collect()
    assert [(r.file_path, r.value) for r in found] == [("/d/a.txt", "078-05-1120"), ("/d/a.txt", "a.b@mail.com"), ("/d/d.txt", "212-555-1234")]
    assert found[0].context.startswith("SSN: 078") and found[0].value_redacted == "07*******20"
    assert store.get_findings("s1", "ssn").count() == 1 and store.get_findings("s1", min_confidence=0.8).count() == 1
    assert store.get_findings("s1", include_test_data=True).count() == 4
    assert store.get_findings_by_file("/d/b.txt").count() == 1
    assert store.get_findings_by_file("/d/b.txt", include_test_data=False).isEmpty()
    assert "value" not in store.get_findings("s1", decrypted=False).columns
    stats = store.statistics().first()
    assert (stats.scans, stats.files, stats.matches, stats.real_matches, stats.test_data_matches) == (2, 5, 6, 5, 1)
    assert stats.by_entity_type == {"ssn": 2, "email": 2, "phone": 1}


def test_filters_reach_the_scan(spark, store):
    store.store_scan(scan_documents(docs(spark)), "/d", scan_id="s1")
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = store.get_findings("s1", "ssn", 0.5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [line for line in plan.splitlines() if "FileScan" in line]
    assert all("= s1)" in line.split("PartitionFilters")[1] for line in pushed)
    assert any("EqualTo(entity_type,ssn)" in line and "GreaterThanOrEqual(confidence,0.5)" in line for line in pushed)


def test_load_scan_is_the_inverse(spark, store):
    before = scan_documents(docs(spark))
    store.store_scan(before, "/d", scan_id="s1")
    def plain(rows):
        return [(p, str(l), str(e), m) for p, l, e, m in sorted((r.path, r.label_recommendation, r.error, [tuple(m) for m in r.matches]) for r in rows)]
    assert plain(store.load_scan("s1").collect()) == plain(before.collect())


def test_replay_replaces(spark, store):
    for _ in range(2):
        store.store_scan(scan_documents(docs(spark)), "/d", scan_id="s1", batch_id=3)
    assert store.table("files").count() == 4 and store.table("matches").count() == 4


def test_delete_purge_rotate_export(spark, store, tmp_path):
    store.store_scan(scan_documents(docs(spark)), "/d", scan_id="s1")
    store.store_scan(scan_documents(docs(spark)), "/d", scan_id="s2")
    assert store.rotate_key(OTHER) == 8
    assert {r.value for r in store.get_findings("s2", "email").collect()} == {"a.b@mail.com"}
    old = FindingsStore(spark, store.root, KEY)
    with pytest.raises(Exception):
        old.get_findings("s2").collect()
    assert store.delete_scan("s1") == 4 and store.delete_scan("s1") == 0
    assert store.get_scan("s1").isEmpty() and store.get_scan("s2").count() == 1
    assert store.export_findings(str(tmp_path / "out"), "s2") == 4
    assert "value" not in spark.read.json(str(tmp_path / "out")).columns
    assert store.purge_all() == 4 and store.table("matches").isEmpty() and store.table("scans").isEmpty()
    actions = {r.action for r in store.audit.entries().collect()}
    assert {"finding_store", "finding_read", "finding_delete", "finding_export", "key_rotate"} <= actions
    counts = [r.record_count for r in store.audit.query(action="finding_delete").collect()]
    assert counts == [4, 0, 4]


def test_bad_scan_id(spark, store):
    with pytest.raises(ValueError):
        store.store_scan(scan_documents(docs(spark)), "/d", scan_id="../x")


def test_encryption(spark):
    df = spark.createDataFrame([("078-05-1120",), ("",), (None,), ("naïve 日本",)], "v string")
    v = F.col("v")
    rows = df.select(
        v, crypto.encrypt(v, KEY).alias("c"), crypto.decrypt(crypto.encrypt(v, KEY), KEY).alias("back"),
        crypto.try_decrypt(crypto.encrypt(v, KEY), OTHER).alias("wrong"),
    ).collect()
    assert all(r.back == r.v for r in rows)
    assert rows[1].c == "" and rows[2].c is None and "078" not in rows[0].c and rows[0].wrong is None
    with pytest.raises(ValueError):
        crypto.encrypt(v, b"short")
    assert len(crypto.generate_key()) == 32


def test_audit_log(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "audit"), user="ann")
    assert log.entries().isEmpty()
    log.log("scan_start", {"path": "/d"}, scan_id="s1")
    log.log("scan_complete", scan_id="s1", record_count=3)
    log.log("data_export", success=False, error="disk full")
    with open(tmp_path / "audit" / "bad.json", "w") as f:
        f.write('not json\n{"action": "unknown_thing", "timestamp": "2024-01-01T00:00:00Z", "user": "x"}\n')
        f.write(json.dumps({"action": "db_open", "timestamp": "2020-01-01T00:00:00Z", "user": "bob", "details": "{}"}) + "\n")
    assert [r.action for r in log.query().collect()] == ["db_open", "scan_start", "scan_complete", "data_export"]
    assert [r.action for r in log.query(limit=1, newest_first=True).collect()] == ["data_export"]
    assert log.query(scan_id="s1").count() == 2 and log.query(action="db_open").first().success is True
    assert log.query(since="2021-01-01 00:00:00").count() == 3
    stats = log.statistics().first()
    assert (stats.entries, stats.errors) == (4, 1)
    assert {r.user: r.entries for r in log.statistics("user").collect()} == {"ann": 3, "bob": 1}
    with pytest.raises(ValueError):
        log.log("no_such_action")


def test_streaming_equals_batch(spark, store, tmp_path):
    source = str(tmp_path / "in")
    docs(spark).repartition(4, "path").write.parquet(source)
    stream = lambda: inc.scan_stream(inc.stream_documents(spark, source, "path string, text string", files_per_batch=1))
    inc.store_stream(stream(), store, "live", source, str(tmp_path / "cp1")).awaitTermination()
    assert store.get_scan("live").first().total_files == 4
    assert store.get_findings("live").count() == 3
    counts = inc.drain_complete(inc.live_entity_counts(stream()), "t_entities", str(tmp_path / "cp2"))
    assert {r.entity_type: r.n for r in counts.collect()} == {"ssn": 1, "email": 1, "phone": 1}
    totals = inc.drain_complete(inc.live_scan_counts(stream()), "t_totals", str(tmp_path / "cp3")).first()
    assert (totals.scanned, totals.with_matches, totals.errors) == (4, 2, 0)


def test_nothing_readable_at_rest(spark, store):
    store.store_scan(scan_documents(docs(spark)), "/d", scan_id="s1")
    for root, _, names in os.walk(store.root):
        for name in names:
            with open(os.path.join(root, name), "rb") as f:
                data = f.read()
            assert b"078-05-1120" not in data and b"a.b@mail.com" not in data
    assert ensure_checkpoint_dir(spark)
