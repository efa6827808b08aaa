"""Scalar functions, rollups, review, labels, training, annotations."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from piiscan.functions import scalar as S
from piiscan.operators import annotations as ann
from piiscan.operators import evaluate as ev
from piiscan.operators import findings as fi
from piiscan.operators import labeling as lab
from piiscan.operators import report as rep
from piiscan.operators import review as rev
from piiscan.operators import rollup as ro
from piiscan.operators import training as tr
from piiscan.operators.classify import classify, scan_documents
from piiscan.operators.detect import explode_findings


def column(spark, values, fn, ddl="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_scalars(spark):
    assert column(spark, ["123-45-6789", "123", "1234", "12345", ""], S.redact) == ["12*******89", "***", "****", "12*45", ""]
    bands = column(spark, [0.95, 0.94, 0.85, 0.84, 0.70, 0.69], S.confidence_level, "v double")
    assert bands == ["very_high", "high", "high", "medium", "medium", "low"]
    assert column(spark, [0.29, 0.85, 0.999, 1.0], S.confidence_pct, "v double") == [int(x * 100) for x in (0.29, 0.85, 0.999, 1.0)]
    assert column(spark, ["/a/b.TXT", ".env", "a.tar.gz", "x.", "/d.e/f", "..foo"], S.file_type) == [".TXT", "", ".gz", "", "", ".foo"]
    assert column(spark, ["medical_record_number", "ssn"], S.display_name) == ["Medical Record Number", "Ssn"]
    assert column(spark, ["x" * 80, "y" * 81], S.truncate_path) == ["x" * 80, "..." + "y" * 77]
    assert column(spark, ["highly_confidential", "confidential", "internal", "public", None], S.badge) == ["high", "high", "medium", "low", "low"]
    assert column(spark, ["(555) 555-5555", "Test@Example.com"], S.normalize_value) == ["5555555555", "test@examplecom"]
    assert column(spark, ["ssn", "cvv", "diagnosis", "password", "other"], S.entity_family) == ["PII", "PCI", "PHI", "secret", None]
    assert column(spark, ["  \x1c\n", "a", None, ""], S.is_blank) == [True, False, True, True]
    assert column(spark, ["a" * 36, "12345678-1234-1234-1234-123456789012"], S.is_guid) == [False, True]
    df = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1, 500000)), (datetime(2024, 1, 1), None)], "a timestamp, b timestamp")
    assert [r.x for r in df.select(S.duration_seconds(F.col("a"), F.col("b")).alias("x")).collect()] == [1.5, 0.0]


def test_anonymize(spark):
    df = spark.createDataFrame([("SSN: 1.2 and 1x2 and 1.2", "1.2", "ssn")], "c string, v string, t string")
    assert df.select(S.anonymize_context(F.col("c"), F.col("v"), F.col("t")).alias("x")).first().x == "SSN: [SSN] and 1x2 and [SSN]"


FILES = [
    ("/a.docx", "078-05-1120 a.b@mail.com"),
    ("/b.txt", "123-45-6789"),
    ("/c.pdf", "call 212-555-1234"),
    ("/d.txt", "plain"),
    ("/e.xlsx", "c.d@mail.com e.f@mail.com"),
]


@pytest.fixture(scope="module")
def files(spark):
    return scan_documents(spark.createDataFrame(FILES, "path string, text string")).cache()


def test_rollups(spark, files):
    by = {r.path: r for r in ro.file_rollup(files).collect()}
    assert by["/a.docx"].entity_types_found == ["email", "ssn"] and by["/a.docx"].highest_confidence == 0.9
    assert by["/b.txt"].highest_confidence == 0.75 and not by["/b.txt"].has_sensitive_data and by["/d.txt"].highest_confidence == 0.0
    got = ro.scan_summary(files).first()
    assert (got.total_files, got.files_with_matches, got.files_errored, got.total_matches) == (5, 3, 0, 5)
    empty = ro.scan_summary(files.limit(0)).first()
    assert (empty.total_files, empty.total_matches) == (0, 0)
    assert [(r.entity_type, r.n) for r in ro.entity_totals(explode_findings(files)).collect()] == [("email", 3), ("phone", 1), ("ssn", 1)]
    assert {r.label_recommendation: r.n_files for r in ro.label_totals(files).collect()} == {"highly_confidential": 1, "internal": 1, "public": 1}


def test_report_numbers_are_dense(spark, files):
    rows = rep.file_rows(files).orderBy("file_number").collect()
    assert [(r.file_number, r.path, r.match_count) for r in rows] == [(1, "/a.docx", 2), (2, "/c.pdf", 1), (3, "/e.xlsx", 2)]
    many = spark.range(5000).select(F.format_string("p%05d", F.col("id")).alias("path")).repartition(16)
    numbered = rep.number_rows(many, "path", "n")
    assert numbered.filter(F.format_string("p%05d", F.col("n") - 1) != F.col("path")).isEmpty() and numbered.count() == 5000


def test_filters(spark, files):
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(fi.filter_files(files, "A.DOC")) == ["/a.docx"]
    assert paths(fi.filter_files(files, label="none")) == ["/b.txt", "/d.txt"]
    assert paths(fi.filter_files(files, entity_type="email")) == ["/a.docx", "/e.xlsx"]


def review_rows(spark, n=300):
    rows = [(f"id{i:04d}", "ssn" if i % 3 else "email", round(0.5 + (i * 37 % 50) / 100, 2), i % 11 == 0, f"/f{i}.txt", "v", f"ctx v {i}", "regex") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, entity_type string, confidence double, is_test_data boolean, file_path string, value string, context string, detector string")


def test_review(spark):
    rows, df = review_rows(spark)
    queue = [(r.confidence, r.id) for r in rev.review_queue(df, limit=25).collect()]
    assert queue == sorted((r[2], r[0]) for r in rows if r[2] < 0.85 and not r[3])[:25]
    assert rev.count_reviewable(df).first().reviewable == sum(r[2] < 0.85 and not r[3] for r in rows)
    got = {(r.entity_type, r.sample_rank): r.id for r in rev.balanced_sample(df, {"ssn": 12, "email": 500}).collect()}
    want = {}
    for kind, quota in (("ssn", 12), ("email", 500)):
        for k, r in enumerate(sorted((r[2], r[0]) for r in rows if r[1] == kind and not r[3])[:quota]):
            want[(kind, k + 1)] = r[1]
    assert got == want
    verdicts = spark.createDataFrame([("id0001", "TP", "t"), ("id0002", "skip", "t"), ("id0004", None, "t"), ("id0005", "FP", "t")], "id string, verdict string, timestamp string")
    out = rev.apply_verdicts(rev.review_queue(df, max_confidence=2.0), verdicts).orderBy("context").collect()
    assert [(r.context, r.verdict, r.file_type) for r in out] == [("ctx [SSN] 1", "TP", ".txt"), ("ctx [SSN] 5", "FP", ".txt")]
    stats = ro.session_statistics(verdicts.fillna({"verdict": "none"})).first()
    assert (stats.total_samples, stats.reviewed, stats.correct, stats.wrong, stats.skipped, stats.accuracy) == (4, 2, 1, 1, 1, 0.5)
    assert ro.verdict_statistics(verdicts.limit(0)).first().accuracy == 0.0


TENANT = [("guid-1", "Highly Confidential"), ("guid-2", "Confidential"), ("guid-9", "Top Secret")]
GUID = "12345678-1234-1234-1234-123456789012"


def test_labels(spark, files):
    tenant = spark.createDataFrame(TENANT, "id string, name string")
    mapping = lab.auto_map(spark, tenant)
    assert {r.recommendation: r.label_id for r in mapping.collect()} == {"highly_confidential": "guid-1", "confidential": "guid-2"}
    wanted = spark.createDataFrame([(GUID,), ("CONFIDENTIAL",), ("top secret",), ("nope",)], "label string")
    got = {r.label: r.label_id for r in lab.resolve_labels(wanted, mapping, tenant).collect()}
    assert got == {GUID: GUID, "CONFIDENTIAL": "guid-2", "top secret": "guid-9", "nope": None}
    checks = lab.mapping_checks(lab.default_mapping(spark)).first()
    assert (checks.has_label_mappings, checks.skipped) == (False, 1)

    cloud = files.withColumn("item_id", F.when(F.col("path") != "/c.pdf", F.concat(F.lit("i"), "path")))
    current = spark.createDataFrame([("i/a.docx", "guid-9", "Top Secret")], "item_id string, label_id string, label_name string")
    plan = {r.path: (r.status, r.reason) for r in lab.plan_labels(cloud, mapping, tenant, current).collect()}
    assert plan == {
        "/a.docx": ("skipped", "Already labeled: Top Secret"),
        "/c.pdf": ("skipped", "Not a cloud file (missing item id)"),
        "/e.xlsx": ("error", "Could not resolve label for: internal"),
    }
    forced = {r.path: (r.status, r.new_label, r.new_label_name) for r in lab.plan_labels(cloud, mapping, tenant, current, skip_already_labeled=False, override="top secret").collect()}
    assert forced["/a.docx"] == ("labeled", "guid-9", "Top Secret") and forced["/e.xlsx"] == ("labeled", "guid-9", "Top Secret")
    summary = {(r.status, r.label): r.n_files for r in lab.label_summary(lab.plan_labels(cloud, mapping, tenant)).collect()}
    assert summary == {("labeled", "Highly Confidential"): 1, ("skipped", None): 1, ("error", None): 1}
    local = {r.path: (r.status, r.reason) for r in lab.plan_local_labels(files, mapping).collect()}
    assert local == {"/a.docx": ("labeled", "Would label"), "/c.pdf": ("skipped", "no label mapping for public"), "/e.xlsx": ("skipped", "no label mapping for internal")}


def test_model_hook(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob"), (2, "boom"), (3, None)], "doc_id bigint, text string")

    def load():
        def model(texts):
            if any(t == "boom" for t in texts):
                raise ValueError("bad text")
            return [[("PERSON", 0, 3, 0.9)] if t.startswith("Ann") else [] for t in texts]

        return model

    rows = ann.annotate_with_model(docs, load)
    got = {(r.doc_id, r.entity_type, r.error) for r in rows.collect()}
    assert got == {(1, "PERSON", None), (2, None, "ValueError: bad text")}
    files = ann.classify_with_annotations(docs, rows.filter("error IS NULL"))
    by = {r.doc_id: r for r in files.collect()}
    assert [(m.entity_type, m.value, m.detector) for m in by[1].matches] == [("name", "Ann", "presidio")]
    assert by[1].label_recommendation == "internal" and by[2].matches == [] and by[3].matches == []
    assert len(ann.supported_entities()) == 14
    few = ann.usable_annotations(spark.createDataFrame([(1, "PERSON", 0, 3, 0.5), (1, "ORG", 0, 3, 0.9), (1, "NRP", 0, 1, 0.49)], f"doc_id int, {ann.ANNOTATION_DDL}"))
    assert [r.mapped_type for r in few.collect()] == ["name"]


def test_training(spark, files, tmp_path):
    corpus = spark.createDataFrame(
        [("a" * 60 + " 078-05-1120 " + "b" * 60, [("SSN", 61, 72, "078-05-1120")]), ("Ann is 1 of 1", [("FIRST_NAME", 0, 3, "Ann"), ("CUSTOM", 7, 8, "1")])],
        "text string, entities array<struct<type:string,start:int,end:int,value:string>>",
    )
    got = [(r.text, r.entity_type) for r in tr.examples_from_corpus(corpus).collect()]
    assert got == [("a" * 49 + " [SSN] " + "b" * 49, "ssn"), ("[NAME] is 1 of 1", "name"), ("Ann is [CUSTOM] of 1", "custom")]
    assert tr.examples_from_corpus(corpus, ["name"]).count() == 1 and tr.examples_from_corpus(corpus, max_examples=2).count() == 2

    negatives = tr.synthetic_false_positives(spark.range(40), "id")
    assert negatives.count() == 240 and negatives.filter("label <> 0").isEmpty()
    assert tr.synthetic_false_positives(spark.range(5), "id", ["ssn", "unknown"]).count() == 5
    assert tr.read_verdicts(spark, str(tmp_path / "none")).isEmpty()
    spark.createDataFrame([("ssn", "c [SSN]", 0.7, "regex", v, ".txt", "t") for v in ("TP", "FP", "skip")], tr.VERDICTS).write.json(str(tmp_path / "v"))
    verdicts = tr.read_verdicts(spark, str(tmp_path / "v"))
    positives = spark.range(240).select(F.format_string("payroll record %d of employee [SSN] salary", F.col("id")).alias("text"), F.lit(1).alias("label"), F.lit("ssn").alias("entity_type"), F.lit("corpus").alias("source"))
    data = tr.prepare_dataset(positives, negatives, verdicts)
    assert data.count() == 482 and data.collect() == tr.prepare_dataset(positives, negatives, verdicts).collect()
    balance = {(r.source, r.label): r.n for r in tr.training_balance(data).collect()}
    assert balance[(None, None)] == 482 and balance[("user_feedback", 1)] == 1 and balance[("synthetic_fp", None)] == 240

    model, metrics = tr.train_classifier(data, max_iter=10, num_features=1 << 10)
    assert metrics["accuracy"] > 0.9
    tr.save_model(spark, model, str(tmp_path / "m"))
    loaded, meta = tr.load_model(spark, str(tmp_path / "m"))
    assert meta["version"] == tr.MODEL_VERSION
    texts = spark.createDataFrame([("Unit test fixture uses 078-05-1120",), ("payroll record 7 of employee 078-05-1120 salary",)], "text string")
    docs = classify(texts.withColumn("path", F.col("text")))
    flagged = {r.path[:4]: r for r in tr.apply_classifier(docs, loaded).collect()}
    assert flagged["Unit"].matches[0].is_test_data and flagged["Unit"].label_recommendation is None
    assert not flagged["payr"].matches[0].is_test_data and flagged["payr"].matches[0].model_version == tr.MODEL_VERSION


def test_evaluation(spark):
    paths = ["hr/a.txt", "finance/x/b.txt", "medical/c", "general/d", "test_data/e", "manifest.json", "other/f"]
    assert column(spark, paths, ev.categorize_path) == ["sensitive", "sensitive", "sensitive", "clean", "test_data", "unknown", "unknown"]
    rows = spark.createDataFrame([("sensitive", True)] * 3 + [("sensitive", False), ("clean", True), ("clean", False), ("test_data", True)], "category string, has_sensitive_data boolean")
    m = ev.with_metrics(ev.file_confusion(rows)).first()
    assert (m.true_positives, m.false_positives, m.false_negatives, m.true_negatives) == (3, 1, 1, 1)
    assert (m.precision, m.recall, m.f1_score, m.false_positive_rate) == (0.75, 0.75, 0.75, 0.5)
    none = ev.with_metrics(ev.file_confusion(rows.limit(0))).first()
    assert (none.precision, none.recall, none.f1_score) == (0.0, 0.0, 0.0)


def test_span_overlap_sweep_against_pairs(spark):
    import random

    rng = random.Random(5)

    def disjoint():
        out, at = [], 0
        for _ in range(rng.randint(0, 8)):
            at += rng.randint(0, 6)
            end = at + rng.randint(1, 6)
            out.append((at, end))
            at = end
        return out

    sets = {d: (disjoint(), disjoint()) for d in range(60)}
    frame = lambda i: spark.createDataFrame([(d, "x", s, e) for d, v in sets.items() for s, e in v[i]], "doc_id int, entity_type string, start_pos int, end_pos int")
    got = {(r.side, r.doc_id, r.start_pos): r.overlaps for r in ev.span_overlaps(frame(0), frame(1)).collect()}
    want = {}
    for d, (found, planted) in sets.items():
        want |= {("found", d, s): any(a < e and s < b for a, b in planted) for s, e in found}
        want |= {("planted", d, s): any(a < e and s < b for a, b in found) for s, e in planted}
    assert got == want


def test_compare_runs_counts_copies(spark):
    before = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    after = spark.createDataFrame([("a",), ("c",), ("c",)], "k string")
    got = {(r.k, r.change, r.copies) for r in fi.compare_runs(before, after, ["k"]).collect()}
    assert got == {("a", "disappeared", 1), ("b", "disappeared", 1), ("c", "appeared", 2)}


def test_verdict_files_and_training_sets(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    assert tr.clear_verdicts(spark, path) == 0
    rows = spark.createDataFrame([("ssn", "c [SSN]", 0.7, "regex", v, ".txt", "t") for v in ("TP", "FP", "skip", None)], tr.VERDICTS)
    tr.save_verdicts(rows, path)
    tr.save_verdicts(rows, path)
    saved = tr.read_verdicts(spark, path)
    assert sorted(r.verdict for r in saved.collect()) == ["FP", "FP", "TP", "TP"]
    tr.write_examples(tr.examples_from_verdicts(saved), str(tmp_path / "train"))
    assert spark.read.schema(tr.TRAINING).json(str(tmp_path / "train")).filter("source = 'user_feedback'").count() == 4
    assert tr.clear_verdicts(spark, path) == 4 and tr.read_verdicts(spark, path).isEmpty()


def test_export_json(spark, files):
    import json

    by = {r.path: json.loads(r.json) for r in rep.export_files_json(files).collect()}
    first = by["/a.docx"]["matches"][0]
    assert first["value"] == "07*******20" and first["confidence_level"] == "medium" and "context" not in first
    assert by["/d.txt"]["has_sensitive_data"] is False and by["/d.txt"]["label_recommendation"] is None
    scan = ro.scan_summary(files).selectExpr("'s1' scan_id", "timestamp'2024-01-01' started_at", "cast(null as timestamp) completed_at", "'/d' source_path", "'filesystem' source_type", "*")
    head = json.loads(rep.export_header_json(scan).first().json)
    assert head["summary"]["total_files"] == 5 and head["completed_at"] is None
