"""Faults that once went unseen: each has its case here."""

import re
import time

import pytest
from pyspark.sql import functions as F

from piiscan.operators import labeling as lab
from piiscan.operators.annotations import annotate_with_model, annotation_spans
from piiscan.operators.classify import classify, scan_documents
from piiscan.operators.detect import detect, explode_findings
from piiscan.operators.patterns import DEFAULT_PATTERNS, EMAIL
from piiscan.sources import assemble
from piiscan.store.audit import AuditLog
from piiscan.store.findings_store import FindingsStore
from piiscan.streaming import incremental as inc

KEY, OTHER = bytes(range(32)), bytes(range(1, 33))


def docs(spark, *rows):
    return spark.createDataFrame(rows, "path string, text string")


@pytest.mark.parametrize("text", ["a." * 500_000 + " @", "a-" * 500_000 + "@", "x@" + "a." * 500_000, "é" + "a" * 1_000_000 + "@b", "." * 1_000_000 + "@x", "1-" * 500_000 + " 1234"])
def test_long_runs_take_linear_time(spark, text):
    frame = docs(spark, ("/x", text))
    classify(docs(spark, ("/x", "warm a@b.com 1234")), "text").collect()
    start = time.time()
    classify(frame, "text").collect()
    assert time.time() - start < 8


EMAIL_TEXTS = [
    "a@b.com-x@y.org", "éa.b@c.org", "é.b@c.org", "..abc@x.com", "-a@b.co", "a@b.c|x@y.org", "_a@b.com a@b.com_", "a@b@c.com", "x@y.z", "%+-@a.bc", "a.@b.cd.e", "é-@b.com",
    "q@w.ab.", "AA@BB.CC|DD", "a@b..com", "é_a.b@c.org", "a@b.com@c.org.d@e.fg", "+a@b.comé", "k@l.mn-o.pq@r.st",
]


def test_email_scan_equals_finditer(spark):
    import random

    r = random.Random(7)
    texts = EMAIL_TEXTS + ["".join(r.choice("ab.@-_%é |c1") for _ in range(r.randint(1, 40))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = explode_findings(frame.select("k", detect(F.col("text"), [EMAIL]).alias("matches"))).select("k", "start", "value").collect()
    got = sorted((r["k"], r["start"], r["value"]) for r in rows)
    want = sorted((k, m.start(), m[0]) for k, t in enumerate(texts) for m in re.finditer(EMAIL.regex, t))
    assert got == want


def test_stored_again_without_findings(spark, tmp_path):
    store = FindingsStore(spark, str(tmp_path / "s"), KEY)
    store.store_scan(scan_documents(docs(spark, ("/x", "SSN 078-05-1120 and a.b@mail.com"))), "/", scan_id="s")
    store.store_scan(scan_documents(docs(spark, ("/x", "clean"))), "/", scan_id="s")
    assert store.get_findings("s", include_test_data=True).count() == 0 and store.get_scan("s").first().total_matches == 0


def test_a_writer_from_before_a_rotation_is_refused(spark, tmp_path):
    found = scan_documents(docs(spark, ("/x", "SSN 078-05-1120")))
    old = FindingsStore(spark, str(tmp_path / "s"), KEY)
    old.store_scan(found, "/", scan_id="a")
    FindingsStore(spark, old.root, KEY).rotate_key(OTHER)
    with pytest.raises(ValueError, match="another key"):
        old.store_scan(found, "/", scan_id="b")
    now = FindingsStore(spark, old.root, OTHER)
    now.store_scan(found, "/", scan_id="b")
    assert {r.value for r in now.get_findings().collect()} == {"078-05-1120"} and now.get_findings().count() == 2
    assert now.audit.query(action="finding_read").filter("record_count > 0").count() >= 2


def test_annotations_outside_the_text(spark):
    frame = spark.createDataFrame([(1, "abc"), (2, "Anna Lee")], "doc_id int, text string")
    rows = [(1, "PERSON", 10, 20, 0.9), (1, "PERSON", -2, 2, 0.9), (1, "PERSON", 2, 2, 0.9), (1, "PERSON", 3, 1, 0.9), (2, "PERSON", 5, 99, 0.9)]
    spans = annotation_spans(frame, spark.createDataFrame(rows, "doc_id int, entity_type string, start int, end int, score double"))
    got = {r["doc_id"]: [(s["start"], s["end"], s["value"]) for s in r["annotation_spans"]] for r in spans.collect()}
    assert got == {1: [], 2: [(5, 8, "Lee")]}


def test_no_body_is_shuffled_for_a_small_annotation_table(spark, tmp_path):
    spark.createDataFrame([(k, "text " * 50) for k in range(100)], "doc_id int, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, "PERSON", 0, 3, 0.9)], "doc_id int, entity_type string, start int, end int, score double").write.parquet(str(tmp_path / "a"))
    joined = annotation_spans(spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "a")))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_one_model_per_worker(spark, tmp_path):
    folder = tmp_path / "loads"
    folder.mkdir()

    def load():
        import os
        import uuid

        (folder / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda texts: [[] for _ in texts]

    frame = spark.createDataFrame([(k, "x") for k in range(64)], "doc_id int, text string").repartition(32)
    annotate_with_model(frame, load).count()
    loads = [p.name.split("-")[0] for p in folder.iterdir()]
    assert len(loads) == len(set(loads)) <= 8


def test_one_answer_per_request(spark):
    mapping = spark.createDataFrame([("a", "id2", None, False), ("A", "id1", None, False)], "recommendation string, label_id string, label_name string, skip boolean")
    labels = spark.createDataFrame([("id1", "One"), ("id1", "one")], "id string, name string")
    got = lab.resolve_labels(spark.createDataFrame([("a",)], "label string"), mapping, labels).collect()
    assert [r["label_id"] for r in got] == ["id1"]


def test_stream_output_holds_no_clear_text(spark, tmp_path):
    source = tmp_path / "in"
    docs(spark, ("/x", "SSN 078-05-1120 of Ann")).write.parquet(str(source))
    stream = inc.stream_documents(spark, str(source), "path string, text string")
    inc.write_results(inc.scan_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"), KEY).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert len(row["matches"]) == 1 and "078-05" not in str(row) and "value" not in row["matches"][0].asDict()
    shown = []
    inc.last_files(stream, 3, str(tmp_path / "cp2"), shown.append).awaitTermination()
    assert shown == [["/x"]]


def test_audit_has_no_limit_of_its_own(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2024, 1, 1), "finding_read", "u", str(k), k, None, True, None) for k in range(1500)]
    from piiscan.schema import AUDIT
    from piiscan.store.audit import filter_entries

    frame = spark.createDataFrame(rows, AUDIT).repartition(5)
    assert filter_entries(frame).count() == 1500
    assert [r.record_count for r in filter_entries(frame, limit=3).collect()] == [r.record_count for r in filter_entries(frame.repartition(3), limit=3).collect()]
    assert AuditLog(spark, str(tmp_path / "none")).query().count() == 0


def test_segments_equal_the_whole(spark):
    rows = [("d", k, f"row {k} 078-05-1120 call 212-555-{k:04d} a{k}@mail.com" if k % 3 else "x" * (k * 7 % 90)) for k in range(200)]
    pieces = spark.createDataFrame(rows, "doc string, k int, piece string")
    whole = "\n".join(r[2] for r in rows)
    one = explode_findings(docs(spark, ("d", whole)).select(detect(F.col("text")).alias("matches"))).select("start", "end", "entity_type", "value").collect()
    for chars in (60, 500, 10**6):
        parts = assemble.segments(pieces, ["doc"], ["k"], chars=chars)
        assert parts.count() == max(1, parts.agg(F.max("segment")).first()[0] + 1) or chars == 60
        got = assemble.findings_of_segments(parts, ["doc"]).select("start", "end", "entity_type", "value").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, one))


def test_segments_see_findings_over_many_pieces(spark):
    """Phone numbers broken over three and more short pieces, long pieces that skip segments, and borders everywhere."""
    texts = []
    for k in range(60):
        texts += ["call", "212", "555", f"{1000 + k}", "", "x" * (k * 37 % 300), "078", "05", "1120"]
    whole = "\n".join(texts)
    pieces = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "doc string, k int, piece string")
    one = explode_findings(docs(spark, ("d", whole)).select(detect(F.col("text")).alias("matches"))).select("start", "end", "entity_type", "value").collect()
    assert len(one) > 60 and any("\n" in r["value"] for r in one)
    for chars, overlap in ((40, 30), (200, 64), (1000, 1024)):
        parts = assemble.segments(pieces, ["doc"], ["k"], chars=chars, overlap=overlap)
        got = assemble.findings_of_segments(parts, ["doc"]).select("start", "end", "entity_type", "value").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, one))


def test_short_segments_are_scanned_together(spark):
    """Runs of segments are stretches of the whole text, each character of which is read about once."""
    texts = [f"row {k} 078-05-1120 call 212-555-{k:04d}" if k % 3 else "x" * (k * 37 % 300) for k in range(900)]
    whole = "\n".join(texts)
    pieces = spark.createDataFrame([(d, k, t) for d in ("d", None) for k, t in enumerate([*texts, None])], "doc string, k int, piece string")
    parts = assemble.segments(pieces, ["doc"], ["k"], chars=100, overlap=1024)
    assert sum(len(r["text"]) for r in parts.filter("doc = 'd'").collect()) > 5 * len(whole)
    for chars in (1, 5000, 10**9):
        runs = assemble.runs_of_segments(parts, ["doc"], chars).collect()
        assert {r["doc"] for r in runs} == {"d", None} and all(whole[r["base_offset"] :].startswith(r["text"]) for r in runs)
        ends = sorted((r["base_offset"], r["base_offset"] + len(r["text"])) for r in runs if r["doc"])
        assert ends[0][0] == 0 and ends[-1][1] == len(whole) and all(a[1] >= b[0] for a, b in zip(ends, ends[1:]))
        if chars > 1:
            assert sum(b - a for a, b in ends) <= len(whole) + 1500 * len(ends)


def test_rules_have_linear_patterns():
    assert EMAIL.scan and all(p.scan is None for p in DEFAULT_PATTERNS if p is not EMAIL)


def test_tables_in_folders_are_streamed_whole(spark, tmp_path):
    """A table as one file and as a folder of files: a stream over either has all its rows."""
    from piiscan.plans.queries import QUERIES

    rows = [(k, "en", "src", f"row {k} SSN 078-05-1120" if k % 2 else "clean") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    frame.repartition(4).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    frame.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    for form in ("parts", "file"):
        got = QUERIES["stream_scan"](spark, str(tmp_path / form)).collect()
        assert sorted((r["path"], r["n_matches"]) for r in got) == sorted((f"/src/en/doc_{k}.txt", k % 2) for k in range(40))
        assert QUERIES["stream_scan_counts"](spark, str(tmp_path / form)).first()["scanned"] == 40


def test_cells_are_dealt_by_their_number(spark, monkeypatch):
    """A column profile of rows that lie in one partition is read by as many tasks as its cells need."""
    from piiscan.sources import columns

    seen, real = [], columns.classify
    monkeypatch.setattr(columns, "classify", lambda df: (seen.append(df.rdd.getNumPartitions()), real(df))[1])
    monkeypatch.setattr(columns, "CELLS_PER_TASK", 50, raising=False)
    rows = [(k, f"SSN 078-05-1120 row {k}" if k % 4 == 0 else "clean", "a.b@mail.com" if k % 2 else None) for k in range(400)]
    frame = spark.createDataFrame(rows, "k int, a string, b string").coalesce(1)
    got = sorted(map(tuple, columns.profile_columns(frame, "k").select("column_name", "entity_type", "rows_with_entity", "n_rows", "share").collect()))
    assert seen == [16]
    assert got == [("a", "ssn", 100, 400, 0.25), ("b", "email", 200, 400, 0.5)]


def test_training_reads_its_inputs_once_and_spread(spark, tmp_path, monkeypatch):
    """The classifier's query scans the customer documents once, and seeds in one file are dealt to all cores."""
    from piiscan.plans import queries as q

    rows = [(k, f"Customer#{k:09d}", k % 25, float(k), "BUILDING") for k in range(240)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet")
    )
    scans, seeds, files, negatives = [], [], q.customer_files, q.tr.synthetic_false_positives
    monkeypatch.setattr(q, "customer_files", lambda *a: (scans.append(1), files(*a))[1])
    monkeypatch.setattr(q.tr, "synthetic_false_positives", lambda df, *a: (seeds.append(df.rdd.getNumPartitions()), negatives(df, *a))[1])
    got = q.tpfp_filter(spark, str(tmp_path)).collect()
    assert got and all(r["flags_only_added"] and r["versioned"] for r in got)
    assert len(scans) == 1 and seeds == [spark.sparkContext.defaultParallelism]


def test_model_equals_the_pipeline_fitted_as_a_whole(spark):
    from piiscan.operators import training as tr

    rows = [(f"call [PHONE] {'now' if k % 2 else 'example'} {k % 7}", k % 2) for k in range(120)]
    examples = spark.createDataFrame(rows, "text string, label int").coalesce(1)
    model, metrics = tr.train_classifier(examples, max_iter=5, num_features=256)
    kept = examples.select("text", F.col("label").cast("double").alias("label")).persist()
    whole = tr.build_classifier(max_iter=5, num_features=256).fit(kept.randomSplit([0.9, 0.1], 42)[0])
    kept.unpersist()
    assert [type(s) for s in model.stages] == [type(s) for s in whole.stages] and metrics["accuracy"] == 1.0
    assert max(abs(model.stages[-1].coefficients.toArray() - whole.stages[-1].coefficients.toArray())) < 1e-6


def test_training_after_an_observed_query(spark):
    """A model can be sent to tasks in a session that has observed a query (the store does), which its training summary can't."""
    from pyspark.sql import Observation

    from piiscan.operators import training as tr

    counted = Observation()
    spark.range(5).observe(counted, F.count(F.lit(1)).alias("n")).collect()
    assert counted.get["n"] == 5
    examples = spark.createDataFrame([(f"call [PHONE] {'now' if k % 2 else 'example'} {k % 7}", k % 2) for k in range(120)], "text string, label int")
    model, metrics = tr.train_classifier(examples, max_iter=5, num_features=256)
    assert metrics["accuracy"] == 1.0 and not model.stages[-1].hasSummary
    assert tr.predict(model, examples.select("text")).filter("is_true_positive").count() == 60
