"""Directory scans, assembled documents, drive listings, generated corpora."""

import os

from pyspark.sql import functions as F

from piiscan.functions import scalar as S
from piiscan.operators.detect import explode_findings
from piiscan.operators.rollup import scan_summary
from piiscan.sources import assemble, drive, files, synth
from piiscan.sources.columns import profile_columns


def make_tree(root):
    contents = {
        "hr/record.txt": b"Employee SSN: 078-05-1120",
        "notes.md": b"nothing here",
        "sample.csv": b"Example: 123-45-6789",
        "pay/card.LOG": b"card 4532015112830366",
        "blank.txt": b" \n",
        "node_modules/lib.js": b"ssn 078-05-1120",
        "src/distribution.csv": b"ssn 078-05-1120",
        "x.egg-info/a.txt": b"ssn 078-05-1120",
        "image.png": b"\x89PNG 078-05-1120",
        "latin.txt": "José 078-05-1120".encode("latin-1"),
        "bom.txt": "﻿078-05-1120\r\n078-05-1121\rend".encode("utf-8"),
        "big.txt": b"x" * 3000 + b" 078-05-1120",
        "a b+c.txt": b"a.b@mail.com",
    }
    for name, data in contents.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def test_scan_directory(spark, tmp_path):
    make_tree(tmp_path)
    rows = {os.path.relpath(r.path, tmp_path): r for r in files.scan_directory(spark, str(tmp_path), max_bytes=2048).collect()}
    assert set(rows) == {
        "hr/record.txt", "notes.md", "sample.csv", "pay/card.LOG", "blank.txt", "latin.txt", "bom.txt", "big.txt", "a b+c.txt",
    }
    assert rows["hr/record.txt"].label_recommendation == "confidential"
    assert rows["sample.csv"].matches[0].is_test_data and rows["sample.csv"].label_recommendation is None
    assert rows["blank.txt"].matches == [] and rows["blank.txt"].error is None
    assert rows["latin.txt"].matches[0].context == "José 078-05-1120"
    bom = rows["bom.txt"].matches
    assert [(m.start, m.end) for m in bom] == [(1, 12), (13, 24)] and bom[0].context == "﻿078-05-1120\n078-05-1121\nend"
    assert rows["big.txt"].error == "File too large (0.0 MB > 0 MB limit)" and rows["big.txt"].matches == []
    assert rows["hr/record.txt"].size_bytes == 25


def test_single_file_and_missing_root(spark, tmp_path):
    make_tree(tmp_path)
    row = files.scan_directory(spark, str(tmp_path / "image.png")).first()
    assert row.error == "Unsupported file type: .png" and row.matches == []
    assert files.scan_directory(spark, str(tmp_path / "node_modules/lib.js")).first().matches
    row = files.scan_directory(spark, str(tmp_path / "absent")).first()
    assert row.error.startswith("Cannot access file")


def test_summary_and_custom_exclusion(spark, tmp_path):
    make_tree(tmp_path)
    got = scan_summary(files.scan_directory(spark, str(tmp_path), exclude=["hr", "*.csv"])).first()
    assert (got.total_files, got.files_errored) == (9, 0)


def files_opened(df):
    """Files the scans of an executed plan really read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_excluded_and_large_files_are_pruned_before_reading(spark, tmp_path):
    make_tree(tmp_path)
    opened = files_opened(files.read_documents(spark, str(tmp_path), max_bytes=2048))
    assert opened == 9  # of 13: the large file by its metadata only, excluded and unsupported ones not at all


def test_extensions(spark):
    assert len(files.TEXT_EXTENSIONS) == 43 and len(files.supported_extensions()) == 51
    names = ["a.TXT", ".env", ".gitignore", "a.tar.gz", "noext", "x.", "d.x/readme"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: (r.e, r.k) for r in df.select("p", files.extension(F.col("p")).alias("e"), files.format_kind(F.col("p")).alias("k")).collect()}
    assert got == {
        "a.TXT": (".txt", "text"), ".env": (".env", "text"), ".gitignore": (".gitignore", None), "a.tar.gz": (".gz", None),
        "noext": ("", None), "x.": ("", None), "d.x/readme": ("", None),
    }


def test_assemble_gate_and_shapes(spark):
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 2, "  "), ("a", 3, "three"), ("b", 1, "y" * 50)], "doc string, page int, text string")
    got = {r.doc: (r.text, r.error) for r in assemble.assemble_pages(pages, max_chars=40).collect()}
    assert got["a"] == ("[Page 1]\none\n[Page 3]\nthree", None)
    assert got["b"][0] is None and got["b"][1].startswith("Document too large")
    assert {r.doc: r.text for r in assemble.assemble_pages(pages, max_chars=None).collect()}["b"] == "[Page 1]\n" + "y" * 50


def listing(spark):
    import json

    rows = [
        {"id": "f1", "name": "Dept", "folder": {"childCount": "2"}, "parentReference": {"id": "root", "path": "/drive/root:"}},
        {"id": "f2", "name": "Sub", "folder": {}, "parentReference": {"id": "f1", "path": "/drive/root:/Dept"}},
        {"id": "f3", "name": "Deep", "folder": {}, "parentReference": {"id": "f2", "path": "/drive/root:/Dept/Sub"}},
        {"id": "f4", "name": "Other", "folder": {}, "parentReference": {"id": "root", "path": "/drive/root:"}},
        {"id": "d1", "name": "a.pdf", "size": 5, "file": {"mimeType": "application/pdf"}, "parentReference": {"id": "f1", "path": "/drive/root:/Dept"}, "lastModifiedDateTime": "2024-03-01T10:00:00Z"},
        {"id": "d2", "name": "b.docx", "parentReference": {"id": "f3", "path": "/drive/root:/Dept/Sub/Deep"}},
        {"id": "d3", "name": "c.docx", "parentReference": {"id": "f4", "path": "/drive/root:/Other"}},
        {"id": "d4", "name": "top.txt", "parentReference": {"id": "root", "path": "/drive/root:"}},
        # a loop of folders outside the tree
        {"id": "l1", "name": "L1", "folder": {}, "parentReference": {"id": "l2"}},
        {"id": "l2", "name": "L2", "folder": {}, "parentReference": {"id": "l1"}},
        {"id": "d5", "name": "lost.txt", "parentReference": {"id": "l1"}},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return drive.parse_items(raw, F.lit("s"), F.lit("d"))


def test_drive_listing(spark, monkeypatch):
    monkeypatch.setattr(drive, "_MAX_ROUNDS", 6)
    items = listing(spark)
    by = {r.id: r for r in items.collect()}
    assert by["d2"].path == "Dept/Sub/Deep/b.docx" and by["f1"].is_folder and not by["d1"].is_folder
    assert by["d1"].size_bytes == 5 and by["d1"].mime_type == "application/pdf" and str(by["d1"].modified) == "2024-03-01 10:00:00"
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(drive.list_folder(items, "f1")) == ["d1", "f2"]
    assert ids(drive.files_under_path(items, "Dept")) == ["d1", "d2"]
    assert ids(drive.expand_folder(items, "f1")) == ["d1", "d2"]
    assert ids(drive.expand_folder(items, "f2")) == ["d2"]
    assert ids(drive.expand_folder(items, "root")) == ["d1", "d2", "d3", "d4"]


def test_generated_corpus_spans_are_exact(spark):
    corpus = synth.generate_from_count(spark, 400)
    rows = corpus.collect()
    shares = {c: sum(r.category == c for r in rows) / 400 for c, _ in synth.SHARES}
    assert abs(shares["hr"] - 0.25) < 0.08 and abs(shares["general"] - 0.15) < 0.08
    assert all(r.text[p.start : p.end] == p.value for r in rows for p in r.planted)
    assert "\x01" not in "".join(r.text for r in rows)
    cards = corpus.select(F.inline("planted")).filter("entity_type = 'credit_card'")
    assert cards.filter(~S.luhn_valid(F.col("value"))).isEmpty() and not cards.isEmpty()


def test_column_profile(spark):
    df = spark.createDataFrame([(i, f"u{i}@mail.com" if i % 2 else "n/a", "plain") for i in range(10)], "id int, contact string, note string")
    got = [(r.column_name, r.entity_type, r.rows_with_entity, r.share) for r in profile_columns(df, "id").collect()]
    assert got == [("contact", "email", 5, 0.5)]
