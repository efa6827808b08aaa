"""Labelled corpus with planted entities, generated from the rows of any seed table.

Values and sentences are SQL expressions over the seed number, in the subset of SQL that every engine
shares, so the same corpus can be rebuilt elsewhere for checking.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sum

# --- Fixed values: category shares in percent, and the numbers documents are drawn from ----------

SHARES = [("hr", 25), ("finance", 25), ("medical", 25), ("general", 15), ("test_data", 10)]
FILE_PREFIX = {
    "hr": "employee_record",
    "finance": "financial_doc",
    "medical": "patient_record",
    "general": "document",
    "test_data": "test_doc",
}

TEMPLATES = {
    "hr": [
        "Personnel file of {name}\nStaff number S{n5}\nSocial security: {ssn}\nBorn {date}\n"
        "Reach at {phone} or {email}\nHome: {address}\nIn case of emergency call {phone2}\n",
        "Enrollment for benefits\nMember {name}, SSN {ssn}\nPlan number {plan}\n"
        "Dependent: {name2}, SSN {ssn2}\nSalary account {n9}\n",
        "Leaving notice {date}\n{name} ({ssn}) leaves team {n3}.\nFinal pay ${n4}.{n2}\nMail documents to {address}\n",
    ],
    "finance": [
        "Invoice {n5} of {date}\nFor {name}, {address}\nCharged to card {card}\nTotal ${n4}.{n2}\n",
        "Receipt {n9}\nBuyer {name}\nE-mail {email}\nTelephone {phone}\nPaid by card ending {n4}\nQuestions: desk@shop-{n3}.com\n",
        "Transfer {n9}\nBeneficiary {name}\nCard on file: {card}\nPurpose: services, {date}\n",
    ],
    "medical": [
        "Patient sheet\n{name}, record {mrn}\nSSN {ssn}\nInsurance {plan}\nContact {phone}, {email}\nAllergies: none\n",
        "Prescription for {name}\nRecord {mrn}\nDose {n2} mg\nPharmacy line {phone}\n",
        "Laboratory report\n{mrn}\nSampled {date}\nGlucose {n2} mg\nCoverage {plan}\n",
    ],
    "general": [
        "Newsletter, issue {n2}\nThe team met its goals for quarter {n1}.\nNext gathering on {date}.\n",
        "Minutes of {date}\nPresent: lead, developer, designer\nBudget ${n5}\nAction: update the plan.\n",
        "Proposal {n3}\nAim: fewer manual steps.\nCost about ${n5}, start {date}.\n",
    ],
    "test_data": [
        "Sandbox record, not real\nSSN 123-45-6789\nCard 4111111111111111\nPhone 555-555-5555\nMail test@example.com\n",
        "Validation examples\n000-00-0000 and 111-11-1111\nCards 4242424242424242, 5500000000000004\n",
        "Developer fixture\nSSN: 123-45-6789\nPhone: (555) 555-5555\nMail: user@test.com\n",
    ],
}

FIRST_NAMES = ["Ada", "Bruno", "Chen", "Dina", "Emil", "Fatima", "Goran", "Hana"]
LAST_NAMES = ["Archer", "Bakker", "Costa", "Dorsey", "Ekman", "Fontana", "Grant", "Hughes"]
STREETS = ["Mill Lane", "Harbour Road", "Station Street", "Garden Way"]
CITIES = ["Northfield", "Eastwick", "Southport", "Westbrook"]
DOMAINS = ["mailbox.net", "office.org", "firm.com", "post.io"]
PLAN_PREFIXES = ["HP", "HPID-", "Health Plan: ", "BC"]
#: Entity type planted by a template field.
PLANTED = {
    "ssn": "ssn", "ssn2": "ssn", "card": "credit_card", "email": "email", "phone": "phone", "phone2": "phone",
    "mrn": "medical_record_number", "plan": "health_plan_id", "name": "name", "name2": "name", "address": "address",
}

OPEN, MID, CLOSE = "chr(1)", "chr(2)", "chr(3)"
_LCG = 2147483648


def pick(seed: str, salt: int, n: int) -> str:
    """A number in [0, n) drawn from the seed: three rounds of 31-bit congruential mixing."""
    first = f"((({seed}) % {_LCG} + {salt * 7919 + 17}) * 1103515245 + 12345) % {_LCG}"
    second = f"(({first}) * 69069 + {salt + 1}) % {_LCG}"
    third = f"(({second}) * 1103515245 + 12345) % {_LCG}"
    return f"(CAST(floor(({third}) / 64) AS BIGINT) % {n})"


def _padded(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


def _number(number: str) -> str:
    return f"CAST({number} AS STRING)"


def _choice(number: str, options: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options[:-1]))
    return f"CASE {number} {whens} ELSE '{options[-1]}' END"


def luhn_card(prefix: str) -> str:
    """15 digits and their check digit."""
    terms = []
    for i in range(1, 16):
        d = f"CAST(substring({prefix}, {i}, 1) AS BIGINT)"
        terms.append(f"(2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)" if i % 2 else d)
    return f"({prefix} || CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS STRING))"


def _draws() -> dict[str, str]:
    """Column name -> drawn number. Each is computed once per document, below the texts."""
    ranges = {"kind": 100, "template": 3, "card_a": 10_000_000, "card_b": 10_000_000}
    for s in ("ssn", "ssn2"):
        ranges |= {f"{s}_a": 898, f"{s}_g": 99, f"{s}_s": 9999}
    for p in ("phone", "phone2"):
        ranges |= {f"{p}_a": 800, f"{p}_e": 800, f"{p}_s": 9000, f"{p}_f": 3}
    for n in ("name", "name2"):
        ranges |= {f"{n}_f": len(FIRST_NAMES), f"{n}_l": len(LAST_NAMES)}
    ranges |= {"mail_n": len(FIRST_NAMES), "mail_i": 9999, "mail_d": len(DOMAINS)}
    ranges |= {"mrn": 9_000_000, "mrn_x": 10, "plan_p": len(PLAN_PREFIXES), "plan_a": 9_000_000, "plan_b": 1000}
    ranges |= {"home_n": 999, "home_s": len(STREETS), "home_c": len(CITIES), "mm": 12, "dd": 28, "yy": 60}
    ranges |= {f"n{w}": 9 * 10 ** (w - 1) for w in (1, 2, 3, 4, 5)} | {"n9_a": 9_000_000, "n9_b": 100}
    return {f"d_{name}": pick("seed", 3 * i + 1, n) for i, (name, n) in enumerate(ranges.items())}


def _fields() -> dict[str, str]:
    """Template field -> text over the drawn columns."""

    def ssn(s: str) -> str:
        area = f"d_{s}_a + CASE WHEN d_{s}_a < 665 THEN 1 ELSE 2 END"
        return f"{_padded(area, 3)} || '-' || {_padded(f'1 + d_{s}_g', 2)} || '-' || {_padded(f'1 + d_{s}_s', 4)}"

    def phone(p: str) -> str:
        a, e, n = _number(f"200 + d_{p}_a"), _number(f"200 + d_{p}_e"), _number(f"1000 + d_{p}_s")
        return (
            f"CASE d_{p}_f WHEN 1 THEN '(' ELSE '' END || {a} || CASE d_{p}_f WHEN 0 THEN '-' WHEN 1 THEN ') ' ELSE '.' END"
            f" || {e} || CASE d_{p}_f WHEN 2 THEN '.' ELSE '-' END || {n}"
        )

    def name(n: str) -> str:
        return f"{_choice(f'd_{n}_f', FIRST_NAMES)} || ' ' || {_choice(f'd_{n}_l', LAST_NAMES)}"

    return {
        "ssn": ssn("ssn"),
        "ssn2": ssn("ssn2"),
        "card": luhn_card("card_prefix"),
        "phone": phone("phone"),
        "phone2": phone("phone2"),
        "email": f"{_choice('d_mail_n', [n.lower() for n in FIRST_NAMES])} || {_number('d_mail_i')} || '@' || {_choice('d_mail_d', DOMAINS)}",
        "mrn": f"'MRN' || {_number('1000000 + d_mrn')} || {_number('d_mrn_x')}",
        "plan": f"{_choice('d_plan_p', PLAN_PREFIXES)} || {_number('1000000 + d_plan_a')} || {_padded('d_plan_b', 3)}",
        "name": name("name"),
        "name2": name("name2"),
        "address": f"{_number('1 + d_home_n')} || ' ' || {_choice('d_home_s', STREETS)} || ', ' || {_choice('d_home_c', CITIES)}",
        "date": f"{_padded('1 + d_mm', 2)} || '/' || {_padded('1 + d_dd', 2)} || '/' || {_number('1950 + d_yy')}",
        **{f"n{w}": _number(f"{10 ** (w - 1)} + d_n{w}") for w in (1, 2, 3, 4, 5)},
        "n9": f"{_number('1000000 + d_n9_a')} || {_padded('d_n9_b', 2)}",
    }


def _template_sql(template: str) -> str:
    """Template -> SQL text in which planted values carry their type between control characters."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            field = piece[1:-1]
            value = f"f_{field}"
            if field in PLANTED:
                value = f"{OPEN} || '{PLANTED[field]}' || {MID} || {value} || {CLOSE}"
            parts.append(value)
        else:
            for i, line in enumerate(piece.split("\n")):
                if i:
                    parts.append("chr(10)")
                if line:
                    parts.append("'" + line.replace("'", "''") + "'")
    return " || ".join(parts)


def corpus_sql(relation: str, seed: str) -> str:
    """SELECT of (doc_id, category, path, marked) over a relation, in shared SQL.

    Three layers: drawn numbers, field texts, documents. Each field is one column used by several
    templates, so it is built once per row and the generated code stays small.
    """
    bounds, upper = [], 0
    for category, share in SHARES:
        upper += share
        bounds.append(f"WHEN d_kind < {upper} THEN '{category}'")
    draws = ", ".join(f"{sql} AS {name}" for name, sql in _draws().items())
    numbers = f"SELECT seed, {draws} FROM (SELECT CAST({seed} AS BIGINT) AS seed FROM {relation}) s"
    carded = f"SELECT *, '4' || {_padded('d_card_a', 7)} || {_padded('d_card_b', 7)} AS card_prefix FROM ({numbers}) d"
    fields = ", ".join(f"{sql} AS f_{name}" for name, sql in _fields().items())
    texts = f"SELECT seed, CASE {' '.join(bounds)} END AS category, d_template AS template, {fields} FROM ({carded}) c"
    bodies = []
    for category, templates in TEMPLATES.items():
        inner = " ".join(f"WHEN {i} THEN {_template_sql(t)}" for i, t in enumerate(templates))
        bodies.append(f"WHEN '{category}' THEN (CASE template {inner} END)")
    prefixes = " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in FILE_PREFIX.items())
    return (
        f"SELECT seed AS doc_id, category,"
        f" category || '/' || (CASE category {prefixes} END) || '_' || CAST(seed AS STRING) || '.txt' AS path,"
        f" CASE category {' '.join(bodies)} END AS marked FROM ({texts}) t"
    )


def generate_corpus(seeds: DataFrame, seed_col: str) -> DataFrame:
    """(doc_id, category, path, text, planted) with exact spans of the planted values. Narrow."""
    marked = seeds.sparkSession.sql(corpus_sql("{seeds}", seed_col), seeds=seeds)
    pieces = F.split("marked", "\\x03")
    literal = lambda p: F.substring_index(p, "\x01", 1)
    tagged = lambda p: F.substring_index(p, "\x01", -1)
    has_value = lambda p: F.contains(p, F.lit("\x01"))

    rows = F.transform(
        pieces,
        lambda p: F.struct(
            literal(p).alias("before"),
            F.when(has_value(p), F.substring_index(tagged(p), "\x02", 1)).alias("entity_type"),
            F.when(has_value(p), F.substring_index(tagged(p), "\x02", -1)).otherwise("").alias("value"),
        ),
    )

    def located(parts):
        ends = running_sum(F.transform(parts, lambda x: F.length(x["before"]) + F.length(x["value"])))
        spans = let(
            ends,
            lambda e: F.transform(
                parts,
                lambda x, i: F.struct(
                    x["entity_type"].alias("entity_type"),
                    x["value"].alias("value"),
                    (F.get(e, i) - F.length(x["value"])).alias("start"),
                    F.get(e, i).alias("end"),
                ),
            ),
        )
        return F.filter(spans, lambda s: s["entity_type"].isNotNull())

    # behind a generator, so that exploding the spans does not repeat their computation in a filter
    return marked.select(
        "doc_id",
        "category",
        "path",
        F.regexp_replace("marked", "\\x01[a-z_]+\\x02|\\x03", "").alias("text"),
        F.explode(F.array(let(rows, located))).alias("planted"),
    )


def corpus_manifest(corpus: DataFrame) -> DataFrame:
    """Documents and planted values per category and type (type null: the documents themselves)."""
    docs = corpus.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(
        "category", F.lit("documents").alias("item"), "n"
    )
    planted = (
        corpus.select("category", F.explode("planted.entity_type").alias("item"))
        .groupBy("category", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return docs.unionByName(planted)


def generate_from_count(spark, count: int) -> DataFrame:
    """A corpus of ``count`` documents."""
    return generate_corpus(spark.range(count).withColumnRenamed("id", "seed"), "seed")
