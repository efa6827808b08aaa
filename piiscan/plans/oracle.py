"""Building blocks of the checking SQL (DuckDB), written independently of the Spark expressions."""

from __future__ import annotations

from .derive import ANNOTATIONS_SQL, CORPUS_MARKED_SQL, CUSTOMER_SQL, DOCUMENTS_SQL, PAGES_SQL, TREE_SQL

_TABLES = {t: t for t in ("documents", "pages", "customer", "orders", "region", "nation", "lineitem")}

DOCUMENTS = DOCUMENTS_SQL.format(**_TABLES)
PAGES = PAGES_SQL.format(**_TABLES)
CUSTOMERS = CUSTOMER_SQL.format(**_TABLES)
TREE = TREE_SQL.format(**_TABLES)
ANNOTATIONS = (
    "SELECT r.doc_id, entity_type, start_pos, CAST(least(end_pos, length(d.text)) AS INT) AS end_pos, score FROM ("
    + ANNOTATIONS_SQL.format(documents="(SELECT *, unnest([0, 1, 2]) AS j FROM documents) x")
    + ") r JOIN documents d ON d.doc_id = r.doc_id WHERE start_pos >= 0 AND start_pos < end_pos AND start_pos < length(d.text)"
)

# RE2 has no look-ahead: the plain shape plus the validity test selects the same social-security numbers.
_RULES = [
    (0, "ssn", 0.75, r"\b([0-8]\d{2}|7([0-6]\d|7[012]))[-\s]?\d{2}[-\s]?\d{4}\b",
     ["123456789", "000000000", "111111111", "222222222", "333333333", "444444444", "555555555", "999999999", "123121234", "987654321"]),
    (1, "credit_card", 0.70,
     r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11})\b",
     ["4111111111111111", "5500000000000004", "340000000000009", "4242424242424242", "5555555555554444", "378282246310005"]),
    (2, "email", 0.90, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
     ["test@examplecom", "test@exampleorg", "user@testcom", "noreply@examplecom", "admin@localhost", "foo@bartest", "example@examplecom"]),
    (3, "phone", 0.65, r"\b(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b",
     ["5555555555", "5551234567", "1234567890", "0000000000"]),
    (4, "medical_record_number", 0.85, r"(?i)\b(?:MRN|mrn|M\.R\.N\.?)[-:\s]?(\d{6,12})\b",
     ["mrn12345678", "mrn00000000", "mrn11111111"]),
    (5, "health_plan_id", 0.85, r"(?i)\b(?:HP|Health\s*Plan(?:\s*ID)?|HPID)[-:\s#]*(\d{8,12})\b",
     ["hp0000000000", "hp1111111111", "hp1234567890"]),
]

_DIGITS = r"regexp_replace(value, '\D', '', 'g')"
_SSN_OK = (
    f"length({_DIGITS}) = 9 AND {_DIGITS}[1:3] NOT IN ('000', '666') AND {_DIGITS}[1:3] < '900'"
    f" AND {_DIGITS}[4:5] <> '00' AND {_DIGITS}[6:9] <> '0000'"
)
_LUHN_SUM = (
    "list_sum(list_transform(range(0, length({d})), lambda j: CASE WHEN j % 2 = 0 THEN CAST({d}[length({d}) - j] AS INT)"
    " ELSE (2 * CAST({d}[length({d}) - j] AS INT)) % 10 + (2 * CAST({d}[length({d}) - j] AS INT)) // 10 END))"
)


def luhn_ok(digits: str) -> str:
    return f"(length({digits}) BETWEEN 13 AND 19 AND {_LUHN_SUM.format(d=digits)} % 10 = 0)"


NORMALIZED = r"regexp_replace(lower(value), '[-.\s()]', '', 'g')"


def _rule_sql(rule: tuple, source: str) -> str:
    ord_, kind, confidence, regex, known = rule
    pattern = "'" + regex.replace("'", "''") + "'"
    valid = {"ssn": _SSN_OK, "credit_card": luhn_ok(_DIGITS)}.get(kind, "true")
    literals = ", ".join(f"'{v}'" for v in known)
    return f"""SELECT doc_id, {ord_} AS ord, '{kind}' AS entity_type, CAST({confidence} AS DOUBLE) AS confidence, value,
  start_pos, CAST(start_pos + length(value) AS INT) AS end_pos, {NORMALIZED} IN ({literals}) AS is_test_data, 'regex' AS detector
FROM (SELECT doc_id, v[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda s: length(s)))
    + coalesce(list_sum(list_transform(v[1:i - 1], lambda s: length(s))), 0) AS INT) AS start_pos
  FROM (SELECT doc_id, v, g, unnest(range(1, len(v) + 1)) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS v, string_split_regex(text, {pattern}) AS g FROM {source})))
WHERE {valid}"""


def candidates(source: str = "base", kinds: list[str] | None = None) -> str:
    rules = [r for r in _RULES if kinds is None or r[1] in kinds]
    return "\nUNION ALL\n".join(_rule_sql(r, source) for r in rules)


def context(alias: str = "b.text") -> str:
    return f"substring({alias}, greatest(start_pos - 50, 0) + 1, end_pos + 50 - greatest(start_pos - 50, 0))"


HIGH = "('ssn', 'credit_card', 'medical_record_number', 'health_plan_id', 'cvv', 'private_key')"


def classified(base: str, extra_candidates: str = "", prefix: str = "") -> str:
    """WITH clause giving base, cand, findings (one row per kept match) and files (one row per text).

    Overlaps are resolved by a recursive walk over the ordered candidates of each text.
    """
    p = prefix
    head = "WITH RECURSIVE " if not p else ""
    return f"""{head}{p}base AS ({base}),
{p}cand AS ({candidates(p + 'base')} {extra_candidates}),
{p}ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, -confidence, ord) AS rn FROM {p}cand),
{p}walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS rn, -1 AS last_end, false AS keep FROM (SELECT DISTINCT doc_id FROM {p}cand)
  UNION ALL
  SELECT r.doc_id, r.rn, CASE WHEN r.start_pos >= w.last_end THEN r.end_pos ELSE w.last_end END, r.start_pos >= w.last_end
  FROM {p}walk w JOIN {p}ranked r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1),
{p}findings AS (
  SELECT b.* EXCLUDE (text), r.entity_type, r.value, r.start_pos, r.end_pos, r.confidence, r.detector,
    {context()} AS context, r.is_test_data,
    md5(concat_ws('|', b.doc_id, r.start_pos, r.entity_type)) AS id
  FROM {p}ranked r JOIN {p}walk w ON r.doc_id = w.doc_id AND r.rn = w.rn AND w.keep JOIN {p}base b ON b.doc_id = r.doc_id),
{p}agg AS (
  SELECT doc_id, count(*) AS n_matches, count(*) FILTER (NOT is_test_data) AS n_real,
    max(confidence) AS best_any, max(confidence) FILTER (NOT is_test_data) AS best,
    coalesce(bool_or(entity_type IN {HIGH}) FILTER (NOT is_test_data), false) AS high,
    string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types_any,
    string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) FILTER (NOT is_test_data) AS types
  FROM {p}findings GROUP BY doc_id),
{p}files AS (
  SELECT b.* EXCLUDE (text), coalesce(n_matches, 0) AS n_matches, coalesce(n_real, 0) AS n_real,
    coalesce(best_any, 0) AS best_any, coalesce(types_any, '') AS types_any, coalesce(types, '') AS types,
    coalesce(n_real, 0) > 0 AS sensitive,
    CASE WHEN coalesce(n_real, 0) = 0 THEN NULL WHEN high AND best >= 0.85 THEN 'highly_confidential'
      WHEN high THEN 'confidential' WHEN best >= 0.70 THEN 'internal' ELSE 'public' END AS label_recommendation
  FROM {p}base b LEFT JOIN {p}agg a ON a.doc_id = b.doc_id)
"""


#: The generated corpus with its planted spans, cut from the marked text.
CORPUS = (
    "SELECT doc_id, category, path, regexp_replace(marked, '\\x01[a-z_]+\\x02|\\x03', '', 'g') AS text"
    f" FROM ({CORPUS_MARKED_SQL}) m"
)
PLANTED = f"""SELECT doc_id, category, entity_type, value,
  CAST(list_sum(list_transform(parts[1:i], lambda s: length(regexp_replace(s, '\\x01[a-z_]+\\x02', '')))) - length(value) AS INT) AS start_pos,
  CAST(list_sum(list_transform(parts[1:i], lambda s: length(regexp_replace(s, '\\x01[a-z_]+\\x02', '')))) AS INT) AS end_pos
FROM (SELECT doc_id, category, parts, i, regexp_extract(parts[i], '\\x01([a-z_]+)\\x02', 1) AS entity_type,
    string_split(parts[i], chr(2))[2] AS value
  FROM (SELECT doc_id, category, string_split(marked, chr(3)) AS parts, unnest(range(1, len(string_split(marked, chr(3))))) AS i
    FROM ({CORPUS_MARKED_SQL}) m))"""

REDACT = (
    "CASE WHEN length(value) <= 4 THEN repeat('*', length(value))"
    " ELSE value[1:2] || repeat('*', length(value) - 4) || value[-2:] END"
)
BAND = (
    "CASE WHEN confidence >= 0.95 THEN 'very_high' WHEN confidence >= 0.85 THEN 'high'"
    " WHEN confidence >= 0.70 THEN 'medium' ELSE 'low' END"
)
TITLE = "array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def title(column: str) -> str:
    return TITLE.format(c=column)
