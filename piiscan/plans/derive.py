"""Inputs of the registered queries: the given tables, and documents derived from their rows.

The derived texts are SQL in the subset that Spark and the checking engine share, so both build the
same documents from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread_small
from ..sources.synth import corpus_sql, generate_corpus, luhn_card

DOCUMENTS_SQL = (
    "SELECT doc_id, '/' || source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || '.txt' AS path, text "
    "FROM {documents}"
)

PAGES_SQL = "SELECT page_id AS doc_id, url AS path, html AS text FROM {pages}"


def _pad(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


def _customer_sql() -> str:
    k = "c_custkey"
    ssn = f"{_pad(f'1 + {k} % 665', 3)} || '-' || {_pad(f'1 + {k} % 99', 2)} || '-' || {_pad(f'1 + {k} % 9999', 4)}"
    plain = f"{_pad(f'1 + {k} % 665', 3)} || {_pad(f'1 + {k} % 99', 2)} || {_pad(f'1 + {k} % 9999', 4)}"
    area, mid, last = f"CAST(200 + {k} % 800 AS STRING)", f"CAST(200 + ({k} * 7) % 800 AS STRING)", f"CAST(1000 + ({k} * 13) % 9000 AS STRING)"
    dashed, round_ = f"{area} || '-' || {mid} || '-' || {last}", f"'(' || {area} || ') ' || {mid} || '-' || {last}"
    mrn = f"CAST(10000000 + ({k} * 37) % 90000000 AS STRING)"
    plan = f"CAST(1000000000 + ({k} * 7919) % 9000000000 AS STRING)"
    email = f"'user' || CAST({k} AS STRING) || '@' || lower(c_mktsegment) || '.com'"
    nl = "chr(10)"
    prefix = f"SELECT *, '4' || {_pad(f'({k} * 104729 + 13) % 100000000000000', 14)} AS card15 FROM {{customer}}"
    carded = f"SELECT *, {luhn_card('card15')} AS card FROM ({prefix}) a"
    text = f"""CASE {k} % 12
        WHEN 0 THEN 'Employee ' || c_name || {nl} || 'SSN: ' || {ssn} || {nl} || 'MRN-' || {mrn}
        WHEN 1 THEN 'Example SSN 123-45-6789 in the form of ' || c_name || ', mail test@example.com'
        WHEN 2 THEN 'Rejected 666-12-' || {last} || ' and 900-45-' || {last} || ' and 123-00-' || {last}
        WHEN 3 THEN 'Call ' || {round_} || ' or write to ' || {email} || '.'
        WHEN 4 THEN 'Card ' || card || ', test card 4111111111111111, broken card ' || card15 || '0'
        WHEN 5 THEN 'Plan HP-' || {plan} || '; Health Plan ID: #' || {mrn}
        WHEN 6 THEN 'MRN ' || {plain} || ' HP' || {mid} || {mid} || {last}
        WHEN 7 THEN 'Quarterly notes on ' || lower(c_mktsegment) || ', nothing to report.'
        WHEN 8 THEN {email} || ' ' || {email} || ' noreply@example.com'
        WHEN 9 THEN 'Phones ' || {dashed} || ', 555-555-5555, ' || {area} || '.' || {mid} || '.' || {last}
        WHEN 10 THEN '   ' || {nl} || '  '
        ELSE 'Account notes: ' || {email} || ' confirmed the card ' || card || ' by phone ' || {dashed}
          || ' and gave ' || {ssn} || ' as well as mrn' || {mrn} || ' for the file, see the letter of the bank'
        END"""
    return (
        f"SELECT {k} AS doc_id, c_nationkey % 5 AS shard, 'scan_' || CAST(c_nationkey AS STRING) AS scan_id,"
        f" 'region_' || CAST(c_nationkey % 5 AS STRING) AS source_path, c_nationkey AS started,"
        f" '/' || lower(c_mktsegment) || '/customer_' || CAST({k} AS STRING) ||"
        f" CASE {k} % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.docx' WHEN 2 THEN '.PDF' WHEN 3 THEN '.md' ELSE '.csv' END AS path,"
        f" {text} AS text FROM ({carded}) b"
    )


CUSTOMER_SQL = _customer_sql()
CORPUS_MARKED_SQL = corpus_sql("customer", "c_custkey")

#: A folder tree: regions, nations and customers are folders, orders are files.
TREE_SQL = (
    "SELECT 'r' || CAST(r_regionkey AS STRING) AS id, 'root' AS parent_id, true AS is_folder, lower(r_name) AS path FROM {region}"
    " UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), true, lower(n_name) FROM {nation}"
    " UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), true, c_name FROM {customer}"
    " UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'c' || CAST(o_custkey AS STRING), false,"
    " 'order_' || CAST(o_orderkey AS STRING) || '.docx' FROM {orders}"
)

#: Annotations of an outside recogniser over all documents (rows with j = 0, 1, 2): three per text, of mapped and unknown types,
#: some beginning before or behind the text, some ending behind it.
ANNOTATIONS_SQL = (
    "SELECT doc_id, CASE (doc_id + j) % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'ORGANIZATION'"
    " ELSE 'IP_ADDRESS' END AS entity_type, CAST((doc_id * 7 + j * 11) % 40 - CASE WHEN (doc_id + j) % 29 = 0 THEN 50 ELSE 0 END AS INT) AS start_pos,"
    " CAST((doc_id * 7 + j * 11) % 40 + 5 + j AS INT) AS end_pos,"
    " CAST(0.3 AS DOUBLE) + CAST((doc_id * 13 + j * 29) % 70 AS DOUBLE) / CAST(100 AS DOUBLE) AS score"
    " FROM {documents}"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_shared(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(run_shared(spark, sf_dir, DOCUMENTS_SQL, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(run_shared(spark, sf_dir, PAGES_SQL, "pages"))


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spread_small(table(spark, sf_dir, "customer"))
    return spark.sql(CUSTOMER_SQL, customer=source)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_corpus(spread_small(table(spark, sf_dir, "customer").select("c_custkey")), "c_custkey")


def drive_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_shared(spark, sf_dir, TREE_SQL, "region", "nation", "customer", "orders")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    thrice = table(spark, sf_dir, "documents").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = spark.sql(ANNOTATIONS_SQL, documents=thrice)
    return rows.withColumnsRenamed({"start_pos": "start", "end_pos": "end"})
