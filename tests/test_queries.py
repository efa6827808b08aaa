"""Registered queries against DuckDB. All of them: PIISCAN_ALL_QUERIES=1, or python check_queries.py."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, compare
from piiscan.plans.queries import ORACLES, QUERIES

from conftest import TESTDATA

SAMPLE = [
    "classify_customer_documents", "classify_documents", "masked_text", "span_resolution", "findings_filtered", "compare_runs",
    "store_statistics", "report_files", "label_plan", "expand_folder", "assemble_sheets", "assemble_slides", "column_pii_profile",
    "benchmark_entity_prf", "export_json", "encryption_round_trip", "stream_scan", "training_balance", "tpfp_filter",
    "store_round_trip", "store_replace", "store_delete", "store_rotate", "store_export", "load_scan", "audit_of_store", "stream_to_store",
    "assemble_long_documents", "assemble_documents", "scan_written_files", "mapping_checked", "model_annotations", "annotations_to_matches",
]
CHOSEN = list(QUERIES) if os.environ.get("PIISCAN_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    _, _, verdict = compare(spark, con, TESTDATA, name, queries()[name], oracle_sql().get(name))
    assert verdict == "ok", verdict


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries()) and len(queries()) >= 80
    assert set(QUERIES) == set(ORACLES)  # every query of the tables above the optional folder has its checking SQL
