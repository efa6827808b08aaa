"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from piiscan.plans.queries import QUERIES
from piiscan.session import build_session

HEADLINE = [
    "classify_documents",
    "entity_totals",
    "match_offsets_context",
    "html_pages_scan",
    "classify_customer_documents",
    "classify_corpus",
    "masked_text",
    "classify_with_annotations",
    "span_resolution",
    "scan_summary",
    "findings_filtered",
    "review_queue",
    "balanced_review",
    "report_files",
    "label_plan",
    "expand_folder",
    "assemble_pages",
    "assemble_sheets",
    "column_pii_profile",
    "duplicate_values",
    "benchmark_entity_prf",
    "luhn_validity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "piiscan-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    cold = run("classify_documents")  # JVM start-up, class loading, first JIT
    run("classify_customer_documents")
    times = {name: round(run(name), 3) for name in names}
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    line = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "cold_classify_sec": round(cold, 3),
        "documents": n_docs,
    }
    if times.get("classify_documents"):
        line["documents_per_sec"] = round(n_docs / times["classify_documents"])
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
