"""The same detection as an incremental job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import has_sensitive_data, scan_documents
from ..operators.detect import explode_findings
from ..operators.patterns import PatternSpec
from ..store.findings_store import FindingsStore, seal_matches


def stream_documents(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Document tables arriving as Parquet files in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream.

    A stream takes a plain path for a folder's; a pattern, here one that only this path fits, may name either.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def scan_stream(docs: DataFrame, path_col: str = "path", text_col: str = "text", patterns: list[PatternSpec] | None = None) -> DataFrame:
    """File results of a stream: stateless, one narrow stage per micro-batch."""
    return scan_documents(docs, path_col, text_col, patterns)


def write_results(results: DataFrame, target: str, checkpoint: str, key: bytes) -> StreamingQuery:
    """Append file results, values and contexts sealed as in the store; drains what is there and stops."""
    return (
        seal_matches(results, key).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def store_stream(results: DataFrame, store: FindingsStore, scan_id: str, source_path: str, checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to the findings store under its batch id; replays replace, never add."""

    def hand_over(batch: DataFrame, batch_id: int) -> None:
        store.store_scan(batch, source_path, scan_id=scan_id, batch_id=batch_id)

    return (
        results.writeStream.foreachBatch(hand_over)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def live_entity_counts(results: DataFrame) -> DataFrame:
    """Running counts of real matches by type; the state is one row per type."""
    found = explode_findings(results.select("matches"))
    return found.filter(~F.col("is_test_data")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def live_scan_counts(results: DataFrame) -> DataFrame:
    """Running totals of scanned, sensitive and failed documents; the state is one row."""
    failed = F.col("error").isNotNull()
    return results.groupBy().agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(~failed & has_sensitive_data(F.col("matches"))).alias("with_matches"),
        F.count_if(failed).alias("errors"),
    )


def last_files(results: DataFrame, n: int, checkpoint: str, show: Callable[[list[str]], None]) -> StreamingQuery:
    """Hand the names of the last ``n`` files of every micro-batch to ``show``; only ``n`` names reach the driver."""

    def hand_over(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("at", F.monotonically_increasing_id())
        show([r["path"] for r in numbered.orderBy(F.desc("at")).limit(n).collect()][::-1])

    return (
        results.select("path").writeStream.foreachBatch(hand_over)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drain_complete(counts: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run an aggregate in complete mode until the source is drained; the result is a small table."""
    query = (
        counts.writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return counts.sparkSession.table(name)
