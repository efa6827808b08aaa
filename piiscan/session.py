"""Session helpers: sizing, small-side broadcast, checkpoint directory."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound for a side we broadcast ourselves; anything larger is left to Catalyst/AQE.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def build_session(app_name: str = "piiscan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, AQE incl. skew handling)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # 256-bit keys in base64 do not show up in explained plans
        "spark.sql.redaction.string.regex": "[A-Za-z0-9+/]{43}=",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (file sizes for scans, exact for literal rows)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Frames built from local rows have no size estimate; up to this many rows they count as small.
BROADCAST_LIMIT_ROWS = 10_000
_UNKNOWN_SIZE = 1 << 62


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only for a side whose size has been checked.

    The planner's estimate decides; where it has none, rows are counted up to a bound. Lookups by a
    handful of keys (label names, say) would otherwise shuffle every file into a handful of tasks.
    Beyond the limits the frame is returned as is, and the join falls back to a shuffle join that AQE
    may still convert, or split where it is skewed.
    """
    size = plan_bytes(df)
    small = size <= limit
    if size >= _UNKNOWN_SIZE:
        small = df.limit(BROADCAST_LIMIT_ROWS + 1).count() <= BROADCAST_LIMIT_ROWS
    return F.broadcast(df) if small else df


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few literal rows as part of the plan: exact size, no job, no Python worker."""
    names = [part.split()[0] for part in ddl.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.sql(
        f"SELECT inline(from_json(:rows, 'array<struct<{', '.join(':'.join(p.split()) for p in ddl.split(','))}>>'))",
        args={"rows": text},
    )


def spread_small(df: DataFrame) -> DataFrame:
    """Use every core on inputs that are too small to be split by file layout.

    A table of one row group is read by one task however many cores are free. When the whole input
    is smaller than one split per core the rows are dealt out evenly; larger inputs, which have
    enough splits of their own, are never shuffled, so the move is bounded by cores x split size.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if cores > 1 and plan_bytes(df) < cores * split:
        return df.repartition(cores)
    return df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``); own temp folder in local mode only,
    removed when the process ends."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        configured = tempfile.mkdtemp(prefix="piiscan-checkpoint-")
        atexit.register(shutil.rmtree, configured, True)
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
