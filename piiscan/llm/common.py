"""What several operators share: whole-text columns, staged tables in the shared folder, bounded Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: White space between words, as the contracts write it: `[^\x20\x09-\x0D]+` is a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Removes an execution's shuffle files when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text bytes per Arrow batch; a single longer text still travels whole, alone in its batch.
ARROW_BATCH_BYTES = 8 * 1024 * 1024


def bound_arrow_batches(spark: SparkSession) -> None:
    """Python workers get batches bounded by bytes, so long texts don't add up to a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of words; no word gives an empty array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The whole row as one struct beside the columns an operator needs, so no column of the input can clash with its own."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *needed)


def restored(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The carried rows' columns again, some of them replaced."""
    return df.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write a frame as Parquet into the shared checkpoint folder and reread it.

    Cuts the lineage at a table every executor can read again after a loss, and keeps column pruning,
    which a row checkpoint would not. The shuffle files of the write go when it ends: nothing reads them again. The folder is
    removed by ``unstage``, or when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    clean = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, clean)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(jpath)
    return spark.read.schema(schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
            jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
