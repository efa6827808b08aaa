"""Table columns as documents: every string cell is a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.classify import classify
from ..operators.detect import explode_findings
from ..operators.rollup import column_profile
from ..session import local_rows

#: Cells of a task. Reading a cell costs far more than moving it, so tasks are cut by number of cells, not by their bytes.
CELLS_PER_TASK = 50_000
MAX_TASKS = 8192


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def cells(df: DataFrame, row_key: str, columns: list[str] | None = None) -> DataFrame:
    """(row_key, column_name, text) for the string columns; narrow."""
    columns = columns or [c for c in string_columns(df) if c != row_key]
    pairs: list[Column] = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in columns]
    return df.select(F.col(row_key).alias("row_key"), F.inline(F.array(*pairs)))


def profile_columns(df: DataFrame, row_key: str, columns: list[str] | None = None) -> DataFrame:
    """Share of rows of each string column that hold each real entity type."""
    columns = columns or [c for c in string_columns(df) if c != row_key]
    n_rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(max(cores, -(-n_rows * len(columns) // CELLS_PER_TASK)), MAX_TASKS)
    dealt = df.select(row_key, *[c for c in columns if c != row_key]).repartition(tasks)
    found = explode_findings(classify(cells(dealt, row_key, columns)))
    totals = local_rows(df.sparkSession, [(c, n_rows) for c in columns], "column_name string,n_rows bigint")
    return column_profile(found, totals)
