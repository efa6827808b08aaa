"""Cloud-drive listings exported as JSON: rows, folders and their contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DRIVE_ITEM_JSON
from ..session import cut_lineage


#: Depth 2**40 is out of reach, so what is still open after these rounds lies on a cycle.
_MAX_ROUNDS = 40


def parse_items(raw: DataFrame, site_id: Column, drive_id: Column, json_col: str = "value") -> DataFrame:
    """Listing rows from API JSON: path below the drive root, folder flag, type and time."""
    item = F.from_json(json_col, DRIVE_ITEM_JSON)
    rows = raw.select("*", item.alias("i"))
    parent = F.coalesce(F.col("i.parentReference.path"), F.lit(""))
    below = F.when(parent.contains(":"), F.regexp_replace(parent, "^[^:]*:", "")).otherwise(parent)
    return rows.select(
        F.col("i.id").alias("id"),
        F.col("i.parentReference.id").alias("parent_id"),
        F.col("i.name").alias("name"),
        F.ltrim(F.concat(below, F.lit("/"), F.col("i.name")), F.lit("/")).alias("path"),
        F.coalesce("i.size", F.lit(0)).cast("long").alias("size_bytes"),
        F.try_to_timestamp("i.lastModifiedDateTime").alias("modified"),
        F.col("i.folder").isNotNull().alias("is_folder"),
        site_id.alias("site_id"),
        drive_id.alias("drive_id"),
        F.coalesce("i.webUrl", F.lit("")).alias("web_url"),
        F.coalesce("i.file.mimeType", F.lit("")).alias("mime_type"),
    )


def list_folder(items: DataFrame, folder_id: str) -> DataFrame:
    """Direct children of a folder."""
    return items.filter(F.col("parent_id") == folder_id)


def files_under_path(items: DataFrame, folder_path: str) -> DataFrame:
    """All files below a folder path: one filter, no join."""
    prefix = folder_path.strip("/")
    files = items.filter(~F.col("is_folder"))
    return files if not prefix else files.filter(F.col("path").startswith(prefix + "/"))


def expand_folder(items: DataFrame, folder_id: str) -> DataFrame:
    """All files in the subtree of any folder, by id.

    Only folders are walked, and by pointer doubling: each round every open folder jumps to the
    ancestor of its ancestor, so a tree of depth d takes log2(d) rounds. Folders whose pointer has
    reached the start folder or a root leave the join, which keeps the popular ancestors out of it.
    """
    folders = items.filter("is_folder").select("id", "parent_id").distinct()
    known = folders.select("id")
    # a parent that is not in the listing is a root; the start folder is its own end
    linked = folders.join(known.withColumnRenamed("id", "_p"), F.col("parent_id") == F.col("_p"), "left")
    at_start = (F.col("id") == folder_id) | F.coalesce(F.col("parent_id") == folder_id, F.lit(False))
    state = linked.select(
        "id",
        F.when(at_start, F.lit(folder_id)).otherwise(F.col("_p")).alias("up"),
        at_start.alias("inside"),
        (~at_start & F.col("_p").isNotNull()).alias("open"),
    )
    state = cut_lineage(state)
    before = -1
    for _ in range(_MAX_ROUNDS):
        still_open = state.filter("open").count()
        if not still_open or still_open == before:  # a round that settles no folder has met a cycle
            break
        before = still_open
        target = state.select(
            F.col("id").alias("up"), F.col("up").alias("_next"), F.col("inside").alias("_in"), F.col("open").alias("_open")
        )
        moved = (
            state.filter("open").join(target, "up")
            .select(
                "id",
                F.col("_next").alias("up"),
                F.col("_in").alias("inside"),
                (~F.col("_in") & F.col("_open")).alias("open"),
            )
        )
        state = cut_lineage(state.filter("NOT open").unionByName(moved))
    inside = state.filter("inside").select(F.col("id").alias("parent_id"))
    start = items.sparkSession.createDataFrame([(folder_id,)], "parent_id string")
    return items.filter(~F.col("is_folder")).join(inside.union(start).distinct(), "parent_id", "left_semi")
