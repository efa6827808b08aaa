"""Label mapping and label plans. The result is a table of actions; applying them is up to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import file_type, is_guid, label_key
from ..schema import LABEL_MAPPING, LABEL_RECOMMENDATIONS
from ..session import local_rows, small_side
from .classify import has_sensitive_data

_MAPPING_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LABEL_MAPPING)

# File types the local labelling client can write to.
LOCAL_LABEL_TYPES = [".docx", ".xlsx", ".pptx", ".pdf", ".doc", ".xls", ".ppt"]


def default_mapping(spark: SparkSession) -> DataFrame:
    """No label ids yet; ``public`` is skipped unless configured otherwise."""
    rows = [(r, None, None, r == "public") for r in LABEL_RECOMMENDATIONS]
    return local_rows(spark, rows, _MAPPING_DDL)


def mapping_from_dict(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return local_rows(spark, [(k.lower(), v, None, False) for k, v in mapping.items()], _MAPPING_DDL)


def auto_map(spark: SparkSession, tenant_labels: DataFrame) -> DataFrame:
    """Recommendations matched to tenant labels by name, ignoring case, blanks and underscores.

    When several tenant labels fit, the greatest id wins so that the result does not depend on order.
    """
    recommendations = local_rows(spark, [(r,) for r in LABEL_RECOMMENDATIONS], "recommendation string")
    return (
        tenant_labels.select("id", "name", label_key(F.col("name")).alias("key"))
        .join(F.broadcast(recommendations.withColumn("key", label_key(F.col("recommendation")))), "key")
        .groupBy("recommendation")
        .agg(F.max(F.struct("id", "name")).alias("best"))
        .select(
            "recommendation",
            F.col("best.id").alias("label_id"),
            F.col("best.name").alias("label_name"),
            F.lit(False).alias("skip"),
        )
    )


def mapping_checks(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        (F.count_if(F.col("label_id").isNotNull()) > 0).alias("has_label_mappings"),
        F.count_if("skip").alias("skipped"),
    )


def resolve_labels(
    requests: DataFrame, mapping: DataFrame, tenant_labels: DataFrame, col: str = "label"
) -> DataFrame:
    """Add ``label_id``: a GUID as is, else the mapping, else a tenant label of that name, else null.

    Both lookups are dimension tables, made unique by their lower-case key (smallest id); they are broadcast after
    a size check.
    """
    by_rec = mapping.filter(~F.coalesce("skip", F.lit(False))).groupBy(F.lower("recommendation").alias("_rec")).agg(
        F.min("label_id").alias("_mapped")
    )
    by_name = (
        tenant_labels.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("_named"))
    )
    wanted = F.lower(F.col(col))
    joined = (
        requests.withColumn("_wanted", wanted)
        .join(small_side(by_rec), F.col("_wanted") == F.col("_rec"), "left")
        .join(small_side(by_name), F.col("_wanted") == F.col("_name"), "left")
    )
    guid = F.when(is_guid(F.col(col)), F.col(col))
    return joined.withColumn("label_id", F.coalesce(guid, "_mapped", "_named")).drop(
        "_wanted", "_rec", "_mapped", "_name", "_named"
    )


def plan_labels(
    files: DataFrame,
    mapping: DataFrame,
    tenant_labels: DataFrame,
    current_labels: DataFrame | None = None,
    skip_already_labeled: bool = True,
    skip_no_recommendation: bool = True,
    override: str | None = None,
) -> DataFrame:
    """Action per sensitive file: labelled, skipped (with the reason) or error.

    ``files`` carries path, matches, label_recommendation and item_id (null for files outside the
    cloud store); ``current_labels`` has (item_id, label_id, label_name).
    """
    wanted = F.lit(override) if override else F.col("label_recommendation")
    todo = files.filter(has_sensitive_data(F.col("matches")))
    if skip_no_recommendation:
        todo = todo.filter(wanted.isNotNull())
    todo = todo.select("path", "item_id", F.col("label_recommendation").alias("recommendation"), wanted.alias("label"))
    resolved = resolve_labels(todo, mapping, tenant_labels)
    names = tenant_labels.groupBy(F.col("id").alias("label_id")).agg(F.min("name").alias("new_label_name"))
    resolved = resolved.join(small_side(names), "label_id", "left")
    if current_labels is not None:
        now = current_labels.select(
            F.col("item_id").alias("_item"),
            F.col("label_id").alias("previous_label"),
            F.col("label_name").alias("previous_label_name"),
        )
        # files outside the cloud have no id: their paths spread them instead of one null partition
        key = F.coalesce("item_id", F.concat(F.lit("path:"), "path"))
        resolved = resolved.withColumn("_key", key).join(now, F.col("_key") == F.col("_item"), "left")
    else:
        none = F.lit(None).cast("string")
        resolved = resolved.select("*", none.alias("previous_label"), none.alias("previous_label_name"))

    local = F.col("item_id").isNull()
    unknown = F.col("label").isNull()
    unresolved = F.col("label_id").isNull()
    labeled = F.lit(skip_already_labeled) & F.col("previous_label").isNotNull()
    status = (
        F.when(local | unknown, "skipped").when(unresolved, "error").when(labeled, "skipped").otherwise("labeled")
    )
    reason = (
        F.when(local, "Not a cloud file (missing item id)")
        .when(unknown, "No label recommendation")
        .when(unresolved, F.concat(F.lit("Could not resolve label for: "), F.col("label")))
        .when(labeled, F.concat(F.lit("Already labeled: "), F.coalesce("previous_label_name", "previous_label")))
        .otherwise("Would label")
    )
    done = ~(local | unknown)
    return resolved.select(
        "path",
        "item_id",
        "recommendation",
        status.alias("status"),
        reason.alias("reason"),
        F.when(done, F.col("previous_label")).alias("previous_label"),
        F.when(done, F.col("label_id")).alias("new_label"),
        F.when(done, F.col("new_label_name")).alias("new_label_name"),
    )


def plan_local_labels(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Plan for files on disk: only some types can be labelled, and the mapping must name a label."""
    lookup = mapping.select(
        F.col("recommendation").alias("label_recommendation"),
        F.when(~F.coalesce("skip", F.lit(False)), F.col("label_id")).alias("new_label"),
        F.coalesce("label_name", F.substring("label_id", 1, 20)).alias("new_label_name"),
    )
    todo = files.filter(has_sensitive_data(F.col("matches")) & F.col("label_recommendation").isNotNull())
    supported = F.lower(file_type(F.col("path"))).isin(LOCAL_LABEL_TYPES)
    mapped = F.col("new_label").isNotNull()
    return todo.join(small_side(lookup), "label_recommendation", "left").select(
        "path",
        F.col("label_recommendation").alias("recommendation"),
        F.when(supported & mapped, "labeled").otherwise("skipped").alias("status"),
        F.when(~supported, "unsupported type")
        .when(~mapped, F.concat(F.lit("no label mapping for "), F.col("label_recommendation")))
        .otherwise("Would label")
        .alias("reason"),
        F.when(supported, F.col("new_label")).alias("new_label"),
        F.when(supported & mapped, F.col("new_label_name")).alias("new_label_name"),
    )


def plan_folder(
    items: DataFrame,
    label: str,
    mapping: DataFrame,
    tenant_labels: DataFrame,
    current_labels: DataFrame | None = None,
) -> DataFrame:
    """One label for every file of a (already expanded) folder listing; unresolvable labels are errors."""
    wanted = items.select("path", F.col("id").alias("item_id"), F.lit(label).alias("label"))
    resolved = resolve_labels(wanted, mapping, tenant_labels)
    if current_labels is not None:
        now = current_labels.select("item_id", F.col("label_id").alias("previous_label"))
        resolved = resolved.join(now, "item_id", "left")
    else:
        resolved = resolved.withColumn("previous_label", F.lit(None).cast("string"))
    ok = F.col("label_id").isNotNull()
    return resolved.select(
        "path",
        "item_id",
        F.when(ok, "labeled").otherwise("error").alias("status"),
        F.when(ok, "Would label").otherwise(F.concat(F.lit("Could not resolve label for: "), F.col("label"))).alias("reason"),
        "previous_label",
        F.col("label_id").alias("new_label"),
    )


def needs_labeling(items: DataFrame, current_labels: DataFrame) -> DataFrame:
    """Items without a current label."""
    return items.join(current_labels.select("item_id"), items["id"] == F.col("item_id"), "left_anti")


def label_summary(plan: DataFrame) -> DataFrame:
    """Totals by status, and by label among the labelled."""
    name: Column = F.when(
        F.col("status") == "labeled", F.coalesce("new_label_name", "recommendation", F.lit("unknown"))
    )
    return plan.groupBy("status", name.alias("label")).agg(F.count(F.lit(1)).alias("n_files"))
