"""Registered queries of the operators in this folder, with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, clustering, fingerprints, html_extract, license_scan, line_dedup, lm_scoring, minhash, oracle, packing, quality, secret_scan, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op3_bpe")
def op3_bpe(spark, sf):
    return bpe.digests(bpe.encode_decode(documents(spark, sf), vocabulary()))


@register("op5_packing")
def op5_packing(spark, sf):
    return packing.pack(documents(spark, sf), vocabulary())


@register("op8_html")
def op8_html(spark, sf):
    return html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet"))


@register("op9_licenses")
def op9_licenses(spark, sf):
    return license_scan.summary(license_scan.scan_licenses(documents(spark, sf)))


@register("op1_lm")
def op1_lm(spark, sf):
    return lm_scoring.score_documents(documents(spark, sf))


@register("op2_minhash", oracle.NEAR_CLASSES)
def op2_minhash(spark, sf):
    return minhash.near_classes(documents(spark, sf)).select("doc_id", "class_id", "class_size")


@register("op6_quality", oracle.quality_sql())
def op6_quality(spark, sf):
    out = quality.assess(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


@register("op7_fingerprints")
def op7_fingerprints(spark, sf):
    return fingerprints.edited_fingerprints(documents(spark, sf))


@register("op4_secrets")
def op4_secrets(spark, sf):
    return secret_scan.summary(secret_scan.find_secrets(documents(spark, sf)))


@register("op10_lines")
def op10_lines(spark, sf):
    out = line_dedup.kept_lines(documents(spark, sf).select("doc_id", "text"))
    return out.select("doc_id", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@register("op11_align")
def op11_align(spark, sf):
    import public_tokenizers

    return align.align_tokenizers(documents(spark, sf), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


@register("op12_clusters", oracle.clusters_sql())
def op12_clusters(spark, sf):
    return clustering.cluster_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


@register("op13_topk", oracle.TOP_K)
def op13_topk(spark, sf):
    return topk.search(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("id") % 20 == 0)
