"""Findings of external recognisers: annotation tables and batch model callables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import empty_array
from ..session import small_side
from .classify import classify
from .detect import SPAN_DDL

# --- Fixed values: recogniser entity types and what they count as --------------------------------

RECOGNIZER_TYPES = {
    "PERSON": "name",
    "EMAIL_ADDRESS": "email",
    "PHONE_NUMBER": "phone",
    "US_SSN": "ssn",
    "CREDIT_CARD": "credit_card",
    "LOCATION": "address",
    "DATE_TIME": "date_of_birth",
    "US_DRIVER_LICENSE": "ssn",
    "US_BANK_NUMBER": "credit_card",
    "US_ITIN": "ssn",
    "US_PASSPORT": "ssn",
    "MEDICAL_LICENSE": "medical_record_number",
    "IP_ADDRESS": "api_key",
    "NRP": "name",
}

ANNOTATION_DDL = "entity_type string, start int, end int, score double"


def supported_entities() -> list[str]:
    return list(RECOGNIZER_TYPES)


def map_entity(recognizer_type: Column) -> Column:
    pairs = [F.lit(x) for kv in RECOGNIZER_TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), recognizer_type)


def usable_annotations(
    annotations: DataFrame, threshold: float = 0.5, entities: list[str] | None = None
) -> DataFrame:
    """Known types at or above the score threshold, mapped to our types (map-side, no join).

    Annotations that begin before the text or hold no character are dropped.
    """
    rows = annotations.filter((F.col("score") >= threshold) & (F.col("start") >= 0) & (F.col("start") < F.col("end")))
    if entities is not None:
        rows = rows.filter(F.col("entity_type").isin(entities))
    return rows.withColumn("mapped_type", map_entity(F.col("entity_type"))).filter(
        F.col("mapped_type").isNotNull()
    )


def annotation_spans(
    docs: DataFrame,
    annotations: DataFrame,
    doc_key: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    entities: list[str] | None = None,
) -> DataFrame:
    """Documents with an ``annotation_spans`` array of candidate spans.

    Annotations are filtered and grouped per document first, so each document body takes part in the
    join once, whatever the number of its annotations. Values are cut from the text; an end behind the text is
    drawn in to its last character.
    """
    grouped = (
        usable_annotations(annotations, threshold, entities)
        .groupBy(doc_key)
        .agg(
            F.collect_list(
                F.struct("start", F.negative("score").alias("rank"), "end", "mapped_type", "score")
            ).alias("_ann")
        )
    )
    # small annotation tables are broadcast, so that no document body is shuffled
    joined = docs.join(small_side(grouped), doc_key, "left")

    def span(a: Column, i: Column) -> Column:
        return F.struct(
            a["start"].alias("start"),
            a["rank"].alias("rank"),
            (i + 1000).alias("ord"),
            F.least(a["end"], F.length(text_col)).alias("end"),
            a["mapped_type"].alias("entity_type"),
            F.substring(F.col(text_col), a["start"] + 1, a["end"] - a["start"]).alias("value"),
            a["score"].alias("confidence"),
            F.lit("presidio").alias("detector"),
            F.lit(False).alias("is_test_data"),
        )

    # an annotation that begins behind the end of its text marks nothing
    spans = F.transform(F.filter(F.sort_array("_ann"), lambda a: a["start"] < F.length(text_col)), span)
    return joined.withColumn("annotation_spans", F.coalesce(spans, empty_array(SPAN_DDL))).drop("_ann")


def classify_with_annotations(
    docs: DataFrame,
    annotations: DataFrame,
    doc_key: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    entities: list[str] | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Rules and annotations together: merged, resolved and labelled per document."""
    merged = annotation_spans(docs, annotations, doc_key, text_col, threshold, entities)
    return classify(merged, text_col, annotation_col="annotation_spans", keep_text=keep_text)


_MODELS: dict[str, Callable] = {}


def _worker_model(key: str, load: Callable[[], Callable]) -> Callable:
    """The model of one scan, loaded once in a worker process that serves many tasks."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = load()
    return _MODELS[key]


def annotate_with_model(
    docs: DataFrame,
    load_model: Callable[[], Callable[[list[str]], list[list[tuple[str, int, int, float]]]]],
    doc_key: str = "doc_id",
    text_col: str = "text",
    batch_rows: int = 256,
) -> DataFrame:
    """Run a user's recogniser over document batches; the only place where Python workers are needed.

    ``load_model()`` runs once per worker process and returns a function from texts to lists of
    (type, start, end, score). A batch that fails is retried text by text; a failing text gives one
    row with ``error`` and no annotation, and the scan goes on.
    """

    load_key = uuid.uuid4().hex
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024 * 1024))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _worker_model(load_key, load_model)
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows]
                keys, texts = part[doc_key].tolist(), part[text_col].fillna("").tolist()
                rows = []
                try:
                    results = list(zip(keys, model(texts)))
                except Exception:  # noqa: BLE001 - a model error must not end the scan
                    results = []
                    for key, text in zip(keys, texts):
                        try:
                            results.append((key, model([text])[0]))
                        except Exception as error:  # noqa: BLE001
                            rows.append((key, None, None, None, None, f"{type(error).__name__}: {error}"))
                rows += [(key, *found, None) for key, spans in results for found in spans]
                out = pd.DataFrame(rows, columns=[doc_key, "entity_type", "start", "end", "score", "error"])
                out["start"] = out["start"].astype("Int32")
                out["end"] = out["end"].astype("Int32")
                out["score"] = out["score"].astype("float64")
                yield out

    key_type = docs.schema[doc_key].dataType.simpleString()
    schema = f"`{doc_key}` {key_type}, {ANNOTATION_DDL}, error string"
    return docs.select(doc_key, text_col).mapInPandas(run, schema)
