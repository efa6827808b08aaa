"""Span-producing pattern scan, as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import block_slice, empty_array, let, running_sum, text_blocks
from ..functions.scalar import is_test_value
from .patterns import DEFAULT_PATTERNS, PatternSpec

#: Candidate span. The first three fields are its rank: position, then confidence, then rule order.
SPAN_DDL = (
    "struct<start:int,rank:double,ord:int,end:int,entity_type:string,value:string,"
    "confidence:double,detector:string,is_test_data:boolean>"
)
CONTEXT_WIDTH = 50


def pattern_spans(text: Column, spec: PatternSpec, ord_: int) -> Column:
    """All non-overlapping matches of one rule as an array of candidate spans.

    One pass extracts the values; only texts with a match are split for the gaps between them, and
    running sums of gap and value lengths give the code-point offsets.
    """

    def located(values: Column) -> Column:
        steps = let(
            F.split(text, spec.jvm, -1),
            lambda gaps: F.transform(
                values,
                lambda v, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(values, i - 1)), F.lit(0)),
            ),
        )
        if spec.scan is None:
            return let(running_sum(steps), lambda starts: _valid(spec, F.transform(
                values, lambda v, i: _span(spec, ord_, v, F.get(starts, i))
            )))
        found = F.regexp_extract_all(text, F.lit(spec.scan), F.lit(1))
        return let(F.struct(running_sum(steps).alias("at"), found.alias("found")), lambda s: _valid(spec, F.transform(
            s["found"], lambda v, i: _span(spec, ord_, v, F.get(s["at"], i) + F.length(F.get(values, i)) - F.length(v))
        )))

    return let(
        F.regexp_extract_all(text, F.lit(spec.jvm), F.lit(0)),
        lambda values: F.when(F.size(values) > 0, located(values)).otherwise(empty_array(SPAN_DDL)),
    )


def _span(spec: PatternSpec, ord_: int, value: Column, start: Column) -> Column:
    return F.struct(
        start.alias("start"),
        F.lit(-spec.confidence).alias("rank"),
        F.lit(ord_).alias("ord"),
        (start + F.length(value)).alias("end"),
        F.lit(spec.entity_type).alias("entity_type"),
        value.alias("value"),
        F.lit(spec.confidence).alias("confidence"),
        F.lit("regex").alias("detector"),
        is_test_value(value, spec.test_values).alias("is_test_data"),
    )


def _valid(spec: PatternSpec, spans: Column) -> Column:
    return spans if spec.validator is None else F.filter(spans, lambda s: spec.validator(s["value"]))


def candidate_spans(text: Column, patterns: list[PatternSpec] | None = None) -> Column:
    """Candidates of all rules, in rule order. Each distinct gate is tested once per text."""
    patterns = DEFAULT_PATTERNS if patterns is None else patterns
    none = empty_array(SPAN_DDL)
    if not patterns:
        return none
    gates = list(dict.fromkeys(spec.gate for spec in patterns if spec.gate is not None))

    def gated(tests: Column) -> Column:
        parts = []
        for ord_, spec in enumerate(patterns):
            spans = pattern_spans(text, spec, ord_)
            if spec.gate is not None:
                spans = F.when(F.get(tests, F.lit(gates.index(spec.gate))), spans).otherwise(none)
            parts.append(spans)
        return F.concat(*parts)

    found = let(F.array(*[gate(text) for gate in gates]) if gates else F.array(F.lit(True)), gated)
    return F.coalesce(found, none)


def to_matches(text: Column, spans: Column) -> Column:
    """Candidate spans -> match structs, adding the context window of each.

    Contexts are cut from a blocked copy of the text: plain ``substring`` walks the string from its
    start for every match.
    """

    def build(blocks: Column, s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT_WIDTH, F.lit(0))
        return F.struct(
            s["entity_type"].alias("entity_type"),
            s["value"].alias("value"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["confidence"].alias("confidence"),
            s["detector"].alias("detector"),
            F.concat(
                block_slice(blocks, begin, s["start"] - begin),
                s["value"],
                block_slice(blocks, s["end"], F.lit(CONTEXT_WIDTH)),
            ).alias("context"),
            s["is_test_data"].alias("is_test_data"),
            F.lit(None).cast("string").alias("model_version"),
        )

    found = F.size(spans) > 0
    return let(
        F.when(found, text_blocks(text)).otherwise(empty_array("string")),
        lambda blocks: F.transform(spans, lambda s: build(blocks, s)),
    )


def detect(text: Column, patterns: list[PatternSpec] | None = None) -> Column:
    """Matches of all rules in detection order, overlaps included."""
    return let(candidate_spans(text, patterns), lambda spans: to_matches(text, spans))


def explode_findings(df: DataFrame, matches_col: str = "matches") -> DataFrame:
    """One row per match, beside the document's other columns (narrow: no shuffle)."""
    others = [c for c in df.columns if c != matches_col]
    return df.select(*others, F.inline(F.filter(matches_col, lambda m: m.isNotNull())))
