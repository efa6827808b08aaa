"""Overlap resolution and masking of spans within one document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import block_range, chain_from_first, let, lower_bound, text_blocks
from ..functions.scalar import token


def resolve_spans(spans: Column) -> Column:
    """Start-first greedy choice: earliest start, then highest confidence, then rule order.

    The rank is the leading fields of the span struct, so the natural order sorts it. After a kept
    span the next one kept is the first that starts at or after its end, found by binary search; the
    chain of those successors is followed by doubling. Spans without overlaps skip all of it.
    """

    def choose(ordered: Column) -> Column:
        overlapping = F.exists(
            F.sequence(F.lit(1), F.size(ordered) - 1),
            lambda i: F.get(ordered, i)["start"] < F.get(ordered, i - 1)["end"],
        )
        return F.when(overlapping, greedy(ordered)).otherwise(ordered)

    def greedy(ordered: Column) -> Column:
        successors = let(
            F.transform(ordered, lambda s: s["start"]),
            lambda starts: F.transform(
                ordered,
                lambda s, i: F.when(
                    F.coalesce(F.get(starts, i + 1) >= s["end"], F.lit(True)), i + 1
                ).otherwise(lower_bound(starts, s["end"])),
            ),
        )
        return F.transform(chain_from_first(successors), lambda j: F.get(ordered, j))

    return F.when(F.size(spans) <= 1, spans).otherwise(let(F.sort_array(spans), choose))


def mask_text(text: Column, matches: Column, include_test_data: bool = True) -> Column:
    """The text with every (non-overlapping, ordered) match replaced by its token.

    The stretches between matches are cut from a blocked copy of the text and joined once, so the
    work is linear in the text however many matches it has.
    """
    chosen = matches if include_test_data else F.filter(matches, lambda m: ~m["is_test_data"])

    def pieces(kept: Column, blocks: Column) -> Column:
        def piece(m: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(kept, i - 1)["end"])
            return F.concat(block_range(blocks, begin, m["start"] - begin), token(m["entity_type"]))

        tail_from = F.get(kept, F.size(kept) - 1)["end"]
        tail = block_range(blocks, tail_from, F.length(text) - tail_from)
        return F.concat(F.array_join(F.transform(kept, piece), ""), tail)

    return let(
        chosen,
        lambda kept: F.when(F.size(kept) == 0, text).otherwise(
            let(text_blocks(text), lambda blocks: pieces(kept, blocks))
        ),
    )
