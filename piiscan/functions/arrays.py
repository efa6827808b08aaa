"""Array building blocks on higher-order functions: single evaluation, prefix sums, greedy chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Inside a lambda Catalyst does no common-subexpression elimination; binding the value to a lambda
    variable is what keeps an expensive regex from running once per use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_array(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def _rounds(n: Column) -> Column:
    """1..ceil(log2(n)) as an array; empty for n <= 1."""
    last = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(empty_array("int"))


def running_sum(numbers: Column) -> Column:
    """Inclusive prefix sums of an int array in O(n log n).

    ``aggregate`` copies its accumulator at every step, so growing an array inside it is quadratic.
    Doubling the reach in each of log(n) rounds copies the array only that often.
    """

    def widen(sums: Column, r: Column) -> Column:
        reach = F.pow(F.lit(2), r - 1).cast("int")
        return F.transform(sums, lambda x, i: F.when(i >= reach, x + F.get(sums, i - reach)).otherwise(x))

    return let(numbers, lambda bound: F.aggregate(_rounds(F.size(bound)), bound, widen))


def lower_bound(sorted_numbers: Column, target: Column) -> Column:
    """First index whose value is at least ``target`` (the size if there is none)."""
    n = F.size(sorted_numbers)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(sorted_numbers, mid) < target
        open_ = s["lo"] < s["hi"]
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"),
        )

    return F.aggregate(
        _rounds(2 * n + 2), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"]
    )


def chain_from_first(successor: Column) -> Column:
    """Indices visited from index 0 by following ``successor`` (size = stop), in O(n log n).

    Each round doubles both the visited prefix and the length of a jump.
    """

    def double(s: Column, _: Column) -> Column:
        ahead = F.filter(
            F.transform(s["chain"], lambda j: F.get(s["jump"], j)), lambda j: j < F.size(s["jump"])
        )
        return F.struct(
            F.concat(s["chain"], ahead).alias("chain"),
            F.transform(s["jump"], lambda j: F.coalesce(F.get(s["jump"], j), j)).alias("jump"),
        )

    return let(
        successor,
        lambda bound: F.aggregate(
            _rounds(F.size(bound)),
            F.struct(F.array(F.lit(0)).alias("chain"), bound.alias("jump")),
            double,
            lambda s: s["chain"],
        ),
    )


_BLOCK = 2048


def text_blocks(text: Column) -> Column:
    """Cut a text into blocks of equal code-point length for constant-time access by offset."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))


def block_slice(blocks: Column, begin: Column, length: Column) -> Column:
    """``length`` (at most one block) code points from offset ``begin`` of a blocked text."""
    index = F.floor(begin / F.lit(_BLOCK)).cast("int")
    pair = F.concat(
        F.coalesce(F.get(blocks, index), F.lit("")),
        F.coalesce(F.get(blocks, index + 1), F.lit("")),
    )
    return F.substring(pair, begin - index * _BLOCK + 1, length)


def block_range(blocks: Column, begin: Column, length: Column) -> Column:
    """Like ``block_slice`` for any length: only the blocks the range touches are joined."""
    first = F.floor(begin / F.lit(_BLOCK)).cast("int")
    last = F.floor((begin + length) / F.lit(_BLOCK)).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(length <= 0, "").otherwise(F.substring(joined, begin - first * _BLOCK + 1, length))
