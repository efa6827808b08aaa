"""Packing token sequences into windows with a non-negative least-squares plan over the length histogram.

Every document gets its end id and is cut into whole windows and one tail. Tails are planned on their
length histogram alone (at most window - 1 numbers, whatever the input): all combinations of up to three
lengths that fill a window are enumerated, ``min ||A x - h||, x >= 0`` is solved for their repeat counts, the
counts are rounded within what the histogram holds, and the residual is packed greedily, cutting a tail where
it overhangs. The last, unfilled window is cut into power-of-two sequences, so no padding is left.

Tails are numbered within their length by a window over (length, salt), the salts following the length's
share of all rows, so a hot length is spread. The plan maps (length, number) to a place, and no other
exchange of tokens takes place.

Null text counts as empty and gives the end id alone. Repeated rows are packed each. Only ``doc_id`` and
``text`` are read. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPLIT, Vocabulary, read_vocabulary
from .common import bound_arrow_batches, shuffle_partitions, stage, whole_text

WINDOW = 1024
END_ID = 0
#: Steps of the least-squares solver; it works on the histogram, so its cost doesn't depend on the input.
SOLVER_STEPS = 400

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_ENCODERS: dict[int, object] = {}


def fast_encoder(content: str):
    """The vocabulary in a library that gives the same ids several times faster; one per Python worker."""
    import tiktoken

    key = hash(content)
    if key not in _ENCODERS:
        v = Vocabulary(content)
        _ENCODERS[key] = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks={t: i for i, t in v.bytes.items()}, special_tokens=v.added)
    return _ENCODERS[key]


def encode_tails(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens (end id included), the checksums of its whole windows and the ids of its tail."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    content = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = fast_encoder(content.value)
        special = list(encoder._special_tokens)
        for batch in batches:
            sizes, sums, tails = [], [], []
            for text in batch.column("text").to_pylist():
                if any(s in text for s in special):
                    ids = encoder.encode(text, allowed_special="all")
                else:
                    ids = encoder.encode_ordinary(text)
                ids.append(end_id)
                data = np.array(ids, "<u4")
                whole = len(ids) // window * window
                sizes.append(len(ids))
                sums.append([zlib.crc32(data[i : i + window].tobytes()) for i in range(0, whole, window)])
                tails.append(data[whole:].tobytes())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                names=["doc_id", "n_tokens", "sums", "tail"],
            )

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_tokens long, sums array<long>, tail binary")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All a <= b <= c (0 stands for none) of the given lengths that fill a window exactly; one row each."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    usable = np.concatenate([[0], lengths])
    a, b = np.meshgrid(usable, lengths, indexing="ij")
    c = window - a - b
    fits = (a <= b) & (b <= c) & (c > 0)
    a, b, c = a[fits], b[fits], c[fits]
    fits = have[c]
    return np.stack([a[fits], b[fits], c[fits]], axis=1)


def solve_repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 with A x near the histogram, by accelerated projected gradients."""
    n = len(histogram)
    flat = combos.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, weights=np.repeat(x, 3), minlength=n)
        y[0] = 0
        return y

    v = np.ones(len(combos))  # power iteration for the step size
    for _ in range(20):
        w = used(v)[combos].sum(1)
        v = w / np.linalg.norm(w)
    step = 1 / max(float(v @ used(v)[combos].sum(1)), 1e-9) / 1.05
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        miss = used(z) - histogram
        miss[0] = 0
        new = np.maximum(z - step * miss[combos].sum(1), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Where the tail with a given length and number goes. Sequences of tails come first, whole windows after them."""

    window: int
    #: per length: first number, sequence, uses per sequence, offset; sorted by first number
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    planned: dict[int, int] = field(default_factory=dict)  # tails of a length that the plan places
    stream_at: dict[int, int] = field(default_factory=dict)  # where the residual tails of a length begin in the stream
    stream_first: int = 0  # sequence in which the stream begins
    stream_tokens: int = 0
    sequences: int = 0


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """histogram[l]: tails of l tokens, 0 < l < window."""
    left = np.array(histogram, np.int64)
    left[0] = 0
    plan = Plan(window)
    taken = np.zeros_like(left)

    def place(lengths: list[int], repeats: int) -> None:
        offset = 0
        for length in dict.fromkeys(lengths):
            uses = lengths.count(length)
            plan.runs.setdefault(length, []).append((int(taken[length]), plan.sequences, uses, offset))
            taken[length] += uses * repeats
            left[length] -= uses * repeats
            offset += uses * length
        plan.sequences += repeats

    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window) if len(lengths) else np.zeros((0, 3), int)
    if len(combos):
        x = solve_repeats(combos, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            repeats = int(round(x[k]))
            if repeats < 1:
                break
            one = [int(v) for v in combos[k] if v]
            repeats = min(repeats, *(int(left[v]) // one.count(v) for v in one))
            if repeats > 0:
                place(one, repeats)
    # residual: longest first, each filled with the longest that fit; exact fills are kept
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            one, room, counts = [longest], window - longest, {longest: 1}
            for length in np.flatnonzero(left[: room + 1])[::-1]:
                length = int(length)
                fits = min(room // length, int(left[length]) - counts.get(length, 0))
                if fits > 0:
                    one += [length] * fits
                    counts[length] = counts.get(length, 0) + fits
                    room -= fits * length
            if room:
                break
            place(one, min(int(left[v]) // c for v, c in counts.items()))
    # what is left runs on as one stream, longest first, cut where it overhangs a window
    plan.planned = {int(v): int(taken[v]) for v in np.flatnonzero(histogram)}
    plan.stream_first = plan.sequences
    for length in np.flatnonzero(left)[::-1]:
        plan.stream_at[int(length)] = plan.stream_tokens
        plan.stream_tokens += int(length * left[length])
    plan.sequences += plan.stream_tokens // window + bin(plan.stream_tokens % window).count("1")
    return plan


def place_tail(plan: Plan, length: int, number: int) -> list[tuple[int, int, int, int]]:
    """Pieces of one tail: (start in the tail, length, sequence, offset)."""
    if number < plan.planned[length]:
        runs = plan.runs[length]
        lo, hi = 0, len(runs)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if runs[mid][0] <= number else (lo, mid)
        first, sequence, uses, offset = runs[lo]
        k = number - first
        return [(0, length, sequence + k // uses, offset + k % uses * length)]
    at = plan.stream_at[length] + (number - plan.planned[length]) * length
    last = plan.stream_tokens // plan.window * plan.window
    pieces, start = [], 0
    while start < length:
        pos = at + start
        if pos < last:
            sequence, begin, end = pos // plan.window, pos // plan.window * plan.window, (pos // plan.window + 1) * plan.window
        else:  # the last window's tokens, in power-of-two sequences
            sequence, begin, rest = last // plan.window, last, plan.stream_tokens - last
            for bit in range(rest.bit_length() - 1, -1, -1):
                end = begin + (1 << bit)
                if rest >> bit & 1:
                    if pos < end:
                        break
                    sequence, begin = sequence + 1, end
        size = min(length - start, end - pos)
        pieces.append((start, size, plan.stream_first + sequence, pos - begin))
        start += size
    return pieces


def pack(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    encoded = encode_tails(docs, vocabulary_path, window, end_id).withColumn("uid", F.monotonically_increasing_id())
    return pack_encoded(stage(encoded, "packing"), window)


def pack_encoded(encoded: DataFrame, window: int = WINDOW) -> DataFrame:
    spark = encoded.sparkSession
    size = F.col("n_tokens") % window
    counted = encoded.groupBy(size.cast("int").alias("len")).agg(F.count("*").alias("n"), F.sum(F.col("n_tokens") - size).alias("whole")).collect()
    histogram = np.zeros(window, np.int64)
    windows_of = np.zeros(window, np.int64)
    for row in counted:  # at most `window` rows
        histogram[row["len"]], windows_of[row["len"]] = row["n"], row["whole"] // window
    plan = make_plan(histogram, window)
    total = max(1, int(histogram.sum()))
    salts = np.maximum(1, -(-histogram * 8 * shuffle_partitions(spark) // total))
    first_window = plan.sequences + np.concatenate([[0], np.cumsum(windows_of)[:-1]])

    per_length = lambda values: F.array(*[F.lit(int(v)) for v in values])[F.col("len")]
    keyed = (
        encoded.withColumn("len", size.cast("int"))
        .withColumn("salts", per_length(salts))
        .withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")))
    )
    groups = keyed.groupBy("len", "salt").agg(F.count("*").alias("n"), F.sum(F.size("sums")).alias("windows"))
    before = Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "len",
        "salt",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        (F.coalesce(F.sum("windows").over(before), F.lit(0)) + per_length(first_window)).alias("windows_before"),
    )
    order = Window.partitionBy("len", "salt").orderBy("uid")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("number", F.row_number().over(order) - 1)
        .withColumn("windows", F.coalesce(F.sum(F.size("sums")).over(upto), F.lit(0)))
        .join(groups, ["len", "salt"])
        .select("doc_id", "n_tokens", "sums", "tail", (F.col("number") + F.col("n_before")).alias("number"), (F.col("windows") + F.col("windows_before")).alias("sequence"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, n, sums, tail, number, sequence in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(k * window, window, crc, sequence + k, 0) for k, crc in enumerate(sums)]
                if tail:
                    base = len(sums) * window
                    for start, length, place, offset in place_tail(plan, n - base, number):
                        rows.append((base + start, length, zlib.crc32(tail[4 * start : 4 * (start + length)]), place, offset))
                for start, length, crc, place, offset in rows:
                    for column, value in zip(out, (doc, start, length, crc, n, place, offset)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=[p.split()[0] for p in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)
