r"""Language-model scores by logistic context mixing over hashed bit predictors.

A text (A-Z lower-cased) is its words, each with the white space behind it as it stands (the first one also with that before it; a
text that ends in a word is closed by a space), and an end mark; these are its units. The bytes of a
unit are coded as binary decisions along a Huffman tree chosen by the byte before, so
frequent bytes take few decisions; the decisions' probabilities multiply to the byte's. Each decision is
predicted by several counters, found by hashes of different contexts (the last 2 to 5 bytes, the word so far, each
with or without the document's state); a counter that has seen little leans on the one before it in this list. The
state is what the words before say about the kind of document (a language, say): the likeliest class of a small mixture
of byte-pair models, refined word by word, and never looking ahead. Their log-odds are combined by gated weights: three mixers, whose
weights are chosen by the counters' confidence, by the place in the word, and by the byte before. The weights
are refined online, block by block, with Newton steps on training documents the counters haven't seen; trees and counters
are then learned again from all training documents.

This spells a unit, at one cost per state. Contexts that reach over the word's border are counted beside it: how often the unit
followed the word before it in training texts, and how often the two units before. A unit seen c times in N behind
such a context has probability (c + strength * p) / (N + strength), p being what the shorter context gives it, and at last its
spelling. Each mixer with each pair of ``STRENGTHS`` is one predictor of the whole text; they are weighed along each document
by how well they have predicted it so far (their posterior), which gives its total log-probability.

The classes begin with a bounded sample of training documents (``CLASS_ROWS``, whole texts) and are then fitted on all of
them, ``CLASS_ROUNDS`` times over.

How it runs: a block (at most one task's documents) lists its distinct units and per document their order. Unit
counts are summed over the corpus by key, so each distinct unit is learned from and spelled once, whatever its
frequency. Scores go back to the blocks by a join on the unit. A block also sends its distinct pairs and triples of units, as hashes
of 56 bits with their counts, to shards of these hashes, which add up all blocks' counts and answer each block; the block then adds up
its documents. The counters are a table keyed by slot
that is never held whole and has no bound: neighbouring words form a part of the vocabulary, a part sends its counts, and the slots whose
counters it needs, to the slots' shards, and a shard adds up all parts' counts and answers each part. What is broadcast or sent to the
driver (trees, weights) has a fixed size.

Every text is scored whole. Null counts as empty, as does a text of white space alone; an empty text has one token, its end. Repeated rows get
equal rows. Only ``doc_id`` and ``text`` are read. An empty table gives no rows. With no training documents
all counters are empty, and every decision has probability 1/2.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow_batches, shuffle_partitions, stage, unstage, whole_text

FOLDS, HELD_OUT, MIX_FOLD = 7, 2, 6
PREDICTORS = 6
GATES = (25, 16, 16)
#: The counters whose confidence chooses the first mixer's weights.
SURE = (2, 5)
#: Distinct words with their white space per block, units of documents per block, and units per step of the numeric code.
BLOCK_UNITS, BLOCK_TOKENS, STEP_UNITS = 1_200_000, 2_000_000, 8_000
#: Bits of a hash of neighbouring units, and training tokens to a shard of them.
GRAM_BITS, GRAM_TOKENS = 56, 1 << 20
#: What the shorter context weighs, in observations, beside the word before and beside the two units before.
STRENGTHS = ((1.0, 0.5), (16.0, 2.0), (256.0, 16.0))
#: Numbers in one piece of a sum as it travels.
PIECE = 1 << 15
#: Slots of a counter table in one shard, and bytes of units in one part of the vocabulary.
SHARD, PART_BYTES = 1 << 20, 400_000
#: Classes of documents, training documents they begin with at most, hashed byte pairs they are told by, and rounds over all training documents.
CLASSES, CLASS_ROWS, PAIRS, CLASS_ROUNDS = 8, 4_000, 2_048, 3
PRIOR = 0.02  # added to both counts of a slot
LEAN = 1.0  # what the estimate of the counter before weighs, in observations
END, OPEN_SPACE = 0xFF, 0xF8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PIECE = re.compile(r"(?:\A[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_STATES = [chr(97 + k) for k in range(CLASSES + 1)]  # the last one: nothing read so far


def table_bits(units: int) -> tuple[int, ...]:
    """log2 of the slots per counter table: they grow with the number of distinct units, sixteen slots each, without a bound."""
    return (max(15, (16 * units).bit_length()),) * PREDICTORS


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


# --- units of a block -------------------------------------------------------------------------------


def lowered(text: str) -> str:
    return text.encode("utf-8", "replace").translate(_LOWER).decode()


def text_words(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def text_pieces(low: str) -> list[str]:
    """The words of a lower-cased text, each with the white space around it: joined they are the text."""
    pieces = _PIECE.findall(low)
    if pieces and not pieces[-1][-1] in " \t\n\x0b\x0c\r":
        pieces[-1] += " "
    return pieces


def byte_pairs(joined: bytes) -> np.ndarray:
    """Hashed pairs of neighbouring bytes."""
    data = np.frombuffer(joined, np.uint8).astype(np.uint32)
    pair = (data[:-1] << np.uint32(8) | data[1:]) * np.uint32(0x9E3779B1)
    return (pair >> np.uint32(32 - PAIRS.bit_length() + 1)).astype(np.int64)


def pair_counts(text: str) -> np.ndarray:
    """How often each hashed byte pair occurs in a text's words."""
    return np.bincount(byte_pairs(f" {' '.join(text_words(text))} ".encode()), minlength=PAIRS)


def class_sums(training: DataFrame, logs: np.ndarray, share_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair counts and numbers of documents by class, every training document in its likeliest class."""
    prior = np.log(share_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, PAIRS + 1))  # the last column counts documents
        for batch in batches:
            for t in batch.column("text").to_pylist():
                x = pair_counts(t)
                if x.sum() > 0:
                    k = int(np.argmax(logs @ x + prior))
                    sums[k, :PAIRS] += x
                    sums[k, PAIRS] += 1
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(sums.ravel()[at], pa.float64())], names=["at", "n"])

    total = np.zeros(CLASSES * (PAIRS + 1))
    for r in training.select("text").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each class and pair at most
        total[r["at"]] = r["n"]
    total = total.reshape(CLASSES, PAIRS + 1)
    return total[:, :PAIRS], total[:, PAIRS]


def fit_classes(docs: DataFrame, rows: int = CLASS_ROWS, rounds: int = CLASS_ROUNDS) -> np.ndarray:
    """Log-probabilities of byte pairs (rows) by class (columns); a sample of bounded size gives the first ones, rounds over all training documents the others."""
    training = docs.select("doc_id", whole_text().alias("text")).filter(fold(F.col("doc_id")) != HELD_OUT)
    share = max(1, -(-training.count() // rows))
    sample = training.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair_counts(t).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(found, pa.binary())], names=["pairs"])

    counts = [np.frombuffer(r["pairs"], "<f4") for r in sample.mapInArrow(run, "pairs binary").orderBy("pairs").limit(2 * rows).collect()]
    x = np.array(counts) if counts else np.zeros((0, PAIRS))
    x = x[x.sum(1) > 0]
    if not len(x):
        return np.zeros((PAIRS, CLASSES), np.float32)
    scaled = np.sqrt(x / x.sum(1, keepdims=True))
    centres = [int(np.argmax(x.sum(1)))]
    for _ in range(CLASSES - 1):  # documents far from those chosen begin the other classes
        centres.append(int(np.argmin(np.max(scaled @ scaled[centres].T, axis=1))))
    member = np.argmax(scaled @ scaled[centres].T, axis=1)
    for _ in range(25):
        share_of = np.bincount(member, minlength=CLASSES) + 1.0
        sums = np.stack([x[member == k].sum(0) for k in range(CLASSES)]) + 0.05 + 0.01 * x.mean(0)
        logs = np.log(sums / sums.sum(1, keepdims=True))
        member = np.argmax(x @ logs.T + np.log(share_of), axis=1)
    for _ in range(rounds):
        sums, n = class_sums(training, logs, share_of)
        share_of = n + 1.0
        sums = sums + 0.05 + 0.01 * sums.sum(0) / max(1.0, n.sum())
        logs = np.log(sums / sums.sum(1, keepdims=True))
    return np.ascontiguousarray(logs.T, np.float32)


def text_states(words: list[str], classes: np.ndarray) -> np.ndarray:
    """The state before each word, and before the end."""
    states = np.full(len(words) + 1, CLASSES)
    if words:
        joined = f" {' '.join(words)} ".encode()
        begin = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)[:-1]  # the pairs of a word begin with the space before it
        said = np.cumsum(np.add.reduceat(classes[byte_pairs(joined)], begin, axis=0), axis=0)
        states[1:] = np.argmax(said, axis=1)
    return states


def unit_key(state: int, piece: str) -> str:
    """The key of a unit: the state, the word with its white space, a mark; no word stands for the end."""
    return f"{_STATES[state]}{piece}{'C' if piece else 'E'}"


def text_units(text: str, classes: np.ndarray) -> list[str]:
    """Keys of a text's units, in order; the last one is the end."""
    low = lowered(text)
    return [unit_key(k, piece) for k, piece in zip(text_states(_WORD.findall(low), classes), [*text_pieces(low), ""])]


def unit_piece() -> Column:
    """The word of a key with its white space; empty for the end."""
    return F.expr("substring(key, 2, length(key) - 2)")


def unit_word() -> Column:
    """The word of a key; empty for the end."""
    return F.btrim(unit_piece(), F.lit(" \t\n\x0b\x0c\r"))


BLOCK_ROWS = "kind int, block long, key string, idx int, n_fit long, n_mix long, docs binary"


def list_blocks(docs: DataFrame, classes) -> DataFrame:
    """Rows of kind 0: a block's distinct units with their counts; one of kind 1: hashes of its units, and its documents' units in order."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, tokens = TaskContext.get().partitionId(), 0, 0
        index: dict[str, int] = {"": 0}  # pieces by number; the end is the first
        documents: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not documents:
                return
            block = part << 32 | number
            number += 1
            sizes = np.array([len(d[2]) for d in documents])
            folds = np.repeat(np.array([d[1] for d in documents]), sizes)
            codes, units = np.unique(np.concatenate([d[2] for d in documents]), return_inverse=True)
            units = units.astype(np.int32)
            n = len(codes)
            n_fit = np.bincount(units[(folds != HELD_OUT) & (folds != MIX_FOLD)], minlength=n)
            n_mix = np.bincount(units[folds == MIX_FOLD], minlength=n)
            pieces = list(index)
            for at in range(0, n, 50_000):
                keys = [unit_key(c % (CLASSES + 1), pieces[c // (CLASSES + 1)]) for c in codes[at : at + 50_000].tolist()]
                m = len(keys)
                yield pa.record_batch(
                    [pa.array([0] * m, pa.int32()), pa.array([block] * m, pa.int64()), pa.array(keys, pa.string()), pa.array(np.arange(at, at + m, dtype=np.int32)),
                     pa.array(n_fit[at : at + m], pa.int64()), pa.array(n_mix[at : at + m], pa.int64()), pa.nulls(m, pa.binary())],
                    names=[c.split()[0] for c in BLOCK_ROWS.split(", ")],
                )
            ends = np.cumsum(sizes)
            blob = pack_hashes(*piece_hashes(pa.array(pieces, pa.string())), codes // (CLASSES + 1))
            blob += pack_documents([(d[0], d[1], units[b - len(d[2]) : b], np.ones(len(d[2]), np.int32)) for d, b in zip(documents, ends)])
            yield pa.record_batch(
                [pa.array([1], pa.int32()), pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())],
                names=[c.split()[0] for c in BLOCK_ROWS.split(", ")],
            )
            index.clear()
            index[""] = 0
            documents.clear()

        for batch in batches:
            for doc, f, text in zip(*(c.to_pylist() for c in batch.columns)):
                low = lowered(text)
                states = text_states(_WORD.findall(low), classes.value)
                numbers = np.array([index.setdefault(p, len(index)) for p in [*text_pieces(low), ""]], np.int64)
                documents.append((doc, f, numbers * (CLASSES + 1) + states))
                tokens += len(numbers)
                if len(index) >= BLOCK_UNITS or tokens >= BLOCK_TOKENS:
                    yield from flush()
                    tokens = 0
        yield from flush()

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).cast("int").alias("fold"), whole_text().alias("text"))
    return frame.mapInArrow(run, BLOCK_ROWS)


def pack_documents(documents: list[tuple]) -> bytes:
    """Ids, folds and units of documents, each with how often it stands there, compressed."""
    n = len(documents)
    known = np.array([d[0] is not None for d in documents], np.uint8)
    head = [np.array([n], np.int64), np.array([d[0] or 0 for d in documents], np.int64), np.array([d[1] for d in documents], np.int64), np.array([len(d[2]) for d in documents], np.int64)]
    body = [known, np.concatenate([d[2] for d in documents]).astype("<i4"), np.concatenate([d[3] for d in documents]).astype("<i4")]
    return zlib.compress(b"".join(a.tobytes() for a in (*head, *body)), 1)


def unpack_documents(blob: bytes) -> tuple[np.ndarray, ...]:
    data = zlib.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, folds, sizes = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
    known = np.frombuffer(data, np.uint8, n, 8 + 24 * n)
    units, counts = np.frombuffer(data, "<i4", 2 * int(sizes.sum()), 8 + 25 * n).reshape(2, -1)
    return ids, known, folds, sizes, units, counts


# --- neighbouring units -----------------------------------------------------------------------------

_BASE, _START = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def text_bytes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and where each begins and the last one ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]].copy(), offsets - offsets[0]


def piece_hashes(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in pieces, and of the white space around them, from polynomial prefix sums."""
    words, spaces = np.empty(len(pieces), np.uint64), np.empty(len(pieces), np.uint64)
    for at in range(0, len(pieces), 50_000):
        data, offsets = text_bytes(pieces.slice(at, 50_000))
        first, end = offsets[:-1], offsets[1:]
        power = np.cumprod(np.r_[1, np.full(len(data), _BASE, np.uint64)].astype(np.uint64), dtype=np.uint64)
        inverse = np.cumprod(np.r_[1, np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)].astype(np.uint64), dtype=np.uint64)
        sums = np.r_[0, np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)].astype(np.uint64)
        inside = np.append(np.flatnonzero(~is_space(data)), len(data))
        low, high = np.searchsorted(inside, first), np.searchsorted(inside, end)
        begin = np.where(low < high, inside[low], first)
        stop = np.where(low < high, inside[high - 1] + 1, first)
        of = lambda a, b: mixed((sums[b] - sums[a]) * inverse[a])
        words[at : at + 50_000] = of(begin, stop)
        spaces[at : at + 50_000] = of(first, begin) * _FACTORS[0] + of(stop, end)
    return words, spaces


def pack_hashes(words: np.ndarray, spaces: np.ndarray, piece: np.ndarray) -> bytes:
    """Hashes of pieces, which can't be compressed but for the white space, and the piece (ascending) of each unit."""
    rest = zlib.compress(spaces.astype("<u8").tobytes() + np.diff(piece, prepend=0).astype("<i4").tobytes(), 1)
    return np.array([len(words), len(piece), len(rest)], "<i8").tobytes() + words.astype("<u8").tobytes() + rest


def unpack_block(blob: bytes) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Hashes of a block's units and of their words, and its documents."""
    n, m, size = np.frombuffer(blob, "<i8", 3).tolist()
    words = np.frombuffer(blob, "<u8", n, 24)
    rest = zlib.decompress(blob[24 + 8 * n : 24 + 8 * n + size])
    whole = mixed(words * _FACTORS[1] + np.frombuffer(rest, "<u8", n))
    piece = np.cumsum(np.frombuffer(rest, "<i4", m, 8 * n))
    return whole[piece], words[piece], unpack_documents(blob[24 + 8 * n + size :])


def block_grams(blob: bytes) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """A block's documents; the distinct hashes of its pairs and triples in ascending order, the order of all, and where each distinct one begins in it."""
    whole, words, documents = unpack_block(blob)
    sizes, units = documents[3:5]
    return documents, *sorted_slots(np.concatenate(unit_grams(whole[units], words[units], np.cumsum(sizes) - sizes)))


def unit_grams(whole: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each unit with the word before it, and with the unit before that and the word before them; documents begin at starts."""

    def before(x: np.ndarray) -> np.ndarray:
        out = np.roll(x, 1)
        out[starts] = _START
        return out

    pair = mixed(before(words) * _FACTORS[0] + whole * _FACTORS[1])
    triple = mixed(before(pair) * _FACTORS[2] + whole * _FACTORS[3])
    return tuple((x >> np.uint64(64 - GRAM_BITS)).astype(np.int64) for x in (pair, triple))


def pack_grams(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending hashes and their counts, byte by byte; the lower bytes of the hashes' steps can't be compressed."""
    planes = np.ascontiguousarray(np.diff(grams, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return np.int64(len(grams)).tobytes() + planes[:4].tobytes() + zlib.compress(planes[4:].tobytes() + counts.astype("<u4").tobytes(), 1)


def unpack_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    rest = zlib.decompress(blob[8 + 4 * n :])
    planes = np.concatenate([np.frombuffer(blob, np.uint8, 4 * n, 8), np.frombuffer(rest, np.uint8, 4 * n)]).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)), np.frombuffer(rest, "<u4", n, 4 * n).astype(np.int64)


def ask_grams(blocks: DataFrame, shard_bits: int) -> DataFrame:
    """(shard, block, blob): the pairs and triples of units in each block, and how often its training documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                documents, distinct, order, begin = block_grams(blob)
                folds, sizes = documents[2:4]
                seen = np.add.reduceat(np.tile(np.repeat(folds != HELD_OUT, sizes), 2)[order].astype(np.int64), begin)
                shards = distinct >> (GRAM_BITS - shard_bits)
                cuts = np.flatnonzero(np.diff(shards, prepend=-1, append=-1))
                for a, b in zip(cuts, cuts[1:]):
                    yield pa.record_batch([pa.array(shards[a : a + 1]), pa.array([block], pa.int64()), pa.array([pack_grams(distinct[a:b], seen[a:b])], pa.binary())], names=["shard", "block", "blob"])

    return blocks.filter("kind = 1").select("block", "docs").mapInArrow(run, "shard long, block long, blob binary")


def answer_grams(asked: DataFrame) -> DataFrame:
    """(shard, block, blob): counts over all blocks of the pairs and triples that a block sent to a shard, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs(batches, "shard"):
            found = [unpack_grams(b) for b in rows.column("blob").to_pylist()]
            counts = np.concatenate([n for _, n in found])
            _, order, begin = sorted_slots(np.concatenate([g for g, _ in found]))
            counts[order] = np.repeat(np.add.reduceat(counts[order], begin), np.diff(begin, append=len(order)))
            blobs = [zlib.compress(n.astype("<u4").tobytes(), 1) for n in np.split(counts, np.cumsum([len(g) for g, _ in found])[:-1])]
            yield pa.record_batch([pa.array([shard] * len(blobs), pa.int64()), rows.column("block").combine_chunks(), pa.array(blobs, pa.binary())], names=["shard", "block", "blob"])

    n = shuffle_partitions(asked.sparkSession)
    return asked.repartition(n, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, "shard long, block long, blob binary")


# --- decisions of units -----------------------------------------------------------------------------


class Trees:
    """A Huffman tree per byte before: the decisions that code each byte."""

    def __init__(self, pairs: np.ndarray, bits: tuple[int, ...]):
        """pairs[a, b]: how often b follows a; every byte gets a code, counted or not. bits: of the slots of each table."""
        self.bits = bits
        sizes, self.start = np.zeros((256, 256), np.int32), np.zeros((256, 256), np.int64)
        nodes, taken = [], []
        at = 0
        for a in range(256):
            for b, path in enumerate(self._paths(pairs[a])):
                sizes[a, b], self.start[a, b] = len(path), at
                at += len(path)
                nodes += [n for n, _ in path]
                taken += [x for _, x in path]
        self.size, self.node, self.bit = sizes, np.array(nodes, np.uint8), np.array(taken, np.uint8)

    @staticmethod
    def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
        heap = [(float(counts[b]) + 1e-3, b, b) for b in range(256)]
        heapq.heapify(heap)
        made, parent = 256, {}
        while len(heap) > 1:
            (n, _, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (made, 0), (made, 1)
            heapq.heappush(heap, (n + m, made, made))
            made += 1
        paths = []
        for b in range(256):
            path, at = [], b
            while at in parent:
                up, bit = parent[at]
                path.append((made - 1 - up, bit))  # the root is 0
                at = up
            paths.append(path[::-1])
        return paths


def unit_bytes(keys: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of units, where each begins, and which ones are the end. White space that doesn't close a unit has
    bytes of its own, which no text holds, so that a unit's last byte tells that it is closed."""
    data, offsets = text_bytes(keys)
    last = offsets[1:] - 1
    ended = data[last] == ord("E")
    open_ = is_space(data)
    open_[last - 1] = False
    data[open_] = np.where(data[open_] == 32, 5, data[open_] - 9) + OPEN_SPACE
    data[last[ended]] = END
    return data, offsets, ended


class Decisions:
    """Decisions of a run of units: slots per predictor, the bit taken, gates' inputs, the unit of each."""

    def __init__(self, trees: Trees, keys: pa.StringArray):
        n = len(keys)
        data, offsets, ended = unit_bytes(keys)
        first, last = offsets[:-1], offsets[1:] - 1
        unit = np.repeat(np.arange(n), np.diff(offsets))
        place = np.arange(len(data)) - first[unit]
        scored = (place > 0) & ((np.arange(len(data)) != last[unit]) | ended[unit])
        at = np.flatnonzero(scored)
        place, unit = place[at], unit[at]

        def back(k: int) -> np.ndarray:
            return np.where(place >= k, data[np.maximum(at - k, 0)], 0).astype(np.uint32)

        c = [back(k) for k in range(1, 6)]
        order2 = c[0] | c[1] << np.uint32(8)
        order3 = order2 | c[2] << np.uint32(16)
        order4 = order3 | c[3] << np.uint32(24)

        def contexts(base: int, one: int, other: int, of_state: int) -> list[np.ndarray]:
            sum_ = np.zeros(len(data) + 1, np.uint32)  # polynomial prefix sums: hashes of the unit so far
            power = np.cumprod(np.full(len(data) + 1, base, np.uint32), dtype=np.uint32)
            inverse = np.cumprod(np.full(len(data) + 1, pow(base, -1, 1 << 32), np.uint32), dtype=np.uint32)
            np.cumsum((data.astype(np.uint32) + np.uint32(1)) * power[:-1], out=sum_[1:], dtype=np.uint32)
            so_far = (sum_[at] - sum_[first[unit] + 1]) * inverse[first[unit] + 1]
            order5 = order4 * np.uint32(one) ^ (c[4] + np.uint32(1)) * np.uint32(other)
            state = (data[first[unit]].astype(np.uint32) + np.uint32(1)) * np.uint32(of_state)
            return [order2 ^ state, order3, order4, order5 ^ state, so_far, so_far ^ state * np.uint32(0x27D4EB2F)]

        hashed = contexts(0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x165667B1)
        # a second hash of 32 bits for tables whose slots need more than one
        further = contexts(0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x9E3779B1) if max(trees.bits) > 32 else hashed

        a, b = c[0].astype(np.int64), data[at]
        size = trees.size[a, b]
        end = np.cumsum(size)
        step = np.arange(int(end[-1]) if len(end) else 0)
        path = step + np.repeat(trees.start[a, b] - end + size, size)
        self.node, self.bit = trees.node[path], trees.bit[path]
        self.unit = np.repeat(unit.astype(np.int32), size)

        def spread(context: np.ndarray, one: int, other: int, of_node: int) -> np.ndarray:
            h = (np.repeat(context, size) * np.uint32(one)) ^ self.node.astype(np.uint32) * np.uint32(of_node)
            h ^= h >> np.uint32(15)
            return h * np.uint32(other)

        self.slots = []
        for context, second, bits in zip(hashed, further, trees.bits):
            h = spread(context, 0x9E3779B1, 0x2C1B3C6D, 0x61C88647)
            slots = h >> np.uint32(max(0, 32 - bits))
            if bits > 32:
                slots = slots.astype(np.int64) << (bits - 32) | (spread(second, 0x85EBCA6B, 0x297A2D39, 0xC2B2AE35) >> np.uint32(64 - bits)).astype(np.int64)
            self.slots.append(slots)
        self.depth = np.minimum(step - np.repeat(end - size, size), 3).astype(np.uint8)
        self.in_word = np.repeat(np.minimum(place - 1, 15).astype(np.uint8), size)
        kind = np.select([c[0] <= 32, c[0] >= 128, (c[0] >= 97) & (c[0] <= 122), (c[0] >= 48) & (c[0] <= 57)], [0, 1, 2, 3], 3)
        self.byte_kind = np.repeat(kind.astype(np.uint8), size)

    def inputs(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log-odds of the predictors (one column each, and a constant); the gates of the three mixers."""
        x = np.empty((len(self.bit), PREDICTORS + 1), np.float32)
        p = np.full(len(self.bit), 0.5, np.float32)
        sure = np.zeros(len(self.bit), np.int64)
        for k, ((odds, seen), slot) in enumerate(zip(tables, self.slots)):
            n = seen[slot].astype(np.float32)
            p = (n / (1 + np.exp(-odds[slot].astype(np.float32))) + LEAN * p) / (n + LEAN)
            p = np.clip(p, 1e-6, 1 - 1e-6)
            x[:, k] = np.log(p / (1 - p))
            if k in SURE:
                sure = sure * 5 + (n > 0) + (n > 1) + (n > 3) + (n > 20)
        x[:, -1] = 0.3
        return x, [sure, self.in_word, self.byte_kind * 4 + self.depth]


def _steps(column: pa.Array) -> Iterator[tuple[int, pa.StringArray]]:
    for at in range(0, len(column), STEP_UNITS):
        yield at, column.slice(at, STEP_UNITS)


# --- what is learned --------------------------------------------------------------------------------


def sum_pieces(rows: DataFrame, finish) -> list[tuple[int, bytes]]:
    """Sum sparse (piece, idx, value) blobs by piece, in sorted runs, one piece in memory; finished pieces go compressed to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([zlib.compress(finish(total), 1)], pa.binary())], names=["piece", "data"])

        for batch in batches:
            for piece, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if piece != now:
                    if now is not None:
                        yield done()
                    now, total = piece, np.zeros(2 * PIECE)
                data = zlib.decompress(blob)
                n = len(data) // 8
                total[np.frombuffer(data, "<u4", n)] += np.frombuffer(data, "<f4", n, 4 * n)
        if now is not None:
            yield done()

    n = shuffle_partitions(rows.sparkSession)
    summed = rows.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(run, "piece long, data binary")
    return [(r["piece"], bytes(r["data"])) for r in summed.collect()]  # compressed; at most the tables' fixed size


def _pieces(first_piece: int, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    found = np.flatnonzero(counts)
    cuts = np.searchsorted(found, np.arange(0, len(counts) + 1, 2 * PIECE))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            idx = found[a:b]
            yield first_piece + k, zlib.compress((idx - k * 2 * PIECE).astype("<u4").tobytes() + counts[idx].astype("<f4").tobytes(), 1)


def _piece_batch(pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p for p, _ in pieces], pa.int64()), pa.array([b for _, b in pieces], pa.binary())], names=["piece", "blob"])


def learn_trees(vocabulary: DataFrame, bits: tuple[int, ...]) -> Trees:
    """Trees from the byte pairs of all training units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(65536)
        for batch in batches:
            for at, keys in _steps(batch.column("key")):
                data, offsets, ended = unit_bytes(keys)
                weight = np.repeat(np.asarray(batch.column("n_fit"))[at : at + len(keys)].astype(float), np.diff(offsets))
                inside = np.ones(len(data), bool)
                inside[offsets[:-1]] = False
                inside[offsets[1:][~ended] - 1] = False
                where = np.flatnonzero(inside)
                pairs += np.bincount(data[where - 1].astype(np.int64) * 256 + data[where], weights=weight[where], minlength=65536)
        yield _piece_batch(list(_pieces(0, pairs)))

    rows = vocabulary.select("key", "n_fit").filter("n_fit > 0").mapInArrow(run, "piece long, blob binary")
    pairs = np.zeros(65536)
    for piece, data in sum_pieces(rows, lambda total: total.tobytes()):
        pairs[piece * 2 * PIECE : (piece + 1) * 2 * PIECE] = np.frombuffer(zlib.decompress(data))
    return Trees(pairs.reshape(256, 256), bits)


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows by run of equal numbers in a column, one run in memory."""
    now, held = None, []
    for batch in batches:
        values = np.asarray(batch.column(column))
        cuts = np.flatnonzero(np.diff(values)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b == a:
                continue
            if values[a] != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = int(values[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def number_parts(vocabulary: DataFrame) -> DataFrame:
    """vocabulary with part: runs of its rows of about ``PART_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = before + np.cumsum(np.asarray(pc.binary_length(batch.column("key"))).astype(np.int64))
            before = int(size[-1]) if len(size) else before
            yield batch.append_column("part", pa.array(task << 32 | size // PART_BYTES))

    return vocabulary.mapInArrow(run, f"{vocabulary._jdf.schema().toDDL()}, part long")


def sorted_slots(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct slots in ascending order, the order of all, and where each distinct one begins in it."""
    n, k = len(slots), len(slots).bit_length()
    if n and int(slots.max()).bit_length() + k < 64:
        found = slots.astype(np.int64)  # sorts faster with its order packed in than an order does
        found <<= k
        found |= np.arange(n)
        found.sort()
        order = (found & (1 << k) - 1).astype(np.int32 if k < 32 else np.int64)
        found >>= k
    else:
        order = np.argsort(slots)
        found = slots[order].astype(np.int64)
    begin = np.flatnonzero(np.r_[n > 0, found[1:] != found[:-1]])
    return found[begin], order, begin


def part_decisions(trees: Trees, keys: pa.ChunkedArray) -> tuple[list[tuple[int, Decisions]], list[np.ndarray]]:
    """Decisions of a part's units in steps, and their slots by table."""
    found = [(at, Decisions(trees, some)) for at, some in _steps(keys.combine_chunks())]
    slots = []
    for k in range(PREDICTORS):
        slots.append(np.concatenate([d.slots[k] for _, d in found]))
        for _, d in found:
            d.slots[k] = None  # held once
    return found, slots


def ask_counters(units: DataFrame, trees) -> DataFrame:
    """(shard, part, blob): the slots of a part's decisions, what its units (key, weight) add to them, and which it asks (asks) for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in runs(batches, "part"):
            found, slots = part_decisions(trees.value, rows.column("key"))
            unit = np.concatenate([d.unit + at for at, d in found])
            bit = np.concatenate([d.bit for _, d in found])
            weight = rows.column("weight").to_numpy()[unit]
            asks = rows.column("asks").to_numpy()[unit]
            ones = weight * bit
            del found
            for k in range(PREDICTORS):
                distinct, order, begin = sorted_slots(slots[k])
                slots[k] = None
                if not len(distinct):
                    continue
                n1 = np.add.reduceat(ones[order], begin)
                n0 = np.add.reduceat(weight[order], begin) - n1
                asked = np.logical_or.reduceat(asks[order], begin)
                shards = distinct // SHARD
                cuts = np.flatnonzero(np.diff(shards, prepend=-1, append=-1))
                blobs = [
                    zlib.compress(np.diff(distinct[a:b] - shards[a] * SHARD, prepend=0).astype("<u4").tobytes() + n0[a:b].astype("<f4").tobytes() + n1[a:b].astype("<f4").tobytes() + asked[a:b].tobytes(), 1)
                    for a, b in zip(cuts, cuts[1:])
                ]
                yield pa.record_batch([pa.array(k << 56 | shards[cuts[:-1]]), pa.array(np.full(len(blobs), part)), pa.array(blobs, pa.binary())], names=["shard", "part", "blob"])

    n = shuffle_partitions(units.sparkSession)
    return units.select("part", "key", "weight", "asks").repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "shard long, part long, blob binary")


def answer_counters(asked: DataFrame) -> DataFrame:
    """(shard, part, blob): log-odds and observations, over all parts, of the slots each part asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SHARD))
        for shard, rows in runs(batches, "shard"):
            total[:] = 0
            blobs = rows.column("blob").to_pylist()
            for blob in blobs:
                idx, n0, n1, _ = unpack_request(blob)
                total[0, idx] += n0
                total[1, idx] += n1
            for part, blob in zip(rows.column("part").to_pylist(), blobs):
                idx, _, _, asks = unpack_request(blob)
                n0, n1 = total[:, idx[asks]]
                if len(n0):
                    seen = np.minimum(n0 + n1, 60_000)  # as confidence; the odds come from the full counts
                    data = np.log((n1 + PRIOR) / (n0 + PRIOR)).astype("<f2").tobytes() + seen.astype("<f2").tobytes()
                    yield pa.record_batch([pa.array([shard]), pa.array([part]), pa.array([zlib.compress(data, 1)], pa.binary())], names=["shard", "part", "blob"])

    n = shuffle_partitions(asked.sparkSession)
    return asked.repartition(n, "shard").sortWithinPartitions("shard", "part").mapInArrow(run, "shard long, part long, blob binary")


def unpack_request(blob: bytes) -> tuple[np.ndarray, ...]:
    data = zlib.decompress(blob)
    n = len(data) // 13
    return np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64), np.frombuffer(data, "<f4", n, 4 * n), np.frombuffer(data, "<f4", n, 8 * n), np.frombuffer(data, np.bool_, n, 12 * n)


def counters(units: DataFrame, trees) -> DataFrame:
    """Answers for the units that ask, from the decisions of all units, each weighted by its count."""
    return stage(answer_counters(ask_counters(units, trees)), "lm-counters")


def with_counters(units: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Answers of a part, then its units (key, and a number) in an order that doesn't follow the words."""
    n = shuffle_partitions(units.sparkSession)
    rows = answers.select("part", "shard", "blob", F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias(column)).unionByName(
        units.select("part", F.lit(1 << 62).alias("shard"), F.lit(None).cast("binary").alias("blob"), "key", column)
    )
    return rows.repartition(n, "part").sortWithinPartitions("part", "shard", F.xxhash64("key"), "key")


def answered(trees: Trees, rows: pa.Table) -> tuple[pa.Table, list[tuple[int, Decisions]], list[tuple[np.ndarray, np.ndarray]]]:
    """A part's units, their decisions in steps, and the counters that the decisions' slots now number."""
    shard = rows.column("shard").to_numpy()
    n = int(np.searchsorted(shard, 1 << 62))
    units = rows.slice(n)
    found, slots = part_decisions(trees, units.column("key"))
    halves = [np.frombuffer(zlib.decompress(b), "<f2").reshape(2, -1) for b in rows.column("blob").slice(0, n).to_pylist()]
    tables = []
    for k in range(PREDICTORS):
        mine = [h for h, s in zip(halves, shard[:n]) if s >> 56 == k]
        odds, seen = np.concatenate(mine, axis=1) if mine else np.zeros((2, 0), np.float16)
        distinct, order, begin = sorted_slots(slots[k])
        if len(distinct) != len(odds):
            raise ValueError(f"{len(distinct)} slots, {len(odds)} counters")
        place = np.empty(len(order), np.int32)
        place[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(begin, append=len(order)))
        slots[k] = None
        tables.append((odds, seen))
        at = 0
        for _, d in found:
            d.slots[k] = place[at : at + len(d.bit)]
            at += len(d.bit)
    return units, found, tables


class Mixer:
    """Weights per gate, refined by Newton steps on the steps' summed gradients and curvatures."""

    def __init__(self, gates: int):
        n = PREDICTORS + 1
        self.w = np.tile(np.r_[np.full(PREDICTORS, 0.3), 0.0], (gates, 1))
        self.h = np.tile(np.eye(n) * 10.0, (gates, 1, 1))

    def learn(self, x: np.ndarray, bit: np.ndarray, gate: np.ndarray, weight: np.ndarray) -> None:
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", x, self.w.astype(np.float32)[gate]), -20, 20)))
        miss = bit - p
        curve = np.maximum(p * (1 - p), 0.25 * np.abs(miss)) * weight  # large misses take no larger steps
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(gate[order], np.arange(len(self.w) + 1))
        x, miss, curve = x[order], (miss * weight)[order], curve[order]
        for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                some = x[a:b]
                self.h[g] += (some * curve[a:b, None]).T @ some
                self.w[g] += np.linalg.solve(self.h[g], miss[a:b] @ some)


def learn_weights(vocabulary: DataFrame, trees, answers: DataFrame) -> list[np.ndarray]:
    """Gated weights, refined online in every task; the tasks' weights are averaged by their curvature."""
    n = PREDICTORS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = [Mixer(g) for g in GATES]
        for _, rows in runs(batches, "part"):
            units, found, model = answered(trees.value, rows)
            n_mix = units.column("n_mix").to_numpy().astype(float)
            for at, d in found:
                if len(d.bit):
                    x, gates = d.inputs(model)
                    for mixer, gate in zip(mixers, gates):
                        mixer.learn(x, d.bit, gate, n_mix[d.unit + at])
        rows = []
        for m, mixer in enumerate(mixers):
            for g in range(GATES[m]):
                rows += [(m, g, i, v) for i, v in enumerate(np.concatenate([mixer.h[g].ravel(), mixer.h[g] @ mixer.w[g]]).tolist())]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["mixer", "gate", "at", "value"])

    rows = stage(with_counters(vocabulary.filter("n_mix > 0"), answers, "n_mix").mapInArrow(run, "mixer int, gate int, at int, value double"), "lm-weights")
    weights = [Mixer(g).w for g in GATES]
    sums: dict[tuple[int, int], np.ndarray] = {}
    for r in rows.groupBy("mixer", "gate", "at").agg(F.sum("value").alias("value")).collect():  # a fixed number of rows
        sums.setdefault((r["mixer"], r["gate"]), np.zeros(n * n + n))[r["at"]] = r["value"]
    for (m, g), v in sums.items():
        weights[m][g] = np.linalg.solve(v[: n * n].reshape(n, n), v[n * n :])
    return weights


# --- scores -----------------------------------------------------------------------------------------


def score_units(vocabulary: DataFrame, trees, answers: DataFrame, weights) -> DataFrame:
    """vocabulary with log10 probabilities of each unit by the three mixers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "part"):
            units, found, model = answered(trees.value, rows)
            out = np.zeros((len(GATES), units.num_rows))
            for at, d in found:
                if not len(d.bit):
                    continue
                x, gates = d.inputs(model)
                sign = d.bit.astype(np.float32) * 2 - 1
                n = min(STEP_UNITS, units.num_rows - at)
                for m, (w, gate) in enumerate(zip(weights.value, gates)):
                    z = sign * np.clip(np.einsum("ij,ij->i", x, w.astype(np.float32)[gate]), -20, 20)
                    out[m, at : at + n] = np.bincount(d.unit, -np.log1p(np.exp(-z)), n)
            columns = [units.column("key").combine_chunks(), units.column("c").combine_chunks(), *(pa.array((o * np.log10(np.e)).astype(np.float32)) for o in out)]
            yield pa.record_batch(columns, names=["key", "c", "s0", "s1", "s2"])

    return with_counters(vocabulary, answers, "c").mapInArrow(run, "key string, c long, s0 float, s1 float, s2 float")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double, n_bytes long"


def add_up(rows: DataFrame, train_tokens: int, distinct: int, train_docs: int) -> DataFrame:
    """Rows of blocks (units with scores, then the documents, then counts of pairs and triples by shard) to document scores."""
    floor = np.log10(train_tokens + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in runs(batches, "block"):
            n = int(np.searchsorted(block.column("kind").to_numpy(), 1))
            units, blobs = block.slice(0, n), block.slice(n).column("docs").to_pylist()
            table = [units.column(x).to_numpy().astype(float) for x in ("c", "n_bytes", "s0", "s1", "s2")]
            (ids, known, folds, sizes, numbers, _), found, order, begin = block_grams(blobs[0])
            counts = np.concatenate([np.frombuffer(zlib.decompress(b), "<u4") for b in blobs[1:]])
            if len(found) != len(counts):
                raise ValueError(f"{len(found)} pairs and triples, {len(counts)} counts")
            seen = np.empty(len(order), np.uint32)
            seen[order] = np.repeat(counts, np.diff(begin, append=len(order)))
            seen = seen.reshape(2, -1)
            del block, blobs, found, order, begin, counts
            ends = np.cumsum(sizes)
            cuts = np.r_[0, np.flatnonzero(np.diff(ends // 200_000)) + 1, len(sizes)]  # documents at a time, of bounded size but for a long text
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    some = slice(ends[a] - sizes[a], ends[b - 1])
                    yield _document_rows((ids[a:b], known[a:b], folds[a:b], sizes[a:b]), numbers[some], seen[:, some].astype(float), table, train_tokens, floor, train_docs)

    return rows.mapInArrow(run, SCORES)


def _document_rows(documents: tuple, units: np.ndarray, seen: np.ndarray, table: list[np.ndarray], train_tokens: int, floor: float, train_docs: int) -> pa.RecordBatch:
    ids, known, folds, sizes = documents
    starts = np.cumsum(sizes) - sizes
    c, n_bytes, *scores = (t[units] for t in table)
    add = lambda v: np.add.reduceat(v, starts)
    n_known = add((c > 0).astype(np.int64))
    base = add(np.log10(c + 1.0)) - sizes * floor

    def before(x: np.ndarray) -> np.ndarray:
        out = np.roll(x, 1).astype(float)
        out[starts] = train_docs
        return out

    totals = [add(v) for s in scores for v in predictions(s, seen, before(c), before(seen[0]))]
    by_predictor = np.stack(totals)
    top = by_predictor.max(0)
    score = top + np.log10((10 ** (by_predictor - top)).mean(0))  # the predictors' posterior-weighted total
    size = add(n_bytes + (n_bytes == 0)).astype(np.int64)  # the end counts as a byte
    return pa.record_batch(
        [pa.array(ids, mask=known == 0), pa.array(folds == HELD_OUT), pa.array(sizes.astype(np.int64)), pa.array(n_known.astype(np.int64)),
         pa.array(np.full(len(ids), train_tokens)), pa.array(base), pa.array(score), pa.array(-score / np.log10(2) / np.maximum(size, 1)), pa.array(size)],
        names=[p.split()[0] for p in SCORES.split(", ")],
    )


def predictions(spelled: np.ndarray, seen: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> Iterator[np.ndarray]:
    """log10 probabilities of units, by strengths, from how they are spelled (log10), how often they were seen behind the word and behind the two
    units before, and how often these were seen."""
    p = 10**spelled
    far = np.flatnonzero((seen[0] == 0) & (spelled < -200))  # beyond what a number holds
    for one, two in STRENGTHS:
        q = np.log10(np.maximum((seen[1] + two * ((seen[0] + one * p) / (words + one))) / (pairs + two), 1e-300))
        q[far] = spelled[far] + np.log10(one / (words[far] + one)) + np.log10(two / (pairs[far] + two))
        yield q


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, n_bytes."""
    spark = docs.sparkSession
    context = spark.sparkContext
    classes = context.broadcast(fit_classes(docs))
    blocks = stage(list_blocks(docs, classes), "lm-blocks")
    units = blocks.filter("kind = 0")
    vocabulary = (
        units.select("key", unit_word().alias("word"), "n_fit", "n_mix")
        .repartitionByRange(shuffle_partitions(spark), "word")
        .groupBy("word", "key")
        .agg(F.sum("n_fit").alias("n_fit"), F.sum("n_mix").alias("n_mix"))
        .withColumn("c", F.sum(F.col("n_fit") + F.col("n_mix")).over(Window.partitionBy("word")))
        .withColumn("first", F.row_number().over(Window.partitionBy("word").orderBy("key")) == 1)
        .sortWithinPartitions("word", "key")
        .drop("word")
    )
    vocabulary = stage(number_parts(vocabulary), "lm-vocabulary")
    seen = F.col("n_fit") + F.col("n_mix")
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    n_units, train_tokens, train_docs, distinct = vocabulary.agg(
        F.count("*"), total(seen), total(F.when(F.col("key").endswith("E"), seen)), F.count(F.when(F.col("first") & (F.col("c") > 0), 1))
    ).first()
    grams = stage(answer_grams(ask_grams(blocks, (train_tokens // GRAM_TOKENS).bit_length())), "lm-grams")

    trees = context.broadcast(learn_trees(vocabulary, table_bits(n_units)))
    seen = vocabulary.select("part", "key", F.col("n_fit").cast("double").alias("weight"), (F.col("n_mix") > 0).alias("asks")).filter("weight > 0 OR asks")
    answers = counters(seen, trees)
    weights = context.broadcast(learn_weights(vocabulary, trees, answers))
    unstage(answers)
    # the weights needed documents that the counters hadn't seen; what scores has learned from all of them
    whole = vocabulary.withColumn("n_fit", F.col("n_fit") + F.col("n_mix"))
    trees = context.broadcast(learn_trees(whole, table_bits(n_units)))
    answers = counters(whole.select("part", "key", F.col("n_fit").cast("double").alias("weight"), F.lit(True).alias("asks")), trees)
    scored = stage(score_units(vocabulary, trees, answers, weights), "lm-scores")
    unstage(answers, vocabulary)

    spelled = units.select("block", "key", "idx").join(scored, "key").select(
        F.lit(0).alias("kind"), "block", F.col("idx").cast("long").alias("idx"), "c",
        F.octet_length(unit_piece()).alias("n_bytes"), "s0", "s1", "s2", F.lit(None).cast("binary").alias("docs"),
    )
    spelled = stage(spelled, "lm-spelled")
    unstage(scored)
    rest = [F.lit(0).cast("long").alias("c"), F.lit(0).alias("n_bytes"), *(F.lit(0.0).cast("float").alias(s) for s in ("s0", "s1", "s2"))]
    documents = blocks.filter("kind = 1").select(F.lit(1).alias("kind"), "block", F.lit(0).cast("long").alias("idx"), *rest, "docs")
    answers = grams.select(F.lit(2).alias("kind"), "block", F.col("shard").alias("idx"), *rest, F.col("blob").alias("docs"))
    rows = spelled.unionByName(documents).unionByName(answers).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "kind", "idx")
    return add_up(rows, train_tokens, distinct, train_docs)
