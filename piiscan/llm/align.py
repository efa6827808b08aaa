"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

Both tokenizers cut a document's bytes; the places where tokens of both end cut it into groups. For a batch of
documents the token ends of A and of B, counted on through the batch, are two ascending lists to be merged. The merge
path of A and B steps is cut into pieces of ``WORK`` steps: on the diagonal i + j = d a binary search finds how many steps come
from A and how many from B, so every piece holds the same work whether it lies in one long document or in many short
ones, and pieces don't depend on each other. A piece emits the ends that its own A and B tokens share. Where the path is cut
between two equal ends, the boundary of the two pieces adds that end; the emitted ends, in order, then number
the groups of all pieces (a running count), which stitches groups that lie across pieces.

A link is an A and a B token that end together. Then one token's bytes end with the other's, so all id pairs that can
ever be linked follow from the vocabularies (``linkable``, under a million whatever the corpus). Links are kept as
numbers of such pairs in a written table; their counts are summed by Spark and, being bounded by the vocabularies,
travel back to all tasks, where each document's links are looked up.

Tokens cover a space and the text. A text that is null or empty, or that one of the tokenizers changes (the joined token bytes
aren't the space and the text), has no tokens: its counts are 0 and its groups ''. Repeated rows count each. Only ``doc_id`` and
``text`` are read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, read_vocabulary
from .common import bound_arrow_batches, stage, whole_text
from .packing import fast_encoder

#: Steps of the merge path in a piece.
WORK = 1 << 15
#: Text bytes encoded at a time, so that a batch's token arrays stay small; one longer text is taken alone.
CHUNK_CHARS = 1 << 20

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_LOADED: dict[str, object] = {}


def piece_bytes(model: bytes) -> list[bytes]:
    """Bytes of every id of a SentencePiece model."""
    p = _pieces(model)
    return [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(t)) else t.replace("▁", " ").encode() for t in map(p.id_to_piece, range(p.get_piece_size()))]


def _pieces(model: bytes):
    import sentencepiece

    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _LOADED[key]


def token_bytes(content: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary; ids that stand for no bytes have none."""
    v = Vocabulary(content)
    return [v.bytes.get(i, b"") for i in range(max([*v.bytes, *v.added.values()]) + 1)]


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Ascending keys (A id * number of B ids + B id) of all pairs of which one's bytes end with the other's."""

    def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                out.setdefault(t, []).append(i)
        return out

    of_a, of_b, n = by_bytes(a), by_bytes(b), len(b)
    keys = {i * n + j for i, t in enumerate(a) for k in range(len(t)) for j in of_b.get(t[k:], ())}
    keys |= {i * n + j for j, t in enumerate(b) for k in range(len(t)) for i in of_a.get(t[k:], ())}
    return np.array(sorted(keys), np.int64)


def diagonal(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """For each number of steps, how many of them the merge of ascending a and b takes from a (of equals a's comes first)."""
    low, high = np.maximum(steps - len(b), 0), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] is among the first steps exactly if it isn't above b's last one
        j = np.clip(steps - middle - 1, 0, max(len(b) - 1, 0))
        more = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[j])
        low, high = np.where(more, middle + 1, low), np.where(open_ & ~more, middle, high)
    return low


def piece_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values in both."""
    at = np.searchsorted(b, a)
    inside = np.flatnonzero(at < len(b))
    same = inside[b[at[inside]] == a[inside]]
    return same, at[same]


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values that both hold, by pieces of equal work."""
    total = len(a) + len(b)
    steps = np.append(np.arange(0, total, work), total)
    i = diagonal(a, b, steps)
    j = steps - i
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(len(steps) - 1):
        if k and i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:  # cut between two equal ends
            found.append((i[k : k + 1] - 1, j[k : k + 1]))
        x, y = piece_overlaps(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        found.append((x + i[k], y + j[k]))
    return tuple(np.concatenate(side) if found else np.zeros(0, np.int64) for side in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


class Aligner:
    """Both tokenizers with their tables; one per Python worker."""

    def __init__(self, content: str, model: bytes, pairs: np.ndarray):
        self.encoder, self.pieces, self.pairs = fast_encoder(content), _pieces(model), pairs
        self.a, self.b = token_bytes(content), piece_bytes(model)
        self.size_a, self.size_b = (np.array([len(t) for t in side], np.int64) for side in (self.a, self.b))
        # an id's decimal text with what follows it: the next id, the other tokenizer's ids, or the next group
        self.text = [b"%d%s" % (i, end) for side, ends in ((self.a, (b",", b"|")), (self.b, (b",", b";"))) for end in ends for i in range(len(side))]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both, none if one of them changes the text."""
        spaced = " " + text
        a = self.encoder.encode_ordinary(spaced)
        data = spaced.encode()
        if b"".join(map(self.a.__getitem__, a)) != data:
            return [], []
        b = self.pieces.encode(text)
        return (a, b) if b"".join(map(self.b.__getitem__, b)) == data else ([], [])

    def align(self, texts: list[str], work: int = WORK) -> list[tuple[int, int, int, str, bytes]]:
        """n_a, n_b, n_groups, digest of the groups and numbers of the linked pairs (32-bit), of each text."""
        ids = [self.tokens(t) if t else ([], []) for t in texts]
        a, b = (np.array([i for pair in ids for i in pair[side]], np.int64) for side in (0, 1))
        at_a, at_b = (np.cumsum([0, *[len(pair[side]) for pair in ids]]) for side in (0, 1))
        x, y = merge_path(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), work)  # a document's last ends are shared
        at_g = np.searchsorted(x, at_a)
        linked = np.searchsorted(self.pairs, a[x] * len(self.b) + b[y]).astype("<i4")

        # in writing order a group's A ids come first, then its B ids
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[x], last_b[y] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, y + 1)[group_a]] = a + last_a * len(self.a)
        order[np.arange(len(b)) + (x + 1)[group_b]] = b + 2 * len(self.a) + last_b * len(self.b)

        out = []
        for k in range(len(texts)):
            n_a, n_b = int(at_a[k + 1] - at_a[k]), int(at_b[k + 1] - at_b[k])
            written = b"".join(map(self.text.__getitem__, order[at_a[k] + at_b[k] : at_a[k + 1] + at_b[k + 1]].tolist()))[:-1]
            digest = hashlib.sha256(written).hexdigest() if n_a else ""
            out.append((n_a, n_b, int(at_g[k + 1] - at_g[k]), digest, linked[at_g[k] : at_g[k + 1]].tobytes()))
        return out


def _worker(content: str, model: bytes, pairs: np.ndarray) -> Aligner:
    key = f"{hash(content)} {hash(model)}"
    if key not in _LOADED:
        _LOADED[key] = Aligner(content, model, pairs)
    return _LOADED[key]


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def aligned(docs: DataFrame, content: str, model: bytes, pairs: np.ndarray, work: int = WORK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, linked (32-bit numbers of linkable pairs): a narrow stage."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    sent = spark.sparkContext.broadcast((content, model, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker(*sent.value)
        for batch in batches:
            rows = [row for part in chunks(batch.column("text").to_pylist()) for row in aligner.align(part, work)]
            columns = [list(c) for c in zip(*rows)] or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "linked"])

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, linked binary")


def pair_counts(found: DataFrame, n_pairs: int) -> DataFrame:
    """pair (number), links: how many links of all documents hold each pair; summed in each task before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for linked in batch.column("linked").to_pylist():
                pair, n = np.unique(np.frombuffer(linked, "<i4"), return_counts=True)
                total[pair] += n
        pair = np.flatnonzero(total)
        yield pa.record_batch([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "links"])

    return found.select("linked").mapInArrow(run, "pair int, links long").groupBy("pair").agg(F.sum("links").alias("links"))


def corpus_counts(found: DataFrame, pairs: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of every linkable pair, and whether it is its B id's highest. At most as many rows as linkable pairs reach the driver."""
    rows = pair_counts(found, len(pairs)).toPandas()
    counts = np.zeros(len(pairs), np.int64)
    counts[rows["pair"].to_numpy()] = rows["links"].to_numpy()
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pairs % n_b, counts)
    return counts, (counts > 0) & (counts == highest[pairs % n_b])


def align_tokenizers(docs: DataFrame, vocabulary_path: str, model_path: str, work: int = WORK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per document.

    n_best counts the links whose pair is the commonest of its B id in the whole corpus, count_sum adds the links' counts.
    """
    spark = docs.sparkSession
    content, model = read_vocabulary(vocabulary_path), read_model(model_path)
    a, b = token_bytes(content), piece_bytes(model)
    pairs = linkable(a, b)
    found = stage(aligned(docs, content, model, pairs, work), "alignments")
    sent = spark.sparkContext.broadcast(corpus_counts(found, pairs, len(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            linked = [np.frombuffer(x, "<i4") for x in batch.column("linked").to_pylist()]
            own = [pa.array([f(p) for p in linked], pa.int64()) for f in (len, lambda p: int(best[p].sum()), lambda p: int(counts[p].sum()))]
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.record_batch([*kept, *own, batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return found.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def read_model(path: str) -> bytes:
    """The SentencePiece model, read once on the driver (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def pair_table(spark: SparkSession, found: DataFrame, pairs: np.ndarray, n_b: int) -> DataFrame:
    """a, b, links: the id pairs linked anywhere in the alignments, with their counts."""
    import pandas as pd

    keys = pd.DataFrame({"pair": np.arange(len(pairs), dtype=np.int32), "a": (pairs // n_b).astype(np.int32), "b": (pairs % n_b).astype(np.int32)})
    return pair_counts(found, len(pairs)).join(spark.createDataFrame(keys, "pair int, a int, b int"), "pair").select("a", "b", "links")
