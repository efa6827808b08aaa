"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

A token sequence is what BPE gives for a text exactly when every neighbouring pair is compatible: merging
the two token texts from bytes never joins across their border. So each prefix of a pre-token has one last
token: the vocabulary entry that ends there and is compatible with the last token of the prefix before it.
Matches come from an Aho-Corasick automaton (suffix links over the vocabulary), the last tokens are stored
per prefix, and back-pointers give the ids. No merge loop runs over the text.

Texts are whole; null counts as empty; an empty text has no ids. Repeated rows are encoded each. Only
``doc_id`` and ``text`` are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, whole_text

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept per worker; a full table is emptied and refilled. Results don't depend on it.
CACHE_ENTRIES = 600_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> str:
    """The tokenizer file's content, read once on the driver; 50,000 entries are 1.6 MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Vocabulary:
    """Token bytes, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters = byte_letters()
        model = data["model"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in self.added}
        ids = {t: i for t, i in model["vocab"].items()}
        self.parts: dict[int, tuple[int, int]] = {}  # of a merged token
        self.rank: dict[int, int] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = ids[left], ids[right], ids[left + right]
            self.pair_rank.setdefault((a, b), rank)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (a, b), rank
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}  # two lists a token at most
        self.text = dict(self.bytes) | {i: t.encode() for t, i in self.added.items()}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one edge of a token as it is built from bytes: (token, rank of the merge that takes it in)."""
        known = self.edges.get((token, side))
        if known is None:
            known = [(token, NEVER)]
            at = token
            while at in self.parts:
                taken, at = self.rank[at], self.parts[at][side]
                known.append((at, taken))
            known.reverse()
            self.edges[token, side] = known
        return known

    def joins(self, left: int, right: int) -> int:
        """Rank of the merge that joins across the border of two tokens, NEVER if none does."""
        ls, rs = self.edge(left, 1), self.edge(right, 0)
        i = k = 0
        while True:
            (a, until_a), (b, until_b) = ls[i], rs[k]
            joined = self.pair_rank.get((a, b), NEVER)
            # of equal merges the leftmost goes first: a's own before the border, the border before b's own
            if joined < until_a and joined <= until_b and joined < NEVER:
                return joined
            if until_a == until_b == NEVER:
                return NEVER
            if until_a <= until_b:
                i += 1
            else:
                k += 1

    def reachable(self) -> list[int]:
        """Tokens that their own bytes encode to."""
        good = []
        for token in self.bytes:
            parts = self.parts.get(token)
            if parts is None or self.joins(*parts) == self.rank[token]:
                good.append(token)
        return good


class Encoder:
    """Encodes texts; one per Python worker."""

    def __init__(self, content: str):
        import ahocorasick
        import regex

        self.vocabulary = v = Vocabulary(content)
        self.automaton = ahocorasick.Automaton()
        for token in v.reachable():
            t = v.bytes[token]
            self.automaton.add_word(t.decode("latin-1"), (token, len(t)))
        self.automaton.make_automaton()
        self.find = regex.compile(SPLIT).findall
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(v.added, key=len, reverse=True)) + ")") if v.added else None
        self.compatible: dict[int, bool] = {}
        self.cache = _Cache(self)

    def pair(self, left: int, right: int) -> bool:
        if len(self.compatible) > CACHE_ENTRIES:
            self.compatible.clear()
        known = self.compatible[left << 32 | right] = self.vocabulary.joins(left, right) == NEVER
        return known

    def pretoken(self, piece: str) -> list[int]:
        """Ids of one pre-token: the last token of every prefix, then the back-pointers."""
        data = piece.encode()
        n = len(data)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        compatible, pair = self.compatible, self.pair
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if size[end]:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = compatible.get(before << 32 | token)
                if fits is None:
                    fits = pair(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        get = self.cache.__getitem__
        if not any(t in text for t in self.vocabulary.added):
            return b"".join(map(get, self.find(text)))
        out = []
        for part in self.split_added.split(text):
            added = self.vocabulary.added.get(part)
            out.append(np.uint32(added).tobytes() if added is not None else b"".join(map(get, self.find(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids, added tokens included; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Cache(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.pretoken(piece), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(content: str) -> Encoder:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded text; one narrow stage, nothing is shuffled."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    content = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(content.value)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([encoder.decode(i) for i in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return frame.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
