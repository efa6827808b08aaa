"""Near duplicates of documents by probability minhashes of word shingles.

A document's distinct five-word shingles send Poisson arrivals with their weight as rate;
each arrival falls on one of m components, and a component keeps the earliest. An element stops as soon as its
next arrival is later than the latest component (early termination). Two documents agree in a component with
probability equal to their probability Jaccard similarity. All weights are equal, however often a shingle occurs, which
makes that the Jaccard similarity of the sets, the one that is verified. Bands of components give buckets; candidate pairs are
verified by the exact Jaccard similarity of their shingle sets, and connected documents form a class.

Documents with the same words in a row are one node from the start (copies are combined before
anything is shuffled). In a bucket every node is paired with the bucket's smallest node. Buckets whose nodes are
not all in one class after that are settled exactly: prefix filtering finds every pair of their nodes of different
classes that can reach the threshold. So a large group of near copies costs one pair per node and band, and no
link between different texts that share a bucket is lost.

Words are runs of letters, digits and ``_`` after lower-casing. Documents of one to four words have one shingle,
all their words; documents without words (null, empty) are near duplicates of nothing. Only
``doc_id`` and ``text`` are read; repeated rows fall in one class; a null ``doc_id`` counts as the smallest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .common import bound_arrow_batches, carried, restored, stage, whole_text
from .components import link_buckets, pairs_across, with_common

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^6)^24 = 0.9993.
BANDS, ROWS = 24, 6

_WORD = re.compile(r"\w+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_WORD_HASHES: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_WORD_HASHES) > 500_000:  # a cache, emptied when full
        _WORD_HASHES.clear()
    out = []
    for w in words:
        h = _WORD_HASHES.get(w)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            if len(w) <= 64:
                _WORD_HASHES[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def shingles(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(size, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = mix(total + _GOLD) + h[i : i + len(total)]
    return np.unique(mix(total))


def signature(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The element whose arrival is the earliest, for each of m components."""
    earliest, winner = np.full(m, np.inf), np.zeros(m, np.uint64)
    time, active, w = np.zeros(len(elements)), elements, weights
    step = 0
    while len(active):
        many = max(1, -(-6 * m // len(active)))  # arrivals per element and round
        rounds = np.arange(step + 1, step + 1 + many, dtype=np.uint64)
        step += many
        r = mix(active[:, None] + rounds[None, :] * _GOLD)
        t = time[:, None] + np.cumsum(-np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53), axis=1) / w[:, None]
        slot = (mix(r ^ _M2) % np.uint64(m)).astype(np.int64)
        at, s, e = t.ravel(), slot.ravel(), np.repeat(active, many)
        sooner = np.flatnonzero(at < earliest[s])
        order = sooner[np.lexsort((e[sooner], at[sooner]))[::-1]]  # of several, the earliest is written last
        earliest[s[order]], winner[s[order]] = at[order], e[order]
        go_on = t[:, -1] < earliest.max()
        active, time, w = active[go_on], t[go_on, -1], w[go_on]
    return winner


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.arange(1, bands + 1, dtype=np.uint64) * _M1
    for i in range(rows):
        total = mix(total + _GOLD) + sig.reshape(bands, rows)[:, i]
    return mix(total).view(np.int64)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (of the text), node (of its words in a row; null without words), n (shingles), bands."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text.lower())
                if not words:
                    nodes.append(None), sizes.append(0), keys.append([])
                    continue
                elements = shingles(words, size)
                nodes.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                sizes.append(len(elements))
                keys.append(band_keys(signature(elements, np.ones(len(elements)), bands * rows), bands, rows))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "node", "n", "bands"],
            )

    text = whole_text()
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    return frame.mapInArrow(run, "doc_id long, text_key binary, node binary, n int, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node, shingles (array of hashes) of the wanted (text_key, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(_WORD.findall(t.lower()), size).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    text = whole_text()
    found = docs.select(F.unhex(F.md5(text)).alias("text_key"), text.alias("text")).join(small_side(wanted), "text_key")
    return found.groupBy("node").agg(F.min("text").alias("text")).mapInArrow(run, "node binary, shingles array<long>")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)


def node_labels(docs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, label) of the nodes that have a near duplicate other than their own copies."""
    nodes = stage(signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select(F.explode("bands").alias("bucket"), "node", F.col("n").alias("size"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("members")).filter("members > 1").drop("members")
    members = stage(rows.join(shared, "bucket"), "buckets")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("text_key", "node")
    sets = stage(shingle_sets(docs, stage(wanted, "wanted")), "shingles")

    def sizes_fit(a, b):
        return (a("size") >= threshold * b("size")) & (b("size") >= threshold * a("size"))

    return link_buckets(members, lambda pairs: verify(pairs, sets, threshold), sizes_fit, lambda open_: prefix_pairs(open_, sets, threshold))


def prefix_pairs(open_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes with different labels that can reach the threshold, by prefix and place filtering.

    With shingles ordered from the rarest on, two sets of Jaccard similarity t share one among the first
    n - ceil(t n) + 1 of each, and after the first one shared both have enough left for the overlap that t asks. Texts with many
    edits of their own begin with shingles nobody else has, so they meet nothing.
    """
    nodes = open_.select("node", "label").distinct()
    rows = nodes.join(sets, "node").select("node", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("bucket"))
    rows = stage(rows, "open-shingles")
    uses = rows.groupBy("bucket").agg(F.count("*").alias("uses"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("uses", "bucket"))
    prefix = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1
    first = rows.join(uses, "bucket").withColumn("rank", rank).filter((F.col("rank") <= prefix) & (F.col("lo") != F.col("hi")))
    first = stage(with_common(first.select("bucket", "node", "size", "label", "rank")), "prefixes")

    def may_match(a, b):
        overlap = F.ceil(threshold / (1 + threshold) * (a("size") + b("size")) - 1e-9)
        return F.least(a("size") - a("rank"), b("size") - b("rank")) + 1 >= overlap

    return pairs_across(first, may_match)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, class_id (smallest doc_id of the class), class_size; one row per document."""
    signed = stage(sign(docs), "signatures")
    labels = node_labels(docs, signed, threshold)
    per_node = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("keeper"))
    per_node = per_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_node = stage(per_node, "nodes")
    classes = per_node.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.min("keeper").alias("keeper"))
    of_node = per_node.select("node", "label").join(classes, "label").select("node", "class_id", "class_size", "keeper")
    return signed.join(of_node, "node", "left").select(
        "doc_id",
        "text_key",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "keeper",
    )


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, one of each class (the smallest doc_id, of equal ones the smallest text key); all columns."""
    classes = stage(near_classes(docs, threshold), "classes")
    key = F.struct("doc_id", "text_key")
    twins = classes.filter("class_size > 1")
    gone = twins.filter(~key.eqNullSafe(F.col("keeper"))).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    again = twins.filter(key.eqNullSafe(F.col("keeper"))).groupBy("doc_id", "text_key").count().filter("count > 1")
    again = stage(again.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")), "repeated")
    keyed = carried(docs, "doc_id", "text").withColumn("_k", F.unhex(F.md5(whole_text())))
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (keyed["_k"] == F.col("_key"))
    kept = keyed.join(small_side(stage(gone, "gone")), same, "left_anti")
    if again.isEmpty():
        return restored(kept, docs.columns)
    once = kept.join(small_side(again), same, "left_anti")
    one_of = kept.join(small_side(again), same, "left_semi").dropDuplicates(["doc_id", "_k"])
    return restored(once.unionByName(one_of), docs.columns)
