"""Exact top-k search by inner product, by MaxScore over sharded postings.

A vector is a bag of signed terms: component d of value v is in posting (d, sign of v). A query's component q_d meets
posting (d, sign of q_d) with gains, at most |q_d| times the posting's largest value (the term's bound), and posting
(d, other sign) with losses, whose bound is 0. With a threshold (the k-th best score so far) MaxScore splits the gain terms: the
weakest ones, whose bounds add up to less than the threshold, are non-essential, for a vector found in none of the
others can't reach it. The postings of the essential components are traversed into partial scores; then
the others, strongest first, are probed for those vectors that stay competitive, i.e. whose partial score and
remaining bounds reach the threshold. What is left has its exact score. Vectors equal to the threshold go on, so ties are
settled by id. A threshold begins with the exact scores of the vectors at the head of the query's strongest postings.

Candidates are cut into shards of ``SHARD_ROWS`` rows, queries into blocks of ``QUERY_ROWS``; every block meets every shard once, and the best k of
each query in a group's shards are merged by rank. Groups have at most ``HELD_SHARDS`` shards; each block is moved once to every group, shards are moved once.
No vector is broadcast, and a task holds one group's indexes and one block.

A component x counts as floor(scale * x), x as double, at most ``REACH`` either way. Vectors that are null or hold a null or
non-finite component take no part. A shorter vector counts as filled up with zeros. Repeated rows and ids are rows of their own (a
query's own row is left out, its copies aren't); null ids are no queries, and as candidates come first among equals. Fewer
candidates than k give fewer ranks; an empty table gives no row. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import to_integers, usable
from .common import bound_arrow_batches, stage

K, SCALE = 20, 64
SHARD_ROWS, QUERY_ROWS = 4096, 512
#: Strongest terms whose first vectors give the first threshold, and how many of each.
SEED_TERMS, SEED_ROWS = 6, 32
#: Terms probed before the competitive vectors are counted again.
PROBE = 8
#: Shards in a group, whose indexes a worker keeps at once (about 6 MB each with 64 components).
HELD_SHARDS = 24


def pack_rows(points: DataFrame, rows: int, scale: int) -> DataFrame:
    """part, dim, keys (of the rows), ids, data (rows x dim integers): the points in parts of that many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() << 32, []

        def packed(take: list[tuple[int, int | None, np.ndarray]]) -> pa.RecordBatch:
            nonlocal part
            dim = max(len(x) for _, _, x in take)
            data = np.zeros((len(take), dim), "<i4")
            for i, (_, _, x) in enumerate(take):
                data[i, : len(x)] = x
            part += 1
            return pa.record_batch(
                [pa.array([part - 1], pa.int64()), pa.array([dim], pa.int32()), pa.array([[t[0] for t in take]], pa.list_(pa.int64())),
                 pa.array([[t[1] for t in take]], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())],
                names=["part", "dim", "keys", "ids", "data"],
            )

        for batch in batches:
            flat = to_integers(batch.column("x").flatten().to_numpy(zero_copy_only=False), scale)
            ends = np.cumsum(batch.column("x").value_lengths().to_numpy(zero_copy_only=False))
            held += zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), np.split(flat, ends[:-1]))
            while len(held) >= rows:
                yield packed(held[:rows])
                held = held[rows:]
        if held:
            yield packed(held)

    return points.select("key", "id", "x").mapInArrow(run, "part long, dim int, keys array<long>, ids array<long>, data binary")


class Shard:
    """Postings of one shard's vectors. Nearly all vectors have nearly all terms, so the two postings of a component
    are kept as one row of signed values, one a vector: gains and losses of a query are then both in it."""

    def __init__(self, keys: list[int], ids: list[int | None], values: np.ndarray):
        # ids stand in order, so that of equal scores the first is the one wanted
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0)), np.int64)
        self.keys = np.array(keys, np.int64)[order]
        self.known = np.array([ids[i] is not None for i in order], bool)
        self.ids = np.array([ids[i] or 0 for i in order], np.int64)
        self.vectors = values[order].astype(np.int64)
        both = np.stack([self.vectors.T, -self.vectors.T])  # by sign, component, vector
        self.top = np.maximum(both.max(axis=2, initial=0), 0)
        heads = min(SEED_ROWS, len(ids))
        self.heads = np.argpartition(-both, heads - 1, axis=2)[:, :, :heads]
        self.kinds: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def numbers(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Postings and vectors in a kind of number that holds every score."""
        if kind not in self.kinds:
            self.kinds[kind] = (np.ascontiguousarray(self.vectors.T.astype(kind)), self.vectors.astype(kind))
        return self.kinds[kind]

    def search(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors but the one with key own, in order; of those that reach least, if it is given."""
        q = query[: self.vectors.shape[1]]
        held = np.flatnonzero(q)
        sign = (q[held] < 0).astype(np.int64)
        bounds = np.abs(q[held]) * self.top[sign, held]
        order = np.argsort(-bounds, kind="stable")
        held, sign, bounds = held[order], sign[order], bounds[order]
        size = int(np.abs(q).sum()) * int(self.top.max(initial=0))
        kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64
        postings, vectors = self.numbers(kind)
        weight = q.astype(kind)

        seeds = np.unique(self.heads[sign[:SEED_TERMS], held[:SEED_TERMS]])
        seeds = seeds[self.keys[seeds] != own]
        threshold = -np.inf if least is None else least
        if len(seeds) >= k:
            threshold = max(threshold, np.partition(vectors[seeds, : len(q)] @ weight, len(seeds) - k)[len(seeds) - k])
        # rest: what a term and all weaker ones can add; essential are the terms before it falls below the threshold
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        split = int(np.argmax(rest < threshold)) if threshold > 0 else len(held)

        partial = weight[held[:split]] @ postings[held[:split]] if split else np.zeros(len(self.keys), kind)
        found = np.flatnonzero(partial + float(rest[split]) >= threshold)
        partial = partial[found]
        for at in range(split, len(held), PROBE):
            components = held[at : at + PROBE]
            partial = partial + vectors[found[:, None], components] @ weight[components]
            stay = partial + float(rest[at + len(components)]) >= threshold
            found, partial = found[stay], partial[stay]
        other = self.keys[found] != own
        found, partial = found[other], partial[other]
        if len(found) > k:  # all that reach the k-th score; of equals the first ones are kept below
            stay = partial >= np.partition(partial, len(partial) - k)[len(partial) - k]
            found, partial = found[stay], partial[stay]
        best = np.argsort(-partial, kind="stable")[:k]
        return found[best], partial[best].astype(np.int64)


def deal(shards: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """part, kind, dim, keys, ids, data by group: each shard (kind 0) in one group, then each block of queries (kind 1) in every one."""
    columns = ["dim", "keys", "ids", "data", "part"]
    # parts are numbered by the task that wrote them, so they are numbered anew to fill groups evenly
    place = F.row_number().over(Window.orderBy("part")) - 1
    numbers = shards.select("part").withColumn("group", (place % groups).cast("int"))  # one row a shard, no vectors
    grouped = shards.join(F.broadcast(numbers), "part").select("group", F.lit(0).alias("kind"), *columns)
    dealt = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), *columns)
    rows = grouped.unionByName(dealt)
    return rows.repartitionByRange(groups, "group").sortWithinPartitions("group", "kind", "part")


def search_groups(rows: DataFrame, k: int) -> DataFrame:
    """query (key of its row), query_id, vec_id, score: the k best of each query in each group of shards, from groups' shards, then blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, indexes = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row] for c in batch.schema.names}
                if r["group"].as_py() != now:
                    now, indexes = r["group"].as_py(), []
                keys, ids = r["keys"].as_py(), r["ids"].as_py()
                values = np.frombuffer(r["data"].as_py(), "<i4").reshape(len(keys), r["dim"].as_py())
                if r["kind"].as_py() == 0:
                    indexes.append(Shard(keys, ids, values))
                    continue
                out = [best_of(indexes, q, key, k) for q, key in zip(values.astype(np.int64), keys)]
                many = [len(scores) for _, _, scores in out]
                known, vec_ids, scores = (np.concatenate(c) for c in zip(*out))
                yield pa.record_batch(
                    [pa.array(np.repeat(np.array(keys, np.int64), many)), pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(vec_ids, mask=~known), pa.array(scores)],
                    names=["query", "query_id", "vec_id", "score"],
                )

    return rows.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def best_of(indexes: list[Shard], query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known ids or not, ids and scores of the k best vectors of all shards but the one with key own; of equal scores null ids come first, then smaller ones.

    The k-th best score so far is where the next shard's threshold begins.
    """
    known, ids, scores = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for shard in indexes:
        places, more = shard.search(query, own, k, int(scores[-1]) if len(scores) >= k else None)
        if len(places):
            known, ids, scores = np.append(known, shard.known[places]), np.append(ids, shard.ids[places]), np.append(scores, more)
            best = np.lexsort((ids, known, -scores))[:k]
            known, ids, scores = known[best], ids[best], scores[best]
    return known, ids, scores


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE,
           shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for every row that is_query (of column ``id``) picks."""
    bound_arrow_batches(vectors.sparkSession)
    points = stage(usable(vectors, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()), "vectors")
    shards = stage(pack_rows(points, shard_rows, scale), "shards")
    blocks = stage(pack_rows(points.filter(F.col("id").isNotNull() & is_query), query_rows, scale), "query-blocks")
    # as few groups as keep all cores busy and their indexes in memory: blocks are moved to every group
    n = shards.count()
    groups = max(-(-n // HELD_SHARDS), min(n, 2 * vectors.sparkSession.sparkContext.defaultParallelism), 1)
    best = search_groups(deal(shards, blocks, groups), k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
