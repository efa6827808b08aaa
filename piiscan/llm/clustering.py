"""Lloyd clustering with the dimensions dealt to shards, in exact integers.

Vectors are cut into parts of ``PART`` rows, and each part into column blocks of ``BLOCK`` components; a block is one row
of a written table. In a round a block's task computes the block's exact share of every squared distance from its slice
of the centroids. The shares of a part are added by key, and the part takes the nearest centroid of each vector. The
choices go back to the blocks, and every shard sums the vectors of each cluster over its own components and so moves its
own slice. No task holds all components of a vector beside all centroids, a group is one part however large the table
is, and only slices (clusters x components numbers in all) pass through the driver.

A component x counts as floor(scale * x), x as double, at most ``REACH`` either way, which keeps distances in 64 bits.
Vectors that are null, of another length, or that hold a null or non-finite component are left out. Repeated rows and
repeated ids count each; a null id is hashed as an empty one. With fewer vectors than clusters each vector begins one; an
empty table gives no row. Only the id and the vector are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, stage

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Components in a column block, rows in a part: a part's distances to 40 centroids are 320 kB a block.
BLOCK, PART = 16, 1024
REACH = 1 << 27


def usable(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int | None = None) -> DataFrame:
    """id, x (array<double>) of the vectors that take part."""
    frame = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))  # NaN is above all
    return frame.filter(F.col("x").isNotNull() & finite & (F.size("x") == dimensions if dimensions is not None else F.lit(True)))


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * x), -REACH, REACH).astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array<double> column whose rows all have that length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def pack_blocks(points: DataFrame, dimensions: int, scale: int, block: int, part_rows: int) -> DataFrame:
    """part, shard, n, ids (with shard 0 only), data (n x block integers): the column blocks of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            whole = to_integers(matrix(batch.column("x"), dimensions), scale)
            for at in range(0, len(whole), part_rows):
                rows = whole[at : at + part_rows]
                cuts = [np.ascontiguousarray(rows[:, c : c + block]).astype("<i4").tobytes() for c in range(0, dimensions, block)]
                ids = batch.column("id").slice(at, len(rows)).to_pylist()
                yield pa.record_batch(
                    [pa.array([part] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array([len(rows)] * len(cuts), pa.int32()),
                     pa.array([ids, *[None] * (len(cuts) - 1)], pa.list_(pa.int64())), pa.array(cuts, pa.binary())],
                    names=["part", "shard", "n", "ids", "data"],
                )
                part += 1

    return points.mapInArrow(run, "part long, shard int, n int, ids array<long>, data binary")


def block_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances over a block's components; doubles where they hold every number that occurs."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def _narrow(d: np.ndarray) -> bytes:
    return d.astype("<i4" if d.max(initial=0) < 1 << 31 else "<i8").tobytes()


def _wide(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * shape[0] * shape[1] else "<i8").reshape(shape).astype(np.int64)


def assign(blocks: DataFrame, slices: list[np.ndarray]) -> DataFrame:
    """part, cluster and distance (binaries, one number a vector), from the blocks and the centroids' slices."""
    k = len(slices[0])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "data"))):
                x = np.frombuffer(data, "<i4").reshape(n, -1).astype(np.int64)
                out.append(_narrow(block_distances(x, slices[shard])))
            yield pa.record_batch([batch.column("part"), batch.column("n"), pa.array(out, pa.binary())], names=["part", "n", "share"])

    def nearest(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        total = sum(_wide(s, (n, k)) for s in group.column("share").to_pylist())
        cluster = total.argmin(1)  # of equals the first
        best = total[np.arange(n), cluster]
        return pa.table({"part": group.column("part").slice(0, 1), "cluster": pa.array([cluster.astype("<i4").tobytes()], pa.binary()), "distance": pa.array([best.astype("<i8").tobytes()], pa.binary())})

    shared = blocks.select("part", "shard", "n", "data").mapInArrow(shares, "part long, n int, share binary")
    return shared.groupBy("part").applyInArrow(nearest, "part long, cluster binary, distance binary")


def move(blocks: DataFrame, chosen: DataFrame, slices: list[np.ndarray]) -> list[np.ndarray]:
    """Every shard's new slice: componentwise floor(sum / count) of its clusters' vectors; empty clusters stay."""
    k = len(slices[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, n, data, cluster in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "data", "cluster"))):
                x = np.frombuffer(data, "<i4").reshape(n, -1).astype(np.int64)
                own = total.setdefault(shard, np.zeros((k, x.shape[1] + 1), np.int64))  # the last column counts
                np.add.at(own, np.frombuffer(cluster, "<i4"), np.concatenate([x, np.ones((n, 1), np.int64)], axis=1))
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["shard", "sums"])

    def slice_of(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        total = sum(np.frombuffer(s, np.int64).reshape(k, -1) for s in group.column("sums").to_pylist())
        count = total[:, -1:]
        new = np.where(count > 0, total[:, :-1] // np.maximum(count, 1), slices[shard])
        return pa.table({"shard": group.column("shard").slice(0, 1), "slice": pa.array([new.astype("<i8").tobytes()], pa.binary())})

    joined = blocks.select("part", "shard", "n", "data").join(chosen.select("part", "cluster"), "part")
    partial = joined.select("shard", "n", "data", "cluster").mapInArrow(sums, "shard int, sums binary")
    rows = partial.groupBy("shard").applyInArrow(slice_of, "shard int, slice binary").collect()  # all centroids, nothing else
    moved = {r["shard"]: np.frombuffer(r["slice"], "<i8").reshape(k, -1) for r in rows}
    return [moved[s] for s in range(len(slices))]


def first_centroids(points: DataFrame, clusters: int, scale: int, prefix: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; of equal hashes the smaller vector."""
    digest = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = points.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(clusters).collect()
    return to_integers(np.array([r["x"] for r in rows], float), scale)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, scale: int = SCALE, prefix: str = "2:", block: int = BLOCK, part_rows: int = PART,
) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    bound_arrow_batches(spark)
    points = usable(vectors, id_col, vector_col, dimensions)
    schema = "vec_id long, cluster int, distance long"
    blocks = stage(pack_blocks(points, dimensions, scale, block, part_rows), "vector-blocks")
    centroids = first_centroids(points, clusters, scale, prefix)
    if not len(centroids):
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    slices = [centroids[:, c : c + block] for c in range(0, dimensions, block)]
    for _ in range(rounds):
        slices = move(blocks, assign(blocks, slices), slices)
    final = stage(assign(blocks, slices), "assignments")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            join = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in batch.column(c).to_pylist()] or [np.zeros(0, kind)])
            yield pa.record_batch([batch.column("ids").flatten(), pa.array(join("cluster", "<i4"), pa.int32()), pa.array(join("distance", "<i8"), pa.int64())], names=["vec_id", "cluster", "distance"])

    ids = blocks.filter("shard = 0").select("part", "ids")
    rows = ids.join(final, "part").select("ids", "cluster", "distance").mapInArrow(unpack, schema)
    per_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per cluster at most
    texts = [",".join(map(str, c)) for c in np.concatenate(slices, axis=1).tolist()]
    total = sum(r["cluster_inertia"] for r in per_cluster)
    facts = [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(texts[r["cluster"]].encode()).hexdigest()) for r in per_cluster]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
