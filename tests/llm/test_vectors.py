import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from piiscan.llm import clustering, topk

ROW = "vec_id long, embedding array<double>, label int, part string, shard string, data string, key string, id string, x string, group string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, *["x"] * 7) for i, v in rows], ROW).repartition(3)


def floors(v, scale):
    return [math.floor(scale * x) for x in v]


def lloyd(rows, dims, clusters, rounds, scale):
    """Plain Lloyd rounds in Python integers."""
    kept = [(i, floors(v, scale)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cent = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cent))
    for _ in range(rounds):
        own = [[] for _ in cent]
        for _, v in kept:
            own[near(v)[1]].append(v)
        cent = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, cent)]
    rows = [(i, *near(v)[::-1]) for i, v in kept]
    per = {k: sum(r[2] for r in rows if r[1] == k) for k in range(len(cent))}
    return sorted((((i is not None, i or 0), k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, cent[k])).encode()).hexdigest()) for i, k, d in rows))


def collected(out):
    return sorted((((r[0] is not None, r[0] or 0), *r[1:]) for r in out.collect()))


BAD = [(500, None), (501, []), (502, [1.0] * 5), (503, [None] + [1.0] * 5), (504, [math.nan] + [1.0] * 5), (505, [-math.inf] + [1.0] * 5)]


@pytest.mark.parametrize("block,part", [(2, 7), (4, 1024), (6, 1)])
def test_clusters_by_brute_force(spark, block, part):
    """Ties, repeated ids and rows, null ids, vectors left out, clashing columns; any cut into shards and parts."""
    r = random.Random(5)
    rows = [(i, [r.choice([-1, 0, 0.5, 1]) + r.random() * 0.01 for _ in range(6)]) for i in range(90)]
    rows += rows[:5] + [(7, [0.25] * 6), (None, [0.5] * 6), (None, [0.5] * 6)] + BAD
    got = clustering.cluster_vectors(frame(spark, rows), dimensions=6, clusters=8, rounds=3, block=block, part_rows=part)
    assert collected(got) == lloyd(rows, 6, 8, 3, clustering.SCALE)


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-4.0, 1.0])]
    got = clustering.cluster_vectors(frame(spark, rows), dimensions=2)
    assert collected(got) == lloyd(rows, 2, 40, 5, clustering.SCALE)
    for none in ([], BAD):
        assert clustering.cluster_vectors(frame(spark, none).limit(len(none)), dimensions=3).collect() == []


def test_distances_are_exact_at_any_size(spark):
    rows = [(i, [x, -x]) for i, x in enumerate([3e38, 5e5, 1e5 + 0.001, -3e38, 0.0])]
    got = {r["vec_id"]: r for r in clustering.cluster_vectors(frame(spark, rows), dimensions=2, clusters=2, rounds=1).collect()}
    assert len(got) == 5 and all(0 <= r["distance"] <= 8 * clustering.REACH**2 for r in got.values())
    x = np.array([[clustering.REACH, -clustering.REACH], [3, 4]], np.int64)
    assert clustering.block_distances(x, -x[:1]).tolist() == [[8 * clustering.REACH**2], [(clustering.REACH + 3) ** 2 + (4 - clustering.REACH) ** 2]]


def by_all_products(rows, k, scale):
    kept = [(n, i, floors(v, scale)) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in kept:
        if i is not None and i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j is not None, j or 0) for m, j, v in kept if m != n)[:k]
            out += [(i, rank + 1, j if known else None, -s) for rank, (s, known, j) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block,k", [(16, 3, 4), (4096, 512, 20), (50, 1, 20)])
def test_topk_by_all_products(spark, shard, block, k):
    """Ties, zeros, negative scores, copies, null ids, short vectors, vectors left out."""
    r = random.Random(shard)
    rows = [(i, [r.gauss(0, 0.3) if r.random() < 0.7 else 0.0 for _ in range(12)]) for i in range(300)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (1000, [0.0] * 12), (1020, [-0.5] * 12), (None, [0.3] * 12), (1001, [0.5, 0.5]), (1040, [0.5, -0.5, 1.0]), (1060, [])]
    rows += [(i, rows[40][1]) for i in (700, 701, 702)] + [(i + 480, v) for i, v in BAD]
    got = topk.search(frame(spark, rows), F.col("id") % 20 == 0, k=k, shard_rows=shard, query_rows=block)
    assert sorted([tuple(r) for r in got.collect()], key=str) == by_all_products(rows, k, topk.SCALE)


def test_topk_edges(spark):
    pick = F.col("id") % 20 == 0
    assert topk.search(frame(spark, [(1, [1.0])]).limit(0), pick).collect() == []
    assert topk.search(frame(spark, [(20, [1.0])]), pick).collect() == []  # its own row is no candidate
    assert topk.search(frame(spark, [(1, [1.0]), (None, [1.0])]), pick).collect() == []  # no query
    big = [(20, [3e38, 1.0]), (1, [1e6, -1e6]), (2, [-3e38, 2.0]), (3, [1e9, 0.0])]
    reach = clustering.REACH
    assert [tuple(r)[1:] for r in topk.search(frame(spark, big), pick).orderBy("rank").collect()] == [
        (1, 3, reach * reach), (2, 1, reach * 64 * 10**6 - 64 * 64 * 10**6), (3, 2, 64 * 128 - reach * reach)]


def test_maxscore_skips_weak_vectors():
    """A query of few terms leaves vectors without an essential term alone, and still ranks exactly."""
    r = np.random.default_rng(1)
    values = np.where(r.random((500, 30)) < 0.1, r.integers(-50, 50, (500, 30)), 0)
    shard = topk.Shard(list(range(500)), list(range(500)), values)
    for q in r.integers(-50, 50, (20, 30)) * (r.random((20, 30)) < 0.3):
        places, scores = shard.search(q, -1, 5)
        want = np.lexsort((np.arange(500), -(values @ q)))[:5]
        assert places.tolist() == want.tolist() and scores.tolist() == (values @ q)[want].tolist()


def test_blocks_are_moved_to_groups_not_broadcast(spark, monkeypatch):
    """Queries times shards of vectors never pass through the driver: each block is shuffled to a few groups, each shard to one."""
    r = np.random.default_rng(8)
    rows = [(k, r.normal(0, 1, 8).tolist()) for k in range(600)]
    monkeypatch.setattr(topk, "HELD_SHARDS", 2)
    taken = []
    monkeypatch.setattr(topk, "search_groups", lambda dealt, k, real=topk.search_groups: taken.append(dealt) or real(dealt, k))
    got = topk.search(frame(spark, rows), F.col("id") % 20 == 0, k=7, shard_rows=10, query_rows=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "explode" not in "".join(x for x in plan.split("\n") if "Broadcast" in x)
    dealt = taken[0].select("group", "kind", "part", F.spark_partition_id().alias("task")).collect()
    shards, blocks = [x for x in dealt if x["kind"] == 0], [x for x in dealt if x["kind"] == 1]
    groups = {x["group"] for x in dealt}
    assert len(shards) == len({x["part"] for x in shards}) >= 60 and len({x["part"] for x in blocks}) >= 8
    assert len(groups) == -(-len(shards) // 2) and len(blocks) == len(groups) * len({x["part"] for x in blocks})
    assert max(Counter(x["group"] for x in shards).values()) <= 2
    assert sorted([tuple(x) for x in got.collect()], key=str) == by_all_products(rows, 7, topk.SCALE)


def test_threshold_passes_from_shard_to_shard():
    """A shard's search returns all that reach the score given, ties included, and the merged best are those of all shards."""
    values = np.array([[3], [5], [5], [2], [5], [4]])
    shards = [topk.Shard([0, 1, 2], [7, None, 9], values[:3]), topk.Shard([3, 4, 5], [1, 2, 3], values[3:])]
    places, scores = shards[1].search(np.array([1]), -1, 2, 5)
    assert shards[1].ids[places].tolist() == [2] and scores.tolist() == [5]
    known, ids, scores = topk.best_of(shards, np.array([1]), -1, 3)
    assert known.tolist() == [False, True, True] and ids.tolist() == [0, 2, 9] and scores.tolist() == [5, 5, 5]
