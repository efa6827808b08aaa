"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: Whether two nodes can be linked, from two functions that give their columns by name.
MayMatch = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]

def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); the label is the smallest node of its component.

    A round lowers each label to the smallest of its neighbours' labels and then to its label's label, so
    long chains shrink geometrically. Every round is one written table; minima are combined before
    they are shuffled, and joins on a hot node are plain equi-joins that the planner can split. Self-loops
    and repeated edges are harmless; no edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("offer")), "b").groupBy("a").agg(F.min("offer").alias("offer"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        low = stage(low, "labels")
        up = low.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = stage(low.join(up, "label").select("node", "was", F.least("label", "jump").alias("label")), "labels")
        if new.filter("was != label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


#: Nodes of a mixed bucket's commonest class that its other nodes meet, before all that is left is settled.
CENTRES = 4
#: Slices of pairs verified one after the other, from that many pairs on.
SLICES, MANY_PAIRS = 4, 1_000_000
#: Members of buckets from which on buckets are told mixed or not in slices.
MANY_MEMBERS = 3_000_000


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's centre with its other nodes."""
    return members.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()


def link_buckets(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    may_match: MayMatch,
    cross_pairs: Callable[[DataFrame], DataFrame],
    stars: Callable[[DataFrame], DataFrame] = star_pairs,
) -> DataFrame:
    """(node, label) of the nodes linked to another one.

    members: (bucket, node, centre, and what may_match and cross_pairs read), the centre being the bucket's smallest node. ``verify`` takes
    pairs (a, b) and returns the true links among them; ``may_match`` and ``stars`` leave out pairs that can't be links.

    Every node is first paired with its centre, one pair per node and bucket however large the bucket. In buckets that are
    not all of one component after that, the nodes outside the commonest component are paired with a few nodes inside it, so that
    large groups without a middle grow together. What is still mixed goes, with the labels so far, to
    ``cross_pairs``: (bucket, node, ..., label, common) to all pairs of different components that may be links. Links inside a
    component would not change it.
    """
    tried = stage(stars(members), "pairs")
    links = stage(verify(tried).select("a", "b"), "links")
    labels = connected(links)
    open_ = mixed_buckets(members, labels)
    again = ordered_pairs(centre_pairs(open_, may_match)).join(tried, ["a", "b"], "left_anti")
    again = stage(again, "pairs")
    if not again.isEmpty():
        tried = tried.union(again)
        links = stage(links.union(verify(again).select("a", "b")), "links")
        labels = connected(links)
        unstage(open_)
        open_ = mixed_buckets(members, labels)
    rest = stage(ordered_pairs(cross_pairs(open_)).join(tried, ["a", "b"], "left_anti"), "pairs")
    unstage(open_)
    more = verified(rest, verify)
    return labels if more.isEmpty() else connected(links.union(more))


def verified(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The true links among staged pairs. Many are verified in slices, so that what one slice was joined with is gone before the next."""
    n = SLICES if pairs.count() > MANY_PAIRS else 1
    return reduce(DataFrame.union, [stage(verify(pairs.filter(F.pmod(F.xxhash64("a"), F.lit(n)) == k)).select("a", "b"), "links") for k in range(n)])


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members with their label and common (the bucket's commonest label), of the buckets with several labels. Many members
    are placed in slices of buckets, so that what one slice was joined with is gone before the next."""
    n = SLICES if members.count() > MANY_MEMBERS else 1
    slices = [members.filter(F.pmod(F.xxhash64("bucket", F.lit(2)), F.lit(n)) == k) for k in range(n)]
    placed = [some.drop("centre").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")) for some in slices]
    return reduce(DataFrame.union, [stage(with_common(some), "mixed") for some in placed])


def with_common(rows: DataFrame) -> DataFrame:
    """The rows (bucket, label, ...) of buckets with several labels, with the commonest one."""
    counts = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    common = counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.count("*").alias("labels"))
    return rows.join(common.filter("labels > 1").drop("labels"), "bucket")


def centre_pairs(open_: DataFrame, may_match: MayMatch) -> DataFrame:
    """Pairs (a, b) of the nodes outside a bucket's commonest component with a few of those inside, picked by hash."""
    facts = F.struct(*[c for c in open_.columns if c not in ("bucket", "label", "common")])
    picks = F.array_distinct(F.array(*[F.min_by(facts, F.xxhash64("node", F.lit(k))) for k in range(CENTRES)]))
    centres = open_.filter("label = common").groupBy("bucket").agg(picks.alias("centres"))
    met = open_.filter("label != common").select("bucket", facts.alias("b")).join(centres, "bucket").select(F.explode("centres").alias("a"), "b")
    of = lambda s: lambda c: F.col(f"{s}.{c}")
    return met.filter(may_match(of("a"), of("b"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def pairs_across(rows: DataFrame, may_match: MayMatch) -> DataFrame:
    """Pairs (a, b) of rows (bucket, node, label, common, and what may_match reads) that share a bucket and differ in label.

    One side leaves out each bucket's commonest label, so a large component isn't paired with itself.
    """
    side = lambda s: rows.select("bucket", *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c != "bucket"])
    one, two = side("a").filter("a_label != a_common"), side("b")
    of = lambda s: lambda c: F.col(f"{s}_{c}")
    # two nodes outside the commonest label meet twice otherwise
    once = (F.col("b_label") == F.col("b_common")) | (F.col("a_node") < F.col("b_node"))
    met = one.join(two, "bucket").filter((F.col("a_label") != F.col("b_label")) & once & may_match(of("a"), of("b")))
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
