"""Connected components of a distributed graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60
#: Neighbours that make a node a hub, and most hubs (16 bytes each) that are sent to every task.
HUB, MAX_SENT_HUBS = 1000, 2_000_000


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each of 0..n-1 over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _with_smallest(edges: DataFrame, best: DataFrame) -> DataFrame:
    """``a, b, m``: the edges with the smallest neighbour of ``a``."""
    hubs = best.filter(F.col("n") > HUB).select("a", "m")
    if not 0 < hubs.count() <= MAX_SENT_HUBS:
        return edges.join(best, "a").select("a", "b", "m")
    own = edges.join(F.broadcast(hubs), "a", "left")
    rest = own.filter("m is null").drop("m").join(best.select("a", "m"), "a")
    return own.filter("m is not null").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` from ``a, b`` (longs): the smallest node reachable, for every node that has a link.

    Alternating large and small stars: every round hangs each node under the smallest of its
    neighbours, first those above it, then those below. A hub is never gathered: its smallest
    neighbour comes from a pre-aggregated minimum, which is sent to the tasks (their number is counted), so its
    edges stay where they are; the other nodes' is joined in a shuffle. Each round is written to the
    shared folder, so lost executors cost one round at most.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = materialize(edges.filter("a != b").select(high.alias("a"), low.alias("b")).distinct(), "stars")
    before = None
    for _ in range(MAX_ROUNDS):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        best = materialize(best.select("a", F.least("a", "m").alias("m"), "n"), "smallest")
        large = _with_smallest(both.filter("b > a"), best).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        best = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(best, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                             F.col("m").alias("b")).filter("a != b").distinct()
        stars = materialize(small, "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
