"""Connected components in Spark and, for what one task holds, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b: any ordered type) to (node, root): root is the smallest node of the component.

    Alternating large-star and small-star steps: every step replaces edges by edges to a local
    minimum, so no step makes more rows than it reads, and O(log n) steps suffice.  Each step is written to the
    shared folder, which cuts its lineage.  Nodes without an edge to another are not returned.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        sym = both(e)
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return sym.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        # every edge leads from the larger node to the smaller one here
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b")))

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = state(now)
    while seen[0]:
        step = scratch.keep(small(large(now).distinct()).distinct())
        reached = state(step)
        scratch.drop(now)
        now = step
        if reached == seen:
            break
        seen = reached
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
