"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: Up to so many edges (32 MB), counted first, one task is faster than rounds of shuffles.
FEW = 2_000_000


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        while (further := new[new]).tobytes() != new.tobytes():
            new = further
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(np.asarray(x.column("u")), np.asarray(x.column("v"))) for x in batches if x.num_rows]
        if parts:
            nodes, names = united(*(np.concatenate(y) for y in zip(*parts)))
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(names[i : i + 100_000])], ["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """``node, component`` for every node of ``edges``; a component's name is its smallest node.

    At most ``few`` distinct edges are united in one task.  Beyond that, the work is distributed:

    Each round links every node's larger neighbours to its smallest one (large star), then every node's smaller
    neighbours and itself to the smallest (small star), until nothing changes; the number of rounds grows with the
    logarithm of the longest path.  Rounds are checkpointed.  Nulls and loops are ignored.
    """
    now = checkpointed(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    if now.count() <= few:
        return in_one_task(now)
    mark = None
    while True:
        # Large star.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: every edge points from the larger node to the smaller.
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = checkpointed(small.distinct())
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
