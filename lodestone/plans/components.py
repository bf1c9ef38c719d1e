"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.materialize import cut, release

#: Edges that one task contracts at a time, which bounds its memory.
FOREST_EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over runs of edges: each node with its root, so that at most one edge per node goes on."""
    held: list[np.ndarray] = []
    count = 0

    def contracted() -> pa.RecordBatch:
        edges = np.concatenate(held)
        names, flat = np.unique(edges, return_inverse=True)
        flat = flat.reshape(edges.shape)
        parent = list(range(len(names)))
        for x, y in flat.tolist():
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x < y:
                parent[y] = x
            elif y < x:
                parent[x] = y
        for i, p in enumerate(parent):  # a root is the smallest of its set, so parents come first
            parent[i] = parent[p]
        roots = names[np.array(parent, np.int64)]
        keep = roots != names
        return pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(roots[keep])], names=["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
        count += len(held[-1])
        if count >= FOREST_EDGES:
            yield contracted()
            held, count = [], 0
    if count:
        yield contracted()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of the edges; component is the smallest node that can be reached.

    Each task first contracts its edges by union-find; alternating large-star and small-star steps then join
    what different tasks found, in a number of rounds that grows with the logarithm of a component's size.  A
    node with very many neighbours is aggregated before it is shuffled and joined back, never gathered.  Nulls
    and loops make no edge.
    """
    clean = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    current = cut(clean.mapInArrow(_forest, "u long, v long"), "forest")
    state = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = cut(small, "stars")
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(current)
        current = following
        if seen == state or not seen[0]:
            break
        state = seen
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
