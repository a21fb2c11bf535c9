"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch

#: Edges that one task contracts: bounds its memory. A larger table is cut into more tasks and then needs rounds.
CHUNK = 500_000


def _contracted(batches: Iterator[pa.RecordBatch]):
    """The task's edges as stars: every node with the smallest node that its edges reach."""
    parts = [np.stack([b["v"].to_numpy(zero_copy_only=False), b["u"].to_numpy(zero_copy_only=False)], axis=1) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, places = np.unique(np.concatenate(parts), return_inverse=True)
    parent = list(range(len(nodes)))  # nodes are sorted, so a smaller place is a smaller node
    for x, y in places.reshape(-1, 2).tolist():
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # parents come first, so one step is enough
        parent[x] = parent[parent[x]]
    root = nodes[np.array(parent)]
    keep = root != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["v", "u"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", chunk: int = CHUNK) -> DataFrame:
    """(id, root) for every node of the edges (a, b); root is the smallest id that can be reached.

    Edges are contracted in chunks of bounded size, each to stars within it. If one chunk holds them all, that is the answer.
    Else rounds of alternating star contraction follow: every node passes its smallest neighbour to its larger neighbours,
    then its smaller neighbours point to the smallest of them, until nothing changes; they grow with the logarithm of the
    longest path. Each round is one written table; the minimum of a hub is a map-side aggregate and its join is one that
    adaptive execution can split. Self edges and repeated edges are allowed, edges with a null end are left out.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current, level = scratch.cut(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")), f"{name}-0"), 0
    seen = None
    while True:
        chunks = -(-current.count() // chunk)
        dealt = current.coalesce(1) if chunks <= 1 else current.repartition(chunks)
        level += 1
        current = scratch.cut(dealt.mapInArrow(_contracted, "v long, u long"), f"{name}-{level}")
        scratch.drop(f"{name}-{level - 1}")
        if chunks <= 1:
            break
        both = current.union(current.select("u", "v"))
        least = both.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("u > v").join(least, F.col("v") == F.col("n")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = scratch.cut(large, f"{name}-{level}l")
        least = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        small = large.join(least, F.col("v") == F.col("n"))
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(least.select("n", "m")).distinct()
        level += 1
        current = scratch.cut(small, f"{name}-{level}")
        scratch.drop(f"{name}-{level - 1}")
        scratch.drop(f"{name}-{level - 1}l")
        state = _state(current)
        if state == seen:
            break
        seen = state
    roots = current.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return scratch.cut(current.select(F.col("v").alias("id"), F.col("u").alias("root")).union(roots), name)


def _state(frame: DataFrame) -> tuple:
    """Number and hash sum of the rows: equal for equal tables."""
    return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
