"""Embedding near-dedup with a forest of random-projection trees (operator 7).

Equal vectors become one node with a weight. Every tree splits all vectors along random directions, level by level; the
split lies where the projections are sparse, and vectors within the spill margin of it go to both sides, so that a pair at
the threshold is parted with a probability below one in a hundred per level. Within a leaf all pairs are compared by their
cosine in double precision. A pair that meets in several leaves is counted in the first of them, so links are counted
without ever listing pairs; each leaf also gives a spanning forest of its links, and the components follow from those.

A node that random directions cannot part (a cone of close vectors) is compared in pairs of bounded blocks: all links of
such a cone are wanted, so the work is what its links need, but no task holds more than two blocks.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components is linked with nothing.
Vectors are compared with vectors of their own length only. Rows that repeat an id are vectors of their own; component_id
is the smallest id of the component, null only if no id in it is known. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch, read, runs, small_enough
from driftlens.llm.components import connected_components


@dataclass(frozen=True)
class Forest:
    """Vectors link from this cosine on. Leaves of at most `leaf` vectors are compared whole; `reach` sets the spill."""

    cosine: float = 0.95
    trees: int = 4
    leaf: int = 2048
    reach: float = 0.75
    most_spill: float = 0.5
    levels: int = 60

    def margin(self, size: int) -> float:
        """Half the width of the spill: a share of the typical projection of a pair at the threshold."""
        return self.reach * math.sqrt(max(0.0, 2 - 2 * self.cosine)) / math.sqrt(size)


def _unit(column: pa.Array, size: int) -> np.ndarray:
    """Rows of bytes of floats or doubles, all of one length, as unit vectors in double precision."""
    data = b"".join(column.to_pylist())
    kind = np.float32 if len(data) == 4 * size * len(column) else np.float64
    x = np.frombuffer(data, kind).astype(np.float64).reshape(len(column), size)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(kind: type):
    """Usable vectors as bytes of their own type."""

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep, packed = [], []
            for i, cell in enumerate(batch["embedding"].to_pylist()):
                if cell and None not in cell:
                    x = np.array(cell, kind)
                    if np.isfinite(x).all() and x.any():
                        keep.append((i, len(x)))
                        packed.append(x.tobytes())
            out = batch.select(["key", "rep", "w"]).take(pa.array([i for i, _ in keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([n for _, n in keep], pa.int32()), pa.array(packed, pa.binary())], names=["key", "rep", "w", "size", "vec"])

    return pack


def _projected(batches: Iterator[pa.RecordBatch]):
    """Each vector's projection on its node's direction, which is a function of the node's number."""
    for batch in batches:
        node, out = batch["node"].to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
        order = np.argsort(node, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
            size = batch["size"][int(at[0])].as_py()
            direction = np.random.default_rng(int(node[at[0]]) & (2**63 - 1)).standard_normal(size)
            out[at] = _unit(batch["vec"].take(pa.array(at)), size) @ (direction / np.linalg.norm(direction))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("node", "key", "n", "size")), pa.array(out)], names=["node", "key", "n", "size", "p"])


def _splits(forest: Forest):
    """For each node the split with the least spill among its middle quantiles; null where every split spills too much."""

    def choose(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            chosen = []
            for size, quantiles in zip(batch["size"].to_pylist(), batch["q"].to_pylist()):
                q, m = np.array(quantiles), forest.margin(size)
                middles = (q[1:] + q[:-1])[len(q) // 4 : len(q) - len(q) // 4 - 1] / 2
                spill = [np.count_nonzero(np.abs(q - t) <= m) / len(q) for t in middles]
                best = min(range(len(middles)), key=lambda i: (spill[i], abs(i - len(middles) / 2)))
                parts = (q < middles[best] - m).any() and (q > middles[best] + m).any()
                chosen.append(float(middles[best]) if spill[best] <= forest.most_spill and parts else None)
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(chosen, pa.float64()), pa.array([forest.margin(s) for s in batch["size"].to_pylist()], pa.float64())], names=["node", "t", "m"])

    return choose


def grow(vectors: DataFrame, scratch: Scratch, forest: Forest) -> DataFrame:
    """(node, key, n) of all leaves of all trees. Only node and key go from level to level; vectors are joined to be projected."""
    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(forest.trees)), lambda t: F.xxhash64(t, "size")))
    rows, leaves = vectors.select(roots.alias("node"), "key"), None
    for level in range(forest.levels + 1):
        rows = scratch.cut(rows, f"rows-{level}")
        counts = scratch.cut(rows.groupBy("node").agg(F.count("*").alias("n")), f"counts-{level}")
        counted = rows.join(small_enough(counts, 24), "node").select("node", "key", "n")
        last = level == forest.levels or not counts.where(F.col("n") > forest.leaf).limit(1).count()
        done = scratch.cut(counted if last else counted.where(F.col("n") <= forest.leaf), f"leaves-{level}")
        leaves = done if leaves is None else leaves.union(done)
        if level:
            scratch.drop(f"projected-{level - 1}")
        if last:
            return leaves
        projected = counted.where(F.col("n") > forest.leaf).join(vectors.select("key", "size", "vec"), "key")
        projected = scratch.cut(projected.mapInArrow(_projected, "node long, key long, n long, size int, p double"), f"projected-{level}")
        scratch.drop(f"rows-{level}")
        quantiles = F.percentile_approx("p", [i / 40 for i in range(1, 40)], 2000)
        splits = projected.groupBy("node").agg(F.first("size").alias("size"), quantiles.alias("q"))
        splits = scratch.cut(splits.mapInArrow(_splits(forest), "node long, t double, m double"), f"splits-{level}")
        met = projected.join(small_enough(splits, 32), "node")
        leaves = leaves.union(scratch.cut(met.where("t IS NULL").select("node", "key", "n"), f"cones-{level}"))
        sides = F.array(
            F.when(F.col("p") <= F.col("t") + F.col("m"), F.xxhash64("node", F.lit(0))), F.when(F.col("p") >= F.col("t") - F.col("m"), F.xxhash64("node", F.lit(1)))
        )
        rows = met.where("t IS NOT NULL").select(F.explode(F.array_compact(sides)).alias("node"), "key")
    raise AssertionError("unreachable")


def _linked(forest: Forest):
    """Per group of one or two blocks: links counted in their first common leaf, and a spanning forest of all links."""

    def compare(batches: Iterator[pa.RecordBatch]):
        for table in runs(batches, "g"):
            table = table.combine_chunks()
            key, weight = table["key"].to_numpy(), table["w"].to_numpy().astype(np.float64)
            block, node = table["block"].to_numpy(), table["node"][0].as_py()
            x = _unit(table["vec"].combine_chunks(), table["size"][0].as_py())
            across = table["across"][0].as_py()
            earlier = [[v for v in leaves if v < node] for leaves in table["leaves"].to_pylist()]
            column = {v: i for i, v in enumerate(sorted({v for own in earlier for v in own}))}
            member = np.zeros((len(key), max(1, len(column))), np.float32)
            for i, own in enumerate(earlier):
                member[i, [column[v] for v in own]] = 1
            links, label = np.zeros(len(key)), np.arange(len(key))
            for start in range(0, len(key), 512):
                rows = np.arange(start, min(start + 512, len(key)))
                near = x[rows] @ x.T >= forest.cosine
                near[np.arange(len(rows)), rows] = False
                if across:
                    near &= block[rows][:, None] != block[None, :]
                first = near & ((member[rows] @ member.T) == 0)
                links[rows] += first @ weight
                for i in np.flatnonzero(near.any(axis=1)):
                    label = _joined(label, start + i, np.flatnonzero(near[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.rint(links).astype(np.int64)), pa.array(key[label])], names=["key", "links", "root"]
            )

    return compare


def _joined(label: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Labels after one is joined with the others: their classes take the smallest label."""
    labels = np.unique(np.append(label[others], label[one]))
    if len(labels) > 1:
        label = np.where(np.isin(label, labels), labels[0], label)
    return label


def near_vectors(embeddings: DataFrame, forest: Forest = Forest(), scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id) for every row."""
    scratch = scratch or Scratch(embeddings.sparkSession, "vectors")
    rows = embeddings.select("vec_id", "embedding", F.xxhash64("embedding").alias("key"))
    distinct = rows.where("embedding IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("embedding").alias("embedding"))
    kind = np.float32 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    vectors = scratch.cut(distinct.mapInArrow(_pack(kind), "key long, rep long, w long, size int, vec binary"), "distinct")
    leaves = grow(vectors, scratch, forest)
    of = leaves.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("leaves"))
    blocks = F.ceil(F.col("n") / forest.leaf).cast("int")
    placed = leaves.join(of.join(vectors.select("key", "w", "size", "vec"), "key"), "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.select("node", "key", "w", "size", "vec", "leaves", "block", partner.alias("other"))
    group = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    paired = paired.select(group.alias("g"), "node", "key", "w", "size", "vec", "leaves", "block", (F.col("block") != F.col("other")).alias("across"))
    # a block meets itself once, alone; in a group of two blocks only pairs across them are compared
    found = paired.repartition("g").sortWithinPartitions("g").mapInArrow(_linked(forest), "key long, links long, root long")
    found = scratch.cut(found, "found")
    components = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), scratch)
    least = components.join(vectors.select("key", "rep"), F.col("id") == F.col("key")).groupBy("root").agg(F.min("rep").alias("least"))
    components = components.join(least, "root").select("id", "least")
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    summary = vectors.select("key", "rep", "w").join(counted, "key").join(components, F.col("key") == F.col("id"), "left")
    summary = scratch.cut(summary.select("key", (F.col("w") - 1 + F.col("links")).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "summary")
    return rows.select("vec_id", "key").join(small_enough(summary, 32), "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def find_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Query op7_vectors: all embeddings, cosine 0.95."""
    found = near_vectors(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
