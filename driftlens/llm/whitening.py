"""Embedding whitening from exact cross-products of bit slices (operator 12).

Entries become integers on a grid. Each task takes blocks of rows, shifts every dimension by its smallest value in the
block, and packs each bit of each dimension across the rows into 64-bit words, one plane a bit. The AND of two planes has as
many set bits as rows hold both, so popcounts weighted by powers of two are the block's cross-products, without rounding;
the shift is undone in whole numbers. Tasks add up their blocks and emit sums in limbs of 31 bits, which Spark adds as
longs. The driver centres the totals as integers (n times the cross-products less the products of sums) and divides once,
so the covariance is the correctly rounded one at any size of the table. It holds a matrix of dimensions by dimensions,
never rows. Whitening then is one pass over the rows without a shuffle.

Defined results: a vector that is null, empty, or holds null, non-finite or too large entries (2**52 and more) is left out.
Vectors of each length are a table of their own, with their own n and components (the driver holds one matrix a length). A
component without variance cannot be scaled: its whitened value is null, and explained is null if nothing varies. Rows that
repeat an id are rows of their own, null ids stay null. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import read

#: The grid: an entry c becomes floor(SCALE * c) + SHIFT. Fixed values of the operator's contract.
SCALE, SHIFT = 1024, 100000
LARGEST = 2.0**52
COMPONENTS = 8
BLOCK_ROWS, BLOCK_CELLS = 8192, 1 << 20
LIMB, LIMBS = 31, 5
SUMS = "dims int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
#: In place of a dimension: the row of sums and the count.
NONE = -1


def grids(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of usable vectors of one length: row numbers, and entries on the grid (rows by dimensions)."""
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    usable = np.concatenate([[0], np.cumsum(~(np.abs(values) < LARGEST))])  # false for nan as well
    good = (length > 0) & (usable[start + length] == usable[start])
    for dims in np.unique(length[good]).tolist():
        rows = np.flatnonzero(good & (length == dims))
        step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // dims))
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            yield own, np.floor(values[start[own][:, None] + np.arange(dims)] * SCALE).astype(np.int64) + SHIFT


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(dimensions, bits, words): bit b of each value of a dimension, packed across rows into 64-bit words."""
    rows, dims = values.shape
    packed = np.zeros((dims, bits, -(-rows // 64) * 8), np.uint8)
    for b in range(bits):
        packed[:, b, : -(-rows // 8)] = np.packbits(((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
    return packed.view(np.uint64)


def exact_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns, as Python's unbounded integers."""
    rows, dims = x.shape
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64, and so exact: the range is below it
    bits = max(1, int(shifted.max()).bit_length())
    kind = np.int64 if 2 * bits + rows.bit_length() < 62 else object
    weights = np.array([1 << b for b in range(bits)], kind)
    planes = bit_planes(shifted, bits)
    sums, cross = np.zeros(dims, kind), np.zeros((dims, dims), kind)
    for i in range(dims):
        for a in range(bits):
            counts = np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64).astype(kind)
            cross[i, i:] += counts @ weights * weights[a]
            sums[i] += counts[0, a] * weights[a]
        cross[i:, i] = cross[i, i:]
    sums, cross = sums.astype(object), cross.astype(object)
    low = low.astype(object)
    cross += np.multiply.outer(low, sums) + np.multiply.outer(sums, low) + rows * np.multiply.outer(low, low)
    return sums + rows * low, cross


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums for each length of vectors: count (NONE, NONE), sums (NONE, j), cross-products (i, j) with i <= j."""
    totals: dict[int, list] = {}
    for batch in batches:
        for _, x in grids(batch["embedding"]):
            sums, cross = exact_sums(x)
            total = totals.setdefault(x.shape[1], [0, 0, 0])
            totals[x.shape[1]] = [total[0] + len(x), total[1] + sums, total[2] + cross]
    for dims, (count, sums, cross) in totals.items():
        i, j = np.triu_indices(dims)
        for a, b, values in [([NONE], [NONE], [count]), ([NONE] * dims, range(dims), sums.tolist()), (i, j, cross[i, j].tolist())]:
            limbs = [[(v >> (LIMB * k)) & ((1 << LIMB) - 1) for v in values] for k in range(LIMBS - 1)] + [[v >> (LIMB * (LIMBS - 1)) for v in values]]
            columns = [pa.array([dims] * len(values), pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in SUMS.split(", ")])


@dataclass
class Basis:
    """How vectors of one length are whitened: count, exact sums, the components as columns, their eigenvalues and shares."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    scales: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @classmethod
    def of(cls, n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int) -> Basis:
        dims = len(sums)
        covariance, trace = np.zeros((dims, dims)), 0
        for (i, j), value in cross.items():
            centred = n * value - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = centred / n**2  # whole numbers; the division rounds once
            trace += centred if i == j else 0
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        trace = trace / n**2
        varies = values > values[0] * dims * np.finfo(float).eps if trace > 0 else np.zeros(len(values), bool)
        scales = np.where(varies, np.sqrt(np.where(varies, values, 1)), np.nan)
        return cls(n, sums, vectors, scales, [max(0.0, float(v)) / trace if trace > 0 else None for v in values])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """n times the rows less the sums: as doubles divided by n, and the exact sum of their squares."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        away = x - whole
        largest = self.n * (int(np.abs(away).max()) + 1)
        if x.shape[1] * largest**2 < 1 << 62:
            exact = self.n * away - rest
            return exact / self.n, (exact * exact).sum(axis=1).tolist()
        exact = self.n * away.astype(object) - rest.astype(object)
        return away - rest / self.n, (exact * exact).sum(axis=1).tolist()

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / self.scales


def fit(table: DataFrame, components: int = COMPONENTS) -> dict[int, Basis]:
    """For each length of vectors its basis; the identity error is measured on all whitened rows."""
    vectors = table.select("embedding")
    sums = vectors.mapInArrow(_scatter, SUMS).groupBy("dims", "i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for dims, i, j, *limbs in sums.collect():
        found.setdefault(dims, {})[i, j] = sum(v << (LIMB * k) for k, v in enumerate(limbs))
    bases = {}
    for dims, values in found.items():
        own = [values[NONE, j] for j in range(dims)]
        bases[dims] = Basis.of(values[NONE, NONE], own, {k: v for k, v in values.items() if k[0] != NONE}, components)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's sums of whitened values (i is NONE) and of their products."""
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in grids(batch["embedding"]):
                white = np.hstack([np.ones((len(x), 1)), bases[x.shape[1]].whiten(bases[x.shape[1]].centred(x)[0])])
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + white.T @ white
        for dims, total in totals.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims), pa.int32()), pa.array(i - 1, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(total[i, j])], names=["dims", "i", "j", "value"])

    measured: dict[int, dict[tuple[int, int], float]] = {}
    for dims, i, j, value in vectors.mapInArrow(moments, "dims int, i int, j int, value double").groupBy("dims", "i", "j").agg(F.sum("value")).collect():
        measured.setdefault(dims, {})[i, j] = value
    for dims, values in measured.items():
        n, means = bases[dims].n, {j: v / bases[dims].n for (i, j), v in values.items() if i == NONE}
        errors = [abs(v / n - means[i] * means[j] - (i == j)) for (i, j), v in values.items() if i != NONE]
        bases[dims].identity_error = max((e for e in errors if e == e), default=None)
    return bases


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row (WHITENED) for each usable vector and component."""
    bases = fit(table, components)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in grids(batch["embedding"]):
                basis = bases[x.shape[1]]
                centred, deviation = basis.centred(x)
                white = basis.whiten(centred)
                count = white.shape[1]
                squares = [Decimal(v) if v < 10**38 else None for v in deviation]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["vec_id"].take(pa.array(np.repeat(own, count))).cast(pa.int64()),
                        pa.array(np.tile(np.arange(1, count + 1), len(own)), pa.int32()),
                        pa.array(np.full(len(own) * count, basis.n), pa.int64()),
                        pa.array(squares, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(own)), count))),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(basis.explained * len(own), pa.float64()),
                        pa.array([basis.identity_error] * (len(own) * count), pa.float64()),
                    ],
                    names=[c.split(" ")[0] for c in WHITENED.split(", ")],
                )

    return table.select("vec_id", "embedding").mapInArrow(rows, WHITENED)


def whiten_embeddings(spark, sf_dir: str) -> DataFrame:
    """Query op12_whitening: the first components of all vectors. A deviation beyond a long is null there."""
    return whitened(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
