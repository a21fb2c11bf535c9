import math

import numpy as np
import pytest

from driftlens.llm import whitening
from driftlens.llm.whitening import exact_sums, whitened

SCHEMA = "vec_id long, embedding array<double>, label int, component string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA).repartition(3)


def brute_force(vectors):
    """Plain sums of whole numbers, and numpy's decomposition of the covariance."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dims)]
    cross = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(dims)] for i in range(dims)]
    values, basis = np.linalg.eigh(np.array([[c / n**2 for c in row] for row in cross]))
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(dims)) for r in x]
    centred = np.array([[(n * r[j] - s[j]) / n for j in range(dims)] for r in x])
    return n, deviation, centred @ basis[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / sum(cross[j][j] for j in range(dims)) * n**2


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_equals_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    points = (rng.standard_normal((700, 12)) * np.linspace(1, 3, 12) + rng.standard_normal(12) * 5) * scale
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900 + i, points[3].tolist()) for i in range(50)]
    bad = [(2000, None), (2001, []), (2002, [None] + [1.0] * 11), (2003, [float("nan")] * 12), (2004, [float("-inf")] + [0.0] * 11), (2005, [1e300] * 12)]
    found = whitened(table(spark, rows + bad)).collect()
    n, deviation, white, explained = brute_force([v for _, v in rows])
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by_id) == sorted(i for i, _ in rows) and all(sorted(c) == list(range(1, 9)) for c in by_id.values())
    sign = np.sign([by_id[0][c + 1].whitened * white[0, c] for c in range(8)])
    for k, (i, _) in enumerate(rows):
        for c in range(8):
            r = by_id[i][c + 1]
            assert (r.n, int(r.deviation)) == (n, deviation[k])
            assert r.whitened == pytest.approx(sign[c] * white[k, c], abs=1e-8) and r.explained == pytest.approx(explained[c], rel=1e-9)
            assert r.identity_error == found[0].identity_error < 1e-9


@pytest.mark.parametrize("low,high", [(0, 2), (-5, 5), (98000, 102000), (-(2**61), 2**61)])
def test_sums_of_bit_slices_are_exact(low, high):
    x = np.random.default_rng(1).integers(low, high, (131, 5))
    sums, cross = exact_sums(x)
    plain = x.astype(object)
    assert sums.tolist() == plain.sum(axis=0).tolist() and cross.tolist() == (plain.T @ plain).tolist()


def test_small_blocks_and_other_lengths(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i * i % 11)]) for i in range(200)] + [(None, [1.0, 2.0]), (5, [1.0, 2.0]), (300, [4.0]), (301, [5.0]), (302, [1.0, 2.0, 3.0])]
    found = whitened(table(spark, rows)).collect()
    counts = {(r.n, r.component) for r in found}
    assert counts == {(202, 1), (202, 2), (2, 1), (1, 1), (1, 2), (1, 3)} and len(found) == 202 * 2 + 2 + 3
    alone = [r for r in found if r.vec_id == 302]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in alone)
    assert sorted(abs(r.whitened) for r in found if r.vec_id in (300, 301)) == pytest.approx([1.0, 1.0])
    for step in (3, 64):
        x = np.array([v for _, v in rows[:202]])
        monkeypatch.setattr(whitening, "BLOCK_ROWS", step)
        import pyarrow as pa

        blocks = list(whitening.grids(pa.array(x.tolist(), pa.list_(pa.float64()))))
        assert sum(len(b) for b, _ in blocks) == 202 and max(len(b) for b, _ in blocks) == step


def test_constant_vectors_have_no_component(spark):
    found = whitened(table(spark, [(i, [1.5, 2.5]) for i in range(5)])).collect()
    assert len(found) == 10 and all(r.whitened is None and r.explained is None for r in found)


def test_one_direction_only(spark):
    found = whitened(table(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in found)
    assert {round(r.explained, 9) for r in found} == {1.0, 0.0} and found[0].identity_error < 1e-9


def test_empty_table(spark):
    assert whitened(table(spark, [])).count() == 0
