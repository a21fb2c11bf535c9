import numpy as np
import pytest

from driftlens.llm.vectors import Forest, near_vectors


def brute_force(rows, least=0.95):
    usable = {}
    for i, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float) / np.abs(v).max()
            usable[i] = x / np.linalg.norm(x)
    links = {i: [j for j in usable if j != i and i in usable and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least] for i in range(len(rows))}
    out = []
    for i, (vec, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out.append((vec, len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forest", [Forest(), Forest(leaf=40), Forest(leaf=40, most_spill=0.2)])
def test_counts_and_components_equal_brute_force(spark, forest):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    points = [c + 0.28 * rng.standard_normal(16) for c in centres for _ in range(15)]
    points += [centres[0] + 0.05 * rng.standard_normal(16) for _ in range(150)]  # a cone that no direction parts
    points += list(rng.standard_normal((100, 16)))
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(2000 + k, [2 * x for x in rows[40][1]]) for k in range(3)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0] * 15 + [None]), (3004, [float("nan")] * 16), (3005, [float("inf")] + [1.0] * 15), (3006, [1e-30] * 16), (3007, [1e30] * 16)]
    rows += [(4000, [1.0, 2.0]), (4001, [2.0, 4.0]), (4002, [1.0]), (5, rows[9][1]), (None, rows[9][1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, key int").repartition(3)
    found = near_vectors(frame, forest).select("vec_id", "n_links", "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == brute_force(rows)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
