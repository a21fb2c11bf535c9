import math
import random

import numpy as np
import pyarrow as pa
import pytest

from driftlens.llm.components import connected_components
from driftlens.llm.common import Scratch
from driftlens.llm import neardup
from driftlens.llm.neardup import Similarity, deduplicate, near_duplicates

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    for sign in WHITE:
        text = text.replace(sign, " ")
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ") if w]


def brute_force(rows, size, least):
    sets = []
    for _, text in rows:
        words = words_of(text or "")
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least_of = {r: min((d for d in docs if d is not None), default=None) for r, docs in groups.items()}
    return sorted(((doc, len(sets[i]), least_of[root(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


def family(rng, base, count, edits):
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture
def corpus():
    rng = random.Random(5)
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 150]))]
        texts += family(rng, base, 12, rng.choice([1, 2, 4])) + [" ".join(base).upper()] * 2
    dense = [f"d{i}" for i in range(150)]
    texts += family(rng, dense, 60, 4)  # links among these lie around the threshold
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) + " a line that all of them share in the end" for _ in range(60)]
    texts += ["", None, " \t\n ", "one", "ONE", "one two", "one two", "Été a b", "été a b", "x y z", "x  y\tz"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(3, texts[3]), (None, texts[5]), (None, "alone with a null id"), (7, "another text under a known id")]


@pytest.mark.parametrize(
    "like",
    [
        Similarity(words=3, least=85),
        Similarity(words=5, least=80),
        Similarity(words=3, least=85, leaf=20, class_docs=12, class_shingles=2500, hubs=2),  # branches, leaders, blocks and strays
    ],
)
def test_components_equal_brute_force(documents, corpus, like):
    found = near_duplicates(documents(corpus), like).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(corpus, like.words, like.least)


@pytest.mark.parametrize("least, equal", [(80, 77), (85, 84)])
def test_the_signature_loses_less_than_the_trees(least, equal):
    n, t = neardup.SIGNATURE, least / 100
    assert sum(math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(equal)) < 1e-7
    one, two = np.zeros(n, np.uint8), np.r_[np.zeros(equal, np.uint8), np.ones(n - equal, np.uint8)]
    leaf = pa.RecordBatch.from_arrays([pa.array([5, 5]), pa.array([1, 2]), pa.array([one.tobytes(), two.tobytes()], pa.binary())], names=["node", "key", "sig"])
    assert [b.num_rows for b in neardup._compare_leaves(Similarity(least=least).gate)(iter([leaf]))] == [1]


def test_deduplicate_keeps_one_of_each_group_and_all_columns(documents):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (3, None), (4, ""), (5, "z y x w v"), (5, "z y x w v")]
    frame = documents(rows)
    kept = deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_empty_table(documents):
    assert near_duplicates(documents([]).where("false")).count() == 0


@pytest.mark.parametrize("chunk", [10**6, 150])
def test_connected_components_of_long_paths_and_hubs(spark, chunk):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (7, 6), (6, 7), (7, 6)]
    rng.shuffle(edges)
    found = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), Scratch(spark, "test"), chunk=chunk)
    roots = {r["id"]: r["root"] for r in found.collect()}
    assert found.count() == len(roots)
    assert all(roots[i] == 100 for i in range(100, 401)) and all(roots[k] == 1000 for k in range(1000, 1400)) and roots[7] == 6 and 5 not in roots
