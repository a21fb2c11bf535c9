"""Change set against a plain model, including the closest-version rules."""

import random
import re

import pytest

from driftlens.operators import changeset as C
from driftlens.schema import LOCK_NODES


def frame(spark, rows):
    """rows: (side, name, version, integrity) in input order."""
    shaped = [("r", s, f"k{i}", n, v, g, None, i) for i, (s, n, v, g) in enumerate(rows)]
    return spark.createDataFrame(shaped, LOCK_NODES)


def number(version):
    m = re.search(r"(?:^|\D)(\d{1,16})(?:\.(\d{1,16}))?(?:\.(\d{1,16}))?(?:$|\D)", version)
    return tuple(int(x or 0) for x in m.groups()) if m else None


def closest(candidates, target):
    t = number(target)
    known = [(number(c), i, c) for i, c in enumerate(candidates) if number(c) is not None]
    if t is None or not known:
        less = sorted(c for c in candidates if c < target)
        return less[-1] if less else min(candidates)
    below = [k for k in known if k[0] <= t]
    return max(below)[2] if below else min(known)[2]


def model(rows):
    sides = {"old": {}, "new": {}}
    for side, name, version, integrity in rows:
        if version:
            sides[side].setdefault((name, version), None)
            sides[side][(name, version)] = integrity
    old, new = sides["old"], sides["new"]
    old_names, new_names = {n for n, _ in old}, {n for n, _ in new}
    out = set()
    for (n, v), g in new.items():
        if n not in old_names:
            out.add(("added", n, None, v))
        elif (n, v) not in old:
            out.add(("upgraded", n, closest([x for m, x in old if m == n], v), v))
        elif g != old[(n, v)]:
            out.add(("integrity-changed", n, v, v))
    out |= {("removed", n, v, None) for n, v in old if n not in new_names}
    return out


def ours(spark, rows):
    found = C.changeset(frame(spark, rows)).select("kind", "name", "version_old", "version_new").collect()
    result = {tuple(r) for r in found}
    assert len(result) == len(found)
    return result


CASES = {
    "both blank": ([("old", "a", "1.0.0", ""), ("new", "a", "1.0.0", "")], set()),
    "blank to set": ([("old", "a", "1.0.0", ""), ("new", "a", "1.0.0", "x")], {("integrity-changed", "a", "1.0.0", "1.0.0")}),
    "set to blank": ([("old", "a", "1.0.0", "x"), ("new", "a", "1.0.0", "")], {("integrity-changed", "a", "1.0.0", "1.0.0")}),
    "dropped version of a kept name": ([("old", "a", "1.0.0", "x"), ("old", "a", "2.0.0", "y"), ("new", "a", "2.0.0", "y")], set()),
    "numbers, not text": ([("old", "a", "1.9.0", ""), ("old", "a", "1.10.0", ""), ("new", "a", "1.11.0", "")], {("upgraded", "a", "1.10.0", "1.11.0")}),
    "only larger": ([("old", "a", "3.0.0", ""), ("old", "a", "2.0.0", ""), ("new", "a", "1.0.0", "")], {("upgraded", "a", "2.0.0", "1.0.0")}),
    "text": ([("old", "a", "beta", ""), ("old", "a", "alpha", ""), ("new", "a", "gamma", "")], {("upgraded", "a", "beta", "gamma")}),
    "pre-release ties with its release, last one wins": (
        [("old", "a", "1.0.0", ""), ("old", "a", "1.0.0-beta.1", ""), ("new", "a", "1.0.1", "")], {("upgraded", "a", "1.0.0-beta.1", "1.0.1")}),
    "last entry wins": ([("old", "a", "1.0.0", "x"), ("old", "a", "1.0.0", "y"), ("new", "a", "1.0.0", "y")], set()),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    rows, expected = CASES[case]
    assert ours(spark, rows) == expected == model(rows)


def test_random_inventories_match_the_model(spark):
    rng = random.Random(7)
    versions = ["1.0.0", "1.0.0-rc.1", "1.2.0", "1.10.0", "2.0", "v3", "1.0.5000", "next", "latest", "0.9.9", "1.0.4096", ""]
    rows = [
        (rng.choice(["old", "new"]), f"p{rng.randrange(40)}", rng.choice(versions), rng.choice(["", "a", "b"])) for _ in range(500)
    ]
    assert ours(spark, rows) == model(rows)


def test_one_long_history_and_row_order(spark):
    """A package with thousands of versions; shuffled and repartitioned input gives the same answer."""
    rows = [("old", "big", f"1.{i // 3000}.{i % 3000}", "") for i in range(0, 6000, 2)]
    rows += [("new", "big", f"1.{i // 3000}.{i % 3000}", "") for i in range(1, 6000, 500)]
    expected = model(rows)
    assert ours(spark, rows) == expected
    shuffled = frame(spark, rows).repartition(13)
    found = C.changeset(shuffled).select("kind", "name", "version_old", "version_new").collect()
    assert {tuple(r) for r in found} == expected


def test_equal_sides_change_nothing(spark):
    rows = [(s, f"p{i}", "1.0.0", "x") for s in ("old", "new") for i in range(20)]
    assert ours(spark, rows) == set()


def test_order_is_total(spark):
    rows = [("new", "b", "1.0.0", ""), ("new", "a", "2.0.0", ""), ("new", "a", "1.0.0", ""), ("old", "c", "1.0.0", "")]
    found = C.changeset(frame(spark, rows)).orderBy(*C.change_order()).collect()
    assert [(r.name, r.version_new) for r in found] == [("a", "1.0.0"), ("a", "2.0.0"), ("b", "1.0.0"), ("c", None)]


def test_content_pairs_are_shared_between_runs(spark):
    changes = spark.createDataFrame(
        [("r1", "c", "upgraded", "a", "1", "2"), ("r2", "c", "upgraded", "a", "1", "2"), ("r2", "d", "added", "b", None, "1"), ("r2", "e", "integrity-changed", "z", "1", "1")],
        "run_id string, change_id string, kind string, name string, version_old string, version_new string",
    )
    known = spark.createDataFrame([("a", "1"), ("a", "2")], "name string, version string")
    content = C.content_pairs(changes, known)
    assert content.count() == 3
    pairs = {(r.package, r.from_ver, r.to_ver) for r in C.distinct_pairs(content).collect()}
    assert pairs == {("a", "1", "2"), ("b", None, "1")}
