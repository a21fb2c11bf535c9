"""Paths, closure and roll-up against plain searches."""

import random
from collections import deque

from driftlens.operators import graph as G

NODES = "run_id string, key string, name string"
EDGES = "run_id string, parent_key string, child_key string, ord long"


def build(seed, size=40, fan=3):
    rng = random.Random(seed)
    names = {"": "app"} | {f"k{i}": f"n{i % (size - 5)}" for i in range(size)}
    children = {}
    for key in names:
        targets = rng.sample([k for k in names if k != key and k], rng.randrange(0, fan + 1) or (fan if key == "" else 0))
        children[key] = targets
    return names, children


def frames(spark, graphs):
    nodes = [(run, k, n) for run, (names, _) in graphs.items() for k, n in names.items()]
    edges = [(run, p, c, i) for run, (_, children) in graphs.items() for p, cs in children.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def shortest(names, children, target, most=3):
    queue, seen, results, best = deque([("", ["app"])]), {}, [], None
    while queue:
        key, path = queue.popleft()
        if best is not None and len(path) > best:
            break
        if key == target and len(path) > 1:
            results.append(path)
            best = len(path)
            if len(results) >= most:
                break
            continue
        if key in seen and seen[key] < len(path):
            continue
        seen[key] = len(path)
        for child in children[key]:
            if names[child] not in path[1:]:
                queue.append((child, [*path, names[child]]))
    return results


def reachable(names, children, direct):
    """Names below any instance of the direct name, from key to key."""
    stack = [k for k in names if names[k] == direct]
    seen = set()
    while stack:
        key = stack.pop()
        if key not in seen:
            seen.add(key)
            stack.extend(children[key])
    return {names[k] for k in seen}


def test_paths_match_a_queue_search(spark):
    graphs = {f"g{i}": build(i) for i in range(6)}
    nodes, edges = frames(spark, graphs)
    found = {}
    for r in sorted(G.provenance_paths(nodes, edges).collect(), key=lambda r: r.place):
        found.setdefault((r.run_id, r.key), []).append(list(r.path))
    for run, (names, children) in graphs.items():
        for key in names:
            if key:
                assert found.get((run, key), []) == shortest(names, children, key), (run, key)


def nested(seed, size=26, kinds=9):
    """Few names for many keys, edges mostly onward: names nest in themselves, several on one way."""
    rng = random.Random(seed)
    names = {"": "app"} | {f"k{i}": f"n{rng.randrange(kinds)}" for i in range(size)}
    keys = list(names)
    children = {k: rng.sample(keys[1:], 2) if rng.random() < 0.15 else [c for c in keys[i + 1 : i + 6] if rng.random() < 0.6] for i, k in enumerate(keys)}
    return names, children


def test_paths_where_names_nest(spark):
    graphs = {f"g{i}": nested(i) for i in range(24)}
    nodes, edges = frames(spark, graphs)
    for most in (1, 3):
        found = {}
        for r in sorted(G.provenance_paths(nodes, edges, most).collect(), key=lambda r: r.place):
            found.setdefault((r.run_id, r.key), []).append(list(r.path))
        for run, (names, children) in graphs.items():
            for key in names:
                if key:
                    assert found.get((run, key), []) == shortest(names, children, key, most), (run, key)


def layered(layers, deeper=False):
    """Layers of two packages, and below the last a second instance of each; `deeper` lets those need each other's names."""
    names, children = {"": "app", "x": "x"}, {"": ["a0", "b0"], "x": []}
    for i in range(layers):
        for c in "ab":
            names |= {f"{c}{i}": f"{c}{i}", f"x{c}{i}": f"{c}{i}"}
            children[f"{c}{i}"] = [f"a{i + 1}", f"b{i + 1}"] if i + 1 < layers else ["x"]
            children["x"].append(f"x{c}{i}")
            children[f"x{c}{i}"] = []
    if deeper:
        for i in range(layers - 1):
            names[f"y{i}"] = f"a{i + 1}"
            children[f"xa{i}"], children[f"y{i}"] = [f"y{i}"], []
    return names, children


def test_layers_of_repeated_names(spark):
    small = {"plain": layered(6), "deeper": layered(6, deeper=True)}
    nodes, edges = frames(spark, small)
    found = {}
    for r in sorted(G.provenance_paths(nodes, edges).collect(), key=lambda r: r.place):
        found.setdefault((r.run_id, r.key), []).append(list(r.path))
    for run, (names, children) in small.items():
        for key in names:
            if key:
                assert found.get((run, key), []) == shortest(names, children, key), (run, key)


def test_twenty_layers_keep_few_paths(spark, monkeypatch):
    """At most three paths a name that can still block, where there are two to the power of twenty paths."""
    kept = []

    def cut(df):
        out = original(df)
        if "held" in df.columns:
            kept.append(out.groupBy("run_id", "key").count().agg({"count": "max"}).first()[0] or 0)
        return out

    original = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", cut)
    nodes, edges = frames(spark, {"g": layered(20)})
    found = {(r.key, r.place): list(r.path) for r in G.provenance_paths(nodes.coalesce(1), edges.coalesce(1)).collect()}
    assert max(kept) <= 3 * 41 and len(kept) == 23
    assert found["xa7", 1] == ["app", *(f"{'b' if i == 7 else 'a'}{i}" for i in range(20)), "x", "a7"]
    assert found["xb19", 3] == ["app", *(f"{'b' if i == 17 else 'a'}{i}" for i in range(20)), "x", "b19"] and ("xb19", 4) not in found


def test_closure_and_rollup(spark):
    graphs = {f"g{i}": build(i + 10) for i in range(4)}
    nodes, edges = frames(spark, graphs)
    closure = G.subtree_closure(nodes, edges)
    found = {}
    for r in closure.collect():
        found.setdefault((r.run_id, r.direct), set()).add(r.name)
    expected = {
        (run, names[c]): reachable(names, children, names[c]) for run, (names, children) in graphs.items() for c in children[""]
    }
    assert found == expected
    findings = spark.createDataFrame([(run, f"n{i}", s) for run in graphs for i, s in ((1, "WARN"), (2, "INFO"), (3, "BLOCK"), (3, "INFO"))], "run_id string, package string, severity string")
    rank = {"n1": ["WARN"], "n2": ["INFO"], "n3": ["BLOCK", "INFO"]}
    for r in G.rollup_by_direct(nodes, edges, findings).collect():
        hits = [s for n in expected[(r.run_id, r.direct)] for s in rank.get(n, [])]
        worst = next((s for s in ("BLOCK", "WARN", "INFO") if s in hits), "CLEAN")
        assert (r.max_severity, r["count"]) == (worst, len(hits))


def test_cycles_end(spark):
    names = {"": "app", "a": "a", "b": "b"}
    nodes, edges = frames(spark, {"g": (names, {"": ["a"], "a": ["b"], "b": ["a"]})})
    assert {r.key for r in G.provenance_paths(nodes, edges).collect()} == {"a", "b"}
    assert G.subtree_closure(nodes, edges).count() == 2


def test_no_edges(spark):
    nodes = spark.createDataFrame([("g", "", "app")], NODES)
    edges = spark.createDataFrame([], EDGES)
    assert G.provenance_paths(nodes, edges).count() == 0


def test_a_path_beyond_three_blocked_ones_is_found(spark):
    """Four equally short ways to x; the first three hold the name c, and x depends on another instance of c."""
    names = {"": "app", "a": "a", "c1": "c", "b1": "b1", "b2": "b2", "b3": "b3", "d": "d", "e": "e", "x": "x", "c2": "c"}
    children = {k: [] for k in names}
    children |= {"": ["c1", "a"], "c1": ["b1", "b2", "b3"], "a": ["d"], "b1": ["x"], "b2": ["x"], "b3": ["x"], "d": ["x"], "x": ["c2"]}
    nodes, edges = frames(spark, {"g": (names, children)})
    found = {(r.key, r.place): list(r.path) for r in G.provenance_paths(nodes, edges).collect()}
    assert found["c2", 1] == ["app", "a", "d", "x", "c"] == shortest_valid(names, children, "c2")
    assert [found["x", p] for p in (1, 2, 3)] == [["app", "c", b, "x"] for b in ("b1", "b2", "b3")] and ("x", 4) not in found


def shortest_valid(names, children, target):
    """The first of the shortest paths without a repeated name, by trying all."""
    queue = deque([("", ["app"])])
    while queue:
        key, path = queue.popleft()
        if key == target:
            return path
        queue.extend((c, [*path, names[c]]) for c in children[key] if names[c] not in path[1:])


def test_instances_of_a_name_are_kept_apart(spark):
    names = {"": "app", "a": "a", "b": "b", "c1": "c", "c2": "c", "x": "x"}
    children = {"": ["a", "b"], "a": ["c1"], "b": ["c2"], "c1": [], "c2": ["x"], "x": []}
    nodes, edges = frames(spark, {"g": (names, children)})
    found = {(r.direct, r.name) for r in G.subtree_closure(nodes, edges).collect()}
    assert found == {("a", "a"), ("a", "c"), ("b", "b"), ("b", "c"), ("b", "x")}
    findings = spark.createDataFrame([("g", "x", "BLOCK"), ("g", "c", "WARN"), ("g", "elsewhere", "INFO")], "run_id string, package string, severity string")
    graded = {r.direct: (r.max_severity, r["count"]) for r in G.rollup_by_direct(nodes, edges, findings).collect()}
    assert graded == {"a": ("WARN", 1), "b": ("BLOCK", 2)}


def test_depth_has_no_bound(spark):
    size = 105
    names = {"": "app"} | {f"k{i}": f"n{i}" for i in range(size)}
    children = {"": ["k0"]} | {f"k{i}": [f"k{i + 1}"] if i + 1 < size else [] for i in range(size)}
    nodes, edges = frames(spark, {"g": (names, children)})
    assert G.provenance_paths(nodes.coalesce(1), edges.coalesce(1)).count() == size


def walked(monkeypatch):
    """The tables of (run, tag, key) that a walk writes, in order."""
    tables, original = [], G.cut_lineage

    def cut(df):
        out = original(df)
        if set(out.columns) == {"run_id", "tag", "key"}:
            tables.append(out)
        return out

    monkeypatch.setattr(G, "cut_lineage", cut)
    return tables


FLAT = {"": "app", "d": "d"} | {f"m{i}": f"m{i}" for i in range(6)} | {f"l{i}": f"l{i}" for i in range(30)}
FLAT_CHILDREN = {"": ["d"], "d": [f"m{i}" for i in range(6)]} | {f"m{i}": [f"l{j}" for j in range(30) if j % 6 == i] for i in range(6)} | {f"l{i}": [] for i in range(30)}


def test_closure_walks_no_keys_without_edges(spark, monkeypatch):
    tables = walked(monkeypatch)
    nodes, edges = frames(spark, {"g": (FLAT, FLAT_CHILDREN)})
    assert {r.name for r in G.subtree_closure(nodes, edges).collect()} == set(FLAT.values()) - {"app"}
    assert not any(r.key.startswith("l") for table in tables for r in table.collect())


def test_rollup_gathers_no_findings_at_a_key(spark, monkeypatch):
    tables = walked(monkeypatch)
    nodes, edges = frames(spark, {"g": (FLAT, FLAT_CHILDREN)})
    findings = spark.createDataFrame([("g", f"l{i}", "WARN") for i in range(30)], "run_id string, package string, severity string")
    assert [tuple(r) for r in G.rollup_by_direct(nodes, edges, findings).collect()] == [("g", "d", "WARN", 30)]
    assert max(r["count"] for table in tables for r in table.groupBy("key").count().collect()) == 1


def test_paths_with_edges_into_visited_keys_dropped(spark, monkeypatch):
    """The edges left are written once a level here, and hold none into a key that has its paths."""
    links, original = [], G.cut_lineage

    def cut(df):
        out = original(df)
        if "parent_key" in out.columns:
            links.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", cut)
    monkeypatch.setattr(G, "PRUNE_FROM", 1)
    for graphs in ({"g": build(0)}, {"g": nested(2, size=10, kinds=4)}, {"g": (FLAT, FLAT_CHILDREN)}):
        links.clear()
        nodes, edges = frames(spark, graphs)
        found = {}
        for r in sorted(G.provenance_paths(nodes.coalesce(1), edges.coalesce(1)).collect(), key=lambda r: r.place):
            found.setdefault(r.key, []).append(list(r.path))
        names, children = graphs["g"]
        assert all(found.get(key, []) == shortest(names, children, key) for key in names if key)
        assert links == sorted(links, reverse=True)
    assert links == [37, 30, 0]


def test_many_small_runs_are_walked_whole(spark, monkeypatch):
    """No table is written a level; results are those of the plain search, and those of runs that are too large stay."""
    tables, original = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: tables.append(df.columns) or original(df))
    graphs = {f"g{i}": (build(i), nested(i), nested(i, size=14, kinds=4), layered(2 + i % 4, deeper=i % 2 == 0))[i % 4] for i in range(48)}
    nodes, edges = frames(spark, graphs)

    def check(found):
        paths = {}
        for r in sorted(found.collect(), key=lambda r: r.place):
            assert len(r.trail) == r.depth == len(r.path) - 1
            paths.setdefault((r.run_id, r.key), []).append(list(r.path))
        for run, (names, children) in graphs.items():
            assert all(paths.get((run, key), []) == shortest(names, children, key) for key in names if key), run

    check(G.provenance_paths(nodes, edges))
    assert len(tables) == 2
    monkeypatch.setattr(G, "RUN_KEYS", 30)
    check(G.provenance_paths(nodes.coalesce(1), edges.coalesce(1)))
    assert ["run_id", "key", "path", "trail", "held", "place"] in tables


def test_runs_walked_whole_and_by_level_agree_on_odd_rows(spark, monkeypatch):
    """Rows that come twice, no root, no name, no place, no parent, a way back to the root."""
    odd = {"g": nested(3, size=16, kinds=5)}
    nodes, edges = frames(spark, odd)
    more = spark.createDataFrame([("g", "z", None), ("h", "a", "a"), ("h", "b", "b"), (None, "a", "a"), ("e", "", "")], NODES)
    wild = spark.createDataFrame([("g", "", "z", None), ("g", "z", "k9", 7), ("g", "k0", "z", 1), ("g", None, "k1", 0), ("g", "k1", "", 0), ("h", "", "a", 0), ("h", "", "b", 0), ("h", "a", "b", 0), (None, "", "a", 0)], EDGES)
    nodes, edges = nodes.unionByName(nodes).unionByName(more).coalesce(1), edges.unionByName(edges.filter("ord = 0")).unionByName(wild).coalesce(1)

    def collected():
        return sorted((tuple(map(str, r)) for r in G.provenance_paths(nodes, edges).collect()))

    by_level = collected()
    monkeypatch.setattr(G, "RUNS_FROM", 1)
    assert collected() == by_level and len(by_level) > 20
