"""Shortest name paths to every package of a run whose graph fits a task.

The rules are those of the search level by level in ``graph``: a key is visited on one level only, a path never holds a name
twice, and of the paths to a key those stay that can still be among the first somewhere below. Names that can be met
again are bits of a number here, so a set of names is compared in one operation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa

COLUMNS = "run_id string, key string, path array<string>, trail array<bigint>, place int, depth int"
#: Rows of a batch of results.
BATCH = 10_000
#: Null in a trail and in a path, where the two must be comparable: below every number, and before every name.
NO_ORD, NO_NAME = -(2**63) - 1, "\0"
Row = tuple[str, tuple[str, ...], tuple[int, ...], int, int]


def _live(children: dict, own: dict[str, int]) -> tuple[dict[str, int], int]:
    """Which names a path may still meet again below a key, and those that may meet another first; as in ``graph``."""
    below, queue = dict(own), list(own)
    for key in queue:
        for child in children.get(key, ()):
            if more := below[key] & ~below.get(child, 0):
                below[child] = below.get(child, 0) | more
                queue.append(child)
    live, met, parents = {}, [], defaultdict(list)
    for key, following in children.items():
        for child in following:
            parents[child].append(key)
            if hit := below.get(key, 0) & own.get(child, 0):
                live[key] = live.get(key, 0) | hit
                met.append((child, hit))
    queue = list(live)
    for key in queue:
        for parent in parents.get(key, ()):
            if more := live[key] & below.get(parent, 0) & ~live.get(parent, 0):
                live[parent] = live.get(parent, 0) | more
                queue.append(parent)
    several = 0
    for child, hit in met:
        others = live.get(child, 0)
        # a single other name leaves that name itself out, two leave none out
        several |= hit if others & (others - 1) else hit & ~others if others else 0
    return live, several


def _enough(paths: Iterable[tuple], live: int, several: bool, most: int) -> list[tuple]:
    """Of the paths to one key, in queue order, those that can still be among the first ``most`` somewhere below."""
    kept: list[tuple] = []
    if several:
        for path in paths:
            if sum(not k[4] & ~path[4] for k in kept) < most:
                kept.append(path)
        return kept
    counts = [0] * most  # names that one, two and so on of the paths do not hold
    for path in paths:
        free = live & ~path[4]
        if len(kept) < most or free & ~counts[-1]:
            kept.append(path)
        for i, count in enumerate(counts):
            counts[i], free = count | free, count & free
        if len(kept) >= most and counts[-1] == live:
            break
    return kept


def paths_of_run(links: list[tuple], roots: list[str | None], most: int) -> Iterator[Row]:
    """(key, path, trail, place, depth) of one run from links (parent_key, key, name, ord) and the names of its root."""
    named, children = defaultdict(set), defaultdict(list)
    for parent, key, name, place in links:
        name, place = NO_NAME if name is None else name, NO_ORD if place is None else place
        children[parent].append((key, name, place))
        named[name].add(key)
    if "" not in children:
        return
    bits, own = {}, defaultdict(int)
    for name, keys in named.items():
        if len(keys) > 1 and name != NO_NAME:
            bits[name] = 1 << len(bits)
            for key in keys:
                own[key] |= bits[name]
    live, several = _live({p: {c[0] for c in cs} for p, cs in children.items()}, own) if bits else ({}, 0)
    frontier = {"": [((), (root or "(root)",), 0) for root in roots or [None]]}
    visited, depth = set(), 0
    while frontier:
        depth += 1
        steps = defaultdict(list)
        for parent, paths in frontier.items():
            for key, name, place in children.get(parent, ()):
                if key in visited or live and name == NO_NAME:
                    continue
                bit, onward = bits.get(name, 0), live.get(key, 0)
                steps[key] += [(trail, place, path, name, (held | bit) & onward) for trail, path, held in paths if not held & bit]
        frontier = {}
        for key, paths in steps.items():
            if not paths:
                continue
            paths.sort()
            onward = live.get(key, 0)
            kept = [
                ((*trail, place), (*path, name), held)
                for trail, place, path, name, held in _enough(paths, onward, bool(onward & several), most)
            ]
            frontier[key] = kept
            for number, (trail, path, _) in enumerate(kept[:most], 1):
                yield key, path, trail, number, depth
        visited |= frontier.keys()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    def listed(place: int, kind: pa.DataType, nothing) -> pa.Array:
        offsets, flat = [0], []
        for row in rows:
            flat += row[place]
            offsets.append(len(flat))
        if nothing in flat:
            flat = [None if v == nothing else v for v in flat]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))

    run, key, _, _, number, depth = zip(*rows, strict=True)
    arrays = [pa.array(run, pa.string()), pa.array(key, pa.string()), listed(2, pa.string(), NO_NAME), listed(3, pa.int64(), NO_ORD), pa.array(number, pa.int32()), pa.array(depth, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["run_id", "key", "path", "trail", "place", "depth"])


def walk_runs(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Results of all runs from rows (run, parent_key, key, name, ord) that stand together by run; a root has no parent."""
    run, links, roots, found = None, [], [], []

    def finished() -> None:
        found.extend((run, *row) for row in paths_of_run(links, roots, most))

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if row[0] != run:
                finished()
                run, links, roots = row[0], [], []
                for at in range(0, len(found) - BATCH + 1, BATCH):
                    yield _batch(found[at : at + BATCH])
                found = found[len(found) - len(found) % BATCH :]
            if row[1] is None:
                roots.append(row[3])
            else:
                links.append(row[1:])
    finished()
    for at in range(0, len(found), BATCH):
        yield _batch(found[at : at + BATCH])
