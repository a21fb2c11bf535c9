"""MinHash near-dedup as a chosen-path set similarity join (operator 1).

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its shingle set, a MinHash signature
   and its places in the first level of several trees. Documents of equal sets become one node at once, so a group of
   copies costs one map-side aggregate however large it is.
2. Trees. In each tree a document follows two chosen coordinates of its minwise tokens from level to level; documents
   that agree on a coordinate meet in a child node. Small nodes are compared exhaustively by signature. A large node is
   compared with one leader; documents close to it join the leader's candidate class and leave the node when, by the
   triangle inequality of the Jaccard distance, none that stays could be linked to them. The rest branch again. Each pair
   at the threshold meets in a tree with probability 0.96 or more at the first level and 0.95 at any depth, so four
   independent trees miss fewer than one in a hundred thousand. All trees share one signature, and a pair of a leaf must
   agree in its bytes up to `GATE` below the threshold: by the binomial tail that loses 7e-8 of the pairs at 0.80, and
   2e-8 at 0.85.
3. Trees only give candidate classes (a spanning forest, never all pairs). Full shingle sets are then compared within each
   class, breadth first, without comparing documents that are already connected: the result is exact inside a class.
   Classes beyond a bounded size are cut into blocks; hubs tie the blocks together, and only documents outside the largest
   component visit every other block.

Defined results: a null or empty text, or one of white space only, has the empty set, n_shingles 0, and is linked with
nothing. Fewer words than a shingle form one shingle. Rows that repeat an id are documents of their own; component_id is
the smallest id of the component. A null id is compared like any other and never is a component_id unless no other exists.
An empty table gives an empty result. Other columns are ignored by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch, read, runs, slices, small_enough
from driftlens.llm.components import connected_components
from driftlens.llm.words import WordHasher, mix, shingle_hashes

SIGNATURE = 128
TREES = 4
#: How far below the threshold the share of equal signature bytes of a candidate pair may lie.
GATE = 0.20
BRANCHES = 2


@dataclass(frozen=True)
class Similarity:
    """Shingles of `words` words; linked if the Jaccard similarity is at least least/100. The rest bounds memory, not results."""

    words: int = 5
    least: int = 80
    leaf: int = 4096
    class_docs: int = 1000
    class_shingles: int = 2_000_000
    hubs: int = 16

    @property
    def threshold(self) -> float:
        return self.least / 100

    @property
    def gate(self) -> float:
        """The least share of equal signature bytes of a candidate pair."""
        return self.threshold - GATE


# ---- 1. sketches ----


class Sketcher:
    """Set sizes, fingerprints, signatures and first nodes of a column of texts."""

    def __init__(self, words: int):
        rng = np.random.default_rng(7)
        self.words, self.hash = words, WordHasher()
        self.flip = rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64)
        self.odd = rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64) | np.uint64(1)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        words, first = self.hash(texts)
        return [shingle_hashes(words[a:b], self.words) for a, b in zip(first, first[1:])]

    def __call__(self, texts: pa.Array):
        sets = self.sets(texts)
        sizes = np.array([len(s) for s in sets], np.int64)
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        full = np.flatnonzero(sizes)
        least = np.zeros((len(sets), SIGNATURE), np.uint64)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            own = np.empty_like(flat)
            for j in range(SIGNATURE):
                np.multiply(np.bitwise_xor(flat, self.flip[j], out=own), self.odd[j], out=own)
                least[full, j] = np.minimum.reduceat(own, starts)
        coordinates = np.arange(TREES * BRANCHES) * (SIGNATURE // (TREES * BRANCHES))
        nodes = mix(least[:, coordinates] + coordinates.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        signatures = (mix(least) >> np.uint64(56)).astype(np.uint8)
        return sizes, prints, signatures, nodes


def sketch(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n, print, key, sig, nodes): key is half of the fingerprint; null with the empty set."""

    def rows(batches: Iterator[pa.RecordBatch]):
        make = Sketcher(words)
        for batch in batches:
            texts = batch["text"]
            for start, stop in slices(texts):
                sizes, prints, signatures, nodes = make(texts.slice(start, stop - start))
                keys = [int.from_bytes(p[:8], "little", signed=True) if p else None for p in prints]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(start, stop - start), batch["text_hash"].slice(start, stop - start), pa.array(sizes), pa.array(keys, pa.int64()),
                        pa.array([s.tobytes() for s in signatures], pa.binary()), pa.array(list(nodes), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n", "key", "sig", "nodes"],
                )

    chosen = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return chosen.mapInArrow(rows, "doc_id long, text_hash long, n long, key long, sig binary, nodes array<long>")


# ---- 2. trees ----


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (list(x) for x in zip(*pairs)) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class Forest:
    """Union-find over list indices."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _compare_leaves(least: float):
    """Over rows sorted by node: every pair of a node is compared by signature; pairs that connect something new are kept."""

    def compare(batches: Iterator[pa.RecordBatch]):
        for table in _whole_nodes(batches):
            node, key = table["node"].to_numpy(), table["key"].to_pylist()
            signatures, forest, pairs = _signatures(table["sig"]), Forest(len(key)), []
            need = int(np.ceil(least * SIGNATURE))
            for gap in range(1, len(node)):
                same = np.flatnonzero(node[gap:] == node[:-gap])
                if not len(same):
                    break
                equal = np.count_nonzero(signatures[same] == signatures[same + gap], axis=1)
                for i in same[equal >= need].tolist():
                    if forest.join(i, i + gap):
                        pairs.append((key[i], key[i + gap]))
            yield _edges(pairs)

    return compare


def _whole_nodes(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.Table]:
    """The sorted rows in tables of at most about `most` rows that end where a node ends."""
    held, rows = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            piece = batch.slice(start, most)
            node = piece["node"].to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if (node != node[-1]).any() else 0
            fits = held and held[-1]["node"][-1].as_py() != node[0]
            if fits and not cut:
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                yield pa.Table.from_batches([*held, piece.slice(0, cut)])
                held = []
            held.append(piece.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _estimate(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        share = (_signatures(batch["sig"]) == _signatures(batch["leader_sig"])).mean(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch["node"], batch["key"], batch["leader"], batch["sig"], pa.array(share)], names=["node", "key", "leader", "sig", "near"])


def _children(batches: Iterator[pa.RecordBatch]):
    """Each row moves to one child for each of two coordinates that a hash of the node chooses."""
    for batch in batches:
        node = batch["node"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        signatures = _signatures(batch["sig"])
        parts = []
        for branch in range(BRANCHES):
            chosen = mix(node * np.uint64(BRANCHES) + np.uint64(branch))
            coordinate = (chosen % np.uint64(SIGNATURE)).astype(np.int64)
            token = signatures[np.arange(len(node)), coordinate].astype(np.uint64)
            parts.append(mix(chosen ^ mix(coordinate.astype(np.uint64) * np.uint64(256) + token)).view(np.int64))
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(part), batch["key"]], names=["node", "key"])


def candidate_edges(sets: DataFrame, scratch: Scratch, like: Similarity) -> DataFrame:
    """Edges (a, b) between keys of likely linked sets, enough to connect every candidate class. `sets`: key, sig, nodes."""
    shell, reach = like.threshold - 0.45, (1 - like.threshold) + 0.10
    rows = sets.select("key", F.explode("nodes").alias("node")).select("node", "key")
    signed = sets.select("key", "sig")
    edges, level = None, 0
    while True:
        stats = rows.groupBy("node").agg(F.count("*").alias("n"), F.min_by("key", F.xxhash64("key")).alias("leader")).where("n > 1")
        met = rows.join(stats, "node").join(signed, "key")
        met = scratch.cut(met.select("node", "key", "n", "leader", "sig"), f"level-{level}")
        leaves = met.where(F.col("n") <= like.leaf).select("node", "key", "sig").repartition("node").sortWithinPartitions("node", "key")
        found = leaves.mapInArrow(_compare_leaves(like.gate), "a long, b long")
        large = met.where(F.col("n") > like.leaf)
        if not large.limit(1).count():
            found = scratch.cut(found.distinct(), f"edges-{level}")
            return found if edges is None else edges.union(found)
        led = large.join(signed.select(F.col("key").alias("leader"), F.col("sig").alias("leader_sig")), "leader")
        led = led.select("node", "key", "leader", "sig", "leader_sig").mapInArrow(_estimate, "node long, key long, leader long, sig binary, near double")
        led = scratch.cut(led, f"led-{level}")
        close = led.where((F.col("near") >= shell) & (F.col("key") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("key").alias("b"))
        found = scratch.cut(found.union(close).distinct(), f"edges-{level}")
        edges = found if edges is None else edges.union(found)
        outside = led.where(F.col("near") < shell).groupBy("node").agg(F.max("near").alias("farther"))
        stay = led.join(outside, "node").where((F.col("key") != F.col("leader")) & (F.col("near") < F.greatest(F.lit(shell), F.col("farther") + reach)))
        rows = scratch.cut(stay.select("node", "key", "sig").mapInArrow(_children, "node long, key long"), f"rows-{level + 1}")
        for name in (f"level-{level}", f"led-{level}", f"rows-{level}"):
            scratch.drop(name)
        level += 1


# ---- 3. exact comparison within candidate classes ----


class Sets:
    """Shingle sets as indices into their common vocabulary."""

    def __init__(self, sets: list[np.ndarray], least: int):
        self.least = least
        self.sizes = np.array([len(s) for s in sets], np.int64)
        vocabulary, places = np.unique(np.concatenate(sets), return_inverse=True)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.places, self.mark = places.astype(np.int32), np.zeros(len(vocabulary), bool)

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are linked with one, by the sizes of intersection and union."""
        n = self.sizes[one]
        fits = others[(100 * np.minimum(self.sizes[others], n) >= self.least * np.maximum(self.sizes[others], n))]
        if not len(fits):
            return fits
        own = self.places[self.bounds[one] : self.bounds[one + 1]]
        self.mark[own] = True
        lengths = self.sizes[fits]
        ends = np.cumsum(lengths)
        take = np.repeat(self.bounds[fits] - (ends - lengths), lengths) + np.arange(ends[-1])
        common = np.add.reduceat(self.mark[self.places[take]], ends - lengths, dtype=np.int64)
        self.mark[own] = False
        return fits[100 * common >= self.least * (lengths + n - common)]

    def components(self) -> list[int]:
        """For each set the index of the first set of its component: breadth first, against unvisited sets only."""
        label, open_ = [-1] * len(self.sizes), np.arange(len(self.sizes))
        while len(open_):
            first, queue = int(open_[0]), [int(open_[0])]
            label[first], open_ = first, open_[1:]
            while queue and len(open_):
                found = self.linked(queue.pop(), open_)
                if len(found):
                    open_ = np.setdiff1d(open_, found, assume_unique=True)
                    queue += found.tolist()
                    for i in found.tolist():
                        label[i] = first
        return label


def _unpacked(table: pa.Table) -> tuple[list[int], list[np.ndarray], dict[str, list]]:
    """Keys and sets of a group, each key once (rows that repeat id and text come twice), with the other columns."""
    keys = table["key"].to_pylist()
    first = list(dict((k, i) for i, k in reversed(list(enumerate(keys)))).values())[::-1]
    rest = {c: [table[c][i].as_py() for i in first] for c in table.column_names if c not in ("key", "set")}
    return [keys[i] for i in first], [np.frombuffer(table["set"][i].as_py(), np.uint64) for i in first], rest


def _within(least: int):
    """Edges from each set of a group to the first of its component."""

    def compare(batches: Iterator[pa.RecordBatch]):
        for table in runs(batches, "g"):
            keys, sets, _ = _unpacked(table)
            label = Sets(sets, least).components()
            yield _edges([(keys[i], keys[j]) for i, j in enumerate(label)])

    return compare


def _between(least: int):
    """Edges from each visitor of a group to one linked resident of each component. Columns: g, key, set, visitor, root."""

    def compare(batches: Iterator[pa.RecordBatch]):
        for table in runs(batches, "g"):
            # a document may be resident and visitor of one group, so keys are told apart by side
            pairs, sides = [], [table.filter(pa.compute.equal(table["visitor"], flag)) for flag in (False, True)]
            if not all(side.num_rows for side in sides):
                continue
            (keys, sets, rest), (own_keys, own_sets, own_rest) = _unpacked(sides[0]), _unpacked(sides[1])
            both, residents = Sets(sets + own_sets, least), np.arange(len(keys))
            roots = np.array(rest["root"])
            for i, (key, root) in enumerate(zip(own_keys, own_rest["root"])):
                others = residents[roots != root]
                found = both.linked(len(keys) + i, others) if len(others) else others
                pairs += list({rest["root"][j]: (key, keys[j]) for j in found.tolist()}.values())
            yield _edges(pairs)

    return compare


def exact_components(documents: DataFrame, members: DataFrame, scratch: Scratch, like: Similarity) -> DataFrame:
    """(id, root) over keys: components by full sets within classes. `members`: key, rep, text_hash, n, class."""
    weight = members.groupBy("class").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("docs") / like.class_docs, F.col("total") / like.class_shingles)).cast("int")
    placed = members.join(weight.select("class", blocks.alias("blocks")), "class").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = scratch.cut(placed.select("class", "key", "rep", "text_hash", "blocks", "block"), "placed")
    words = like.words

    def load(batches: Iterator[pa.RecordBatch]):
        make = Sketcher(words)
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                sets = pa.array([s.tobytes() for s in make.sets(part["text"])], pa.binary())
                yield pa.RecordBatch.from_arrays([part["class"], part["key"], part["blocks"], part["block"], sets], names=["class", "key", "blocks", "block", "set"])

    texts = documents.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    side = small_enough(placed, 64)
    loaded = texts.join(side, (F.col("hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("class", "key", "blocks", "block", "text")
    loaded = loaded.mapInArrow(load, "class long, key long, blocks int, block int, set binary")
    group = F.xxhash64("class", "block")
    crowded = bool(placed.where("blocks > 1").limit(1).count())
    loaded = scratch.cut(loaded, "sets") if crowded else loaded
    grouped = loaded.select(group.alias("g"), "key", "set").repartition("g").sortWithinPartitions("g")
    edges = scratch.cut(grouped.mapInArrow(_within(like.least), "a long, b long"), "within")
    if not crowded:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # classes of several blocks: hubs first, then whatever is outside the largest component
    large = placed.where("blocks > 1").select("class", "key", "blocks", "block")
    sets = loaded.where("blocks > 1")
    hub = F.row_number().over(_by("class").orderBy(F.xxhash64("key", F.lit("hub"))))
    hubs = scratch.cut(large.withColumn("rank", hub).where(F.col("rank") <= like.hubs).select("class", "key"), "hubs")
    visiting = sets.join(hubs, ["class", "key"], "left_semi")
    edges = edges.union(_visits(sets.withColumn("root", F.lit(0).cast("long")), visiting.withColumn("root", F.lit(1).cast("long")), scratch, like, "hub-edges"))
    loose = large.select(F.col("key").alias("a"), F.col("key").alias("b"))
    roots = _rooted(edges, loose, scratch, "tied")
    of = large.join(roots, F.col("key") == F.col("id")).select("class", "key", "root")
    sizes = of.groupBy("class", "root").agg(F.count("*").alias("size"))
    giants = sizes.groupBy("class").agg(F.max_by("root", F.struct("size", "root")).alias("giant"))
    stray = scratch.cut(of.join(giants, "class").where("root <> giant").select("class", "key", "root"), "stray")
    rooted = sets.join(of.select("key", "root"), "key")
    visiting = sets.join(stray, ["class", "key"])
    edges = edges.union(_visits(rooted, visiting, scratch, like, "stray-edges"))
    return _rooted(edges, loose, scratch, "joined")


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def _visits(residents: DataFrame, visitors: DataFrame, scratch: Scratch, like: Similarity, name: str) -> DataFrame:
    """Every block of visitors meets every block of residents of its class, in a group of its own."""
    came = visitors.select("class", F.col("block").alias("from_block")).distinct()
    home = residents.join(came, "class").select("class", "block", "from_block", "key", "set", "root", F.lit(False).alias("visitor"))
    away = visitors.select("class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "block", "key", "set", "root")
    away = away.select("class", F.col("at").alias("block"), F.col("block").alias("from_block"), "key", "set", "root", F.lit(True).alias("visitor"))
    both = home.union(away).select(F.xxhash64("class", "block", "from_block").alias("g"), "key", "set", "visitor", "root")
    return scratch.cut(both.repartition("g").sortWithinPartitions("g").mapInArrow(_between(like.least), "a long, b long"), name)


def _rooted(edges: DataFrame, loose: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) of all edges' ends and of keys without an edge."""
    roots = connected_components(edges, scratch, name)
    alone = edges.union(loose).select(F.col("a").alias("id")).distinct().join(roots, "id", "left_anti").select("id", F.col("id").alias("root"))
    return roots.union(alone)


# ---- the operator ----


def near_duplicates(documents: DataFrame, like: Similarity = Similarity(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for every row."""
    scratch = scratch or Scratch(documents.sparkSession, "neardup")
    documents = documents.select("doc_id", "text")
    sketches = scratch.cut(sketch(documents, like.words), "sketch")
    found = sketches.where("key IS NOT NULL")
    sets = found.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes"))
    sets = scratch.cut(sets.select("key", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("text_hash"), "n", "sig", "nodes"), "nodes")
    classes = connected_components(candidate_edges(sets, scratch, like), scratch, "classes")
    members = sets.select("key", "rep", "text_hash", "n").join(classes.select(F.col("id").alias("key"), F.col("root").alias("class")), "key")
    roots = exact_components(documents, members, scratch, like)
    named = roots.join(sets.select("key", "rep"), F.col("id") == F.col("key")).select("id", "root", "rep")
    least = named.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("size")).where("size > 1")
    joined = scratch.cut(named.join(least, "root").select(F.col("id").alias("key"), "least"), "roots")
    own = sets.select("key", "rep")
    named = own.join(small_enough(joined, 16), "key", "left").select("key", F.coalesce("least", "rep").alias("component_id"))
    return sketches.select("doc_id", "text_hash", "n", "key").join(named, "key", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def deduplicate(documents: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """The documents of which no earlier near-duplicate exists, with all their columns; of rows that repeat the kept id and text one stays."""
    scratch = Scratch(documents.sparkSession, "neardup")
    marked = near_duplicates(documents, like, scratch)
    marked = scratch.cut(marked.groupBy("doc_id", "text_hash", "component_id").agg(F.count("*").alias("n")), "marked")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    renamed = lambda rows: rows.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    gone, repeated = renamed(marked.where(~kept)), renamed(marked.where(kept & (F.col("n") > 1)))
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"))
    same = lambda side: F.col("row.doc_id").eqNullSafe(side["id"]) & (F.col("h") == side["hash"])
    left = rows
    for side in (gone, repeated):
        left = left.join(small_enough(side, 16), same(side), "left_anti")
    once = rows.join(small_enough(repeated, 16), same(repeated), "left_semi")
    once = once.groupBy(F.col("row.doc_id"), "h").agg(F.first("row").alias("row"))
    return left.select("row.*").union(once.select("row.*"))


def find_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Query op1_neardup: three-word shingles, similarity 0.85."""
    found = near_duplicates(read(spark, sf_dir, "documents"), Similarity(words=3, least=85))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
