"""Benchmark decontamination by spaced seeds (operator 6).

A seed is a mask over a window of words; positions with a 0 are ignored, so a window is still found when those words were
substituted. The windows of the benchmark are hashed under every mask into an index, the windows of every document are
looked up in it, and each hit is verified: along its diagonal, `WINDOW` aligned words (all of a shorter item) must agree
in four fifths; or, where words were also put in or left out, the text around the hit must hold `IN_ORDER` of the item's
words in their order. Words are compared without regard to case of A to Z and to ASCII punctuation.

The benchmark is a query set of stated size and meets all documents in blocks of at most about `BLOCK_BYTES` of item text.
A block's index takes about twelve bytes per byte of text. It is broadcast, its pass is written, and it is destroyed before
the next is sent; the last one stays as long as the result. Documents are not shuffled, so a passage that a
third of all documents share costs one lookup per document.

Defined results: null and empty texts and items never match. An item of fewer words than the widest mask must occur word
for word; an item of fewer than `LEAST_WORDS` words is no evidence and matches nothing. Items that repeat an id report
that id once per document. Documents that repeat an id are compared one by one. A null item id is reported as null. An
empty benchmark or an empty table gives no hit. Other columns, whatever their names, are kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch, read, slices
from driftlens.llm.words import NOT_ALPHANUMERIC, WordHasher, mix

#: 1: the word counts, 0: it may differ. All masks span twelve words or fewer. By enumeration, every window of WINDOW words, and
#: every item of WIDEST, that differs in two words or fewer is met by one of them.
MASKS = ("111011010111", "110110111011", "11110001111", "1110110011", "11011101", "1110111", "111111")
WIDEST = max(map(len, MASKS))
WINDOW = 13
AGREE = 0.8
#: Share of an item's words, and number of words at least, that count as the item if they stand in order around a hit.
IN_ORDER, LEAST_IN_ORDER = 0.6, 10
LEAST_WORDS = 5
BLOCK_BYTES = 8 << 20
HITS = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of the words under the mask, by the window's first word."""
    count = len(words) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, len(mask), np.uint64)
    for k, sign in enumerate(mask):
        if sign == "1":
            total = (total ^ words[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return mix(total)


def _half(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


class SeedIndex:
    """The windows of some items: for each mask half hashes in order with the window's place among all words, and a bit table
    that rules out most lookups. Two halves that agree by chance cost one verification."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        hasher = WordHasher(separators=NOT_ALPHANUMERIC)
        self.ids = [i for i, _ in items]
        self.words, first = hasher(pa.array([t for _, t in items], pa.string()))
        self.first = np.asarray(first, np.int64)
        size = np.diff(self.first)
        short = sorted({n for n in size.tolist() if LEAST_WORDS <= n < WIDEST})
        seeds = [*((m, False) for m in MASKS), *(("1" * n, True) for n in short)]  # True: for items of just that length
        self.masks = [mask for mask, _ in seeds]
        self.tables = []
        for mask, whole in seeds:
            hashes = seed_hashes(self.words, mask)
            place = np.arange(len(hashes))
            item = self.item(place)
            inside = place + len(mask) <= self.first[item + 1]
            chosen = inside & (size[item] == len(mask) if whole else size[item] >= WIDEST)
            hashes, place = hashes[chosen], place[chosen].astype(np.uint32)
            half = _half(hashes)
            order = np.argsort(half, kind="stable")
            bits = np.zeros(1 << max(12, (8 * len(half)).bit_length()), bool)  # one in eight or fewer is set
            bits[hashes & np.uint64(len(bits) - 1)] = True
            self.tables.append((half[order], place[order], np.packbits(bits, bitorder="little")))

    def item(self, place: np.ndarray) -> np.ndarray:
        """The item that holds a place among all words; items without words hold none."""
        return np.searchsorted(self.first, place, "right") - 1

    def own(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item + 1]]

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.first.nbytes + sum(a.nbytes for table in self.tables for a in table)

    @classmethod
    def of(cls, state: dict) -> SeedIndex:
        """An index from the plain values that a broadcast carries."""
        index = cls.__new__(cls)
        vars(index).update(state)
        return index

    def hits(self, words: np.ndarray, first: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """For each text with windows of the index its (item, diagonal) pairs. `first` has the texts' first words and the end;
        the diagonal is the place in the text less the place in the item."""
        found: dict[int, set[tuple[int, int]]] = {}
        for mask, (halves, places, bits) in zip(self.masks, self.tables):
            own = seed_hashes(words, mask)
            slot = own & np.uint64(8 * len(bits) - 1)
            set_bit = bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
            at = np.flatnonzero(set_bit) if len(halves) else np.zeros(0, np.int64)
            text = np.searchsorted(first, at, "right") - 1
            inside = at + len(mask) <= first[text + 1] if len(at) else np.zeros(0, bool)
            at, text = at[inside], text[inside]
            half = _half(own[at])
            low, high = np.searchsorted(halves, half, "left"), np.searchsorted(halves, half, "right")
            for k in np.flatnonzero(high > low).tolist():
                p, pairs = int(at[k] - first[text[k]]), found.setdefault(int(text[k]), set())
                place = places[low[k] : high[k]].astype(np.int64)
                item = self.item(place)
                pairs.update(zip(item.tolist(), (p - (place - self.first[item])).tolist()))
        return found

    def overlapping(self, words: np.ndarray, first: np.ndarray) -> list[dict[int, tuple[int, int, int, int]]]:
        """`verified` for each text."""
        found = self.hits(words, first)
        return [self.verified(words[a:b], found[i]) if i in found else {} for i, (a, b) in enumerate(zip(first, first[1:]))]

    def verified(self, words: np.ndarray, pairs: set[tuple[int, int]]) -> dict[int, tuple[int, int, int, int]]:
        """For each item that overlaps: places in text and item, length and equal words of its best stretch."""
        best: dict[int, tuple[int, int, int, int]] = {}
        unsure: dict[int, list[int]] = {}
        for item, diagonal in sorted(pairs):
            own = self.own(item)
            start, stop = max(0, -diagonal), min(len(own), len(words) - diagonal)
            equal = own[start:stop] == words[start + diagonal : stop + diagonal]
            width = min(WINDOW, len(own))
            share = 1.0 if len(own) < WIDEST else AGREE
            sums = np.concatenate([[0], np.cumsum(equal)])
            good = np.flatnonzero(sums[width:] - sums[:-width] >= share * width) if len(equal) >= width else ()
            if len(good):
                a, b = int(good[0]), int(good[-1]) + width  # from the first to the last window that agrees
                entry = (start + diagonal + a, start + a, b - a, int(sums[b] - sums[a]))
                if item not in best or entry[3] > best[item][3]:
                    best[item] = entry
            elif len(own) >= WIDEST:
                unsure.setdefault(item, []).append(diagonal)
        for item, diagonals in unsure.items():
            if item not in best:
                found = [e for d in diagonals if (e := self._in_order(words, item, d))]
                if found:
                    best[item] = max(found, key=lambda e: e[3])
        return best

    def _in_order(self, words: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int, int] | None:
        """The words of the item that the text around a diagonal holds in order, if they are enough (longest common subsequence)."""
        own = self.own(item)
        slack = len(own) // 3
        low, high = max(0, diagonal - slack), min(len(words), diagonal + len(own) + slack)
        near = words[low:high]
        before = np.zeros(len(near) + 1, np.int64)
        for word in own:
            step = np.maximum(before[1:], before[:-1] + (near == word))
            before[1:] = np.maximum.accumulate(step)
        total = int(before[-1])
        return (low, 0, len(own), total) if total >= max(LEAST_IN_ORDER, IN_ORDER * len(own)) else None


def _blocks(benchmark: DataFrame) -> Iterator[SeedIndex]:
    """Indexes of all items, block by block: the driver holds one block, whose text has at most about BLOCK_BYTES."""
    items = benchmark.select("item_id", "text").where("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=repr)
        if rows:
            yield SeedIndex(rows)


def _scan(documents: DataFrame, index: SeedIndex, schema, make) -> tuple[DataFrame, Broadcast]:
    """Looks every text up in one block; make(batch, overlaps, index) gives a batch of output. Also the block as it is sent."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(index))

    def search(batches: Iterator[pa.RecordBatch]):
        hasher, own = WordHasher(separators=NOT_ALPHANUMERIC), SeedIndex.of(shared.value)
        for batch in batches:
            texts, overlaps = batch["text"] if "text" in batch.schema.names else batch["row"].field("text"), []
            for start, stop in slices(texts):
                overlaps += own.overlapping(*hasher(texts.slice(start, stop - start)))
            yield make(batch, overlaps, own)

    return documents.mapInArrow(search, schema), shared


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row (HITS) for each document and item that overlap, with the longest verified stretch."""

    def rows(batch, found, index):
        out = []
        for doc, hits in zip(batch["doc_id"].to_pylist(), found):
            best: dict[int | None, tuple] = {}
            for item, entry in hits.items():  # items that repeat an id count once
                kept = best.setdefault(index.ids[item], entry)
                best[index.ids[item]] = max(kept, entry, key=lambda e: e[3])
            out += [(doc, item, *entry) for item, entry in best.items()]
        columns = list(zip(*out)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split(" ")[0] for x in HITS.split(", ")])

    spark = documents.sparkSession
    scratch, result, held = Scratch(spark, "leaks"), spark.createDataFrame([], HITS), None
    for number, index in enumerate(_blocks(benchmark)):
        if held:  # the hits of a block are written before the next block is sent
            result = result.unionByName(scratch.cut(held[0], f"block{number}"))
            held[1].destroy()
        held = _scan(documents.select("doc_id", "text"), index, HITS, rows)
    return result.unionByName(held[0]) if held else result


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, with all their columns."""
    packed = documents.select(F.struct("*").alias("row"))  # the text goes to the tasks once, within the row

    def rows(batch, found, _):
        return batch.filter(pa.array([not hits for hits in found], pa.bool_()))

    scratch, held = Scratch(documents.sparkSession, "clean"), None
    for number, index in enumerate(_blocks(benchmark)):
        if held:
            packed = scratch.cut(packed, f"block{number}")
            held.destroy()
        packed, held = _scan(packed, index, packed.schema, rows)
    return packed.select("row.*")


def find_leaks(spark, sf_dir: str) -> DataFrame:
    """Query op6_decontaminate: every overlap of a document with a benchmark item."""
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
