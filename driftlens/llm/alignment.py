"""Alignment of two tokenizers' tokens over the same bytes (operator 11).

Every text is tokenised whole by both: byte-level BPE (A) and pieces (B). Where an A token and a B token end at the same
byte, and the next token of each begins with a space, the documents fall apart into windows, mostly words. A window is
known by its two tuples of ids, and the same words come again and again, so its inner alignment is worked out once and
remembered: the groups between shared ends, their text for the digest, and the linked id pairs with their occurrences.
Windows of more than `LONG` tokens are aligned like any other but not remembered, and the memory is emptied when full.

The tasks write one row a document with its distinct pairs, and Spark counts in how many documents each pair is linked.
Most of all rows belong to few pairs: those with at least `total / HEAVY` documents, of which there cannot be more than
`HEAVY`, whatever the size of the corpus, go to all tasks as a sorted array. The other pairs join by shuffle, where then no
key holds more than `total / HEAVY` rows.

Defined results: a text that is null, empty, or that a tokenizer does not give back byte for byte has no tokens: zeros and
an empty digest. Rows that repeat an id are documents of their own and count as such; a null id is kept as null. An empty
table gives no row. Other columns are ignored. Both vocabulary files must lie at the same path on every executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch, read, slices
from driftlens.llm.packing import PIECES

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Windows of more tokens than this are not remembered; so many windows and pairs are, before the memory is emptied.
LONG, MOST_WINDOWS, MOST_PAIRS = 64, 200_000, 2_000_000
#: Groups with more links are paired by their distinct ids instead of token by token.
LARGE_GROUP = 1 << 14
#: Pairs that are sent to all tasks, at most (17 bytes each).
HEAVY = 1 << 20
#: A pair as one number: the A id above, the B id below.
HALF = 32
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "row_id long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, pairs array<long>, times array<long>"
SCORED = ALIGNED.replace("pairs array<long>, times array<long>", "n_best long, count_sum long, pairs array<long>, times array<long>")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """The bytes of each token of a vocabulary, their number, and whether they begin with a space."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.bytes, self.encode = tokens, encode
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.space = np.array([t[:1] == b" " for t in tokens])


def tokens_a(vocabulary: str = VOCABULARY_A) -> Tokens:
    """A byte-level vocabulary whose ids are in the order of its merges, so that the ids are the ranks. Its special tokens
    are never made: their strings in a text are plain text."""
    import json

    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        content, alphabet = json.load(file), byte_alphabet()
    special = {t["id"] for t in content["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in content["model"]["vocab"].items() if i not in special}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, number in ranks.items():
        tokens[number] = token
    encoding = tiktoken.Encoding("alignment", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return Tokens(tokens, lambda texts: [encoding.encode_ordinary(" " + t) for t in texts])


def tokens_b(model: str = MODEL_B) -> Tokens:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    tokens = [bytes([int(n[3:-1], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return Tokens(tokens, lambda texts: pieces.encode(texts, num_threads=1))


class Column:
    """Whole numbers in one array that grows."""

    def __init__(self, *first: int):
        self.data, self.size = np.zeros(1 << 12, np.int64), 0
        self.extend(np.array(first, np.int64))

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), np.int64)])
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.data[at]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its size."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Windows:
    """Alignments of windows by their tuples of ids: the number of groups and links, the groups as text, and the pairs."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        comma, bar, semicolon = ([f"{i}{mark}" for i in range(max(len(a.bytes), len(b.bytes)))] for mark in ",|;")
        self.words, self.base = comma + bar + semicolon, len(comma)
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.groups, self.links, self.pairs, self.times, self.first = Column(), Column(), Column(), Column(), Column(0)

    def full(self) -> bool:
        return len(self.texts) > MOST_WINDOWS or self.pairs.size > MOST_PAIRS

    def numbers(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
        """The number of each window. Windows end before the tokens `stop_a` and `stop_b`, groups before `end_a` and `end_b`."""
        bytes_a, bytes_b, known, made = a.tobytes(), b.tobytes(), self.known, len(self.texts)
        cut_a, cut_b = [0, *(4 * stop_a).tolist()], [0, *(4 * stop_b).tolist()]
        keys = list(zip([bytes_a[i:j] for i, j in zip(cut_a, cut_a[1:])], [bytes_b[i:j] for i, j in zip(cut_b, cut_b[1:])]))
        out, new = list(map(known.get, keys)), []
        for k in [k for k, number in enumerate(out) if number is None]:
            number = known.get(keys[k])  # the same window may stand earlier in this slice
            if number is None:
                number = made + len(new)
                new.append(k)
                if len(keys[k][0]) + len(keys[k][1]) <= 4 * LONG:
                    known[keys[k]] = number
            out[k] = number
        if new:
            self._add(np.array(new), a, b, stop_a, end_a, end_b)
        return np.array(out, np.int64)

    def _add(self, new: np.ndarray, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> None:
        """Aligns windows that are not known: all at once, group by group."""
        last = np.searchsorted(end_a, stop_a[new], "right")  # every window's end is a group's end
        first = np.where(new > 0, np.searchsorted(end_a, stop_a[new - 1], "right"), 0)
        count = last - first
        group, window = ranges(first, count), np.repeat(np.arange(len(new)), count)
        before = np.maximum(group - 1, 0)
        start_a, start_b = np.where(group > 0, end_a[before], 0), np.where(group > 0, end_b[before], 0)
        size_a, size_b = end_a[group] - start_a, end_b[group] - start_b
        size = size_a * size_b
        self.groups.extend(count)
        self.links.extend(np.bincount(window, size, len(new)).astype(np.int64))

        # the text: all tokens of a group, those of A first, each with the mark that follows it
        ids = np.empty(int((size_a + size_b).sum()), np.int64)
        place = np.cumsum(size_a + size_b) - size_a - size_b
        ids[ranges(place, size_a)], ids[ranges(place + size_a, size_b)] = a[ranges(start_a, size_a)], b[ranges(start_b, size_b)]
        ids[place + size_a - 1] += self.base
        ids[place + size_a + size_b - 1] += 2 * self.base
        ends = np.cumsum(np.bincount(window, size_a + size_b, len(new)).astype(np.int64)).tolist()
        words, codes, i = self.words, ids.tolist(), 0
        for j in ends:
            self.texts.append("".join([words[c] for c in codes[i:j]]))
            i = j

        # the pairs: each A token with each B token of its group; large groups by their distinct ids
        large = size > LARGE_GROUP
        small = np.where(large, 0, size)
        inner = ranges(np.zeros(len(group), np.int64), small)
        width = np.repeat(size_b, small)
        pairs = a[np.repeat(start_a, small) + inner // width].astype(np.int64) << HALF | b[np.repeat(start_b, small) + inner % width]
        times, of = np.ones(len(pairs), np.int64), np.repeat(window, small)
        for g in np.flatnonzero(large).tolist():
            (x, n), (y, m) = (np.unique(ids[s : s + z], return_counts=True) for ids, s, z in ((a, start_a[g], size_a[g]), (b, start_b[g], size_b[g])))
            at = np.searchsorted(of, window[g], "right")
            pairs = np.insert(pairs, at, (x.astype(np.int64)[:, None] << HALF | y).ravel())
            times = np.insert(times, at, np.multiply.outer(n, m).ravel())
            of = np.insert(of, at, np.full(len(x) * len(y), window[g]))
        self.pairs.extend(pairs)
        self.times.extend(times)
        self.first.extend(self.first[self.first.size - 1] + np.cumsum(np.bincount(of, minlength=len(new))))


def align_texts(texts: list[str | None], a: Tokens, b: Tokens, windows: Windows) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """COUNTS of each text (texts by counts), the digests, and the texts' distinct pairs: text numbers, pairs and occurrences."""
    counts, digests = np.zeros((len(texts), len(COUNTS)), np.int64), [""] * len(texts)
    whole = [k for k, t in enumerate(texts) if t]
    chosen, ids_a, ids_b = [], [], []
    for k, own_a, own_b in zip(whole, a.encode([texts[k] for k in whole]), b.encode([texts[k] for k in whole])):
        expected = b" " + texts[k].encode()
        if b"".join([a.bytes[i] for i in own_a]) == expected == b"".join([b.bytes[i] for i in own_b]):
            chosen.append(k)
            ids_a.append(own_a)
            ids_b.append(own_b)
    if not chosen:
        return counts, digests, *(np.zeros(0, np.int64),) * 3
    size_a, size_b = (np.array([len(i) for i in ids]) for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.array([i for own in ids for i in own], np.int32) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(a.size[flat_a]), np.cumsum(b.size[flat_b])
    at = np.searchsorted(end_b, end_a)
    shared = np.flatnonzero(end_b[at] == end_a)  # the ends of texts are among them, and every text begins with a space
    at = at[shared]
    cut = np.append(a.space[flat_a[shared[:-1] + 1]] & b.space[flat_b[at[:-1] + 1]], True)
    if windows.full():
        windows.clear()
    number = windows.numbers(flat_a, flat_b, shared[cut] + 1, at[cut] + 1, shared + 1, at + 1)
    bounds = np.concatenate([[0], np.searchsorted(shared[cut] + 1, np.cumsum(size_a), "right")])
    for column, values in enumerate((size_a, size_b, *(np.add.reduceat(x[number], bounds[:-1]) for x in (windows.groups, windows.links)))):
        counts[chosen, column] = values
    for k, i, j in zip(chosen, bounds.tolist(), bounds[1:].tolist()):
        digests[k] = hashlib.sha256("".join([windows.texts[w] for w in number[i:j].tolist()])[:-1].encode()).hexdigest()
    size = windows.first[number + 1] - windows.first[number]
    place, text = ranges(windows.first[number], size), np.repeat(np.repeat(np.arange(len(chosen)), np.diff(bounds)), size)
    pairs, times = windows.pairs[place], windows.times[place]
    # one number for text and pair sorts faster than two columns
    short = (pairs >> HALF) * len(b.bytes) + (pairs & ((1 << HALF) - 1))
    order = np.argsort(text * (len(a.bytes) * len(b.bytes)) + short)
    text, pairs, times = text[order], pairs[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pairs[1:] != pairs[:-1])]))
    return counts, digests, np.array(chosen)[text[new]], pairs[new], np.add.reduceat(times, new)


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """A list of values for each row; rows come in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, pa.int64()))


def aligned(documents: DataFrame, vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B) -> DataFrame:
    """One row (ALIGNED) for each document, with its distinct linked pairs of ids and how often each occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b, part, made = tokens_a(vocabulary_a), tokens_b(model_b), TaskContext.get().partitionId(), 0
        windows = Windows(a, b)
        for batch in batches:
            for start, stop in slices(batch["text"]):
                own = batch.slice(start, stop - start)
                counts, digests, text, pairs, times = align_texts(own["text"].to_pylist(), a, b, windows)
                first, made = (part << 33) + made, made + len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + len(own))), own["doc_id"].cast(pa.int64()), *(pa.array(c) for c in counts.T.copy()), pa.array(digests, pa.string()), _lists(text, pairs, len(own)), _lists(text, times, len(own))],
                    names=[c.split(" ")[0] for c in ALIGNED.split(", ")],
                )

    return documents.select("doc_id", "text").mapInArrow(rows, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """For each pair of ids the number of documents that hold it linked, and whether that is its A id's highest."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = counts.withColumn("a", F.shiftright("pair", HALF))
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))
    return counts.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("highest")).cast("long").alias("best"))


def alignment_report(documents: DataFrame, vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B, heavy: int = HEAVY) -> DataFrame:
    """Per document its counts, the digest of its groups, and what the corpus says of its links (n_best, count_sum)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = scratch.cut(aligned(documents, vocabulary_a, model_b), "rows")
    counts = scratch.cut(pair_counts(rows), "counts")
    least = (counts.agg(F.sum("docs")).first()[0] or 0) // heavy + 1  # fewer than `heavy` pairs have as many documents
    table = counts.where(F.col("docs") >= least).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "docs", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds what the heavy pairs give; the lists keep the other pairs."""
        known, docs, best = shared.value
        for batch in batches:
            pairs, times = (batch[c].flatten().to_numpy() for c in ("pairs", "times"))
            row = np.repeat(np.arange(len(batch)), batch["pairs"].value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            total = np.zeros((2, len(batch)), np.int64)
            for k, value in enumerate((best, docs)):
                np.add.at(total[k], row[found], times[found] * value[at[found]])
            rest = ~found
            columns = [*batch.columns[:-2], *map(pa.array, total), _lists(row[rest], pairs[rest], len(batch)), _lists(row[rest], times[rest], len(batch))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in SCORED.split(", ")])

    scored = scratch.cut(rows.mapInArrow(score, SCORED), "scored")
    scratch.drop("rows")
    rest = scored.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row_id", "x.pairs", "x.times")
    rest = rest.join(counts.where(F.col("docs") < least), F.col("pairs") == F.col("pair"))
    rest = rest.groupBy("row_id").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    more = lambda own, other: (F.col(own) + F.coalesce(F.col(other), F.lit(0))).alias(own)
    return scored.join(rest, "row_id", "left").select("doc_id", *COUNTS, more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")


def align_documents(spark, sf_dir: str) -> DataFrame:
    """Query op11_alignment: every document under both tokenizers."""
    return alignment_report(read(spark, sf_dir, "documents"))
