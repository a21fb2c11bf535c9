"""Token ids packed into fixed rows by best fit decreasing (operator 2).

Each task tokenises the documents of its partition, splits documents longer than a row into pieces, and packs the pieces
of a bounded buffer: longest first, each into the open row with the least room that still holds it. The row is found in a
segment tree over room sizes, so a piece costs a logarithm of the row length, not a walk over rows. Nothing is shuffled;
the buffer bounds memory and decides which pieces may share a row.

A packed row holds `ids` padded to the row length, the `cu_seqlens` of its pieces (cumulative lengths from 0), the
`position_ids` that restart at every piece, and the `doc_ids` and `piece` numbers of its pieces in order.

Defined results: null and empty texts have no tokens and appear in no row. A document longer than a row fills rows with
its first pieces and packs the rest; pieces in order of number give back its ids without loss. Rows that repeat an id are
packed as documents of their own. A null id is kept as null. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftlens.llm.common import read

ROW_LENGTH = 2048
PAD = 50256
#: Tokens that are packed together, at most (a document's own tokens on top).
BUFFER = 1 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts text before merging: a fixed value of that vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PACKED = "row_id long, doc_ids array<long>, piece array<int>, cu_seqlens array<int>, n_tokens int, ids array<int>, position_ids array<int>"


def tokenizer(vocabulary: str = VOCABULARY):
    """A function from a text to its token ids (numpy). The vocabulary file must lie at the same path on every executor."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class RoomTree:
    """Open rows by room: a segment tree over the sizes 0 to n that finds the smallest size in use not below a given one."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.used = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.used[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) of the tightest open row, or None."""
        node = size + self.leaves
        if not self.used[node]:
            while node > 1 and (node & 1 or not self.used[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.used[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            self.used[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], most: int) -> list[list[int]]:
    """The rows, each a list of indices of pieces of at most `most`, in the order in which they were placed."""
    tree, rows = RoomTree(most), []
    for index in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[index])
        room, row = found or (most, len(rows))
        if not found:
            rows.append([])
        rows[row].append(index)
        tree.add(room - sizes[index], row)
    return rows


def pack(documents: DataFrame, row_length: int = ROW_LENGTH, vocabulary: str = VOCABULARY, pad: int = PAD, buffer: int = BUFFER) -> DataFrame:
    """The packed rows of all documents (PACKED). row_id is the partition's number and a count in it, as Spark's own increasing ids."""

    def packed(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        encode, part, made = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush():
            nonlocal made
            rows = best_fit_decreasing([len(p[2]) for p in pieces], row_length)
            for start in range(0, len(rows), 256):
                yield _batch(pieces, rows[start : start + 256], (part << 33) + made)
                made += len(rows[start : start + 256])

        for batch in batches:
            for doc, cell in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = cell.as_py()
                ids = encode(text) if text else ()
                for number, start in enumerate(range(0, len(ids), row_length)):
                    pieces.append((doc, number, ids[start : start + row_length]))
                held += len(ids)
                if held >= buffer:
                    yield from flush()
                    pieces, held = [], 0
        yield from flush()

    def _batch(pieces, rows, first_id):
        docs, numbers, ends, sizes, ids, places = [], [], [], [], [], []
        for row in rows:
            lengths = [len(pieces[i][2]) for i in row]
            docs.append([pieces[i][0] for i in row])
            numbers.append([pieces[i][1] for i in row])
            ends.append(np.cumsum([0, *lengths]).tolist())
            sizes.append(sum(lengths))
            line = np.full(row_length, pad, np.int32)
            line[: sizes[-1]] = np.concatenate([pieces[i][2] for i in row])
            ids.append(line)
            places.append(np.concatenate([np.arange(n, dtype=np.int32) for n in [*lengths, row_length - sizes[-1]]]))
        fixed = lambda parts: pa.ListArray.from_arrays(pa.array(np.arange(0, (len(parts) + 1) * row_length, row_length), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array(range(first_id, first_id + len(rows)), pa.int64()), pa.array(docs, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(sizes, pa.int32()), fixed(ids), fixed(places)],
            names=["row_id", "doc_ids", "piece", "cu_seqlens", "n_tokens", "ids", "position_ids"],
        )

    return documents.select("doc_id", "text").mapInArrow(packed, PACKED)


def pack_documents(spark, sf_dir: str) -> DataFrame:
    """Query op2_packing: all documents as packed rows."""
    return pack(read(spark, sf_dir, "documents"))
