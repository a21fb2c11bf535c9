"""Words and word hashes of whole columns of text, computed on the UTF-8 bytes with numpy.

A word is a longest run of characters other than the blank and U+0009 to U+000D. Those characters are single bytes
that never occur inside another character, so bytes can be tested without decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words as a pattern of Java, Python and RE2.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor and multiply rounds): close inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset at which each text begins, one more for the end. Nulls are empty."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


WHITE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: For comparisons that ignore punctuation: every ASCII character but letters and digits separates words.
NOT_ALPHANUMERIC = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _starts(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Flags of bytes in words, and of first bytes of words."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    return inside, first


def word_counts(texts: pa.Array) -> np.ndarray:
    data, offsets = bytes_of(texts)
    total = np.concatenate([[0], np.cumsum(_starts(data, offsets)[1])])
    return total[offsets[1:]] - total[offsets[:-1]]


class WordHasher:
    """64-bit hashes of words: a polynomial in a fixed odd base over random byte values, taken from running sums."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, lower: bool = True, separators: np.ndarray = WHITE):
        self.separators = separators
        self.bytes = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
        if lower:
            self.bytes[65:91] = self.bytes[97:123]
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.power) <= size:
            size = max(size + 1, 1 << 16)
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and the index of each text's first word, one more for the end."""
        data, offsets = bytes_of(texts)
        self._grow(len(data))
        inside, first = _starts(data, offsets, self.separators)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes[data] * self.power[: len(data)])])
        return mix((sums[stop] - sums[start]) * self.inverse[start]), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The set of hashes of all runs of so many words; of fewer words the whole sequence, of none the empty set."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return np.unique(total)
