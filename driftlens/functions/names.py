"""Package names, mail addresses and name distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_pypi(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def normalized_hash(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^(sha\d+):([A-Fa-f0-9]+)\z", "$1-$2")


def scope_of(name: Column) -> Column:
    return F.when(name.startswith("@") & name.contains("/"), F.substring_index(name, "/", 1))


def base_of(name: Column) -> Column:
    scoped = name.startswith("@") & name.contains("/")
    return F.when(scoped, F.regexp_replace(name, r"^@[^/]*/", "")).otherwise(name)


def name_tokens(name: Column) -> Column:
    """Distinct hyphen tokens of the unscoped lower-case name, sorted."""
    parts = F.filter(F.split(F.lower(base_of(name)), "-"), lambda t: t != "")
    return F.array_sort(F.array_distinct(parts))


def package_spec(spec: Column) -> Column:
    """``name@version`` with scope support; version defaults to latest; NULL when malformed."""
    s = F.trim(spec)
    pattern = r"^(@[^/]+/[^@]+|[^@]+)(?:@(.*))?\z"
    name = F.regexp_extract(s, pattern, 1)
    version = F.regexp_extract(s, pattern, 2)
    malformed_scope = s.startswith("@") & ~s.rlike(r"^@[^/]+/[^@]+")
    return F.when(
        (name != "") & ~malformed_scope,
        F.struct(name.alias("name"), F.when(version == "", "latest").otherwise(version).alias("version")),
    )


def mail_domain(email: Column) -> Column:
    domain = F.lower(F.substring_index(email, "@", -1))
    return F.when(email.contains("@") & (domain != ""), domain)


def anchor_trusts(email: Column, anchor: Column) -> Column:
    """``@domain`` trusts the domain and its subdomains, a full address itself, a bare word the local part."""
    mail = F.lower(email)
    word = F.lower(anchor)
    local = F.substring_index(mail, "@", 1)
    domain = F.regexp_replace(mail, r"^[^@]*@", "")
    suffix = F.regexp_replace(word, r"^@", "")
    well_formed = mail.rlike(r"^[^@]+@.+")
    return (F.length(anchor) >= 3) & well_formed & (
        F.when(word.startswith("@"), (domain == suffix) | domain.endswith(F.concat(F.lit("."), suffix)))
        .when(word.contains("@"), word == mail)
        .otherwise(word == local)
    )


def deletions_up_to_two(word: Column) -> Column:
    """The word and everything reachable by deleting one or two characters.

    Two words within edit distance two share at least one of these, so candidate pairs come from an
    equality join instead of comparing every name with every name.
    """

    def drop_one(text):
        positions = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            positions,
            lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
        )

    once = drop_one(word)
    twice = F.flatten(F.transform(once, drop_one))
    return F.array_distinct(F.concat(F.array(word), once, twice))


#: Words of this many characters and more are met by their segments, shorter ones by their forms.
LEAST_SEGMENTED = 3
SEGMENTS = 3


def _segment(length: Column, number: Column) -> tuple[Column, Column]:
    """Where a segment of a word of that length begins (from 0), and its length: three of nearly equal length."""
    start = F.floor(number * length / SEGMENTS).cast("int")
    return start, F.floor((number + 1) * length / SEGMENTS).cast("int") - start


def segments(word: Column) -> Column:
    """The three segments of a word with their numbers and the word's length; none of a short word."""
    length = F.length(word)

    def one(number: Column) -> Column:
        start, size = _segment(length, number)
        return F.struct(length.alias("length"), number.alias("number"), F.substring(word, start + 1, size).alias("segment"))

    numbers = F.when(length >= LEAST_SEGMENTED, F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, one)


def _probes() -> list[tuple[int, int, int, bool]]:
    """(difference of lengths, segment, shift, swapped) of the pieces of a word that can equal a segment within two edits.

    Two edits leave one of three segments whole, unless one of them swaps the letters on both sides of a border. Then
    a segment before a border is whole but for its last letter, which stands one place later. Edits before the segment
    shift it, those behind it make up the rest of the difference in length.
    """
    plain = [(d, i, s, False) for d in range(-2, 3) for i in range(SEGMENTS) for s in range(-2, 3) if abs(s) + abs(d - s) <= 2]
    return plain + [(d, i, s, True) for d in (-1, 0, 1) for i in range(SEGMENTS - 1) for s in (-1, 0, 1) if abs(s) + abs(d - s) <= 1]


def segment_probes(word: Column) -> Column:
    """Pieces of a word, at most 49, one of which is a segment of any word of three letters or more within two edits."""
    length = F.length(word)

    def one(p: Column) -> Column:
        other = length - p["difference"]
        start, size = _segment(other, p["number"])
        start = start + p["shift"]
        fits = (other >= LEAST_SEGMENTED) & (start >= 0) & (start + size + p["swapped"].cast("int") <= length)
        piece = F.when(p["swapped"], F.concat(F.substring(word, start + 1, size - 1), F.substring(word, start + size + 1, F.lit(1)))).otherwise(F.substring(word, start + 1, size))
        return F.when(fits, F.struct(other.alias("length"), p["number"].alias("number"), piece.alias("segment")))

    table = F.array(*[
        F.struct(F.lit(d).alias("difference"), F.lit(i).alias("number"), F.lit(s).alias("shift"), F.lit(w).alias("swapped")) for d, i, s, w in _probes()
    ])
    return F.array_distinct(F.array_compact(F.transform(table, one)))


def short_forms(word: Column, most: int) -> Column:
    """What is left of a word of at most ``most`` letters by deleting none, one or two, without the empty rest."""
    none = F.array().cast("array<string>")
    return F.when(F.length(word) <= most, F.filter(deletions_up_to_two(word), lambda f: f != "")).otherwise(none)


CELLS = 20_000_000  # table cells per block of pairs, which bounds memory for long names


def _codes(words: list[str], filler: int) -> np.ndarray:
    width = max(map(len, words))
    table = np.full((width, len(words)), filler, dtype=np.int32)
    for column, word in enumerate(words):
        table[: len(word), column] = [ord(c) for c in word]
    return table


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distance where swapping two neighbours costs one, for many pairs at once.

    The recurrence runs over positions; each step handles every pair of the block as one array.
    """
    a, b = _codes(left, -1), _codes(right, -2)
    steps = np.zeros((len(a) + 1, len(b) + 1, len(left)), dtype=np.int16)
    steps[:, 0, :] = np.arange(len(a) + 1)[:, None]
    steps[0, :, :] = np.arange(len(b) + 1)[:, None]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            edits = np.minimum(np.minimum(steps[i - 1, j], steps[i, j - 1]) + 1, steps[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1:
                swapped = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1])
                edits = np.where(swapped, np.minimum(edits, steps[i - 2, j - 2] + 1), edits)
            steps[i, j] = edits
    ends = [len(w) for w in left], [len(w) for w in right]
    return steps[ends[0], ends[1], np.arange(len(left))].astype(np.int32)


@F.pandas_udf(T.IntegerType())
def edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    if left.empty:
        return pd.Series([], dtype="int32")
    longest = max(left.str.len().max(), right.str.len().max()) + 1
    block = max(1, CELLS // int(longest * longest))
    parts = [edit_distances(list(left[i : i + block]), list(right[i : i + block])) for i in range(0, len(left), block)]
    return pd.Series(np.concatenate(parts))
