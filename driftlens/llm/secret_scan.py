"""Secret scan by assignment-aware lexing (operator 4).

Base spans come from three fixed patterns. The lexer then reads source and configuration syntax: it finds names followed
by an assignment sign, parses the value as an expression of quoted literals, names, `+` and adjacent literals (or as a bare
value where a line holds nothing else), and keeps the values of names as references to their parts. If a sensitive name
receives a value that looks like a secret as a whole (length, mixture of signs, no placeholder in any part), every
assignment is reported whose literal the value holds, over any number of names between. Literals are reported as kind
`assign`, from name to end of value.

Defined results: null and empty texts have no spans. Offsets are code points, ends exclusive. A span of the method that
overlaps a base span of its kind is not repeated. Equal names: the assignment that precedes the use counts. Rows that
repeat an id are scanned one by one; other columns are ignored. Very long texts are scanned whole; all patterns are
linear in the text, a value takes memory for its parts and distinct characters only, and spans are merged in order. An
empty table gives no row.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from driftlens.llm.common import read

KINDS = ("assign", "access", "hex")
#: The base patterns: fixed values of the contract.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

#: Parts of names that make a target sensitive, alone or before "key".
SENSITIVE = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "privatekey", "accesskey", "secretkey", "authkey"}
BEFORE_KEY = {"api", "access", "secret", "private", "auth", "signing", "encryption", "client", "master"}
STEM = re.compile(r"(?ai:pass|pwd|secret|token|key|credential)")
PLACEHOLDER = re.compile(r"(?ai:change.?me|example|placeholder|your[_-]|dummy|redacted|none|null|true|false|undefined)")
QUOTED = re.compile(r"""\"((?:[^"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`""")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*", re.A)
JOINER = re.compile(r"[\x20\t]*(?:\+|\.\.|&)?[\x20\t]*(?:\\?\n[\x20\t]*)?", re.A)
BARE = re.compile(r"[^\s#;,\"']+[\x20\t]*$", re.A | re.M)
#: A name, whatever its length, with a sign of assignment. The look-behind keeps a name from being tried at each of its letters.
TARGET = re.compile(r"(?<![\w$.-])[.-]*+([\w$][\w$.-]*+)[\"']?\]?[\"']?[\x20\t]*+(?:=>|:=|=(?!=)|:(?!:))[\x20\t]*+", re.A)
LINE_HEAD = re.compile(r"[\x20\t]*+(?:(?:export|set|const|let|var)\b)?[\x20\t]*+[\"'.-]*+", re.A)
#: From this score on a value is taken for a secret.
LEAST_SCORE = 2.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def name_parts(name: str) -> list[str]:
    """The lower-case parts of a name, cut at signs and where capitals begin."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def is_sensitive(name: str) -> bool:
    parts = name_parts(name)
    return any(p in SENSITIVE for p in parts) or any(a in BEFORE_KEY and b == "key" for a, b in zip(parts, parts[1:]))


class Value:
    """What a name stands for: literals and other values in order, as references, with what a score needs of the whole.

    Nothing is joined, so `a = a + a` doubles a number and not a text. A value knows the span of its own assignment, and
    through its parts all assignments whose literals it holds.
    """

    def __init__(self, start: int):
        self.start, self.end = start, start
        self.parts: list[Value] = []
        self.literal = self.blank = self.placeholder = self.told = False
        self.length, self.first = 0, ""
        self.counts: Counter[str] = Counter()

    def add_literal(self, text: str, end: int) -> None:
        self.literal, self.end = True, end
        self._add(len(text), text[:1], Counter(text), bool(re.search(r"\s", text)), bool(PLACEHOLDER.search(text)))

    def add_value(self, value: Value, end: int) -> None:
        self.parts.append(value)
        self.end = end
        self._add(value.length, value.first, value.counts, value.blank, value.placeholder)

    def _add(self, length: int, first: str, counts: Counter[str], blank: bool, placeholder: bool) -> None:
        self.first = self.first or first
        self.length += length
        self.counts.update(counts)
        self.blank |= blank
        self.placeholder |= placeholder

    def score(self) -> float:
        """How much the value looks like a secret: bits per character, more for mixed kinds of signs; 0 for placeholders."""
        if self.length < 6 or self.placeholder or self.blank or len(self.counts) == 1 or self.first in "<{$%":
            return 0.0
        bits = -sum(n / self.length * math.log2(n / self.length) for n in self.counts.values())
        kinds = sum(any(re.match(p, c) for c in self.counts) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return bits + 0.5 * (kinds - 1)


def literal_score(text: str) -> float:
    value = Value(0)
    value.add_literal(text, len(text))
    return value.score()


def _expression(text: str, start: int, at: int, constants: dict[str, Value]) -> Value | None:
    """The value at a place, for an assignment that begins at `start`; None where it is no constant."""
    value = Value(start)
    while True:
        if quoted := QUOTED.match(text, at):
            value.add_literal(next(g for g in quoted.groups() if g is not None), quoted.end() - 1)
            at = quoted.end()
            adjacent = True
        elif name := IDENTIFIER.match(text, at):
            if name[0] not in constants or text[name.end() : name.end() + 1] == "(":
                return None
            value.add_value(constants[name[0]], name.end())
            at, adjacent = name.end(), False
        else:
            return None
        joined = JOINER.match(text, at)
        if not any(sign in joined[0] for sign in ("+", "..", "&")):
            if not (adjacent and "\n" not in joined[0] and joined.end() > at and QUOTED.match(text, joined.end())):
                return value
        at = joined.end()


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the method, in one pass: a name stands for its last assignment before the use. Texts without a sensitive
    stem are not lexed."""
    if not STEM.search(text):
        return []
    spans: list[tuple[str, int, int]] = []
    constants: dict[str, Value] = {}
    line, line_end, head_end = 0, text.find("\n"), LINE_HEAD.match(text).end()
    for target in TARGET.finditer(text):
        start, place = target.start(1), target.end()
        while 0 <= line_end < start:
            line, line_end = line_end + 1, text.find("\n", line_end + 1)
            head_end = -1
        if head_end < 0:
            head_end = LINE_HEAD.match(text, line).end()
        value = _expression(text, start, place, constants)
        if value:
            constants[target[1]] = value
        else:
            constants.pop(target[1], None)  # what it holds now is not known
        if not is_sensitive(target[1]):
            continue
        if value and value.score() >= LEAST_SCORE:
            waiting = [value]
            if value.parts:
                spans.append(("assign", value.start, value.end))
            while waiting:  # each assignment is told once, so the walks add up to the text
                own = waiting.pop()
                if not own.told:
                    own.told = True
                    waiting += reversed(own.parts)
                    if own.literal:
                        spans.append(("assign", own.start, own.end))
        elif not value and head_end == start and (bare := BARE.match(text, place)):
            found = bare[0].rstrip()
            if literal_score(found) >= LEAST_SCORE:
                spans.append(("assign", start, place + len(found)))
    return spans


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans that the method adds where none of their kind is yet."""
    base = base_spans(text or "")
    taken = sorted((a, b) for k, a, b in base if k == "assign")
    added = []
    for kind, a, b in lexed_spans(text or ""):
        at = bisect.bisect_left(taken, (b,))  # taken spans do not overlap, so only the one before can reach in
        if not at or taken[at - 1][1] <= a:
            taken.insert(at, (a, b))
            added.append((kind, a, b))
    return base, added


def find_secrets(documents: DataFrame) -> DataFrame:
    """One row (RESULT) for each document."""

    def search(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                base, added = scan(text.as_py())
                counts = Counter(k for k, _, _ in base)
                rows.append((doc, *(counts[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split(" ")[0] for x in RESULT.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(search, RESULT)


def scan_documents(spark, sf_dir: str) -> DataFrame:
    """Query op4_secrets: secrets of every document."""
    return find_secrets(read(spark, sf_dir, "documents"))
