"""Quality classifier by compression (operator 10).

zstandard dictionaries are built from text labelled good and from text labelled bad, each in two views: the text as it
is, and its outline (runs of letters, capitals and digits replaced by one sign each), which shows markup and shouting that the
words hide. A text is cut into blocks and every block is compressed with all of them; it compresses better with the
dictionary of its own kind. The normalised differences of the sizes, and the size per byte itself (endless repeats
compress to nothing), are turned into a probability by a logistic curve, fitted on labelled documents that no dictionary
has seen.

Defined results: a null or empty text has no blocks, and gets the score of the labelled share of good documents.
Labels whose quality is null, or whose document is missing, teach nothing. If a class has no labelled text, every score
is that share (0.5 without any label). Documents that repeat an id are scored one by one; the score looks at the text
only. Very long texts are scored over all their blocks.
"""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from driftlens.llm.common import read

#: Labelled documents used to fit, at most, of each class: half for the dictionaries, half for the curve.
SAMPLE = 1200
#: Bytes of each sampled document that reach the driver, at most, in pieces spread over the document; and bytes of a dictionary,
#: which its documents share (327 of each with 600 documents, in pieces spread likewise).
EXCERPT, PIECES = 4096, 4
DICTIONARY = 192 << 10
#: Bytes of text that are compressed at once: short enough that the dictionary counts against the text's own repeats.
BLOCK = 2048
#: The same for outlines, which soon repeat themselves.
PIECE = 160
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit: a fifth of all, by a checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Letters (and bytes of other alphabets), capitals and digits become one sign each; punctuation and white space stay.
OUTLINE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


RUNS = re.compile(rb"(a|A|0)\1+")


def outline_of(text: bytes) -> bytes:
    """The signs of a text with runs of letters, capitals or digits drawn together."""
    return RUNS.sub(rb"\1", text.translate(OUTLINE))


@dataclass
class CompressionModel:
    """The two dictionary texts and the curve over the measures: a weight for each, scaled by centre and spread."""

    good: bytes
    bad: bytes
    prior: float = 0.5
    weights: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()

    def measures(self):
        """A function from a text's bytes to its measures, None without text."""

        def tool(data: bytes) -> zstandard.ZstdCompressor:
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=3)
            return zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)

        tools = [tool(d) for d in (self.bad, self.good, outline_of(self.bad), outline_of(self.good))]

        def measure(text: bytes) -> tuple[float, ...] | None:
            if not text:
                return None
            bad, good = (sum(len(t.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for t in tools[:2])
            outline = outline_of(text)
            bad_outline, good_outline = (sum(len(t.compress(outline[i : i + PIECE])) for i in range(0, len(outline), PIECE)) for t in tools[2:])
            rate = min(1.5, good / len(text))
            return 2.0 * (bad - good) / (bad + good), 2.0 * (bad_outline - good_outline) / (bad_outline + good_outline), rate, rate * rate

        return measure

    def probability(self, measures: tuple[float, ...] | None) -> float:
        if measures is None or not self.weights:
            return self.prior
        z = self.weights[-1] + sum(w * (m - c) / s for w, m, c, s in zip(self.weights, measures, self.centre, self.spread))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _text_bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionModel:
    """Learns from labelled documents that are not held out: a fixed pseudo-random sample of at most `sample` of each class."""
    usable = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("id"), "quality").where(~held_out(F.col("id"))).dropDuplicates(["id"])
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    order = F.xxhash64("id", F.lit("quality"))
    chosen: dict[int, dict[int, int]] = {}
    for label in (0, 1):
        part = usable.where(F.col("quality") == label).orderBy(order, "id").limit(sample)
        for place, row in enumerate(part.collect()):
            chosen.setdefault(place % 2, {})[row["id"]] = label
    excerpt = _excerpt(F.encode(F.col("text"), "utf-8")).alias("text")
    rows = _of(documents, chosen.get(0, {})).select("id", excerpt).collect()
    examples: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(rows, key=lambda r: (r["id"], bytes(r["text"]))):
        examples[chosen[0][row["id"]]].append(bytes(row["text"]))
    if not all(examples.values()):
        return CompressionModel(b"good 0", b"bad 0", prior)
    model = CompressionModel(_dictionary(examples[1]), _dictionary(examples[0]), prior)
    rest = _of(documents, chosen.get(1, {})).select("id", "text")
    points = sorted((tuple(r["measures"]), chosen[1][r["id"]]) for r in _measured(rest, model, ["id"]).collect())
    return _calibrated(model, points) if len({y for _, y in points}) == 2 else model


def _of(documents: DataFrame, ids: dict[int, int]) -> DataFrame:
    """The documents of a bounded set of ids that have text."""
    bounded = documents.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    return documents.select("doc_id", "text").where("text <> ''").join(F.broadcast(bounded), F.col("doc_id") == F.col("id"))


def _excerpt(data: Column) -> Column:
    """A text of at most EXCERPT bytes, or so many bytes of a longer one: pieces from its start to its end."""
    piece, size = EXCERPT // PIECES, F.octet_length(data)
    starts = [(F.floor((size - piece) * i / (PIECES - 1)) + 1).cast("int") for i in range(PIECES)]
    return F.when(size <= EXCERPT, data).otherwise(F.concat(*(F.substring(data, s, F.lit(piece)) for s in starts)))


def _spread(text: bytes, share: int) -> bytes:
    """At most `share` bytes of a text: pieces from its start to its end."""
    if len(text) <= share:
        return text
    piece = share // PIECES
    return b"".join(text[s : s + piece] for s in ((len(text) - piece) * i // (PIECES - 1) for i in range(PIECES)))


def _dictionary(texts: list[bytes]) -> bytes:
    """Raw content: an equal share of each text, spread over it."""
    share = max(256, min(EXCERPT, DICTIONARY // max(1, len(texts))))
    return b"\n".join(_spread(t, share) for t in texts)[-DICTIONARY:].ljust(8)


def _calibrated(model: CompressionModel, points: list[tuple[tuple[float, ...], int]], decay: float = 1e-3) -> CompressionModel:
    """Logistic regression with weight decay by Newton steps. Both classes weigh alike; the intercept then takes the prior."""
    x, y = np.array([m for m, _ in points]), np.array([label for _, label in points], float)
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    x = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    keep = np.diag([decay] * (x.shape[1] - 1) + [1e-9])
    weights = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -60, 60)))
        slope = x.T @ (each * (y - p)) - keep @ weights
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + keep, slope)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    weights[-1] += math.log(model.prior / (1 - model.prior))
    return replace(model, weights=tuple(weights.tolist()), centre=tuple(centre.tolist()), spread=tuple(spread.tolist()))


def _measured(documents: DataFrame, model: CompressionModel, keep: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(asdict(model))

    def measure(batches):
        own = CompressionModel(**shared.value).measures()
        for batch in batches:
            values = pa.array([own(_text_bytes(text)) for text in batch["text"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), values], names=[*keep, "measures"])

    return documents.mapInArrow(measure, documents.select(*keep).schema.add("measures", ArrayType(DoubleType())))


def score(documents: DataFrame, model: CompressionModel, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of the documents with a probability, 0 to 1, that the label is good."""
    shared = documents.sparkSession.sparkContext.broadcast(asdict(model))

    def rate(batches):
        own = CompressionModel(**shared.value)
        measure = own.measures()
        for batch in batches:
            texts = batch["text"] if "text" in batch.schema.names else batch["row"].field("text")
            values = pa.array([own.probability(measure(_text_bytes(text))) for text in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), values], names=[*keep, name])

    return documents.mapInArrow(rate, documents.select(*keep).schema.add(name, "double"))


def score_documents(spark, sf_dir: str) -> DataFrame:
    """Query op10_quality: the score of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(documents, fit(documents, read(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns only."""
    model = fit(documents, labels)
    packed = documents.select(F.struct("*").alias("row"))  # the text goes to the tasks once, within the row
    return score(packed, model, ["row"]).where(F.col("score") >= threshold).select("row.*")
