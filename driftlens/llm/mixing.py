"""Mixing sources to target weights by systematic sampling (operator 8).

Each source gets a target number of words. Its documents, in order of size, are laid end to end with their expected
copies as lengths; one random offset is added and a document is emitted once per integer boundary that it crosses.
Neighbours in that order have nearly equal sizes, so the words taken differ from the target by about one document.

The prefix sum needs a rank within the source. It comes from counts by (source, size, bucket): the counts are summed
per source over the few distinct sizes, and only rows of equal source, size and bucket are numbered one by one. No
task gathers a source, and a group of equal documents is split over the buckets.

Defined results: a null or empty text has size 0 and belongs to its source like any other. Sources are ordered by code
point with the null source last. A source without words has target 0. Documents that repeat an id are separate rows.
An empty table gives an empty result. Other columns of the input are kept by `emit` and ignored by `mix`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch, read, slices, small_enough
from driftlens.llm.words import word_counts

#: Buckets by which rows of one source and one size are numbered.
BUCKETS = 1024
MOST_COPIES = 3


def sized(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size[, further columns]) with size the number of words of the text."""
    columns = [c for c in (keep or ["doc_id", "source"]) if c != "text"]

    def count(batches):
        for batch in batches:
            texts = batch["text"]
            counts = [word_counts(texts.slice(start, stop - start)) for start, stop in slices(texts)]  # a few megabytes of text at once
            arrays = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())], names=[*(n for n in batch.schema.names if n != "text"), "size"])

    chosen = documents.select(*columns, "text")
    schema = chosen.drop("text").schema.add("size", "long")
    return chosen.mapInArrow(count, schema)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, docs, target): shares by weight of all words, none above `most` times its own words.

    What a capped source leaves is shared again by weight. Sources reach their cap in the order of cap over weight, so the
    number of capped ones is the first k for which the level of the others does not exceed the next one's ratio.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    level = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (
        by_source.withColumn("weight", weight)
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(level), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    reached = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return ranked.select("source", "source_size", "docs", F.least("cap", F.col("weight") * reached).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1): 32 bits of a digest of seed and name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """The rows of `sizes` with source_size, target and copies. Reruns agree: order and offset are functions of the rows."""
    sizes = scratch.cut(sizes.withColumn("bucket", F.pmod(F.col("doc_id"), F.lit(BUCKETS))), "sizes")
    counts = sizes.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("source", "size", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("smaller"))
    beside = Window.partitionBy("source", "size").orderBy(F.col("bucket").isNull(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(beside), F.lit(0)))
    shares = targets(sizes, weights, most)
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    places = counts.join(by_size, same(counts, by_size, ["source", "size"])).select(
        counts["source"], counts["size"], counts["bucket"], (F.col("before") + F.col("smaller")).alias("base")
    )
    places = places.join(shares, same(places, shares, ["source"])).select(places["source"].alias("s"), places["size"].alias("z"), places["bucket"].alias("b"), "base", "source_size", "target")
    each = Window.partitionBy("source", "size", "bucket").orderBy("doc_id")
    numbered = sizes.withColumn("place", F.row_number().over(each))
    joined = numbered.join(places, [numbered["source"].eqNullSafe(places["s"]), numbered["size"].eqNullSafe(places["z"]), numbered["bucket"].eqNullSafe(places["b"])])
    rank = F.col("base") + F.col("place")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda k: F.floor(k * expected + offset(F.col("source"), seed))
    return joined.withColumn("copies", (crossed(rank) - crossed(rank - 1)).cast("long")).drop("s", "z", "b", "base", "place", "bucket")


def mix_documents(spark, sf_dir: str) -> DataFrame:
    """Query op8_mixing: sizes, targets and the words taken of every document."""
    scratch = Scratch(spark, "mixing")
    mixed = mix(sized(read(spark, sf_dir, "documents")), scratch)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """The documents themselves with all their columns, each as often as the mix takes it.

    Texts stay where they are read: only (id, row hash, copies) meets them, by a broadcast if its counted size allows and
    by a shuffle else. Rows that are equal in every column share their copies and are brought together for that.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    plain = [f.name for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64(*plain).alias("row_hash"))
    sizes = sized(rows.select("row.doc_id", "row.source", "row_hash", "row.text"), ["doc_id", "source", "row_hash"])
    copies = mix(sizes, scratch, weights, most, seed).groupBy("doc_id", "row_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    copies = scratch.cut(copies.where("copies > 0").withColumnRenamed("doc_id", "id").withColumnRenamed("row_hash", "hash"), "copies")

    def taken(frame: DataFrame, side: DataFrame) -> DataFrame:
        return frame.join(side, frame["row"]["doc_id"].eqNullSafe(side["id"]) & (frame["row_hash"] == side["hash"]))

    single = taken(rows, small_enough(copies.where("n = 1"), 40))
    repeated = taken(rows, small_enough(copies.where("n > 1"), 40))
    repeated = repeated.groupBy("row_hash", "id", "copies").agg(F.first("row").alias("row"))
    every = single.select("row", "copies").union(repeated.select("row", "copies"))
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
