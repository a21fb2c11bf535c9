"""The snapshot table: analysed packages kept by content hash, so nothing is analysed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.hashing import keyed_digest, sha256

FORMAT_VERSION = 2


def sealed(snapshots: DataFrame, key: bytes) -> DataFrame:
    """Adds the content address and a keyed digest over version, integrity and canonical content."""
    body = F.to_json(F.struct(*sorted(snapshots.columns)))
    text = F.concat_ws("\n", F.lit(f"v{FORMAT_VERSION}"), F.lit(str(FORMAT_VERSION)), F.col("integrity"), body)
    return snapshots.withColumns(
        {"format_version": F.lit(FORMAT_VERSION), "address": sha256(F.col("integrity")), "seal": keyed_digest(key)(text)}
    )


def authentic(stored: DataFrame, key: bytes) -> DataFrame:
    """Rows of the current format whose seal holds; anything else counts as missing."""
    extra = ["format_version", "address", "seal", "bucket"]
    plain = stored.filter(F.col("format_version") == FORMAT_VERSION)
    body = F.to_json(F.struct(*sorted(c for c in stored.columns if c not in extra)))
    text = F.concat_ws("\n", F.lit(f"v{FORMAT_VERSION}"), F.lit(str(FORMAT_VERSION)), F.col("integrity"), body)
    return plain.filter(keyed_digest(key)(text) == F.col("seal")).drop(*extra)


def write_snapshots(snapshots: DataFrame, path: str, key: bytes) -> None:
    """Parquet, partitioned by the first hash digit so that lookups of few packages prune files."""
    (
        sealed(snapshots, key).withColumn("bucket", F.substring("address", 1, 1))
        .write.mode("append").partitionBy("bucket").parquet(path)
    )


def read_snapshots(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    return authentic(spark.read.parquet(path), key)


def cached(references: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split references (name, version, integrity) into those with a snapshot and those without."""
    keys = ["name", "version", "integrity"]
    known = snapshots.select(*keys).distinct()
    pinned = F.col("integrity") != ""
    hits = references.filter(pinned).join(known, keys, "left_semi")
    misses = references.filter(pinned).join(known, keys, "left_anti").unionByName(references.filter(~pinned))
    return hits, misses
