"""Exact deduplication as a stateful stream (operator 13), with DataFrame functions only.

Two streams keep what is known, both restartable and without expiry. The first reads new files of the documents once and
appends one narrow row a document to a ledger: the digest of its normalised text, its length, its id, and where its content
lies (file and row number). The second folds the ledger into keyed state in RocksDB, on disk: for each digest the document
that stays, with its locator, and the number of copies. The state is merged per task before the shuffle, so a text that a
third of all documents share costs one row a task. A later run over the same `home` only reads files that are new.

A digest that comes again is a hit. The texts of all hits are fetched by their locators and grouped by digest and full
bytes: a digest with one class of bytes is confirmed, and one with several (a collision) is decided by the bytes alone. A
locator is a unique key, and equal bytes merge within a task before they are shuffled, so no group of copies meets in one
task.

Texts are equal when identical after deletion of U+0009 to U+000D and the blank. Of equal texts the longest original (code
points) stays, then the smallest id; a null id comes last, and among equal ids the last locator stays.

Defined results: a null text counts as empty, and empty texts are copies of one another. Rows that repeat an id are rows of
their own; one row of a group is kept, whatever its id. keep_id is null only if no row of the group has an id. An empty table
gives no row. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch

WHITE = " \t\n\x0b\x0c\r"
#: Bytes of new files that one micro-batch takes, at most (a larger file is a batch of its own).
BATCH_BYTES = 256 << 30
#: Memory for the state stores of one executor, in MB; the rest of the state is on its disk.
STATE_MB = 512


def normalised(text: Column) -> Column:
    """The text without white space; six plain replacements are faster than a pattern."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def _open(path: str) -> str:
    """The path as a pattern that matches it alone: a streaming source takes a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


class Ledger:
    """The two streams over one table of documents, their checkpoints and the state, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, home: str, digest_bytes: int = 32, batch_bytes: int = BATCH_BYTES):
        self.spark, self.path, self.home, self.digest_bytes, self.batch_bytes = spark, path, home.rstrip("/"), digest_bytes, batch_bytes
        self.session = spark.newSession()  # the settings of the streams stay out of the caller's session
        for key, value in {
            "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk is set aside for each
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
        }.items():
            self.session.conf.set(key, value)

    def _run(self, writer, name: str) -> None:
        writer.option("checkpointLocation", f"{self.home}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()

    def _stream(self, schema, path: str) -> DataFrame:
        return self.session.readStream.schema(schema).options(maxBytesPerTrigger=str(self.batch_bytes), maxFileAge="36500d").parquet(path)

    def append(self) -> None:
        """Reads the files that are new and appends their rows to the ledger."""
        documents = self._stream(self.spark.read.parquet(self.path).schema, _open(self.path))
        place = documents.metadataColumn("_metadata")
        rows = documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"),
            F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"),
            place["file_path"].alias("file"),
            place["row_index"].alias("row"),
        )
        rows = rows.withColumn("digest", F.substring("sha", 1, self.digest_bytes))
        self._run(rows.writeStream.format("parquet").option("path", f"{self.home}/ledger"), "ledger")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/ledger")

    def fold(self) -> None:
        """Folds new rows of the ledger into the state."""
        seen = self._stream(self.rows().schema, f"{self.home}/ledger").groupBy("digest").agg(F.max(_rank()).alias("best"), F.count(F.lit(1)).alias("copies"))
        self._run(seen.writeStream.format("noop").outputMode("update"), "state")

    def state(self) -> DataFrame:
        """What the state holds: digest, the document that stays (best) and copies."""
        stored = self.session.read.format("statestore").load(f"{self.home}/state-checkpoint")
        best, copies = stored.schema["value"].dataType.names
        return stored.select(F.col("key")[stored.schema["key"].dataType.names[0]].alias("digest"), F.col("value")[best].alias("best"), F.col("value")[copies].alias("copies"))


def _rank() -> Column:
    """Orders documents of one text; the largest stays. The complement of an id turns its order round, without overflow."""
    return F.struct("n_chars", F.bitwise_not("doc_id").alias("id"), "file", "row")


def _decision(rows: DataFrame) -> DataFrame:
    """The result's columns, from rows with their group's best and copies."""
    return rows.select(
        "doc_id",
        F.bitwise_not("best.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_duplicates(spark: SparkSession, path: str, home: str | None = None, digest_bytes: int = 32, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each row of the Parquet table at `path`: doc_id, keep_id, group_size, kept, text_sha256.

    `home` keeps ledger and state for later runs over more files; without it they go to a new folder. A short digest saves
    state and costs more checks, not results.
    """
    scratch = Scratch(spark, "exact")
    ledger = Ledger(spark, path, home or scratch.path("home"), digest_bytes, batch_bytes)
    ledger.append()
    ledger.fold()
    ledger.state().write.parquet(scratch.path("state"))
    placed = scratch.cut(ledger.rows().join(spark.read.parquet(scratch.path("state")), "digest"), "placed")
    if home is None:
        scratch.drop("home")

    documents = spark.read.parquet(path)
    place = documents.metadataColumn("_metadata")
    texts = documents.select("text", place["file_path"].alias("file"), place["row_index"].alias("row"))
    hits = placed.where("copies > 1").select("file", "row", "digest", _rank().alias("rank"))
    full = texts.join(hits, ["file", "row"]).select("digest", "rank", normalised(F.col("text")).alias("bytes"))
    classes = full.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    collided = scratch.cut(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("digest"), "collided")
    if collided.isEmpty():
        return _decision(placed)

    among = full.join(collided, "digest")
    best = among.groupBy("digest", "bytes").agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("copies"))
    by_bytes = among.join(best, ["digest", "bytes"]).select("rank.file", "rank.row", "best", "copies")
    rows = placed.join(collided, "digest", "left_semi").drop("best", "copies").join(by_bytes, ["file", "row"])
    return _decision(placed.join(collided, "digest", "left_anti")).unionByName(_decision(rows))


def find_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13_exact: every document with the one that stays for its text."""
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")
