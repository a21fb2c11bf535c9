"""What the operators of this subpackage share: written intermediate tables, size-checked broadcasts and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that a join may broadcast after its rows were counted.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one on a local master only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context._jsc.sc().isLocal():
        folder = "file://" + tempfile.mkdtemp(prefix="driftlens-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


class Scratch:
    """Tables written below the shared folder. Each cuts the lineage: a lost executor never replays what lies before it."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def cut(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes the frame as a table and reads it back."""
        schema = frame.schema
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all, once nothing reads it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(frame: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its counted rows fit the limit; else the join shuffles it like any other."""
    return F.broadcast(frame) if frame.count() * row_bytes <= limit else frame


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(texts: pa.Array, most_bytes: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes):
        if row > start and held + size > most_bytes:
            yield start, row
            start, held = row, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it. Holds one batch and one key's rows."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        column = table[key].combine_chunks()
        edges = [0, *(pc.indices_nonzero(pc.not_equal(column[1:], column[:-1])).to_numpy() + 1).tolist(), len(column)]
        for start, stop in zip(edges, edges[1:]):
            piece = table.slice(start, stop - start)
            if held and held[-1][key][-1].as_py() != piece[key][0].as_py():
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_tables(held)
