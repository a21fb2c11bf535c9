"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings a job needs for the documented semantics; cluster sizing stays with the submitter.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "driftlens", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master may go without; it gets a scratch folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _scratch
    _scratch = _scratch or tempfile.mkdtemp(prefix="driftlens-ckpt-")
    return _scratch


_scratch: str | None = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes an intermediate result to the shared checkpoint folder and reads it back.

    A lost executor never replays the work before it. Unlike an RDD checkpoint the table is columnar, so
    later steps read only the columns they use, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/driftlens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partitions for work that is heavy per row.

    A fixed partition count keeps adaptive coalescing, which looks at bytes only, from putting a small
    but expensive input into one task.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *columns)
