"""Scan jobs: life cycle, answers and progress, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TTL_SECONDS = 24 * 3600


def job_status(jobs: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """What polling each job answers at ``now``.

    ``jobs``: scan_id, submitted_at, finished_at (NULL while running), error (NULL unless failed). The
    time to live restarts when a job ends. A failed job answers with a blocking verdict.
    """
    expires = F.coalesce("finished_at", "submitted_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    overdue, running = now > expires, F.col("finished_at").isNull()
    status = (
        F.when(running & overdue, "gone")
        .when(running, "pending")
        .when(overdue, "expired")
        .when(F.col("error").isNotNull(), "error")
        .otherwise("done")
    )
    code = F.when(status == "gone", 404).when(status == "pending", 202).when(status == "expired", 410).otherwise(200)
    return jobs.withColumns(
        {"status": status, "http_status": code, "verdict": F.when(status == "error", "BLOCK")}
    )


def request_check(requests: DataFrame, accepted: Column, pending: Column, max_jobs: int = 1000) -> DataFrame:
    """Admission status of scan requests: content type, sizes, rate, key, shape, queue space, in this order.

    ``requests``: content_type, content_length, authorized, lockfile_before, lockfile_after, ecosystem.
    """
    most = 500 * 1024
    shape = (
        F.col("lockfile_before").isNotNull() & F.col("lockfile_after").isNotNull()
        & (F.length("lockfile_before") <= most) & (F.length("lockfile_after") <= most)
        & (F.col("ecosystem").isNull() | F.col("ecosystem").isin("npm", "pypi"))
    )
    return requests.withColumn(
        "http_status",
        F.when(~F.lower("content_type").contains("application/json"), 415)
        .when(F.col("content_length") > 1024 * 1024, 413)
        .when(~accepted, 429)
        .when(~F.col("authorized"), 401)
        .when(~shape, 400)
        .when(pending >= max_jobs, 503)
        .otherwise(202),
    )


def progress_counts(events: DataFrame, width: str) -> DataFrame:
    """Progress events per tumbling window and kind. Works on a stream when the caller sets a watermark."""
    return (
        events.groupBy(F.window("ts", width), "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "kind", "n")
    )


def new_snapshots_only(arrivals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Packages whose content hash has no snapshot of the current format yet."""
    return arrivals.dropDuplicates(["name", "version", "integrity"]).join(
        snapshots.select("name", "version", "integrity").distinct(), ["name", "version", "integrity"], "left_anti"
    )


def wanted_schema(batch: DataFrame) -> StructType:
    """The columns that a lookup needs; the hash digits stay text, however they look."""
    return StructType([*batch.select("name", "version", "integrity").schema.fields, StructField("bucket", StringType())])


def incremental_analysis(arrivals: DataFrame, snapshot_path: str, analyse, checkpoint: str):
    """Stream of package references: analyse what the snapshot table lacks and append it.

    ``analyse`` maps a DataFrame of references to snapshot rows. Each micro-batch reads the table as
    of its start, so replaying a batch after a failure adds nothing twice. The table is partitioned by two
    hash digits of the content, and a batch reads only the partitions (256 at most) that its content can be in.
    """
    bucket = F.substring(F.sha2("integrity", 256), 1, 2)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        wanted = batch
        try:
            stored = spark.read.schema(wanted_schema(batch)).parquet(snapshot_path)
            buckets = [row[0] for row in batch.select(bucket).distinct().collect()]
            wanted = new_snapshots_only(batch, stored.filter(F.col("bucket").isin(buckets)))
        except Exception as error:  # the table appears with the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            wanted = batch.dropDuplicates(["name", "version", "integrity"])
        analyse(wanted).withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(snapshot_path)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
