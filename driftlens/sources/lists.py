"""Plain-text inputs: name lists, domain lists, version bumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty, non-comment lines with their byte-order position in the file."""
    whole = spark.read.text(path, wholetext=True)
    return (
        whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
        .select("ord", F.trim("line").alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    )


def read_popular_names(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.col("line").alias("name"), F.col("ord").cast("long").alias("ord"))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.lower("line").alias("domain"))


def read_bumps(spark: SparkSession, path: str) -> DataFrame:
    """``package@old..new`` lines; the new side may repeat the package name."""
    pattern = r"^(.+?)@([^\s@]+?)\.\.(?:.*@)?([^\s@]+)$"
    return (
        _lines(spark, path)
        .select(
            F.regexp_extract("line", pattern, 1).alias("package"), F.regexp_extract("line", pattern, 2).alias("old_version"),
            F.regexp_extract("line", pattern, 3).alias("new_version"), F.col("ord").cast("long").alias("ord"),
        )
        .filter("package != ''")
    )
