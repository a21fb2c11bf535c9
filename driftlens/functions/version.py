"""Version strings as comparable structs, and version ranges as interval rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRICT = (
    r"^[v=\s]*(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)"
    r"(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?\s*\z"
)
LOOSE = r"(?:^|\D)(\d{1,16})(?:\.(\d{1,16}))?(?:\.(\d{1,16}))?(?:\z|\D)"


def _int_or_zero(text: Column) -> Column:
    return F.coalesce(F.when(text != "", text).cast("long"), F.lit(0).cast("long"))


def coerced(version: Column) -> Column:
    """First dotted number in the text as (major, minor, patch); NULL when there is none."""
    major = F.regexp_extract(version, LOOSE, 1)
    return F.when(
        major != "",
        F.struct(
            _int_or_zero(major).alias("major"),
            _int_or_zero(F.regexp_extract(version, LOOSE, 2)).alias("minor"),
            _int_or_zero(F.regexp_extract(version, LOOSE, 3)).alias("patch"),
        ),
    )


def parsed(version: Column) -> Column:
    """Full version as a struct that orders by precedence; NULL unless the text is a valid version.

    A release sorts above its pre-releases; numeric identifiers sort below words.
    """
    pre = F.regexp_extract(version, STRICT, 4)

    def identifier(part):
        numeric = part.rlike(r"^\d+\z")
        return F.struct(
            F.when(numeric, 0).otherwise(1).alias("word"),
            F.when(numeric, part).cast("decimal(38,0)").alias("number"),
            F.when(numeric, "").otherwise(part).alias("text"),
        )

    return F.when(
        version.rlike(STRICT),
        F.struct(
            F.regexp_extract(version, STRICT, 1).cast("long").alias("major"),
            F.regexp_extract(version, STRICT, 2).cast("long").alias("minor"),
            F.regexp_extract(version, STRICT, 3).cast("long").alias("patch"),
            F.when(pre == "", 1).otherwise(0).alias("release"),
            F.transform(F.filter(F.split(pre, r"\."), lambda p: p != ""), identifier).alias("pre"),
        ),
    )


def range_intervals(text: str) -> list[tuple[str | None, bool, str | None, bool]]:
    """``>=1.0.0 <1.6.0 || =0.7.29`` as (low, low inclusive, high, high inclusive) rows."""
    intervals = []
    for alternative in text.split("||"):
        low, low_in, high, high_in = None, True, None, True
        for comparator in re.findall(r"(>=|<=|>|<|=)?\s*([^\s<>=]+)", alternative):
            op, version = comparator
            if op in (">", ">="):
                low, low_in = version, op == ">="
            elif op in ("<", "<="):
                high, high_in = version, op == "<="
            else:
                low = high = version
                low_in = high_in = True
        intervals.append((low, low_in, high, high_in))
    return intervals


def advisory_intervals(spark: SparkSession, advisories) -> DataFrame:
    """One row per affected interval, with both bounds parsed for comparison."""
    rows = [
        (ghsa, cve, package.lower(), severity, *interval)
        for ghsa, cve, package, ranges, severity in advisories
        for interval in range_intervals(ranges)
    ]
    schema = (
        "ghsa string, cve string, package string, severity string, "
        "low string, low_in boolean, high string, high_in boolean"
    )
    return spark.createDataFrame(rows, schema).withColumns(
        {"low_key": parsed(F.col("low")), "high_key": parsed(F.col("high"))}
    )


def inside_interval(key: Column) -> Column:
    above = F.col("low").isNull() | (key > F.col("low_key")) | (F.col("low_in") & (key == F.col("low_key")))
    below = F.col("high").isNull() | (key < F.col("high_key")) | (F.col("high_in") & (key == F.col("high_key")))
    return key.isNotNull() & above & below
