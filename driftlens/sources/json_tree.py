"""Leaves of nested JSON, several levels of all documents at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.session import cut_lineage

#: Levels that one pass goes down. Deeper documents take further passes, so this bounds no depth.
LEVELS = 6


def string_leaves(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys, leaf, depth long) for every string below an object or array, repeated ones included; depth 1 is the top level.

    All documents go down together, `LEVELS` levels a pass: a string found on the way is handed on as it is, everything else
    is replaced by its children. A pass writes its strings and the objects and arrays that are still open, and the next
    pass takes the open ones, until none is left. Jobs are as many as the deepest document has passes. Null, a bare
    string and text that is no JSON have no leaves; numbers, booleans and nulls are none. A text that repeats a name
    within an object is refused by the parser: see `unreadable`.
    """
    spark = texts.sparkSession
    level = texts.select(
        *keys, F.lit(None).cast("string").alias("leaf"), F.lit(0).cast("long").alias("depth"), F.try_parse_json(column).alias("v")
    ).filter("v is not null")
    found = None
    while True:
        for _ in range(LEVELS):
            child = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).filter("leaf is not null or value is not null")
            # of the values that JSON has, only a string becomes binary; a schema would cost a walk over all that lies below
            child = child.withColumn("string", F.try_variant_get("value", "$", "binary").cast("string"))
            level = child.select(
                *keys, F.coalesce("leaf", "string").alias("leaf"), F.when(F.col("leaf").isNull(), F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
                F.when(F.col("string").isNull(), F.col("value")).alias("v"),
            )
        kind = F.when(F.col("leaf").isNull(), F.schema_of_variant("v"))
        step = level.withColumn("v", F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.col("v")))
        step = cut_lineage(step.filter("leaf is not null or v is not null"))
        leaves = step.filter("leaf is not null").select(*keys, "leaf", "depth")
        found = leaves if found is None else found.unionByName(leaves)
        level = step.filter("v is not null")
        if level.isEmpty():
            return found


def unreadable(texts: DataFrame, column: str = "text") -> DataFrame:
    """The rows whose text looks like an object or array but is refused by the parser (broken, or with repeated names)."""
    return texts.filter(F.col(column).rlike(r"^\s*[\[{]") & F.try_parse_json(column).isNull())
