"""Table layouts. One row per fact; every table carries the keys Spark partitions on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identity of one (old snapshot, new snapshot) comparison. from_ver is NULL when there is no old side.
PAIR = ["run_id", "change_id", "package", "from_ver", "to_ver"]

LOCK_NODES = (
    "run_id string, side string, key string, name string, version string, "
    "integrity string, resolved string, ord long"
)
LOCK_EDGES = "run_id string, side string, parent_key string, child_key string, ord long"
WORKSPACE_LINKS = "run_id string, side string, key string, name string, version string, resolved string"
NPM_ALIASES = "run_id string, side string, declared_name string, real_name string, version string, ord long"

FACT_COLUMNS = ["path", "cap", "key", "line", "snippet", "context", "kind", "ord"]
FILE_COLUMNS = ["path", "bytes", "sha256", "parse_error", "entropy", "minified", "suspicious", "ord"]

FINDING_COLUMNS = [
    "run_id", "change_id", "detector", "category", "package", "from_ver", "to_ver", "direction",
    "severity", "confidence", "message", "evidence", "code_kind",
]

SEVERITIES = ["BLOCK", "WARN", "INFO"]


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "BLOCK", 0).when(severity == "WARN", 1).when(severity == "INFO", 2).otherwise(3)


def rank_label(rank: Column) -> Column:
    """Inverse of :func:`severity_rank`; no finding at all reads as CLEAN."""
    return F.when(rank == 0, "BLOCK").when(rank == 1, "WARN").when(rank == 2, "INFO").otherwise("CLEAN")


def direction_of_pair() -> Column:
    return F.when(F.col("from_ver").isNull(), "added").otherwise("changed")


def evidence_of(file: Column, line: Column, snippet: Column) -> Column:
    return F.array(
        F.struct(
            file.cast("string").alias("file"),
            F.coalesce(line, F.lit(1)).cast("int").alias("line"),
            F.substring(snippet, 1, 240).alias("snippet"),
        )
    )


def to_findings(df, detector, category, severity, confidence, message, evidence, code_kind=None):
    """Project detector output onto the findings layout. ``df`` carries the PAIR columns."""

    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    return df.select(
        "run_id", "change_id",
        col(detector).alias("detector"),
        col(category).alias("category"),
        "package", "from_ver", "to_ver",
        direction_of_pair().alias("direction"),
        col(severity).alias("severity"),
        col(confidence).alias("confidence"),
        message.alias("message"),
        evidence.alias("evidence"),
        (code_kind if code_kind is not None else F.lit(None)).cast("string").alias("code_kind"),
    )
