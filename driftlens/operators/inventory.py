"""Findings that come from the inventories themselves, added after escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import text as X
from driftlens.schema import evidence_of


def _findings(df, detector, category, package, from_ver, to_ver, direction, severity, confidence, message, evidence):
    def col(value):
        return F.lit(value) if value is None or isinstance(value, str) else value

    return df.select(
        "run_id", "change_id",
        col(detector).alias("detector"), col(category).alias("category"), package.alias("package"),
        col(from_ver).cast("string").alias("from_ver"), col(to_ver).cast("string").alias("to_ver"),
        col(direction).alias("direction"), col(severity).alias("severity"), col(confidence).alias("confidence"),
        message.alias("message"), evidence.alias("evidence"), F.lit(None).cast("string").alias("code_kind"),
    )


def integrity_mismatches(changes: DataFrame) -> DataFrame:
    """Same version, different content hash; one side may be blank."""
    rows = changes.filter(F.col("kind") == "integrity-changed")
    blank = F.col("integrity_old") == ""
    return _findings(
        rows, "integrity.hash-mismatch", "INTEG", F.col("name"), F.col("version_old"), F.col("version_new"),
        "changed", "BLOCK", "high",
        F.when(blank, F.lit("the earlier inventory had no integrity value for this version")).otherwise(
            F.lit("same version with a different integrity value")
        ),
        evidence_of(
            F.lit("package.json"), F.lit(1),
            F.concat(
                F.lit("integrity "), F.when(blank, F.lit("<missing>")).otherwise(F.col("integrity_old")),
                F.lit(" → "), F.col("integrity_new"),
            ),
        ),
    )


def failed_analyses(changes: DataFrame, failures: DataFrame) -> DataFrame:
    """A package that could not be analysed blocks, once per package and run.

    ``failures`` has (run_id, name, version, error). A failure on the new side of a change wins over
    one seen only on the old side.
    """
    arriving = changes.select(
        "run_id", "change_id", "name", F.col("version_new").alias("version"), "version_old", "kind"
    )
    rows = (
        failures.join(arriving, ["run_id", "name", "version"], "left")
        .withColumn("order", F.struct(F.col("change_id").isNull().cast("int"), "version"))
        .groupBy("run_id", "name")
        .agg(F.min_by(F.struct("change_id", "version", "version_old", "kind", "error"), "order").alias("f"))
        .select("run_id", "name", "f.*")
    )
    return _findings(
        rows.withColumn("change_id", F.coalesce("change_id", F.concat(F.lit("failed:"), "name"))),
        "analysis.failed", "META", F.col("name"),
        F.when(F.col("kind").isNotNull(), F.col("version_old")).otherwise(F.col("version")),
        F.when(F.col("kind").isNotNull(), F.col("version")),
        F.when(F.col("kind") == "added", "added").otherwise("changed"),
        "BLOCK", "high",
        F.concat(F.lit("the package could not be analysed, so nothing is known about it: "), F.col("error")),
        evidence_of(F.lit("package.json"), F.lit(1), F.col("error")),
    )


def workspace_shadows(links: DataFrame, popular: DataFrame | None = None) -> DataFrame:
    """Link entries in the new inventory; a popular name makes the shadowing blocking."""
    rows = links.filter((F.col("side") == "new") & (F.col("name") != ""))
    if popular is not None:
        top = popular.select("name").distinct().withColumn("top", F.lit(True))
        rows = rows.join(top, "name", "left")
    else:
        rows = rows.withColumn("top", F.lit(None).cast("boolean"))
    return _findings(
        rows.withColumn("change_id", F.concat(F.lit("link:"), "key")),
        "deps.workspace-shadowing", "DEPS", F.col("name"), None, F.when(F.col("version") != "", F.col("version")),
        "added", F.when(F.col("top"), "BLOCK").otherwise("WARN"), "medium",
        F.concat(F.lit("linked entry "), F.col("key"), F.lit(" is not analysed and may shadow a registry package")),
        evidence_of(
            F.col("key"), F.lit(1),
            F.concat(
                F.lit('"link": true, "name": "'), F.col("name"), F.lit('", "resolved": "'),
                F.coalesce("resolved", F.lit("")), F.lit('"'),
            ),
        ),
    )


def aliased_names(aliases: DataFrame) -> DataFrame:
    rows = (
        aliases.filter(F.col("side") == "new")
        .groupBy("run_id", "declared_name", "real_name")
        .agg(F.min_by("version", "ord").alias("version"))
        .withColumn("change_id", F.concat(F.lit("alias:"), "declared_name", F.lit(":"), "real_name"))
    )
    installed = F.concat(F.col("real_name"), F.lit("@"), F.col("version"))
    return _findings(
        rows, "deps.aliased-name", "DEPS", F.col("declared_name"), None,
        F.when(F.col("version") != "", F.col("version")), "added", "WARN", "high",
        F.concat(F.lit("the declared name installs "), installed),
        evidence_of(
            F.concat(F.lit("node_modules/"), F.col("declared_name")), F.lit(1),
            F.concat(F.col("declared_name"), F.lit("@npm:"), installed),
        ),
    )


def unusual_sources(changes: DataFrame) -> DataFrame:
    """Git sources of any arriving package, local file sources of added ones; once per package and kind."""
    rows = (
        changes.filter((F.col("kind") != "removed") & F.col("key_new").isNotNull())
        .withColumn("source", X.resolved_kind(F.col("resolved_new")))
        .filter(F.col("source").isNotNull())
        .groupBy("run_id", "name", "source")
        .agg(
            F.min_by(
                F.struct("change_id", "kind", "version_old", "version_new", "key_new", "resolved_new"),
                F.struct("kind", F.coalesce("version_new", F.lit(""))),
            ).alias("c")
        )
        .select("run_id", "name", "source", "c.*")
        .filter((F.col("source") == "git") | (F.col("kind") == "added"))
    )
    git = F.col("source") == "git"
    return _findings(
        rows,
        F.when(git, "deps.non-registry-source").otherwise("deps.local-source"), "DEPS", F.col("name"),
        F.when(git, F.col("version_old")), F.col("version_new"),
        F.when(F.col("kind") == "added", "added").otherwise("changed"),
        F.when(git, "WARN").otherwise("INFO"), F.when(git, "high").otherwise("medium"),
        F.concat(
            F.when(git, F.lit("installed from version control: ")).otherwise(F.lit("installed from a local file: ")),
            F.col("resolved_new"),
        ),
        evidence_of(F.col("key_new"), F.lit(1), F.concat(F.lit("resolved: "), F.col("resolved_new"))),
    )
