"""Verdicts, scores, studies and coverage: plain grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.schema import rank_label, severity_rank

SCORE = "decimal(12,2)"


def verdicts(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(rank_label(F.min(severity_rank(F.col("severity")))).alias("verdict"))


def exit_code(verdict: Column, forced: Column) -> Column:
    base = F.when(verdict == "BLOCK", 2).when(verdict == "WARN", 1).otherwise(0)
    return F.when(forced, F.greatest(base, F.lit(2))).otherwise(base)


def finding_weight() -> Column:
    """base x confidence x direction in hundredths; exact, so sums do not depend on order."""
    base = F.when(F.col("severity") == "BLOCK", 5).when(F.col("severity") == "WARN", 2).otherwise(0)
    confidence = F.when(F.col("confidence") == "high", 10).when(F.col("confidence") == "medium", 7).otherwise(5)
    direction = F.when(F.col("direction") == "changed", 8).when(F.col("direction") == "removed", 3).otherwise(10)
    return base * confidence * direction


def risk_scores(findings: DataFrame, keys: list[str]) -> DataFrame:
    """0 to 10 in steps of 0.1, rounded half up."""
    total = F.least(F.lit(1000), F.sum(finding_weight().cast("long")))
    return findings.groupBy(*keys).agg((F.floor((total + 5) / 10) / 10).cast("double").alias("risk_score"))


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    severity = F.col("severity")
    return findings.groupBy(*keys).agg(
        F.count_if(severity == "BLOCK").alias("block"),
        F.count_if(severity == "WARN").alias("warn"),
        F.count_if(severity == "INFO").alias("info"),
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("category").alias("categories"),
    )


def finding_order() -> list[Column]:
    """Total order inside a run: severity, package, detector (dictionary order), first evidence."""
    first = F.get("evidence", F.lit(0))
    return [
        severity_rank(F.col("severity")), F.collate("package", "UNICODE"), F.collate("detector", "UNICODE"),
        F.collate(first["file"], "UNICODE"), first["line"],
    ]


# --- studies: one row per version bump -------------------------------------------------------

def bump_rows(findings: DataFrame, bumps: DataFrame) -> DataFrame:
    """(bump keys, verdict, finding_count, detectors, error). Bumps without findings are CLEAN."""
    keys = ["package", "old_version", "new_version"]
    per_bump = findings.groupBy(*keys).agg(
        F.min(severity_rank(F.col("severity"))).alias("rank"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set("detector")).alias("hit_detectors"),
    )
    failed = F.col("error").isNotNull()
    return bumps.join(per_bump, keys, "left").select(
        *keys,
        F.when(failed, "ERROR").otherwise(rank_label(F.col("rank"))).alias("verdict"),
        F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("finding_count"),
        F.when(failed | F.col("hit_detectors").isNull(), F.array().cast("array<string>")).otherwise(F.col("hit_detectors")).alias("detectors"),
        "error",
    )


def npm_study_summary(rows: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    succeeded = F.count_if(ok)
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        succeeded.alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("finding_count"))), F.lit(0)).alias("findings"),
        *[F.count_if(ok & (F.col("verdict") == v)).alias(v.lower()) for v in ("BLOCK", "WARN", "INFO", "CLEAN")],
        F.when(succeeded > 0, F.sum(F.when(ok, F.col("finding_count"))) / succeeded).otherwise(0.0).alias("findings_per_bump"),
    )


def npm_detector_rates(rows: DataFrame) -> DataFrame:
    """Bumps hit per detector (each bump counts once) over the bumps that succeeded."""
    ok = rows.filter(F.col("error").isNull())
    hits = ok.select(F.explode("detectors").alias("detector")).groupBy("detector").agg(F.count(F.lit(1)).alias("hits"))
    succeeded = ok.agg(F.count(F.lit(1)).alias("n"))
    return hits.select("detector", "hits", (F.col("hits") / succeeded.scalar()).alias("rate"))


def worst_offenders(rows: DataFrame, k: int = 10) -> DataFrame:
    """Top-k report: Spark keeps k rows per partition before merging."""
    return rows.filter(F.col("error").isNull()).orderBy(F.desc("finding_count"), "package", "new_version").limit(k)


def batch(rows: DataFrame, order: list[str], offset: int, size: int | None) -> DataFrame:
    chosen = rows.orderBy(*order).offset(offset)
    return chosen if size is None else chosen.limit(size)


def pypi_study_summary(rows: DataFrame) -> DataFrame:
    """Rates over all rows, failed ones included; an empty study divides by one."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    verdict = F.col("verdict")
    return rows.agg(
        *[F.count_if(verdict == v).alias(v.lower()) for v in ("BLOCK", "WARN", "INFO", "CLEAN", "ERROR")],
        (F.count_if(verdict == "BLOCK") / total).alias("block_rate"),
        (F.count_if(verdict.isin("BLOCK", "WARN")) / total).alias("warn_or_block_rate"),
    )


def pypi_detector_hits(findings: DataFrame) -> DataFrame:
    """Hits per finding, not per bump."""
    return findings.groupBy("detector").agg(F.count(F.lit(1)).alias("hits"))


# --- coverage, assurance ----------------------------------------------------------------------

def coverage(members: DataFrame) -> DataFrame:
    """Covered share per class plus the overall row; ``members`` has (class_id, member_id, covered)."""
    grouped = members.rollup("class_id").agg(
        F.count_if("covered").alias("covered"), F.count(F.lit(1)).alias("total"), F.grouping("class_id").alias("g")
    )
    return grouped.select(
        F.when(F.col("g") == 1, "(overall)").otherwise(F.col("class_id")).alias("class_id"),
        "covered", "total",
        F.when(F.col("total") == 0, 100).otherwise(F.floor(F.col("covered") * 100 / F.col("total"))).cast("long").alias("percent"),
    )


def uncovered(members: DataFrame) -> DataFrame:
    return members.filter(~F.col("covered")).select("class_id", "member_id")


def pass_rates(outcomes: DataFrame, bucket: str) -> DataFrame:
    """Passed share per bucket; NULL when a bucket holds only skipped cases."""
    status = F.col("status")
    return outcomes.groupBy(bucket).agg(
        F.count_if(status == "passed").alias("passed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(~status.isin("passed", "failed")).alias("skipped"),
        F.avg(F.when(status == "passed", 1.0).when(status == "failed", 0.0)).alias("rate"),
    )


def ledger(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("class", "scanner").agg(F.count(F.lit(1)).alias("deltas"))


def ledger_note(deltas: DataFrame, pending: DataFrame) -> DataFrame:
    marked = deltas.select(F.lit(1).alias("d")).unionByName(pending.select(F.lit(0).alias("d")))
    d, p = F.count_if(F.col("d") == 1), F.count_if(F.col("d") == 0)
    return marked.agg(
        F.when((d == 0) & (p == 0), F.lit("0 deltas"))
        .when(p == 0, F.concat(d.cast("string"), F.lit(" deltas, all classified")))
        .otherwise(F.concat(d.cast("string"), F.lit(" classified, "), p.cast("string"), F.lit(" PENDING (ledger not clean)")))
        .alias("note")
    )


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First row per key; the top-1 window is trimmed per partition before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def fixture_results(fixtures: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per fixture: verdict (CLEAN without findings), number of findings, distinct detectors in order.

    ``fixtures``: fixture_id, year, threat, active. Findings are counted per fixture and detector first, so a fixture with a
    third of all findings costs one row per task and detector. Findings of unknown fixtures are left out.
    """
    per = findings.groupBy("fixture_id", "detector").agg(F.count(F.lit(1)).alias("n"), F.min(severity_rank(F.col("severity"))).alias("rank"))
    per = per.groupBy("fixture_id").agg(F.sum("n").alias("findings"), rank_label(F.min("rank")).alias("verdict"), F.array_sort(F.collect_set("detector")).alias("detectors"))
    return fixtures.join(per, "fixture_id", "left").select(
        "fixture_id", "year", "threat", "active", F.coalesce("verdict", F.lit("CLEAN")).alias("verdict"), F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("detectors", F.array().cast("array<string>")).alias("detectors"),
    )


def detection_totals(results: DataFrame) -> DataFrame:
    """Totals by threat and year, by threat, by year and over all, from one aggregate over `fixture_results`.

    Fixtures of a tier that is not active are counted but do not enter the rate; a group without an active fixture has no
    rate (null), which the text states. Rates are rounded half up in whole per mille. ``level`` tells a total from a group
    whose own threat or year is null. An empty table has no totals.
    """
    caught = F.col("active") & (F.col("verdict") != "CLEAN")
    totals = results.groupingSets([["threat", "year"], ["threat"], ["year"], []], "threat", "year").agg(
        F.grouping_id().alias("g"), F.count("fixture_id").alias("fixtures"), F.count_if("active").alias("measured"),
        F.count_if(caught).alias("caught"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
    )
    mille = F.floor((F.col("caught") * 2000 + F.col("measured")) / (F.col("measured") * 2))
    text = F.concat(F.floor(mille / 10).cast("string"), F.lit("."), (mille % 10).cast("string"), F.lit("%"))
    return totals.select(
        F.when(F.col("g") == 0, "threat and year").when(F.col("g") == 1, "threat").when(F.col("g") == 2, "year").otherwise("all").alias("level"),
        "threat", "year", "fixtures", "measured", "caught", (F.col("measured") - F.col("caught")).alias("missed"), "findings",
        F.when(F.col("measured") > 0, mille / 1000).alias("rate"), F.when(F.col("measured") > 0, text).otherwise("no data").alias("rate_text"),
    )
