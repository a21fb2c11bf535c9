"""Reports of other scanners in one layout, for the differential ledger.

Each reader takes rows (report_id, text) holding one JSON report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ["report_id", "scanner", "package", "severity", "cve", "title"]
CVE = r"(CVE-\d{4}-\d{4,7})"


def _severity(word: Column) -> Column:
    upper = F.upper(F.coalesce(word, F.lit("")))
    return F.when(upper == "MEDIUM", "MODERATE").when(upper.isin("LOW", "MODERATE", "HIGH", "CRITICAL", "INFO"), upper).otherwise("INFO")


def _cve(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CVE, 1), F.lit(""))


def npm_audit(reports: DataFrame) -> DataFrame:
    """``vulnerabilities`` by package; advisory objects sit in ``via`` next to plain package names."""
    schema = "vulnerabilities map<string, struct<severity:string, via:array<string>>>"
    entries = reports.select("report_id", F.explode(F.from_json("text", schema)["vulnerabilities"]).alias("package", "v"))
    advisories = entries.select("report_id", "package", "v.severity", F.explode("v.via").alias("via")).filter(F.col("via").startswith("{"))
    title = F.coalesce(F.get_json_object("via", "$.title"), F.lit("advisory"))
    return advisories.select(
        "report_id", F.lit("npm-audit").alias("scanner"), "package",
        _severity(F.coalesce(F.get_json_object("via", "$.severity"), F.col("severity"))).alias("severity"), _cve(F.col("via")).alias("cve"), title.alias("title"),
    )


def osv(reports: DataFrame) -> DataFrame:
    """``results[].packages[].vulnerabilities[]`` with aliases that may name a CVE."""
    schema = (
        "results array<struct<packages:array<struct<package:struct<name:string>,"
        "vulnerabilities:array<struct<id:string,summary:string,aliases:array<string>,database_specific:struct<severity:string>>>>>>>"
    )
    rows = reports.select("report_id", F.explode(F.from_json("text", schema)["results"]).alias("r")).select("report_id", F.explode("r.packages").alias("p"))
    found = rows.select("report_id", F.col("p.package.name").alias("package"), F.explode("p.vulnerabilities").alias("v"))
    return found.select(
        "report_id", F.lit("osv-scanner").alias("scanner"), "package", _severity(F.col("v.database_specific.severity")).alias("severity"),
        _cve(F.concat_ws(" ", "v.id", "v.aliases")).alias("cve"), F.coalesce("v.summary", "v.id").alias("title"),
    )


def guarddog(reports: DataFrame) -> DataFrame:
    """Rule hits per package: every rule with a non-empty result is one finding."""
    schema = "package string, results map<string,string>"
    parsed = reports.select("report_id", F.from_json("text", schema).alias("d"))
    hits = parsed.select("report_id", F.col("d.package").alias("package"), F.explode("d.results").alias("rule", "detail"))
    return hits.filter(~F.coalesce(F.trim("detail"), F.lit("")).isin("", "{}", "[]", "null", "false")).select(
        "report_id", F.lit("guarddog").alias("scanner"), "package", F.lit("HIGH").alias("severity"), F.lit(None).cast("string").alias("cve"), F.col("rule").alias("title")
    )


def unmatched(scanner_findings: DataFrame, ours: DataFrame) -> DataFrame:
    """Findings of other scanners for packages we reported nothing on. ``ours``: package."""
    return scanner_findings.join(ours.select("package").distinct(), "package", "left_anti")


def classified(deltas: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deltas with their recorded class, and those still pending. ``decisions``: scanner, package, title, class."""
    keys = ["scanner", "package", "title"]
    known = deltas.join(decisions.select(*keys, "class").dropDuplicates(keys), keys)
    return known, deltas.join(decisions.select(*keys).distinct(), keys, "left_anti")
