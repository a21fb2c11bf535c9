"""Severity escalation by co-occurrence, then advisory notes and technique tags.

The three escalation rules depend on one another, but every later rule can be stated in terms of
counts taken before the first. One aggregate per (change, package) therefore decides all three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import fixed_values as V
from driftlens.functions.version import advisory_intervals, inside_interval, parsed

SCOPE = ["run_id", "change_id", "package"]
TYPO = "deps.typosquat-candidate"


def _package_signals(findings: DataFrame) -> DataFrame:
    category, severity = F.col("category"), F.col("severity")
    warn, block = severity == "WARN", severity == "BLOCK"
    dangerous = (category == "CODE") & F.col("code_kind").isin(V.DANGEROUS_CODE_KINDS)
    counts = {f"warn_{c}": F.count_if(warn & (category == c)) for c in V.CATEGORIES}
    counts.update(
        partners=F.bool_or(category.isin(V.OBF_PARTNER_CATEGORIES) | F.coalesce(dangerous, F.lit(False))),
        blocks=F.bool_or(block & category.isin(V.CAPABILITY_CATEGORIES)),
        typo_warns=F.count_if(warn & (F.col("detector") == TYPO)),
        dangerous_warns=F.count_if(warn & F.coalesce(dangerous, F.lit(False))),
        warn_ids=F.collect_set(F.when(warn, F.struct("category", "detector"))),  # at most one per detector id
    )
    return findings.groupBy(*SCOPE).agg(*[expr.alias(name) for name, expr in counts.items()])


def decide(findings: DataFrame, network_pairs: DataFrame) -> DataFrame:
    """Per (change, package): which of the three escalations apply.

    ``network_pairs`` lists the (run_id, change_id) whose new URL is really used as a network argument.
    """
    signals = _package_signals(findings).join(
        network_pairs.select("run_id", "change_id").distinct().withColumn("network_argument", F.lit(True)),
        ["run_id", "change_id"],
        "left",
    )
    # rule 1: concealment next to a capability
    signals = signals.withColumn("lift_obf", F.col("partners") & (F.col("warn_OBF") > 0)).withColumn(
        "warn_OBF", F.when(F.col("lift_obf"), 0).otherwise(F.col("warn_OBF"))
    )

    def kinds():
        total = F.lit(0)
        for c in V.CATEGORIES:
            total = total + (F.col(f"warn_{c}") > 0).cast("int")
        return total

    # rule 2: look-alike name next to blocking capability or two kinds of warning
    signals = signals.withColumn(
        "lift_typo", (F.col("typo_warns") > 0) & (F.col("blocks") | F.col("lift_obf") | (kinds() >= 2))
    ).withColumn(
        "warn_DEPS", F.when(F.col("lift_typo"), F.col("warn_DEPS") - F.col("typo_warns")).otherwise(F.col("warn_DEPS"))
    )
    # rule 3: accumulated warnings
    warns = F.lit(0)
    for c in V.CATEGORIES:
        warns = warns + F.col(f"warn_{c}")
    signals = signals.withColumn("n_warn", warns).withColumn("n_kind", kinds())
    network = F.coalesce("network_argument", F.lit(False))
    attack = F.lit(False)
    for a, b in V.ATTACK_PAIRS:
        both = (F.col(f"warn_{a}") > 0) & (F.col(f"warn_{b}") > 0)
        attack = attack | (both & network if "NET" in (a, b) else both)
    only = lambda c: (F.col("n_kind") == 1) & (F.col(f"warn_{c}") > 0)
    compound = (
        ((F.col("n_warn") >= 3) & (F.col("n_kind") >= 2))
        | ((F.col("n_warn") >= 2) & attack)
        | ((F.col("n_warn") >= 3) & only("OBF"))
        | ((F.col("dangerous_warns") >= 3) & only("CODE"))
    )
    still_warning = F.filter(
        "warn_ids",
        lambda w: ~(F.col("lift_obf") & (w["category"] == "OBF")) & ~(F.col("lift_typo") & (w["detector"] == TYPO)),
    )
    return signals.withColumn("lift_all", compound).select(
        *SCOPE, "lift_obf", "lift_typo", "lift_all", "n_warn", "n_kind",
        F.array_sort(F.transform(still_warning, lambda w: w["detector"])).alias("warn_detectors"),
    )


def escalate(findings: DataFrame, network_pairs: DataFrame) -> DataFrame:
    decisions = decide(findings, network_pairs).filter("lift_obf or lift_typo or lift_all")
    warn = F.col("severity") == "WARN"
    by_obf = F.col("lift_obf") & warn & (F.col("category") == "OBF")
    by_typo = F.col("lift_typo") & warn & (F.col("detector") == TYPO)
    by_all = F.col("lift_all") & warn
    why = (
        F.when(by_obf, F.lit(" [escalated: concealment together with other capabilities]"))
        .when(by_typo, F.lit(" [escalated: look-alike name with further signals]"))
        .when(
            by_all,
            F.concat(
                F.lit(" [escalated: "), F.col("n_warn").cast("string"), F.lit(" warnings of "),
                F.col("n_kind").cast("string"), F.lit(" kinds from "), F.array_join("warn_detectors", ", "), F.lit("]"),
            ),
        )
        .otherwise(F.lit(""))
    )
    columns = findings.columns
    return (
        findings.join(decisions, SCOPE, "left")
        .withColumn("message", F.concat("message", why))
        .withColumn("severity", F.when(F.coalesce(by_obf | by_typo | by_all, F.lit(False)), "BLOCK").otherwise(F.col("severity")))
        .select(*columns)
    )


def advisory_matches(versions: DataFrame, intervals: DataFrame) -> DataFrame:
    """(package, version, ghsa, cve, relation) for exact and adjacent advisory hits.

    Adjacent: the version itself is clear, but one within three patches or one minor step is not.
    Distinct versions join on the package name; the interval test filters inside the join.
    """
    table = intervals.withColumnRenamed("package", "listed")
    keyed = versions.select("package", "version").distinct().withColumn("key", parsed(F.col("version")))
    joined = keyed.filter(F.col("key").isNotNull()).join(table, F.lower("package") == F.col("listed"))

    def neighbour(minor, patch):
        return F.struct(
            F.col("key.major").alias("major"), minor.alias("minor"), patch.alias("patch"),
            F.lit(1).alias("release"), F.slice(F.col("key.pre"), 1, 0).alias("pre"),
        )

    patches = [neighbour(F.col("key.minor"), F.col("key.patch") + d) for d in (-3, -2, -1, 1, 2, 3)]
    minors = [neighbour(F.col("key.minor") + d, F.lit(0).cast("long")) for d in (-1, 1)]
    near = F.exists(
        F.filter(F.array(*patches, *minors), lambda v: (v["patch"] >= 0) & (v["minor"] >= 0)),
        lambda v: inside_interval(v),
    )
    return (
        joined.groupBy("package", "version", "ghsa", "cve")
        .agg(F.bool_or(inside_interval(F.col("key"))).alias("hit"), F.bool_or(near).alias("near"))
        .filter("hit or near")
        .withColumn("relation", F.when(F.col("hit"), "affected").otherwise("adjacent"))
        .select("package", "version", "ghsa", "cve", "relation")
    )


def annotate_advisories(findings: DataFrame, intervals: DataFrame) -> DataFrame:
    version = F.coalesce("to_ver", "from_ver")
    keyed = findings.withColumn("version", version)
    cite = F.concat("ghsa", F.coalesce(F.concat(F.lit(" ("), F.col("cve"), F.lit(")")), F.lit("")))
    affected = F.col("relation") == "affected"
    notes = (
        advisory_matches(keyed.select("package", "version"), intervals)
        .groupBy("package", "version")
        .agg(
            F.array_join(F.sort_array(F.collect_list(F.when(affected, cite))), ", ").alias("affected"),
            F.array_join(F.sort_array(F.collect_list(F.when(~affected, cite))), ", ").alias("adjacent"),
        )
        # adjacency is only noted when nothing matches exactly
        .withColumn("adjacent", F.when(F.col("affected") == "", F.col("adjacent")).otherwise(F.lit("")))
    )
    hit, near = F.coalesce("affected", F.lit("")) != "", F.coalesce("adjacent", F.lit("")) != ""
    return (
        keyed.join(notes, ["package", "version"], "left")
        .withColumn(
            "message",
            F.concat(
                "message",
                F.when(hit, F.concat(F.lit(" [GHSA: "), F.col("affected"), F.lit("]"))).otherwise(F.lit("")),
                F.when(near, F.concat(F.lit(" [adjacent GHSA: "), F.col("adjacent"), F.lit("]"))).otherwise(F.lit("")),
            ),
        )
        .withColumn(
            "confidence",
            F.when(hit, "high").when(near & (F.col("confidence") == "low"), "medium").otherwise(F.col("confidence")),
        )
        .select(*findings.columns)
    )


def builtin_advisories(spark: SparkSession) -> DataFrame:
    return advisory_intervals(spark, V.ADVISORIES)


def technique_tags(findings: DataFrame) -> DataFrame:
    """Adds ``mitre``: a lookup in a literal map of 28 detector ids, evaluated in place without a join."""
    pairs = []
    for detector, tags in V.TECHNIQUE_TAGS.items():
        pairs += [F.lit(detector), F.array(*[F.lit(t) for t in tags])]
    found = F.try_element_at(F.create_map(*pairs), F.col("detector"))
    return findings.withColumn("mitre", F.coalesce(found, F.array().cast("array<string>")))


def checked(findings: DataFrame) -> DataFrame:
    """Fails the job on a malformed finding instead of dropping it."""
    bad_evidence = (F.size("evidence") < 1) | F.exists(
        "evidence",
        lambda e: e["file"].isNull() | (e["file"] == "") | e["line"].isNull() | e["snippet"].isNull() | (e["snippet"] == ""),
    )
    wrong_added = (F.col("direction") == "added") & F.col("from_ver").isNotNull()
    wrong_removed = (F.col("direction") == "removed") & (F.col("to_ver").isNotNull() | (F.col("severity") != "INFO"))
    wrong_tag = F.exists("mitre", lambda t: ~t.rlike(r"^T\d{4}(\.\d{3})?\z"))
    problem = (
        F.when(F.coalesce(bad_evidence, F.lit(True)), "evidence missing or incomplete")
        .when(wrong_added, "an added package has no earlier version")
        .when(wrong_removed, "a removed package has no later version and is INFO")
        .when(wrong_tag, "malformed technique id")
    )
    return findings.withColumn(
        "detector", F.when(problem.isNull(), F.col("detector")).otherwise(F.raise_error(F.concat(F.lit("invalid finding: "), problem)))
    )
