"""Configuration filters, admission decisions, receipts and the merge gate."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import fixed_values as V
from driftlens.functions import hashing as H
from driftlens.schema import SEVERITIES, severity_rank


class ConfigError(ValueError):
    """The configuration text is not acceptable."""


@dataclass(frozen=True)
class Config:
    allowlist: dict[str, list[str]] = field(default_factory=dict)
    severityOverride: dict[str, str] = field(default_factory=dict)
    ignorePackages: list[str] = field(default_factory=list)
    ignorePathsInside: dict[str, list[str]] = field(default_factory=dict)
    trustedPublishers: dict[str, list[str]] = field(default_factory=dict)
    failOn: list[str] = field(default_factory=list)


def parse_config(text: str) -> Config:
    """Strict reading: unknown keys, unknown names and short match strings are errors."""
    try:
        raw = json.loads(text)
    except ValueError as error:
        raise ConfigError(f"configuration is not valid JSON: {error}") from error
    if not isinstance(raw, dict):
        raise ConfigError("configuration is not an object")
    if raw.pop("version", 1) != 1:
        raise ConfigError("version: must be 1")
    known = set(Config.__dataclass_fields__)
    problems = [f"{key}: unknown key" for key in raw if key not in known]

    def need(ok, where, what):
        if not ok:
            problems.append(f"{where}: {what}")

    def long_enough(value):
        return isinstance(value, str) and len(value.strip()) >= 3

    for key in ("allowlist", "severityOverride", "ignorePathsInside", "trustedPublishers"):
        need(isinstance(raw.get(key, {}), dict), key, "must be an object")
    for key in ("ignorePackages", "failOn"):
        need(isinstance(raw.get(key, []), list), key, "must be a list")
    if not problems:
        for package, categories in raw.get("allowlist", {}).items():
            need(package and isinstance(categories, list) and set(categories) <= set(V.CATEGORIES), f"allowlist.{package}", "must list known categories")
        for detector, severity in raw.get("severityOverride", {}).items():
            need(long_enough(detector) and severity in SEVERITIES, f"severityOverride.{detector}", "must be a known severity")
        for key in ("ignorePathsInside", "trustedPublishers"):
            for package, values in raw.get(key, {}).items():
                need(package and isinstance(values, list) and all(map(long_enough, values)), f"{key}.{package}", "needs strings of at least 3 characters")
        need(all(isinstance(p, str) and p for p in raw.get("ignorePackages", [])), "ignorePackages", "needs names")
        need(all(map(long_enough, raw.get("failOn", []))), "failOn", "needs strings of at least 3 characters")
    if problems:
        raise ConfigError("; ".join(problems))
    return Config(**raw)


def config_tables(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """One small DataFrame per configuration map."""

    def pairs(mapping):
        return [(k, v) for k, values in mapping.items() for v in values]

    return {
        "allow": spark.createDataFrame(pairs(config.allowlist), "package string, category string"),
        "override": spark.createDataFrame(list(config.severityOverride.items()), "detector string, severity string"),
        "ignore": spark.createDataFrame([(p,) for p in config.ignorePackages], "package string"),
        "ignore_path": spark.createDataFrame(pairs(config.ignorePathsInside), "package string, prefix string"),
        "trust": spark.createDataFrame(pairs(config.trustedPublishers), "package string, anchor string"),
        "fail_on": spark.createDataFrame([(d,) for d in config.failOn], "detector string"),
    }


def _by_package(tables: dict[str, DataFrame]) -> DataFrame:
    """The rules of each package in one row; the entries are written by hand, so few per package."""
    kinds = {"ignore": None, "ignore_path": "prefix", "allow": "category", "trust": "anchor"}
    parts = [
        tables[kind].select("package", F.lit(kind).alias("kind"), (F.col(value) if value else F.lit(None).cast("string")).alias("value"))
        for kind, value in kinds.items()
    ]
    entries = functools.reduce(DataFrame.unionByName, parts)
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("value")))
    return entries.groupBy("package").agg(
        F.bool_or(F.col("kind") == "ignore").alias("ignored"), of("ignore_path").alias("prefixes"), of("allow").alias("allowed"), of("trust").alias("anchors")
    )


def apply_config(findings: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Ignore, ignore by path, allow-list, override, trust: in this order.

    The tables keyed by package become one, so findings are joined once by package and once by detector. Two detectors
    are exempt from every rule.
    """
    exempt = F.col("detector").isin(V.ALWAYS_APPLY)
    columns = findings.columns
    df = findings.join(_by_package(tables), "package", "left").join(tables["override"].withColumnRenamed("severity", "forced"), "detector", "left")
    first_file = F.get("evidence", F.lit(0))["file"]
    first_snippet = F.get("evidence", F.lit(0))["snippet"]
    usable = lambda values: F.filter(values, lambda v: F.length(F.trim(v)) >= 3)
    under = F.exists(usable(F.col("prefixes")), lambda p: first_file.startswith(p))
    df = df.filter(exempt | ~(F.coalesce("ignored", F.lit(False)) | F.coalesce(under, F.lit(False))))
    allowed = ~exempt & F.coalesce(F.array_contains("allowed", F.col("category")), F.lit(False))
    trusted = (F.col("detector") == "meta.maintainer-change") & F.coalesce(
        F.exists(usable(F.col("anchors")), lambda a: first_snippet.contains(a)), F.lit(False)
    )
    severity = (
        F.when(trusted, "INFO")
        .when(~exempt & F.col("forced").isNotNull(), F.col("forced"))
        .when(allowed, "INFO")
        .otherwise(F.col("severity"))
    )
    note = F.concat(
        F.when(allowed, F.concat(F.lit(" [allowlisted: "), F.col("category"), F.lit("]"))).otherwise(F.lit("")),
        F.when(trusted, F.lit(" [trusted publisher]")).otherwise(F.lit("")),
    )
    return df.withColumns({"severity": severity, "message": F.concat("message", note)}).select(*columns)


def forced_failure(findings: DataFrame, fail_on: DataFrame, by_prefix: bool = False) -> DataFrame:
    """Runs holding a finding listed in ``fail_on``; ``by_prefix`` also matches ``id.`` prefixes."""
    wanted = fail_on.select(F.col("detector").alias("wanted")).distinct()
    # A dotted id has few prefixes: expand them and keep the join an equality join.
    parts = F.split("detector", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    ids = prefixes if by_prefix else F.array("detector")
    return (
        findings.select("run_id", F.explode(ids).alias("wanted"))
        .join(wanted, "wanted", "left_semi")
        .select("run_id")
        .distinct()
    )


def config_trust(configs: DataFrame, strict: bool = True) -> DataFrame:
    """Whether a configuration may filter the very change it is part of.

    ``configs`` has (run_id, current_text, baseline_text); NULL means the file is absent.
    """
    current, baseline = H.sha256(F.col("current_text")), H.sha256(F.col("baseline_text"))
    absent = F.col("current_text").isNull()
    in_diff = ~absent & (baseline.isNull() | (current != baseline))
    return configs.select(
        "run_id",
        F.when(absent, "default").when(in_diff, "in-diff").otherwise("baseline").alias("source"),
        in_diff.alias("in_diff"),
        (in_diff & F.lit(strict)).alias("blocked"),
        F.when(in_diff, F.lit("BLOCK" if strict else "WARN")).alias("severity"),
        F.when(in_diff, F.when(baseline.isNull(), "added").otherwise("changed")).alias("direction"),
    )


def config_findings(configs: DataFrame, strict: bool = True, file: str = ".driftlens.json") -> DataFrame:
    """One finding per run whose configuration is part of the change."""
    judged = config_trust(configs, strict).filter("in_diff")
    added = F.col("direction") == "added"
    return judged.select(
        "run_id", F.lit("config").alias("change_id"), F.lit("config.in-diff-untrusted").alias("detector"), F.lit("META").alias("category"),
        F.lit("<config>").alias("package"), F.when(~added, "baseline").alias("from_ver"), F.lit("changed").alias("to_ver"), "direction", "severity",
        F.lit("high").alias("confidence"),
        F.lit("the configuration is part of this change" + (" and is not applied" if strict else " and is applied on request")).alias("message"),
        F.array(
            F.struct(
                F.lit(file).alias("file"), F.lit(1).alias("line"),
                F.when(added, "(not present before)").otherwise("(differs from the baseline)").alias("snippet"),
            )
        ).alias("evidence"),
        F.lit(None).cast("string").alias("code_kind"),
    )


@dataclass(frozen=True)
class Policy:
    review: tuple[str, ...] = ("INFO", "WARN")
    block: tuple[str, ...] = ("BLOCK",)
    fail_closed: bool = True

    def canonical(self) -> str:
        return json.dumps(
            {
                "blockSeverities": sorted(set(self.block)),
                "failClosed": self.fail_closed,
                "reviewSeverities": sorted(set(self.review)),
            },
            separators=(",", ":"), sort_keys=True,
        )


def admission(findings: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """allow, review or block per key. A failed analysis blocks first when the policy fails closed."""
    present = [F.bool_or(F.col("severity") == s).alias(f"has_{s}") for s in SEVERITIES]
    grouped = findings.groupBy(*keys).agg(F.bool_or(F.col("detector") == "analysis.failed").alias("failed"), *present)

    def hits(names):
        return F.array_compact(F.array(*[F.when(F.col(f"has_{s}"), s) for s in sorted(set(names))]))

    blocked, review = hits(policy.block), hits(policy.review)
    failed = F.col("failed") & F.lit(policy.fail_closed)
    return grouped.select(
        *keys,
        F.when(failed, "block").when(F.size(blocked) > 0, "block").when(F.size(review) > 0, "review").otherwise("allow").alias("decision"),
        F.when(failed, F.lit("analysis failed"))
        .when(F.size(blocked) > 0, F.concat(F.lit("blocking severity present: "), F.array_join(blocked, ", ")))
        .when(F.size(review) > 0, F.concat(F.lit("review severity present: "), F.array_join(review, ", ")))
        .otherwise(F.lit("no finding matches the policy"))
        .alias("reason"),
    )


RECEIPT_FIELDS = [
    "package", "packageVersion", "artifactSha256", "projectHash", "policyHash", "findingsHash", "decision", "issuedAt",
]


def _unsigned_receipt(kind: str) -> Column:
    fields = {name: H.json_string(F.col(name)) for name in RECEIPT_FIELDS}
    fields["version"] = F.lit("1")
    fields["kind"] = H.json_string(F.lit(kind))
    fields["integrity"] = H.json_string(F.lit("sha256-deterministic-unsigned"))
    fields["authenticity"] = H.json_string(F.lit("not-signed"))
    return H.canonical_object(fields)


def receipts(decisions: DataFrame, kind: str = "driftlens-admission-receipt") -> DataFrame:
    """Adds the hash over the canonical text of each decision row (columns: RECEIPT_FIELDS)."""
    return decisions.withColumn("receiptHash", H.sha256(_unsigned_receipt(kind)))


def verify_receipts(rows: DataFrame, kind: str = "driftlens-admission-receipt") -> DataFrame:
    return rows.withColumn("valid", F.col("receiptHash").eqNullSafe(H.sha256(_unsigned_receipt(kind))))


def findings_hash(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of the canonical JSON of each key's findings: an array of objects with sorted names, in report order.

    A receipt covers one package, so the findings gathered per key are those of one comparison.
    """
    columns = sorted(c for c in findings.columns if c not in keys)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    first = F.get("evidence", F.lit(0))
    place = F.struct(severity_rank(F.col("severity")).alias("rank"), "package", "detector", first["file"].alias("file"), first["line"].alias("line"), text.alias("text"))
    listed = F.transform(F.array_sort(F.collect_list(place)), lambda p: p["text"])
    return findings.groupBy(*keys).agg(H.sha256(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))).alias("findings_hash"))


def findings_digest(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free digest of a finding set, built without gathering the set.

    Each row is hashed; per key the row hashes are summed lane by lane in wide decimals and the sums
    hashed once more. Partial sums merge on the map side.
    """
    text = F.to_json(F.struct(*sorted(c for c in findings.columns if c not in keys)))
    lanes = [F.conv(F.substring(F.col("h"), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    return (
        findings.select(*keys, H.sha256(text).alias("h"))
        .groupBy(*keys)
        .agg(H.sha256(F.concat_ws("-", F.count(F.lit(1)), *[F.sum(lane) for lane in lanes])).alias("findings_hash"))
    )


def merge_gate(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Packages with an automatic install hook and a named secret read; an endpoint makes it worse."""
    snippets = F.array_join(F.transform("evidence", lambda e: F.concat_ws("\n", e["snippet"], e["file"])), "\n")
    text = F.concat_ws("\n", "message", snippets)
    hook = F.col("detector").isin("install.script-added", "install.script-changed") & text.rlike(
        r'(?i)Lifecycle script\s+"(?:preinstall|install|postinstall)"\s+(?:was added|body changed)'
    )
    secret = (F.col("detector") == "env.token-harvest") & text.rlike(V.GATE_SECRETS)
    return (
        findings.groupBy(*keys)
        .agg(
            F.bool_or(hook).alias("hook"), F.bool_or(secret).alias("secret"),
            F.bool_or(F.col("detector") == "net.new-endpoint").alias("endpoint"),
        )
        .filter("hook and secret")
        .select(
            *keys,
            F.when(F.col("endpoint"), "install-time-secret-exfiltration").otherwise("install-time-secret-harvest").alias("violation"),
        )
    )


def gate_problems(runs: DataFrame) -> DataFrame:
    """Fail-closed part of the gate: runs whose result is unreadable or reports analyser errors.

    ``runs`` has (run_id, schema_version, finding_count, error_count) with NULL for a missing section.
    """
    problem = (
        F.when(F.col("schema_version").isNull(), "analysis-invalid")
        .when(F.col("finding_count").isNull(), "analysis-invalid")
        .when(F.col("error_count").isNull(), "analysis-invalid")
        .when(F.col("error_count") > 0, "analysis-error")
    )
    return runs.withColumn("violation", problem).filter("violation is not null").select("run_id", "violation")
