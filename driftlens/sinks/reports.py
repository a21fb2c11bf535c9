"""Reports as ordered line tables.

A report of one run can be larger than a task, so no renderer builds a document in one row. Each
returns (run_id, section, sort keys, line); :func:`write_lines` range-partitions by those keys, and the
text files read in order are the document.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens import __version__
from driftlens.functions import fixed_values as V
from driftlens.schema import rank_label, severity_rank

JSON_SCHEMA_VERSION = 2
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
LINE_KEYS = ["run_id", "section", "key1", "key2", "key3", "seq"]


def _lines(df: DataFrame, section, line, key1="", key2="", key3="", seq=0) -> DataFrame:
    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    return df.select(
        "run_id", col(section).cast("int").alias("section"), col(key1).cast("string").alias("key1"),
        col(key2).cast("string").alias("key2"), col(key3).cast("string").alias("key3"),
        col(seq).cast("long").alias("seq"), col(line).alias("line"),
    )


def _stack(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files under ``path/run_id=.../``; file order and line order follow the document."""
    (
        lines.repartitionByRange(*LINE_KEYS)
        .sortWithinPartitions(*LINE_KEYS)
        .select("run_id", "line")
        .write.partitionBy("run_id").mode("overwrite").text(path)
    )


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _array_lines(items: DataFrame, section: int, keys: list[Column], text: Column) -> DataFrame:
    """Elements of a JSON array, one per line with separating commas.

    Equal elements are counted first, which makes every remaining row distinct; the smallest row of a
    run is its first element and carries no comma. No global numbering is needed.
    """
    padded = [*keys, F.lit(""), F.lit(""), F.lit("")][:3]
    rows = (
        items.select("run_id", *[k.cast("string").alias(f"key{i + 1}") for i, k in enumerate(padded)], text.alias("text"))
        .groupBy("run_id", "key1", "key2", "key3", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    place = F.struct("key1", "key2", "key3", "text")
    first = rows.groupBy("run_id").agg(F.min(place).alias("first"))
    rows = rows.join(first, "run_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    lead = F.when((place == F.col("first")) & (F.col("copy") == 1), F.lit("")).otherwise(F.lit(","))
    return _lines(rows, section, F.concat(lead, F.col("text")), F.col("key1"), F.col("key2"), F.col("key3"), F.col("copy"))


def _finding_keys() -> list[Column]:
    first = F.get("evidence", F.lit(0))
    return [
        F.concat(severity_rank(F.col("severity")).cast("string"), F.lit(" "), F.col("package")),
        F.col("detector"),
        F.concat(F.coalesce(first["file"], F.lit("")), F.lit(":"), F.lpad(F.coalesce(first["line"], F.lit(0)).cast("string"), 9, "0")),
    ]


def json_lines(runs: DataFrame, findings: DataFrame, changes: DataFrame, errors: DataFrame, rollup: DataFrame) -> DataFrame:
    """The full result as JSON with sorted keys. ``runs``: run_id, verdict, risk_score."""
    finding = _json(
        F.col("category"), F.col("confidence"), F.col("detector"), F.col("direction"),
        F.transform("evidence", lambda e: F.struct(e["file"].alias("file"), e["line"].alias("line"), e["snippet"].alias("snippet"))).alias("evidence"),
        F.col("from_ver").alias("from"), F.col("message"), F.col("mitre"), F.col("package"), F.col("provenance"),
        F.col("severity"), F.col("to_ver").alias("to"),
    )
    change = _json(
        F.col("kind"), F.col("name"), F.col("integrity_new").alias("newIntegrity"), F.col("version_new").alias("newVersion"),
        F.col("key_new").alias("nodeKeyNew"), F.col("key_old").alias("nodeKeyOld"),
        F.col("integrity_old").alias("oldIntegrity"), F.col("version_old").alias("oldVersion"),
    )
    error = _json(F.col("error"), F.col("name").alias("package"), F.col("version"))
    impact = F.concat(
        F.regexp_extract(F.to_json(F.struct(F.col("direct").alias("v"))), r'^\{"v":(.*)\}\z', 1), F.lit(":"),
        _json(F.col("count"), F.col("max_severity").alias("maxSeverity")),
    )
    tail = F.concat(
        F.lit('},"schemaVersion":'), F.lit(str(JSON_SCHEMA_VERSION)), F.lit(',"verdict":"'), F.col("verdict"), F.lit('"}')
    )
    return _stack(
        _lines(runs, 0, '{"changes":['),
        _array_lines(changes, 1, [F.col("name"), F.col("kind"), F.coalesce("version_new", F.lit(""))], change),
        _lines(runs, 2, '],"errors":['),
        _array_lines(errors, 3, [F.col("name"), F.col("version")], error),
        _lines(runs, 4, '],"findings":['),
        _array_lines(findings, 5, _finding_keys(), finding),
        _lines(runs, 6, F.concat(F.lit('],"riskScore":'), F.col("risk_score").cast("string"), F.lit(',"rollupByDirect":{'))),
        _array_lines(rollup, 7, [F.col("direct")], impact),
        _lines(runs, 8, tail),
    )


def sarif_rules(findings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One rule per detector; the first finding in report order describes it."""
    order = F.struct(severity_rank(F.col("severity")), "package", F.get("evidence", F.lit(0))["file"])
    return findings.groupBy(*keys, F.col("detector").alias("rule_id")).agg(
        F.min_by("category", order).alias("category"), F.min_by("mitre", order).alias("mitre")
    )


def sarif_lines(runs: DataFrame, findings: DataFrame, require_evidence: bool = True, driver: str = "driftlens") -> DataFrame:
    """SARIF 2.1.0. Without ``require_evidence`` a finding lacking evidence gets a package-level location."""
    shown = findings.filter(F.size("evidence") > 0) if require_evidence else findings
    level = F.when(F.col("severity") == "BLOCK", "error").when(F.col("severity") == "WARN", "warning").otherwise("note")
    has = F.size("evidence") > 0
    uri = F.when(has, F.concat(F.col("package"), F.lit("/"), F.get("evidence", F.lit(0))["file"])).otherwise(F.col("package"))
    region = F.struct(
        F.coalesce(F.get("evidence", F.lit(0))["line"], F.lit(1)).alias("startLine"),
        F.struct(F.get("evidence", F.lit(0))["snippet"].alias("text")).alias("snippet"),
    )
    via = F.when(
        F.size("provenance") > 0, F.concat(F.lit("\n  via: "), F.array_join(F.get("provenance", F.lit(0)), " → "))
    ).otherwise(F.lit(""))
    text = F.concat(
        F.lit("["), F.col("package"), F.lit(" "), F.coalesce("from_ver", F.lit("")), F.lit("→"), F.coalesce("to_ver", F.lit("")),
        F.lit("] "), F.col("message"), via,
    )
    result = _json(
        level.alias("level"),
        F.array(
            F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
        ).alias("locations"),
        F.struct(text.alias("text")).alias("message"),
        F.struct("confidence", F.col("from_ver").alias("from"), "mitre", "package", F.col("to_ver").alias("to")).alias("properties"),
        F.col("detector").alias("ruleId"),
    )
    rule = _json(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), F.struct("category", "mitre").alias("properties"),
        F.struct(F.concat(F.col("category"), F.lit(": "), F.col("rule_id")).alias("text")).alias("shortDescription"),
    )
    head = '{"$schema":%s,"version":"2.1.0","runs":[{"tool":{"driver":{"name":%s,"version":%s,"rules":[' % (
        json.dumps(SARIF_SCHEMA), json.dumps(driver), json.dumps(__version__)
    )
    tail = F.concat(
        F.lit('],"properties":{"riskScore":'), F.col("risk_score").cast("string"), F.lit(',"verdict":"'), F.col("verdict"), F.lit('"}}]}')
    )
    return _stack(
        _lines(runs, 0, head),
        _array_lines(sarif_rules(findings, ("run_id",)), 1, [F.col("rule_id")], rule),
        _lines(runs, 2, ']}},"results":['),
        _array_lines(shown, 3, _finding_keys(), result),
        _lines(runs, 4, tail),
    )


def entry_point(detector: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for prefix, name in V.ENTRY_POINTS:
        chain = chain.when(detector.startswith(prefix), name)
    return chain.otherwise("main-import-side-effect")


def capability_of(category: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for name, capability in V.CATEGORY_CAPABILITY.items():
        chain = chain.when(category == name, capability)
    return chain


INCIDENT = ["run_id", "package", "direction"]


def _incident_findings(findings: DataFrame) -> DataFrame:
    return findings.filter((F.col("package") != "") & ~F.col("package").startswith("<"))


def incidents(findings: DataFrame) -> DataFrame:
    """One record per package and direction. The lists hold ids from fixed vocabularies, so they stay short."""
    evasion = F.when(
        F.col("detector").startswith("net.encoded") | (F.col("detector") == "obf.entropy-jump"), "obfuscation"
    ).when(F.col("detector").isin("code.dynamic-eval", "code.reflect-get"), "dynamic-dispatch")
    order = F.struct(severity_rank(F.col("severity")), "detector", F.get("evidence", F.lit(0))["file"])
    return (
        _incident_findings(findings)
        .groupBy(*INCIDENT)
        .agg(
            F.count(F.lit(1)).alias("finding_count"),
            F.min_by(entry_point(F.col("detector")), order).alias("entry_point"),
            F.collect_set(capability_of(F.col("category"))).alias("capabilities"),
            F.collect_set("detector").alias("signals"),
            F.collect_set(evasion).alias("evasion"),
        )
    )


def incident_versions(findings: DataFrame) -> DataFrame:
    """Affected versions as rows; one per incident and version."""
    version = F.coalesce(F.when(F.col("to_ver") != "", F.col("to_ver")), F.col("from_ver"), F.lit("unknown"))
    return _incident_findings(findings).select(*INCIDENT, version.alias("version")).distinct()


def incident_indicators(findings: DataFrame) -> DataFrame:
    """URLs in network evidence as rows; only reserved hosts are repeated."""
    url = F.explode(F.flatten(F.transform("evidence", lambda e: F.regexp_extract_all(e["snippet"], F.lit("(https?://[^\\s\"'`)<>\\]]+)"), F.lit(1)))))
    return (
        _incident_findings(findings)
        .filter(F.col("detector").startswith("net."))
        .select(*INCIDENT, url.alias("url"))
        .filter(F.col("url").rlike(r"(?i)\.(invalid|example|test|localhost)\b"))
        .distinct()
    )


def incident_lines(findings: DataFrame, verdicts: DataFrame, year: int, ecosystem: str = "npm") -> DataFrame:
    """Incident records as JSON lines, their versions and indicators as lines of their own below them."""
    label = F.concat_ws(
        "-", F.lit("OSIF"), F.lit(str(year)), F.regexp_replace(F.upper("package"), "[^A-Z0-9]", "-"), F.upper("direction")
    )
    core = incidents(findings).join(verdicts.select("run_id", "verdict"), "run_id")
    record = _json(
        F.array_sort("capabilities").alias("capabilities_gained"),
        F.struct("finding_count", F.array_sort("signals").alias("signals"), "verdict").alias("detectability"),
        F.lit(ecosystem).alias("ecosystem"), F.col("entry_point"), F.array_sort("evasion").alias("evasion_techniques"),
        label.alias("id"), F.lit("0.1").alias("osif_version"), F.col("package"),
    )
    version = _json(F.col("version").alias("affected_version"), label.alias("id"))
    indicator = _json(label.alias("id"), F.struct(F.lit("url").alias("kind"), F.col("url").alias("value")).alias("indicator"))
    return _stack(
        _lines(core, 0, record, F.col("package"), F.col("direction"), "0"),
        _lines(incident_versions(findings), 0, version, F.col("package"), F.col("direction"), F.concat(F.lit("1 "), F.col("version"))),
        _lines(incident_indicators(findings), 0, indicator, F.col("package"), F.col("direction"), F.concat(F.lit("2 "), F.col("url"))),
    )


def _clipped(snippet: Column) -> Column:
    quoted = F.regexp_replace(snippet, "`", "\\\\\\\\`")
    return F.when(F.length(quoted) > 200, F.concat(F.substring(quoted, 1, 200), F.lit(" …(truncated)"))).otherwise(quoted)


def markdown_lines(findings: DataFrame, changes: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Severity, then package, then finding with at most two pieces of evidence."""
    rank = severity_rank(F.col("severity"))
    if "provenance" not in findings.columns:
        findings = findings.withColumn("provenance", F.array().cast("array<array<string>>"))
    totals = findings.groupBy("run_id").agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("n"))
    if runs is not None:
        totals = runs.select("run_id").distinct().join(totals, "run_id", "left")
    if changes is not None:
        totals = totals.join(changes.groupBy("run_id").agg(F.count(F.lit(1)).alias("changed")), "run_id", "left")
    else:
        totals = totals.withColumn("changed", F.lit(0))
    n = F.coalesce("n", F.lit(0))
    head = F.concat(
        F.lit("**"), rank_label(F.col("rank")), F.lit("** · "), n.cast("string"), F.lit(" finding(s) across "),
        F.coalesce("changed", F.lit(0)).cast("string"), F.lit(" changed package(s)."),
    )
    per_severity = findings.groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("from_ver").isNotNull() & F.col("to_ver").isNotNull(), F.concat_ws(" → ", "from_ver", "to_ver")).otherwise(
        F.coalesce("to_ver", "from_ver", F.lit(""))
    )
    packages = findings.groupBy("run_id", "severity", "package").agg(
        F.min_by(F.struct(label.alias("label"), F.get("provenance", F.lit(0)).alias("via")), F.struct("detector", F.get("evidence", F.lit(0))["file"])).alias("p")
    )
    via = F.when(F.col("p.via").isNotNull(), F.concat(F.lit("\n  - via: `"), F.array_join("p.via", " → "), F.lit("`"))).otherwise(F.lit(""))
    proof = F.array_join(
        F.transform(
            F.slice("evidence", 1, 2),
            lambda e: F.concat(F.lit("\n    - `"), e["file"], F.lit(":"), e["line"].cast("string"), F.lit("` — `"), _clipped(e["snippet"]), F.lit("`")),
        ),
        "",
    )
    detail = F.concat(F.lit("  - **`"), F.col("detector"), F.lit("`** — "), F.col("message"), proof)
    first = F.get("evidence", F.lit(0))
    return _stack(
        _lines(totals, 0, F.concat(F.lit("### behavioural diff\n\n"), head, F.lit("\n"))),
        _lines(totals.filter(n == 0), 1, "_No behavioural changes detected in this update._"),
        _lines(per_severity, rank + 2, F.concat(F.lit("#### "), F.col("severity"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"))),
        _lines(packages, rank + 2, F.concat(F.lit("- **`"), F.col("package"), F.lit("`** `"), F.col("p.label"), F.lit("`"), via), F.col("package"), "", ""),
        _lines(findings, rank + 2, detail, F.col("package"), F.col("detector"), F.concat_ws(":", first["file"], first["line"].cast("string")), 1),
    )


def console_lines(findings: DataFrame, rollup: DataFrame, errors: DataFrame, runs: DataFrame) -> DataFrame:
    """The Markdown content plus up to three paths per package, impact by direct dependency and failures."""
    rank = severity_rank(F.col("severity"))
    first = F.get("evidence", F.lit(0))
    paths = findings.groupBy("run_id", "severity", "package").agg(F.min_by("provenance", F.struct("detector", first["file"])).alias("paths"))
    listed = F.array_join(F.transform(F.slice("paths", 1, 3), lambda p: F.concat(F.lit("    via: "), F.array_join(p, " → "))), "\n")
    impact = rollup.filter(F.col("max_severity") != "CLEAN")
    failed = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.size("evidence") > 2, F.concat(F.lit("\n      … +"), (F.size("evidence") - 2).cast("string"), F.lit(" more evidence"))).otherwise(F.lit(""))
    proof = F.array_join(F.transform(F.slice("evidence", 1, 2), lambda e: F.concat(F.lit("\n      "), e["file"], F.lit(":"), e["line"].cast("string"), F.lit("  "), e["snippet"])), "")
    return _stack(
        _lines(runs, 0, F.concat(F.lit("behavioural diff summary\n  "), F.col("verdict"))),
        _lines(paths, rank + 1, F.concat(F.col("severity"), F.lit("  "), F.col("package"), F.lit("\n"), listed), F.col("package"), ""),
        _lines(findings, rank + 1, F.concat(F.lit("    · "), F.col("detector"), F.lit(" — "), F.col("message"), proof, more), F.col("package"), F.col("detector"), first["file"], 1),
        _lines(impact.select("run_id").distinct(), 5, "Impact by direct dependency:"),
        _lines(impact, 6, F.concat(F.lit("  "), F.col("direct"), F.lit(": "), F.col("max_severity"), F.lit(" ("), F.col("count").cast("string"), F.lit(" in subtree)")), F.col("direct")),
        _lines(failed, 7, F.concat(F.lit("("), F.col("n").cast("string"), F.lit(" package(s) failed to analyse)"))),
    )


def explain(findings: DataFrame, detector: str, package: str | None = None) -> DataFrame:
    found = findings.filter(F.col("detector") == detector)
    return found if package is None else found.filter(F.col("package") == package)


def detections_table(replays: DataFrame) -> DataFrame:
    """Replayed fixtures against their manifests: what had to fire, what did, and the verdict.

    ``replays``: fixture_id, expected_verdict, verdict, must_fire array, fired array.
    """
    missing = F.array_except("must_fire", "fired")
    return replays.select(
        "fixture_id", "expected_verdict", "verdict", F.array_join(F.array_sort(missing), ", ").alias("missing"),
        ((F.size(missing) == 0) & (F.col("verdict") == F.col("expected_verdict"))).alias("as_expected"),
    )


def scorecard_lines(rates: DataFrame) -> DataFrame:
    """Rates per bucket as text; NULL means no data and is said so."""
    shown = F.when(F.col("rate").isNull(), F.lit("no data")).otherwise(F.concat(F.format_string("%.1f", F.col("rate") * 100), F.lit("%")))
    return rates.select("bucket", F.concat(F.col("bucket"), F.lit(": "), shown).alias("line"))

