"""The whole analysis: lockfiles and archives in, findings and reports out, many runs at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import text as X
from driftlens.operators import aggregate as A
from driftlens.operators import changeset as C
from driftlens.operators import delta as D
from driftlens.operators import escalate as E
from driftlens.operators import graph as G
from driftlens.operators import inventory as I
from driftlens.operators import lookalike as L
from driftlens.operators import manifest as M
from driftlens.operators import obfuscation as O
from driftlens.operators import policy as P
from driftlens.operators.scan_javascript import javascript_facts
from driftlens.operators.scan_python import python_facts, setup_hooks
from driftlens.schema import FACT_COLUMNS, FILE_COLUMNS, FINDING_COLUMNS
from driftlens.session import cut_lineage
from driftlens.sources import manifests as S
from driftlens.sources.archives import routed, unpack

KEY = ["name", "version"]

#: A detector: from the compared tables, by name, to findings in the columns that ``to_findings`` gives.
Detector = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Snapshots:
    """Everything known about analysed package versions, keyed by (name, version)."""

    known: DataFrame
    failures: DataFrame
    facts: DataFrame
    files: DataFrame
    artifacts: DataFrame
    scripts: DataFrame
    deps: DataFrame
    emails: DataFrame
    bundled: DataFrame
    bundled_scripts: DataFrame
    entries: DataFrame


@dataclass
class Lists:
    """Reference lists. ``popular``: name, ord. ``domains``: domain. ``trust``: package, anchor."""

    popular: DataFrame
    domains: DataFrame
    trust: DataFrame
    advisories: DataFrame


@dataclass
class Result:
    changes: DataFrame
    findings: DataFrame
    errors: DataFrame
    rollup: DataFrame
    runs: DataFrame


def analyse(archives: DataFrame) -> Snapshots:
    """Snapshot tables of package archives (name, version, kind, content).

    Archives are unpacked once and the file rows kept on checkpoint storage: every later table reads
    those rows instead of unpacking again.
    """
    entries = cut_lineage(unpack(archives))
    unreadable = entries.filter("error is not null").select(*KEY, "error")
    rows = entries.filter("error is null").drop("error")
    npm, pypi = rows.filter("ecosystem = 'npm'"), rows.filter("ecosystem = 'pypi'")

    manifests = S.package_manifests(npm.filter("path = 'package.json'"))
    headers = S.header_fields(_header_texts(pypi))
    malformed = S.malformed_headers(headers)
    failures = unreadable.unionByName(malformed)
    known = archives.select(*KEY).distinct().join(failures, KEY, "left_anti")

    bundles = S.bundled(manifests)
    placed = routed(rows, bundles)
    source = placed.filter(F.col("route").isin("javascript", "python")).withColumn("ord", F.col("ord").cast("long"))
    script, python = source.filter("route = 'javascript'"), source.filter("route = 'python'")
    source_facts = javascript_facts(script).unionByName(python_facts(python))
    artifacts = placed.filter("route = 'native'").select(
        *KEY, "path", "bytes", "sha256", F.col("native").alias("kind"), "wasm_imports", "wasm_error", F.col("ord").cast("long").alias("ord")
    )
    facts = cut_lineage(source_facts.unionByName(artifact_facts(artifacts)))
    cap = F.col("cap")
    per_file = facts.filter(cap.isin("suspicious_literal", "parse_error")).groupBy(*KEY, "path").agg(
        F.count_if(cap == "suspicious_literal").cast("int").alias("suspicious"), F.max(F.when(cap == "parse_error", F.col("key"))).alias("parse_error")
    )
    files = source.select(
        *KEY, "path", "bytes", "sha256", X.byte_entropy(F.col("text")).alias("entropy"),
        ((F.col("route") == "javascript") & X.minified(F.col("text"))).alias("minified"), "ord",
    ).join(per_file, [*KEY, "path"], "left").withColumn("suspicious", F.coalesce("suspicious", F.lit(0)))
    return Snapshots(
        known=known,
        failures=failures,
        facts=facts.filter(cap != "parse_error"),
        files=files,
        artifacts=artifacts,
        scripts=S.scripts(manifests).unionByName(setup_hooks(python)),
        deps=S.dependencies(manifests).unionByName(S.python_dependencies(headers)),
        emails=S.emails(manifests).unionByName(S.python_emails(headers)),
        bundled=bundles,
        bundled_scripts=S.bundled_scripts(manifests, npm.filter(F.col("path").endswith("/package.json"))),
        entries=S.entry_files(manifests),
    )


def _header_texts(rows: DataFrame) -> DataFrame:
    """The header file of each Python package: dist-info or egg-info first, then the top level."""
    path = F.col("path")
    rank = (
        F.when(path.rlike(r"^[^/]+\.dist-info/METADATA\z"), 0).when(path.rlike(r"^[^/]+\.egg-info/PKG-INFO\z"), 1)
        .when(path == "METADATA", 2).when(path == "PKG-INFO", 3)
    )
    return rows.filter(rank.isNotNull()).groupBy(*KEY).agg(F.min_by("text", F.struct(rank, path)).alias("text"))


def artifact_facts(artifacts: DataFrame) -> DataFrame:
    """Native files and WebAssembly imports as facts, so that one comparison covers them too."""
    shared = [*KEY, "path", "ord"]
    binaries = artifacts.select(
        *shared, F.lit("artifact").alias("cap"), F.concat_ws("|", "path", "sha256").alias("key"), F.lit(1).alias("line"),
        F.concat(F.col("kind"), F.lit(" artifact, sha256="), F.substring("sha256", 1, 16), F.lit("…")).alias("snippet"),
        "kind", F.lit(None).cast("string").alias("context"),
    )
    imports = artifacts.select(*shared, F.explode("wasm_imports").alias("i")).select(
        *shared, F.lit("wasm_import").alias("cap"), F.concat_ws("|", "path", "i.module", "i.name").alias("key"), F.lit(1).alias("line"),
        F.concat(F.lit("import "), F.col("i.module"), F.lit("."), F.col("i.name")).alias("snippet"),
        F.col("i.name").alias("kind"), F.col("i.module").alias("context"),
    )
    return binaries.unionByName(imports)


def detect(pairs: DataFrame, snapshots: Snapshots, lists: Lists, detectors: Sequence[Detector] = ()) -> DataFrame:
    """Findings of every comparison: all detectors, then escalation, advisories, tags and checks.

    ``detectors`` are further ones of the caller: functions from the compared tables, by name, to findings.
    """

    def both(table, *columns):
        return C.attach(pairs, table, list(columns))

    facts = cut_lineage(both(snapshots.facts, *FACT_COLUMNS))
    files = cut_lineage(both(snapshots.files, *FILE_COLUMNS))  # three detectors read the measures of every source text
    scripts = both(snapshots.scripts, "hook", "body")
    deps = both(snapshots.deps.withColumnRenamed("dep", "dep_name"), "bucket", F.col("dep_name").alias("name"), "spec", "ord")
    emails = both(snapshots.emails, "source", "email")
    bundled = both(snapshots.bundled, F.col("bundle").alias("name"))
    hooks = both(snapshots.bundled_scripts, F.col("bundle").alias("name"), "hook", "body")
    artifacts = both(snapshots.artifacts, "path", "kind", "wasm_error")
    entries = both(snapshots.entries, "path").filter("side = 'new'")
    analysed = pairs.join(snapshots.known.select(F.col("name").alias("package"), F.col("version").alias("to_ver")), ["package", "to_ver"], "left_semi")

    parts = [
        M.lifecycle_scripts(scripts), M.maintainer_changes(emails, lists.trust), D.capability_findings(facts),
        O.obfuscation_findings(files, entries), M.new_direct_dependencies(deps), L.typosquat_candidates(analysed, lists.popular),
        D.first_version_cluster(facts, files), O.unparseable_wasm(artifacts), M.bundled_dependencies(bundled), M.bundled_lifecycle(hooks),
        O.mangled_identifiers(facts), O.confusable_boundaries(facts), D.dns_templated_hostname(facts),
        L.hyphen_permutations(analysed, lists.popular), M.disposable_author_domains(emails, lists.domains), M.url_dependencies(deps),
        D.image_decode_exec(files, facts), D.self_publish_shape(facts, scripts),
    ]
    compared = {
        "facts": facts, "files": files, "scripts": scripts, "deps": deps, "emails": emails, "bundled": bundled,
        "bundled_scripts": hooks, "artifacts": artifacts, "entries": entries,
    }
    parts += [detector(compared) for detector in detectors]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = cut_lineage(found)
    found = found.unionByName(D.first_install_fallback(found))
    found = E.escalate(found, D.pairs_with_new_network_argument(facts))
    return E.checked(E.technique_tags(E.annotate_advisories(found, lists.advisories)))


def run_diff(
    locks: dict[str, DataFrame], snapshots: Snapshots, lists: Lists, config: dict[str, DataFrame] | None = None, detectors: Sequence[Detector] = ()
) -> Result:
    """Every run of the lock tables at once. The tables are written once, so that no lockfile is parsed again."""
    locks = {name: cut_lineage(table) for name, table in locks.items()}
    changes = cut_lineage(C.changeset(locks["nodes"]))
    content = C.content_pairs(changes, snapshots.known)
    per_pair = detect(C.distinct_pairs(content), snapshots, lists, detectors).drop("run_id").withColumnRenamed("change_id", "pair_id")
    # A comparison made once serves every run that contains it.
    detected = content.select("run_id", "change_id", C.pair_id().alias("pair_id")).join(per_pair, "pair_id").drop("pair_id")
    new_nodes = locks["nodes"].filter("side = 'new'").drop("side")
    new_edges = locks["edges"].filter("side = 'new'").drop("side")
    detected = _with_provenance(detected, changes, new_nodes, new_edges)

    failures = snapshots.failures.join(
        changes.select("run_id", "name", F.explode(F.array_compact(F.array("version_old", "version_new"))).alias("version")).distinct(), KEY
    ).select("run_id", *KEY, "error")
    synthetic = (
        I.integrity_mismatches(changes)
        .unionByName(I.failed_analyses(changes, failures))
        .unionByName(I.workspace_shadows(locks["links"], lists.popular))
        .unionByName(I.aliased_names(locks["aliases"]))
        .unionByName(I.unusual_sources(changes))
    )
    synthetic = E.technique_tags(synthetic).withColumn("provenance", F.array().cast("array<array<string>>"))
    findings = detected.unionByName(synthetic)
    if config is not None:
        findings = P.apply_config(findings, config)
    findings = cut_lineage(findings)
    errors = failures.unionByName(locks["errors"].select("run_id", F.col("side").alias("name"), F.lit("").alias("version"), "error"))
    return summarise(locks, changes, findings, errors)


def summarise(locks: dict[str, DataFrame], changes: DataFrame, findings: DataFrame, errors: DataFrame) -> Result:
    new_nodes = locks["nodes"].filter("side = 'new'").drop("side")
    new_edges = locks["edges"].filter("side = 'new'").drop("side")
    rollup = G.rollup_by_direct(new_nodes, new_edges, findings)
    all_runs = locks["nodes"].select("run_id").distinct()
    graded = A.verdicts(findings, ["run_id"]).join(A.risk_scores(findings, ["run_id"]), "run_id")
    runs = all_runs.join(graded, "run_id", "left").select(
        "run_id", F.coalesce("verdict", F.lit("CLEAN")).alias("verdict"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score")
    )
    return Result(changes, findings, errors, rollup, runs)


def _with_provenance(findings: DataFrame, changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Up to three shortest paths per finding. At most three rows per node meet in the list."""
    paths = G.provenance_paths(nodes, edges).select("run_id", F.col("key").alias("key_new"), "place", "path")
    listed = (
        changes.select("run_id", "change_id", "key_new").join(paths, ["run_id", "key_new"])
        .groupBy("run_id", "change_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("p"))
        .select("run_id", "change_id", F.col("p.path").alias("provenance"))
    )
    return findings.join(listed, ["run_id", "change_id"], "left").select(
        *FINDING_COLUMNS, "mitre", F.coalesce("provenance", F.array().cast("array<array<string>>")).alias("provenance")
    )


def run_scan(locks: dict[str, DataFrame], snapshots: Snapshots, lists: Lists, config: dict[str, DataFrame] | None = None) -> Result:
    """Posture of one inventory: a comparison with nothing, reported as absolute instead of added."""
    only_new = {name: cut_lineage(table.filter("side = 'new'") if "side" in table.columns else table) for name, table in locks.items()}
    result = run_diff(only_new, snapshots, lists, config)
    findings = result.findings.withColumn("direction", F.when(F.col("direction") == "added", "absolute").otherwise(F.col("direction")))
    return summarise(only_new, result.changes, findings, result.errors)


def compare_install(old: Snapshots, new: Snapshots, pairs: DataFrame, lists: Lists, policy: P.Policy = P.Policy()) -> DataFrame:
    """Pre-install gate: admission decision per (package, from_ver, to_ver) before anything is installed.

    ``old`` and ``new`` may be the same tables. A pair without findings is admitted.
    """
    merged = Snapshots(**{f: getattr(old, f).unionByName(getattr(new, f)) if old is not new else getattr(new, f) for f in Snapshots.__dataclass_fields__})
    asked = pairs.select("package", "from_ver", "to_ver", C.pair_id().alias("pair_id")).distinct()
    found = detect(C.distinct_pairs(pairs), merged, lists).select(F.col("change_id").alias("pair_id"), "detector", "severity")
    failed = merged.failures.select(F.col("name").alias("package"), F.col("version").alias("to_ver"))
    refused = asked.join(failed, ["package", "to_ver"]).select(
        "pair_id", F.lit("analysis.failed").alias("detector"), F.lit("BLOCK").alias("severity")
    )
    decided = P.admission(found.unionByName(refused), policy, ["pair_id"])
    return asked.join(decided, "pair_id", "left").select(
        "package", "from_ver", "to_ver", F.coalesce("decision", F.lit("allow")).alias("decision"),
        F.coalesce("reason", F.lit("no finding matches the policy")).alias("reason"),
    )
