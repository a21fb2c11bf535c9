"""Named queries: each library operator run over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import hashing as H
from driftlens.functions import names as N
from driftlens.functions import text as X
from driftlens.functions.decode import decode_js_url
from driftlens.operators import aggregate as A
from driftlens.operators import assurance as Q
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
from driftlens.operators.scan_python import python_facts
from driftlens.operators.syntax_javascript import parse_errors
from driftlens.plans import tables as T
from driftlens.sinks import reports as R
from driftlens.sources import archives as Z
from driftlens.sources import lockfiles as K
from driftlens.sources import manifests as S
from driftlens.sources.json_tree import string_leaves
from driftlens.streaming import jobs as J
from driftlens.streaming import limiter as W

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def flat(findings: DataFrame) -> DataFrame:
    first = F.get("evidence", F.lit(0))
    return findings.select(
        "run_id", "change_id", "detector", "package", "from_ver", "to_ver", "direction", "severity", "confidence",
        first["file"].alias("file"), first["line"].alias("line"), first["snippet"].alias("snippet"),
    )


# --- change set ------------------------------------------------------------------------------

@query
def changeset_diff(spark, folder):
    return C.changeset(T.lock_nodes(spark, folder)).drop("change_id", "resolved_new")


@query
def closest_version_asof(spark, folder):
    changes = C.changeset(T.lock_nodes(spark, folder)).filter(F.col("kind") == "upgraded")
    return changes.select("run_id", "name", "version_new", "version_old")


@query
def integrity_mismatch(spark, folder):
    return flat(I.integrity_mismatches(C.changeset(T.lock_nodes(spark, folder))))


@query
def unusual_sources(spark, folder):
    return flat(I.unusual_sources(C.changeset(T.lock_nodes(spark, folder))))


@query
def change_kinds(spark, folder):
    changes = C.changeset(T.lock_nodes(spark, folder))
    return changes.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def fail_closed(spark, folder):
    nodes = T.lock_nodes(spark, folder)
    broken = nodes.filter("integrity = ''").groupBy("run_id", "name", "version").agg(
        F.concat(F.lit("cannot read "), F.min("ord").cast("string")).alias("error")
    )
    found = I.failed_analyses(C.changeset(nodes), broken)
    return found.select("run_id", "package", "from_ver", "to_ver", "direction", "severity", "detector")


@query
def workspace_links(spark, folder):
    """Every entry taken as a link; the names that also come from the registry are the ones worth shadowing."""
    links = T.lock_nodes(spark, folder)
    return flat(I.workspace_shadows(links, links.filter("resolved IS NULL").select("name")))


@query
def aliased_names(spark, folder):
    nodes = T.lock_nodes(spark, folder)
    aliases = nodes.select(
        "run_id", "side", F.col("name").alias("declared_name"),
        F.concat(F.lit("real-"), F.col("integrity")).alias("real_name"), "version", "ord",
    )
    return flat(I.aliased_names(aliases))


# --- sources ------------------------------------------------------------------------------------

@query
def lockfile_kinds(spark, folder):
    files = T.lock_files(spark, folder)
    return files.select("run_id", K.lockfile_kind(F.col("filename"), F.col("text")).alias("kind"))


@query
def lockfile_nodes(spark, folder):
    nodes = K.lock_tables(T.lock_files(spark, folder))["nodes"]
    return nodes.filter("key != ''").select("run_id", "key", "name", "version", "integrity")


@query
def lockfile_edges(spark, folder):
    return K.lock_tables(T.lock_files(spark, folder))["edges"].select("run_id", "parent_key", "child_key")


@query
def lockfile_links(spark, folder):
    return K.lock_tables(T.lock_files(spark, folder))["links"].select("run_id", "key", "name")


@query
def manifest_scripts(spark, folder):
    return S.scripts(S.package_manifests(T.package_manifests(spark, folder)))


@query
def manifest_dependencies(spark, folder):
    return S.dependencies(S.package_manifests(T.package_manifests(spark, folder))).drop("ord")


@query
def manifest_emails(spark, folder):
    return S.emails(S.package_manifests(T.package_manifests(spark, folder)))


@query
def manifest_entries(spark, folder):
    return S.entry_files(S.package_manifests(T.package_manifests(spark, folder)))


@query
def preferred_artifacts(spark, folder):
    k = F.col("p_partkey")
    listed = T.load(spark, folder, "part").select(
        F.col("p_name").alias("name"), F.concat(F.lit("1."), T.text("p_size")).alias("version"),
        F.concat(F.lit("f"), T.text(k), T.pick(["-py3-none-any.whl", "-cp39.whl", ".tar.gz", ".zip"], k % 4)).alias("filename"),
    )
    return Z.preferred_artifacts(listed)


@query
def scan_javascript(spark, folder):
    found = javascript_facts(T.source_files(spark, folder, T.JS_TEMPLATE, T.JS_MODULES, ".js"))
    return found.select("path", "cap", "key", "line", "context")


@query
def javascript_flow(spark, folder):
    """Environment keys and file targets that scripts reach over aliases, patterns, arguments and members."""
    found = javascript_facts(T.flow_files(spark, folder))
    return found.filter("cap IN ('env', 'fs_read', 'fs_write')").select("path", "cap", "key")


@query
def javascript_errors(spark, folder):
    """documents and pages taken as scripts: the first error of each, with its place."""
    return parse_errors(T.scripts_of_texts(spark, folder)).select("name", "path", "parse_error")


@query
def scan_python(spark, folder):
    found = python_facts(T.source_files(spark, folder, T.PY_TEMPLATE, T.PY_MODULES, ".py"))
    return found.select("path", "cap", "key", "line")


# --- delta detectors ----------------------------------------------------------------------------

@query
def new_capability_delta(spark, folder):
    return flat(D.capability_findings(T.facts(spark, folder)))


@query
def new_endpoint_best_evidence(spark, folder):
    facts = T.facts(spark, folder).filter(F.col("cap") == "url")
    return D.new_facts(facts).select("change_id", "key", "path", "line", "context", "sightings")


@query
def url_context_merge(spark, folder):
    urls = T.facts(spark, folder).filter(F.col("cap") == "url")
    return urls.groupBy("change_id", "side", "path", "key").agg(
        F.max_by("context", X.url_context_priority(F.col("context"))).alias("context")
    )


@query
def hotpath_filter(spark, folder):
    found = D.capability_findings(T.facts(spark, folder).filter(F.col("cap").isin("fs_write", "fs_read")))
    return flat(found).select("change_id", "detector", "package", "severity", "file", "line")


@query
def env_harvest(spark, folder):
    return flat(D.capability_findings(T.facts(spark, folder).filter(F.col("cap") == "env")))


@query
def dynamic_code_tier(spark, folder):
    found = D.capability_findings(T.facts(spark, folder).filter(F.col("cap") == "dynamic_code"))
    return found.groupBy("change_id", "code_kind", "severity", "confidence").agg(F.count(F.lit(1)).alias("sites"))


@query
def native_artifact_delta(spark, folder):
    return flat(D.capability_findings(T.facts(spark, folder).filter(F.col("cap") == "artifact")))


@query
def wasm_import_filter(spark, folder):
    return flat(D.capability_findings(T.facts(spark, folder).filter(F.col("cap") == "wasm_import")))


@query
def wasm_unparseable(spark, folder):
    return flat(O.unparseable_wasm(T.artifacts(spark, folder)))


@query
def first_version_cluster(spark, folder):
    files = _package_files(spark, folder)
    return flat(D.first_version_cluster(T.facts(spark, folder), files))


def _package_files(spark, folder):
    """Files of the packages in ``facts``: one per supplier and path, measured from its fact rows."""
    facts = T.facts(spark, folder)
    return facts.groupBy("run_id", "change_id", "package", "from_ver", "to_ver", "side", "path").agg(
        F.count_if(F.col("cap") == "suspicious_literal").alias("suspicious"), F.lit(False).alias("minified")
    )


@query
def first_install_fallback(spark, folder):
    found = T.findings(spark, folder).filter(F.col("direction") == "added")
    one_pair = found.withColumn("to_ver", F.lit("1.0.0"))
    return flat(D.first_install_fallback(one_pair))


@query
def network_argument_pairs(spark, folder):
    return D.pairs_with_new_network_argument(T.facts(spark, folder))


@query
def dns_templated(spark, folder):
    return flat(D.dns_templated_hostname(T.facts(spark, folder))).drop("snippet")


@query
def self_publish_shape(spark, folder):
    return flat(D.self_publish_shape(T.facts(spark, folder), T.scripts(spark, folder)))


@query
def image_read_exec(spark, folder):
    found = D.image_decode_exec(T.images(spark, folder), T.facts(spark, folder))
    return flat(found)


@query
def mangled_ids(spark, folder):
    return flat(O.mangled_identifiers(T.facts(spark, folder)))


@query
def homoglyph(spark, folder):
    return flat(O.confusable_boundaries(T.facts(spark, folder)))


# --- text measures --------------------------------------------------------------------------------

@query
def entropy_by_file(spark, folder):
    docs = T.load(spark, folder, "documents")
    return docs.select("doc_id", F.round(X.byte_entropy(F.col("text")), 6).alias("entropy"))


@query
def minified_files(spark, folder):
    docs = T.load(spark, folder, "documents")
    return docs.filter(X.minified(F.col("text"))).select("doc_id")


@query
def printable_share(spark, folder):
    docs = T.load(spark, folder, "documents")
    return docs.select("doc_id", F.round(X.printable_share(F.col("text")), 6).alias("share"))


@query
def text_urls(spark, folder):
    """URLs in page markup by page, with how often each occurs."""
    pages = T.load(spark, folder, "pages")
    body = F.concat_ws(" ", "url", "html")
    found = pages.select("page_id", F.explode(X.urls(body)).alias("found"))
    return found.groupBy("page_id", "found").agg(F.count(F.lit(1)).alias("n"))


@query
def live_hosts(spark, folder):
    pages = T.load(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.concat_ws(" ", F.regexp_replace("url", r"\.example\.", ".sample."), "html").alias("text"),
    )
    return Q.live_hosts(pages)


@query
def entropy_jump(spark, folder):
    found = O.obfuscation_findings(T.files(spark, folder), T.declared_entries(spark, folder))
    return flat(found.filter(F.col("detector") == "obf.entropy-jump")).drop("snippet")


@query
def new_obfuscated_file(spark, folder):
    found = O.obfuscation_findings(T.files(spark, folder), T.declared_entries(spark, folder))
    return flat(found.filter(F.col("detector") == "obf.new-obfuscated-file"))


# --- manifests -------------------------------------------------------------------------------------

@query
def script_tier(spark, folder):
    # one body per hook and side: the smallest, as a manifest holds one
    one = T.scripts(spark, folder).groupBy(
        "run_id", "change_id", "package", "from_ver", "to_ver", "side", "hook"
    ).agg(F.min("body").alias("body"))
    return flat(M.lifecycle_scripts(one))


@query
def new_direct_dep(spark, folder):
    return flat(M.new_direct_dependencies(T.deps(spark, folder)))


@query
def dep_spec_class(spark, folder):
    return flat(M.url_dependencies(T.deps(spark, folder)))


@query
def maintainer_change(spark, folder):
    return flat(M.maintainer_changes(T.emails(spark, folder), T.trust(spark, folder)))


@query
def disposable_domain(spark, folder):
    domains = T.load(spark, folder, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lower("c_mktsegment"), F.lit(".sub.example")).alias("domain")
    )
    return flat(M.disposable_author_domains(T.emails(spark, folder), domains))


@query
def bundled_added(spark, folder):
    return flat(M.bundled_dependencies(T.bundled(spark, folder))).drop("snippet")


@query
def bundled_hooks(spark, folder):
    found = flat(M.bundled_lifecycle(T.bundled(spark, folder)))
    return found.groupBy("change_id", "file", "snippet", "direction", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- names -------------------------------------------------------------------------------------------

@query
def typosquat(spark, folder):
    return flat(L.typosquat_candidates(T.names(spark, folder), T.popular(spark, folder)))


@query
def hyphen_permutation(spark, folder):
    return flat(L.hyphen_permutations(T.token_names(spark, folder), T.popular(spark, folder)))


@query
def canonical_names(spark, folder):
    part = T.load(spark, folder, "part")
    raw = F.concat(F.regexp_replace("p_name", " ", "__"), F.lit(".-"), F.col("p_brand"))
    return part.select("p_partkey", N.canonical_pypi(raw).alias("name"))


@query
def package_specs(spark, folder):
    part = T.load(spark, folder, "part")
    k = F.col("p_partkey")
    scope = F.when(k % 3 == 0, F.concat(F.lit("@"), F.regexp_replace("p_brand", "#", ""), F.lit("/"))).otherwise("")
    version = F.when(k % 2 == 0, F.concat(F.lit("@1."), T.text("p_size"))).otherwise("")
    spec = F.concat(scope, F.substring_index("p_name", " ", 1), version)
    return part.select("p_partkey", N.package_spec(spec).alias("s")).select("p_partkey", "s.name", "s.version")


# --- escalation, advisories, tags --------------------------------------------------------------------

@query
def escalation(spark, folder):
    found = E.escalate(_keyed(spark, folder), T.network_pairs(spark, folder))
    return found.select("event_id", "severity")


def _keyed(spark, folder):
    return T.findings(spark, folder)


@query
def obf_escalation(spark, folder):
    decided = E.decide(_keyed(spark, folder), T.network_pairs(spark, folder))
    return decided.filter("lift_obf").select("change_id", "package")


@query
def typo_escalation(spark, folder):
    decided = E.decide(_keyed(spark, folder), T.network_pairs(spark, folder))
    return decided.filter("lift_typo").select("change_id", "package")


@query
def compound_escalation(spark, folder):
    decided = E.decide(_keyed(spark, folder), T.network_pairs(spark, folder))
    return decided.filter("lift_all").select(
        "change_id", "package", F.col("n_warn").cast("long").alias("n_warn"), F.col("n_kind").cast("long").alias("n_kind"),
        F.array_join("warn_detectors", ",").alias("detectors"),
    )


def _versions(spark, folder):
    names = [a[2] for a in E.V.ADVISORIES]
    orders = T.load(spark, folder, "orders")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    version = F.concat_ws(
        ".", T.text(o % 12), T.text(c % 7), T.text(F.month("o_orderdate") % 9)
    )
    return orders.select(T.pick(names, o % len(names)).alias("package"), version.alias("version"))


@query
def advisory_match(spark, folder):
    hits = E.advisory_matches(_versions(spark, folder), E.builtin_advisories(spark))
    return hits.filter(F.col("relation") == "affected").select("package", "version", "ghsa")


@query
def adjacent_advisory(spark, folder):
    hits = E.advisory_matches(_versions(spark, folder), E.builtin_advisories(spark))
    return hits.filter(F.col("relation") == "adjacent").select("package", "version", "ghsa")


@query
def technique_tags(spark, folder):
    tagged = E.technique_tags(_keyed(spark, folder))
    return tagged.select("event_id", F.array_join("mitre", ",").alias("tags"))


# --- verdicts, scores, order -------------------------------------------------------------------------

@query
def verdict(spark, folder):
    return A.verdicts(_keyed(spark, folder), ["run_id", "change_id"])


@query
def risk_score(spark, folder):
    return A.risk_scores(_keyed(spark, folder), ["change_id"])


@query
def severity_rollup(spark, folder):
    return A.severity_counts(_keyed(spark, folder), ["run_id", "package"])


@query
def exit_codes(spark, folder):
    findings = _keyed(spark, folder)
    fail_on = T.load(spark, folder, "nation").filter("n_regionkey = 2").select(
        T.pick([d for d, _ in T.DETECTORS], F.col("n_nationkey") % 16).alias("detector")
    )
    forced = P.forced_failure(findings.select(F.col("change_id").alias("run_id"), "detector"), fail_on)
    graded = A.verdicts(findings, ["change_id"]).join(
        forced.select(F.col("run_id").alias("change_id"), F.lit(True).alias("forced")), "change_id", "left"
    )
    return graded.select("change_id", A.exit_code(F.col("verdict"), F.coalesce("forced", F.lit(False))).alias("code"))


@query
def finding_order_topk(spark, folder):
    """The first hundred findings of the report order."""
    ordered = _keyed(spark, folder).orderBy(
        A.severity_rank(F.col("severity")), "package", "detector", F.get("evidence", F.lit(0))["file"], "event_id"
    )
    return ordered.limit(100).select("event_id", "severity", "package", "detector")


# --- policy ------------------------------------------------------------------------------------------

def _config_tables(spark, folder):
    """Configuration rows drawn from suppliers: they name packages of the findings."""
    s = F.col("s_suppkey")
    supplier = T.load(spark, folder, "supplier")
    package = F.concat(F.lit("u"), T.text(s), F.lit("-"), T.text(s % 29))
    categories = ["NET", "ENV", "META", "INSTALL"]
    nation = T.load(spark, folder, "nation")
    n = F.col("n_nationkey")
    return {
        "allow": supplier.select(package.alias("package"), T.pick(categories, s % 4).alias("category")),
        "ignore": supplier.filter("s_acctbal < 1000").select(F.concat(F.lit("u"), T.text(s), F.lit("-"), T.text(s % 7)).alias("package")),
        "ignore_path": supplier.filter("s_acctbal > 6000").select(
            F.concat(F.lit("u"), T.text(s), F.lit("-"), T.text(s % 11)).alias("package"), F.lit("lib/f1").alias("prefix")
        ),
        "trust": supplier.select(F.concat(F.lit("u"), T.text(s), F.lit("-"), T.text(s % 13)).alias("package"), F.lit("@y.example").alias("anchor")),
        "override": nation.filter("n_regionkey = 1").select(
            T.pick([d for d, _ in T.DETECTORS], n % 16).alias("detector"), T.pick(["BLOCK", "WARN", "INFO"], n % 3).alias("severity")
        ).groupBy("detector").agg(F.min("severity").alias("severity")),
    }


@query
def config_apply(spark, folder):
    kept = P.apply_config(_keyed(spark, folder), _config_tables(spark, folder))
    return kept.select("event_id", "severity")


@query
def config_trust(spark, folder):
    c = F.col("c_custkey")
    configs = T.load(spark, folder, "customer").select(
        c.cast("string").alias("run_id"),
        F.when(c % 5 != 0, F.col("c_mktsegment")).alias("current_text"),
        F.when(c % 3 != 0, F.when(c % 2 == 0, F.col("c_mktsegment")).otherwise("other")).alias("baseline_text"),
    )
    return P.config_trust(configs)


@query
def policy_decision(spark, folder):
    return P.admission(_keyed(spark, folder), P.Policy(), ["change_id"])


def _canonical(spark, folder):
    """Findings with the members that their canonical JSON has, next to change_id."""
    found, _ = _reported(spark, folder)
    return found.select(
        "change_id", "category", "confidence", "detector", "direction", "evidence", F.col("from_ver").alias("from"), "message", "mitre", "package",
        "provenance", "severity", F.col("to_ver").alias("to"),
    )


def _decisions(spark, folder):
    decided = P.admission(_keyed(spark, folder), P.Policy(), ["change_id", "package"])
    hashes = P.findings_hash(_canonical(spark, folder).withColumn("owner", F.col("package")), ["change_id", "owner"])
    return decided.join(hashes.withColumnRenamed("owner", "package"), ["change_id", "package"]).select(
        "package",
        F.lit("1.0.0").alias("packageVersion"),
        H.sha256(F.col("package")).alias("artifactSha256"),
        H.sha256(F.col("change_id")).alias("projectHash"),
        H.sha256(F.lit(P.Policy().canonical())).alias("policyHash"),
        F.col("findings_hash").alias("findingsHash"),
        "decision",
        F.lit("2024-01-01T00:00:00.000Z").alias("issuedAt"),
    )


@query
def receipt_hash(spark, folder):
    return P.receipts(_decisions(spark, folder)).select("package", "decision", F.col("receiptHash").alias("receipt_hash"))


@query
def receipt_verify(spark, folder):
    issued = P.receipts(_decisions(spark, folder))
    altered = issued.withColumn(
        "decision", F.when(F.col("package").endswith("-7"), "allow").otherwise(F.col("decision"))
    )
    return P.verify_receipts(altered).select("package", "valid")


@query
def merge_gate(spark, folder):
    return P.merge_gate(_keyed(spark, folder), ["run_id", "package"])


@query
def explain_finding(spark, folder):
    found = R.explain(_keyed(spark, folder), "net.new-endpoint", None)
    return found.select("event_id", "package", "severity")


@query
def findings_digest(spark, folder):
    return P.findings_digest(_keyed(spark, folder).drop("event_id"), ["change_id"])


# --- graph --------------------------------------------------------------------------------------------

@query
def provenance_paths(spark, folder):
    nodes, edges = T.graph(spark, folder)
    found = G.provenance_paths(nodes, edges)
    return found.select("key", F.array_join("path", ">").alias("path"), F.col("place").cast("long").alias("place"))


@query
def diamond_paths(spark, folder):
    nodes, edges = T.diamonds(spark, folder)
    found = G.provenance_paths(nodes, edges)
    return found.select("run_id", "key", F.array_join("path", ">").alias("path"), F.col("place").cast("long").alias("place"))


@query
def subtree_closure(spark, folder):
    nodes, edges = T.graph(spark, folder)
    return G.subtree_closure(nodes, edges).select("direct", "name")


@query
def rollup_by_direct(spark, folder):
    nodes, edges = T.graph(spark, folder)
    found = T.findings(spark, folder).select(
        F.lit("g").alias("run_id"),
        F.concat(F.lit("c"), F.split("package", "[u-]")[1]).alias("package"),
        "severity",
    )
    return G.rollup_by_direct(nodes, edges, found).select("direct", "max_severity", "count")


# --- studies, coverage, assurance -----------------------------------------------------------------------

def _bumps(spark, folder):
    """events as studied version bumps per package; some packages fail to analyse."""
    found = _keyed(spark, folder).select(
        "package", F.lit("1.0.0").alias("old_version"), F.lit("1.1.0").alias("new_version"), "severity", "detector"
    )
    bumps = found.select("package", "old_version", "new_version").distinct().withColumn(
        "error", F.when(F.col("package").endswith("-3"), F.lit("timed out"))
    )
    return found, bumps


@query
def study_npm(spark, folder):
    found, bumps = _bumps(spark, folder)
    return A.npm_study_summary(A.bump_rows(found, bumps)).withColumn("findings_per_bump", F.round("findings_per_bump", 6))


@query
def study_npm_detectors(spark, folder):
    found, bumps = _bumps(spark, folder)
    return A.npm_detector_rates(A.bump_rows(found, bumps)).withColumn("rate", F.round("rate", 6))


@query
def study_offenders(spark, folder):
    found, bumps = _bumps(spark, folder)
    return A.worst_offenders(A.bump_rows(found, bumps)).select("package", "verdict", "finding_count")


@query
def study_pypi(spark, folder):
    found, bumps = _bumps(spark, folder)
    summary = A.pypi_study_summary(A.bump_rows(found, bumps))
    return summary.withColumns({c: F.round(c, 6) for c in ("block_rate", "warn_or_block_rate")})


@query
def study_pypi_detectors(spark, folder):
    return A.pypi_detector_hits(_keyed(spark, folder))


@query
def coverage_gate(spark, folder):
    labels, docs = T.load(spark, folder, "labels"), T.load(spark, folder, "documents").select("doc_id", "source")
    members = docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("class_id"), F.col("doc_id").cast("string").alias("member_id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("covered"),
    )
    return A.coverage(members)


@query
def assurance_rates(spark, folder):
    turns = T.load(spark, folder, "conversations")
    size = F.length("text")
    outcomes = turns.select("role", F.when(size % 3 == 0, "passed").when(size % 3 == 1, "failed").otherwise("skipped").alias("status"))
    return A.pass_rates(outcomes, "role").withColumn("rate", F.round("rate", 6))


@query
def ledger_by_class(spark, folder):
    labels = T.load(spark, folder, "labels")
    deltas = labels.select(
        T.pick(["advisory-only", "intentional-non-goal", "real-gap", "noise"], F.col("quality") * 2 + F.col("toxic")).alias("class"),
        T.pick(["scanner-a", "scanner-b", "scanner-c"], F.col("doc_id") % 3).alias("scanner"),
    )
    return A.ledger(deltas)


def _cases(spark, folder):
    turns = T.load(spark, folder, "conversations")
    kind = T.pick(["ok", "crash", "timeout", "fail-safe", "oom", "ok"], F.length("text") % 6)
    classes = ["net-egress", "secret-read", "env/secret-read", "fs-read", "obfuscation-decode"]
    return turns, kind, classes


@query
def oracle_fail_safe(spark, folder):
    turns, kind, classes = _cases(spark, folder)
    first = turns.filter(F.col("turn") == 0)
    cases = first.select(
        F.col("conv_id").alias("case_id"), kind.alias("kind"),
        F.when(F.col("conv_id") % 4 == 0, "*").when(F.col("conv_id") % 4 != 1, T.pick(classes, F.col("conv_id") % 5)).alias("required"),
    )
    found = turns.filter(F.col("turn") > 0).select(
        F.col("conv_id").alias("case_id"), T.pick(classes, F.length("text") % 5).alias("capability_class")
    )
    return Q.fail_safe(cases, found)


@query
def finding_survives(spark, folder):
    turns, kind, classes = _cases(spark, folder)
    variant = F.when(F.col("turn") % 2 == 0, "before").otherwise("after")
    cases = turns.filter(F.col("turn") < 2).select(
        F.col("conv_id").alias("case_id"), variant.alias("variant"), kind.alias("kind"),
        T.pick(classes, F.col("conv_id") % 5).alias("wanted"),
    )
    found = turns.select(
        F.col("conv_id").alias("case_id"), variant.alias("variant"),
        T.pick(classes, F.length("text") % 5).alias("capability_class"),
    )
    return Q.finding_survives(cases, found, Q.alias_table(spark))


@query
def identity_invariant(spark, folder):
    found = _keyed(spark, folder)
    view = found.select("change_id", "detector", "severity", "confidence")
    rewritten = found.select(
        "change_id", "detector",
        F.when(F.col("event_id") % 10 == 0, "INFO").otherwise(F.col("severity")).alias("severity"), "confidence",
    )
    return Q.identity_invariant(view, rewritten, ["change_id"])


# --- reports --------------------------------------------------------------------------------------------

@query
def sarif_rules(spark, folder):
    return R.sarif_rules(E.technique_tags(_keyed(spark, folder))).select(
        "rule_id", "category", F.array_join("mitre", ",").alias("tags")
    )


@query
def osif_incidents(spark, folder):
    incidents = R.incidents(_keyed(spark, folder))
    return incidents.select(
        "package", "direction", "finding_count", "entry_point",
        F.array_join(F.array_sort("capabilities"), ",").alias("capabilities"),
        F.array_join(F.array_sort("signals"), ",").alias("signals"),
        F.array_join(F.array_sort("evasion"), ",").alias("evasion"),
    )


@query
def osif_versions(spark, folder):
    return R.incident_versions(_keyed(spark, folder)).drop("run_id")


@query
def osif_indicators(spark, folder):
    return R.incident_indicators(_keyed(spark, folder)).drop("run_id")


@query
def markdown_lines(spark, folder):
    lines = R.markdown_lines(_keyed(spark, folder))
    return lines.groupBy("run_id", "section").agg(F.count(F.lit(1)).alias("lines"))


# --- jobs, limits ---------------------------------------------------------------------------------------

@query
def job_ttl(spark, folder):
    e = F.col("event_id")
    jobs = T.load(spark, folder, "events").select(
        e.cast("string").alias("scan_id"),
        F.col("ts").alias("submitted_at"),
        F.when(e % 4 != 0, F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("finished_at"),
        F.when(e % 4 == 1, F.lit("analyser stopped")).alias("error"),
    )
    end = jobs.agg(F.max("submitted_at"))
    return J.job_status(jobs, end.scalar()).select("scan_id", "status", "verdict", "http_status")


@query
def progress_counts(spark, folder):
    events = T.load(spark, folder, "events").select(
        "ts", T.pick(["analyze", "cache-hit", "error", "done"], F.col("event_id") % 4).alias("kind"), F.col("user_id").alias("package")
    )
    counted = J.progress_counts(events, "1 day")
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")


@query
def rate_limit(spark, folder):
    """Accepted and rejected submissions per client with a two-day window of five."""
    events = T.load(spark, folder, "events").select(F.col("user_id").cast("string").alias("client"), F.col("ts"), F.col("event_id").alias("request_id"))
    return W.limit_batch(events, window_ms=2 * 24 * 3600 * 1000, most=5)


# --- operators without a query of their own above ----------------------------------------------------------

@query
def encoded_urls(spark, folder):
    """Page addresses as base64 and hex literals, decoded again."""
    address = F.encode("url", "UTF-8")
    one_line = F.regexp_replace(F.base64(address), r"\r\n", "")  # Spark breaks base64 after 76 characters
    literals = T.load(spark, folder, "pages").select("page_id", F.explode(F.array(one_line, F.hex(address))).alias("literal"))
    found = literals.withColumn("hit", decode_js_url("literal"))
    return found.filter(F.col("hit.url").isNotNull()).select("page_id", F.col("hit.url").alias("found"), F.col("hit.encoding").alias("encoding"))


@query
def first_per_key(spark, folder):
    """The earliest event of each user."""
    events = T.load(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return A.first_per_key(events, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query
def batch_slice(spark, folder):
    """The second batch of two hundred findings."""
    return A.batch(_keyed(spark, folder), ["event_id"], 200, 200).select("event_id", "package", "severity")


@query
def checked_findings(spark, folder):
    """All findings with their technique tags, after validation."""
    return E.checked(E.technique_tags(_keyed(spark, folder))).select("event_id", "detector")


@query
def instance_closure(spark, folder):
    """Customers, orders and parts as a graph whose names have many instances."""
    nodes, edges = T.instances(spark, folder)
    return G.subtree_closure(nodes, edges).select("direct", "name")


@query
def instance_rollup(spark, folder):
    nodes, edges = T.instances(spark, folder)
    found = T.findings(spark, folder).select(F.lit("i").alias("run_id"), F.concat(F.lit("part"), F.col("event_id") % 97).alias("package"), "severity")
    return G.rollup_by_direct(nodes, edges, found).select("direct", "max_severity", "count")


@query
def finding_order_dictionary(spark, folder):
    """Every finding with its place in its run's report; names are in dictionary order."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(*A.finding_order(), "event_id"))
    return _keyed(spark, folder).select("run_id", "event_id", "severity", "package", "detector", place.cast("long").alias("place"))


@query
def change_order_dictionary(spark, folder):
    """Every change with its place in its run's report."""
    older = F.collate(F.coalesce("version_old", F.lit("")), "UNICODE")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(*C.change_order(), older))
    changes = C.changeset(T.lock_nodes(spark, folder))
    return changes.select("run_id", "name", "kind", "version_old", "version_new", place.cast("long").alias("place"))


@query
def json_files(spark, folder):
    """Page markup as JSON files: their URLs, each once per file and without context."""
    pages = T.load(spark, folder, "pages").select(
        F.lit("pages").alias("name"), F.lit("1").alias("version"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"),
        F.col("page_id").alias("ord"), F.col("html").alias("text"),
    )
    return javascript_facts(pages).select("path", "cap", "key", "context")


@query
def markdown_text(spark, folder):
    """The text of the Markdown report: heading, severities and findings (package lines repeat their first finding)."""
    return R.markdown_lines(_keyed(spark, folder)).filter(~F.col("line").startswith("- **")).select("run_id", "line")


def _reported(spark, folder):
    """Findings as reports take them, and one row per run."""
    empty = F.array()
    found = _keyed(spark, folder).withColumns({"mitre": empty.cast("array<string>"), "provenance": empty.cast("array<array<string>>")})
    runs = A.verdicts(found, ["run_id"]).join(A.risk_scores(found, ["run_id"]), "run_id")
    return found, runs


@query
def json_findings(spark, folder):
    """The findings of the JSON report, one object per line."""
    found, runs = _reported(spark, folder)
    changes = C.changeset(T.lock_nodes(spark, folder))
    errors = spark.createDataFrame([], "run_id string, name string, version string, error string")
    rollup = spark.createDataFrame([], "run_id string, direct string, max_severity string, count long")
    lines = R.json_lines(runs, found, changes, errors, rollup).filter("section = 5")
    return lines.select("run_id", F.regexp_replace("line", "^,", "").alias("line"))


@query
def sarif_results(spark, folder):
    """The results of the SARIF report, one object per line."""
    found, runs = _reported(spark, folder)
    return R.sarif_lines(runs, found).filter("section = 3").select("run_id", F.regexp_replace("line", "^,", "").alias("line"))


@query
def findings_hash(spark, folder):
    """The hash over the findings of a change."""
    return P.findings_hash(_canonical(spark, folder), ["change_id"])


@query
def json_leaves(spark, folder):
    """Every string in nested exports with its depth."""
    return string_leaves(T.nested_exports(spark, folder), ["order_key"])


@query
def fixture_table(spark, folder):
    """The detections table: verdict, findings and detectors of each fixture."""
    return A.fixture_results(*T.detection_corpus(spark, folder)).withColumn("detectors", F.array_join("detectors", ", "))


@query
def detection_totals(spark, folder):
    """Caught and missed fixtures at four levels."""
    return A.detection_totals(A.fixture_results(*T.detection_corpus(spark, folder)))
