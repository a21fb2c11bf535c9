"""Configuration, admission, receipts, gate, snapshots, other scanners' reports, jobs and the limiter."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from driftlens.functions import names
from driftlens.operators import assurance, policy
from driftlens.plans import tables
from driftlens.sources import scanner_reports as SR
from driftlens.sources import snapshots
from driftlens.streaming import jobs, limiter

EVIDENCE = "array<struct<file:string,line:int,snippet:string>>"


@pytest.mark.parametrize("bad", [
    "not json", "[]", '{"version": 2}', '{"surprise": 1}', '{"allowlist": {"a": ["NOPE"]}}', '{"severityOverride": {"net.x": "LOUD"}}',
    '{"ignorePathsInside": {"a": ["x"]}}', '{"trustedPublishers": {"a": ["   "]}}', '{"failOn": ["ab"]}', '{"ignorePackages": "a"}',
])
def test_bad_configurations_are_refused(bad):
    with pytest.raises(policy.ConfigError):
        policy.parse_config(bad)


def test_configuration_order(spark):
    rows = [
        ("1", "net.new-endpoint", "NET", "a", "WARN", "lib/x.js"), ("2", "net.new-endpoint", "NET", "gone", "WARN", "lib/x.js"),
        ("3", "exec.new-module", "EXEC", "a", "WARN", "vendor/x.js"), ("4", "integrity.hash-mismatch", "INTEG", "gone", "BLOCK", "package.json"),
        ("5", "meta.maintainer-change", "META", "a", "WARN", "package.json"), ("6", "code.x", "CODE", "a", "WARN", "lib/x.js"),
        ("7", "integrity.hash-mismatch", "INTEG", "a", "BLOCK", "package.json"),
    ]
    shaped = [(i, d, c, p, s, "m", [(f, 1, "maintainers: [] → [me@corp.example]")]) for i, d, c, p, s, f in rows]
    frame = spark.createDataFrame(shaped, f"change_id string, detector string, category string, package string, severity string, message string, evidence {EVIDENCE}")
    config = policy.parse_config(json.dumps({
        "allowlist": {"a": ["NET", "INTEG"]}, "severityOverride": {"net.new-endpoint": "BLOCK", "code.x": "INFO", "integrity.hash-mismatch": "INFO"},
        "ignorePackages": ["gone"], "ignorePathsInside": {"a": ["vendor/"]}, "trustedPublishers": {"a": ["@corp.example"]},
    }))
    found = {r.change_id: r.severity for r in policy.apply_config(frame, policy.config_tables(spark, config)).collect()}
    assert found == {"1": "BLOCK", "4": "BLOCK", "5": "INFO", "6": "INFO", "7": "BLOCK"}


def test_fail_on(spark):
    findings = spark.createDataFrame([("r1", "net.new-endpoint"), ("r2", "network.x")], "run_id string, detector string")
    wanted = spark.createDataFrame([("net",)], "detector string")
    assert [r.run_id for r in policy.forced_failure(findings, wanted, by_prefix=True).collect()] == ["r1"]
    assert policy.forced_failure(findings, wanted).count() == 0


def test_config_in_the_same_change(spark):
    rows = [("same", "x", "x"), ("new", "x", None), ("edited", "x", "y"), ("none", None, "x")]
    frame = spark.createDataFrame(rows, "run_id string, current_text string, baseline_text string")
    found = {r.run_id: (r.severity, r.direction, r.from_ver) for r in policy.config_findings(frame).collect()}
    assert found == {"new": ("BLOCK", "added", None), "edited": ("BLOCK", "changed", "baseline")}
    assert {r.severity for r in policy.config_findings(frame, strict=False).collect()} == {"WARN"}


@pytest.mark.parametrize("severities, detector, rules, decision", [
    (["INFO"], "analysis.failed", policy.Policy(), "block"), (["INFO"], "analysis.failed", policy.Policy(fail_closed=False), "review"),
    (["BLOCK"], "x", policy.Policy(), "block"), (["WARN"], "x", policy.Policy(), "review"), (["WARN"], "x", policy.Policy(review=()), "allow"),
    (["INFO"], "x", policy.Policy(block=("INFO",)), "block"),
])
def test_admission(spark, severities, detector, rules, decision):
    frame = spark.createDataFrame([("k", s, detector) for s in severities], "k string, severity string, detector string")
    assert policy.admission(frame, rules, ["k"]).collect()[0].decision == decision


def test_receipts_detect_changes(spark):
    row = {f: f'va"l\\{f}' for f in policy.RECEIPT_FIELDS}
    issued = policy.receipts(spark.createDataFrame([row]))
    assert policy.verify_receipts(issued).collect()[0].valid
    for field in policy.RECEIPT_FIELDS:
        assert not policy.verify_receipts(issued.withColumn(field, F.lit("other"))).collect()[0].valid


def test_findings_digest_ignores_order_only(spark):
    rows = [("k", i, f"m{i % 7}") for i in range(50)]
    frame = spark.createDataFrame(rows, "k string, i int, m string")
    digest = lambda f: policy.findings_digest(f, ["k"]).collect()[0].findings_hash
    assert digest(frame) == digest(frame.orderBy(F.desc("i")).repartition(7))
    assert digest(frame) != digest(frame.filter("i > 0")) and digest(frame) != digest(frame.withColumn("m", F.lit("x")))


def test_merge_gate(spark):
    rows = [
        ("both", "install.script-added", 'Lifecycle script "postinstall" was added', "x"), ("both", "env.token-harvest", "m", "process.env.NPM_TOKEN"),
        ("worse", "install.script-changed", 'Lifecycle script "install" body changed', "x"), ("worse", "env.token-harvest", "m", "GITHUB_TOKEN"), ("worse", "net.new-endpoint", "m", "x"),
        ("hook", "install.script-added", 'Lifecycle script "postinstall" was added', "x"), ("hook", "env.token-harvest", "m", "process.env.HOME"),
        ("test", "install.script-added", 'Lifecycle script "test" was added', "x"), ("test", "env.token-harvest", "m", "NPM_TOKEN"),
    ]
    frame = spark.createDataFrame([(p, d, m, [("f", 1, s)]) for p, d, m, s in rows], f"package string, detector string, message string, evidence {EVIDENCE}")
    found = {r.package: r.violation for r in policy.merge_gate(frame, ["package"]).collect()}
    assert found == {"both": "install-time-secret-harvest", "worse": "install-time-secret-exfiltration"}
    runs = spark.createDataFrame([("a", None, 1, 0), ("b", 2, 1, 3), ("c", 2, 1, 0)], "run_id string, schema_version int, finding_count int, error_count int")
    assert {r.run_id: r.violation for r in policy.gate_problems(runs).collect()} == {"a": "analysis-invalid", "b": "analysis-error"}


def test_snapshot_table(spark, tmp_path):
    path, key = str(tmp_path / "snapshots"), b"k" * 32
    frame = spark.createDataFrame([("a", "1", "sha512-x", "body"), ("b", "1", "sha512-y", "body")], "name string, version string, integrity string, facts string")
    snapshots.write_snapshots(frame, path, key)
    stored = snapshots.read_snapshots(spark, path, key)
    assert sorted(r.name for r in stored.collect()) == ["a", "b"] and stored.columns == frame.columns
    assert snapshots.read_snapshots(spark, path, b"other").count() == 0
    forged = spark.read.parquet(path).withColumn("facts", F.when(F.col("name") == "a", "evil").otherwise(F.col("facts")))
    assert [r.name for r in snapshots.authentic(forged, key).collect()] == ["b"]
    asked = spark.createDataFrame([("a", "1", "sha512-x"), ("c", "1", "sha512-z"), ("b", "1", "")], "name string, version string, integrity string")
    hits, misses = snapshots.cached(asked, stored)
    assert [r.name for r in hits.collect()] == ["a"] and sorted(r.name for r in misses.collect()) == ["b", "c"]


@pytest.mark.parametrize("email, anchor, trusted", [
    ("octocat@app.github.com", "@github.com", True), ("octocat@github.com.evil.example", "@github.com", False), ("Sindre@x.example", "sindre", True),
    ("a@b.example", "a", False), ("me@b.example", "me@b.example", True), ("xgithub.com@evil.example", "@github.com", False), ("x@notgithub.com", "@github.com", False),
])
def test_trust_anchors(spark, email, anchor, trusted):
    frame = spark.createDataFrame([(email, anchor)], "e string, a string")
    assert frame.select(names.anchor_trusts(F.col("e"), F.col("a")).alias("t")).collect()[0].t is trusted


def test_other_scanners(spark):
    audit = json.dumps({"vulnerabilities": {"a": {"severity": "high", "via": [{"title": "bad", "url": "https://x.example/CVE-2023-12345"}, "b"]}, "b": {"severity": "low", "via": ["a"]}}})
    osv = json.dumps({"results": [{"packages": [{"package": {"name": "c"}, "vulnerabilities": [{"id": "GHSA-1", "summary": "s", "aliases": ["CVE-2020-1111"], "database_specific": {"severity": "MEDIUM"}}]}]}]})
    dog = json.dumps({"package": "d", "results": {"exec": {"setup.py": "x"}, "quiet": {}}})
    one = lambda text: spark.createDataFrame([("r", text)], "report_id string, text string")
    found = SR.npm_audit(one(audit)).unionByName(SR.osv(one(osv))).unionByName(SR.guarddog(one(dog)))
    assert {(r.scanner, r.package, r.severity, r.cve, r.title) for r in found.collect()} == {
        ("npm-audit", "a", "HIGH", "CVE-2023-12345", "bad"), ("osv-scanner", "c", "MODERATE", "CVE-2020-1111", "s"), ("guarddog", "d", "HIGH", None, "exec"),
    }
    left = SR.unmatched(found, spark.createDataFrame([("d",)], "package string"))
    known, pending = SR.classified(left, spark.createDataFrame([("npm-audit", "a", "bad", "advisory-only")], "scanner string, package string, title string, class string"))
    assert [r["class"] for r in known.collect()] == ["advisory-only"] and [r.package for r in pending.collect()] == ["c"]


def test_stored_text_is_defanged(spark):
    rows = [(1, "curl https://real.site.com/x"), (2, "curl https://a.invalid/x"), (3, 'bash -c "echo hi; true"'), (4, "bash -c 'rm -rf x'"), (5, "ssh://git.corp.dev/x 8.8.8.8 127.0.0.1"),
            (6, "eval(" + "A" * 90 + ")")]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted({r.doc_id for r in assurance.runnable_commands(frame).collect()}) == [1, 4]
    assert {(r.doc_id, r.host) for r in assurance.live_hosts(frame).collect()} == {(1, "real.site.com"), (5, "git.corp.dev"), (5, "8.8.8.8")}
    assert [r.doc_id for r in assurance.encoded_payloads(frame).collect()] == [6]


def replay(requests, window, most):
    recent, out = {}, {}
    for client, ms, request in sorted(requests, key=lambda r: (r[0], r[1], r[2])):
        ok, wait, recent[client] = limiter.decide(recent.get(client, []), ms, window, most)
        out[(client, request)] = (ok, wait)
    return out


def as_frame(spark, requests):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, start + dt.timedelta(milliseconds=ms), r) for c, ms, r in requests], "client string, ts timestamp, request_id long")


def test_limiter_matches_a_replay(spark):
    rng = random.Random(11)
    requests = [("busy", rng.randrange(0, 400_000), i) for i in range(1500)]  # one client with most of the load
    requests += [(f"c{rng.randrange(20)}", rng.randrange(0, 4_000_000), i) for i in range(1500, 2500)]
    requests += [("burst", 5_000, i) for i in range(2500, 2520)]  # one millisecond
    found = {(r.client, r.request_id): (r.accepted, r.retry_after_s) for r in limiter.limit_batch(as_frame(spark, requests), 60_000, 5).collect()}
    assert found == replay(requests, 60_000, 5)


def test_limiter_whole_events_table(spark):
    folder, window = "/root/testdata/sf0.001", 2 * 24 * 3600 * 1000
    from driftlens.plans.registry import REGISTRY

    events = tables.load(spark, folder, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id").collect()
    requests = [(str(r.user_id), r.ms, r.event_id) for r in events]
    found = {(r.client, r.request_id): (r.accepted, r.retry_after_s) for r in REGISTRY["rate_limit"](spark, folder).collect()}
    assert found == replay(requests, window, 5)


def test_limiter_stream(spark, tmp_path):
    requests = [("a", i * 1000, i) for i in range(8)] + [("b", 0, 100)] + [("a", 70_000, 8)]
    source = str(tmp_path / "in")
    as_frame(spark, requests).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("client string, ts timestamp, request_id long").parquet(source)
    query = limiter.limit_stream(stream).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    finished = query.awaitTermination(60)
    query.stop()
    assert finished
    found = {(r.client, r.request_id): r.accepted for r in spark.table("limited").collect()}
    assert found == {k: v[0] for k, v in replay(requests, 60_000, 5).items()}


def test_progress_stream_with_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=m), "done") for m in (1, 2, 11, 45)]
    spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in")).withWatermark("ts", "5 minutes")
    query = jobs.progress_counts(stream, "10 minutes").writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("progress").collect()) == [1, 2]


def test_incremental_analysis_runs_once_per_content(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "snapshots")
    rows = [("a", "1", "x"), ("a", "1", "x"), ("b", "1", "y")]
    schema = "name string, version string, integrity string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    for more in ([("b", "1", "y"), ("c", "1", "z")], []):
        stream = spark.readStream.schema(schema).parquet(source)
        query = jobs.incremental_analysis(stream, table, lambda wanted: wanted, str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    assert sorted(r.name for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def test_request_checks(spark):
    base = dict(content_type="application/json", content_length=10, authorized=True, lockfile_before="{}", lockfile_after="{}", ecosystem="npm", ok=True, pending=0)
    cases = [({}, 202), ({"content_type": "text/plain"}, 415), ({"content_length": 2_000_000}, 413), ({"ok": False}, 429), ({"authorized": False}, 401), ({"ecosystem": "x"}, 400), ({"pending": 1000}, 503)]
    schema = "i int, content_type string, content_length long, authorized boolean, lockfile_before string, lockfile_after string, ecosystem string, ok boolean, pending int"
    frame = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], schema)
    found = {r.i: r.http_status for r in jobs.request_check(frame, F.col("ok"), F.col("pending")).collect()}
    assert found == {i: code for i, (_, code) in enumerate(cases)}
