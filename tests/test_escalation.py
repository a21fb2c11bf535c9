"""Escalation against a step-by-step model, plus advisories and scores."""

import random

import pytest

from driftlens.functions import fixed_values as V
from driftlens.operators import aggregate, escalate

FINDING = (
    "run_id string, change_id string, detector string, category string, package string, from_ver string, to_ver string, "
    "direction string, severity string, confidence string, message string, "
    "evidence array<struct<file:string,line:int,snippet:string>>, code_kind string"
)
PAIRS = "run_id string, change_id string"


def finding(detector, category, severity, package="p", kind=None, change="c", confidence="high", direction="changed", to="1.0.1"):
    return ("r", change, detector, category, package, None if direction == "added" else "1.0.0", to, direction, severity, confidence, "m", [("f.js", 1, "s")], kind)


def step_by_step(rows, network):
    """The rules applied one after another, as they are described."""
    fs = [dict(i=i, det=r[2], cat=r[3], pkg=(r[1], r[4]), sev=r[8], kind=r[12]) for i, r in enumerate(rows)]
    risky = {f["pkg"] for f in fs if f["cat"] in V.OBF_PARTNER_CATEGORIES or (f["cat"] == "CODE" and f["kind"] in V.DANGEROUS_CODE_KINDS)}
    for f in fs:
        if f["cat"] == "OBF" and f["sev"] == "WARN" and f["pkg"] in risky:
            f["sev"] = "BLOCK"
    blocked = {f["pkg"] for f in fs if f["sev"] == "BLOCK" and f["cat"] in V.CAPABILITY_CATEGORIES}
    kinds = {}
    for f in fs:
        if f["sev"] == "WARN":
            kinds.setdefault(f["pkg"], set()).add(f["cat"])
    for f in fs:
        if f["det"] == "deps.typosquat-candidate" and f["sev"] == "WARN" and (f["pkg"] in blocked or len(kinds.get(f["pkg"], ())) >= 2):
            f["sev"] = "BLOCK"
    groups = {}
    for f in fs:
        if f["sev"] == "WARN":
            groups.setdefault(f["pkg"], []).append(f)
    for pkg, warns in groups.items():
        cats = {f["cat"] for f in warns}
        code = sum(f["cat"] == "CODE" and f["kind"] in V.DANGEROUS_CODE_KINDS for f in warns)
        attack = any({a, b} <= cats and ("NET" not in (a, b) or pkg[0] in network) for a, b in V.ATTACK_PAIRS)
        if (len(warns) >= 3 and len(cats) >= 2) or (len(warns) >= 2 and attack) or (len(warns) >= 3 and cats == {"OBF"}) or (code >= 3 and cats == {"CODE"}):
            for f in warns:
                f["sev"] = "BLOCK"
    return [f["sev"] for f in fs]


def escalated(spark, rows, network=()):
    numbered = [(*r[:10], str(i), *r[11:]) for i, r in enumerate(rows)]
    found = escalate.escalate(spark.createDataFrame(numbered, FINDING), spark.createDataFrame([("r", c) for c in network], PAIRS)).collect()
    return [f.severity for f in sorted(found, key=lambda f: int(f.message.split(" ")[0]))]


TYPO = ("deps.typosquat-candidate", "DEPS", "WARN")
CASES = [
    ([finding(*TYPO)], (), ["WARN"]),
    ([finding(*TYPO), finding("net.new-module", "NET", "WARN")], (), ["BLOCK", "WARN"]),
    ([finding("obf.entropy-jump", "OBF", "WARN"), finding("code.x", "CODE", "INFO", kind="dynamic-import")], (), ["WARN", "INFO"]),
    ([finding("obf.entropy-jump", "OBF", "WARN"), finding("code.x", "CODE", "WARN", kind="eval")], (), ["BLOCK", "WARN"]),
    ([finding("net.new-endpoint", "NET", "INFO"), finding("code.x", "CODE", "INFO", kind="dynamic-import")], (), ["INFO", "INFO"]),
    ([finding("net.new-endpoint", "NET", "WARN"), finding("exec.new-module", "EXEC", "WARN")], ("c",), ["BLOCK", "BLOCK"]),
    ([finding("net.new-endpoint", "NET", "WARN"), finding("exec.new-module", "EXEC", "WARN")], (), ["WARN", "WARN"]),
]


@pytest.mark.parametrize("index", range(len(CASES)))
def test_cases(spark, index):
    rows, network, expected = CASES[index]
    assert escalated(spark, rows, network) == expected == step_by_step(rows, network)


def test_random_findings_match_the_step_by_step_rules(spark):
    rng = random.Random(3)
    pool = [("net.new-endpoint", "NET"), ("exec.new-module", "EXEC"), ("env.token-harvest", "ENV"), ("code.x", "CODE"), ("obf.a", "OBF"),
            ("install.a", "INSTALL"), ("deps.typosquat-candidate", "DEPS"), ("meta.a", "META"), ("fs.a", "FS")]
    rows = []
    for _ in range(1500):
        detector, category = rng.choice(pool)
        package = rng.randrange(500)
        kind = rng.choice(["eval", "dynamic-import", "vm"]) if category == "CODE" else None
        rows.append(finding(detector, category, rng.choice(["BLOCK", "WARN", "WARN", "INFO", "INFO"]), f"p{package}", kind, f"c{package}"))
    network = [f"c{i}" for i in range(0, 500, 2)]
    assert escalated(spark, rows, network) == step_by_step(rows, set(network))


@pytest.mark.parametrize("version, relation", [("1.95.5", "affected"), ("1.95.7", "affected"), ("1.95.8", "adjacent"), ("1.95.11", None), ("1.95.2", "adjacent"), ("nonsense", None)])
def test_advisory_ranges(spark, version, relation):
    versions = spark.createDataFrame([("@Solana/web3.js", version)], "package string, version string")
    found = escalate.advisory_matches(versions, escalate.builtin_advisories(spark)).collect()
    assert [r.relation for r in found] == ([relation] if relation else [])


def test_pre_release_bounds(spark):
    versions = spark.createDataFrame([("colors", v) for v in ("1.4.44-liberty-1", "1.4.44-liberty-2", "1.4.44", "1.4.0")], "package string, version string")
    found = {r.version: r.relation for r in escalate.advisory_matches(versions, escalate.builtin_advisories(spark)).collect()}
    assert found["1.4.44-liberty-2"] == found["1.4.44"] == "affected"
    assert found["1.4.44-liberty-1"] == "adjacent" and found["1.4.0"] == "adjacent"


def test_advisory_raises_confidence(spark):
    rows = [finding("net.new-endpoint", "NET", "WARN", "coa", confidence="low", to="2.0.3"), finding("net.new-endpoint", "NET", "WARN", "coa", confidence="low", to="2.1.5")]
    found = escalate.annotate_advisories(spark.createDataFrame(rows, FINDING), escalate.builtin_advisories(spark)).collect()
    assert {r.to_ver: (r.confidence, "GHSA" in r.message) for r in found} == {"2.0.3": ("high", True), "2.1.5": ("medium", True)}


SCORES = [
    ([("BLOCK", "high", "added")], 5.0), ([("BLOCK", "high", "added")] * 2, 10.0), ([("BLOCK", "high", "added")] * 3, 10.0),
    ([("WARN", "high", "added")], 2.0), ([("INFO", "high", "added")], 0.0), ([("BLOCK", "medium", "added")], 3.5), ([("BLOCK", "low", "added")], 2.5),
    ([("BLOCK", "high", "changed")], 4.0), ([("BLOCK", "high", "absolute")], 5.0), ([("WARN", "medium", "changed")], 1.1),
    ([("BLOCK", "high", "added"), ("WARN", "low", "absolute")], 6.0), ([("BLOCK", "medium", "changed"), ("WARN", "medium", "changed")], 3.9),
]


@pytest.mark.parametrize("parts, score", SCORES)
def test_risk_scores(spark, parts, score):
    rows = [("r", *p) for p in parts]
    frame = spark.createDataFrame(rows, "run_id string, severity string, confidence string, direction string")
    assert aggregate.risk_scores(frame, ["run_id"]).collect()[0].risk_score == score


def test_malformed_findings_fail_the_job(spark):
    bad = list(finding("net.new-endpoint", "NET", "WARN"))
    bad[11] = []
    frame = escalate.technique_tags(spark.createDataFrame([tuple(bad)], FINDING))
    with pytest.raises(Exception, match="evidence missing"):
        escalate.checked(frame).collect()
    good = escalate.technique_tags(spark.createDataFrame([finding("net.new-endpoint", "NET", "WARN")], FINDING))
    assert escalate.checked(good).collect()[0].mitre == ["T1071.001", "T1041", "T1567"]
