"""Detectors on hand-built snapshots: what fires, how it is graded, and what stays silent."""

import random

import pytest
from pyspark.sql import functions as F

from driftlens.functions import names as N
from driftlens.operators import delta, lookalike, manifest, obfuscation

PAIR = "run_id string, change_id string, package string, from_ver string, to_ver string, side string"
FACTS = PAIR + ", path string, cap string, key string, line int, snippet string, context string, kind string, ord long"
FILES = PAIR + ", path string, bytes long, sha256 string, parse_error string, entropy double, minified boolean, suspicious int, ord long"


def fact(side, cap, key, change="c", path="a.js", line=1, snippet="s", context=None, kind=None, added=False, order=0):
    return ("r", change, change, None if added else "1", "2", side, path, cap, key, line, snippet, context, kind, order)


def file(side, path, entropy=4.0, minified=False, suspicious=0, change="c", added=False, sha="x", order=0):
    return ("r", change, change, None if added else "1", "2", side, path, 10, sha, None, entropy, minified, suspicious, order)


def graded(frame):
    return sorted((r.detector, r.change_id, r.severity, r.confidence) for r in frame.collect())


def test_delta_grades(spark):
    rows = [
        fact("old", "net_module", "http"), fact("new", "net_module", "http"), fact("new", "net_module", "https"),
        fact("new", "exec_module", "vm", "n", added=True), fact("new", "url", "https://a", context="literal"), fact("new", "url", "https://b"),
        fact("new", "fs_write", "/etc/x"), fact("new", "fs_write", "out/x"), fact("new", "fs_read", "a/.npmrc"), fact("new", "env", "HOME"), fact("new", "env", "A,NPM_TOKEN"),
        fact("new", "env", "*"), fact("new", "dynamic_code", "a.js:1:vm", kind="vm"), fact("new", "dynamic_code", "a.js:2:eval", kind="eval"),
        fact("new", "dynamic_code", "a.js:2:eval", kind="eval"), fact("new", "artifact", "x.node|1", kind="node"), fact("new", "encoded_url", "https://c", kind="hex"),
        fact("new", "wasm_import", "w|env|exec", context="env", kind="exec"), fact("new", "wasm_import", "w|math|add", context="math", kind="add"),
    ]
    found = graded(delta.capability_findings(spark.createDataFrame(rows, FACTS)))
    assert found == sorted([
        ("net.new-module", "c", "WARN", "medium"), ("exec.new-module", "n", "WARN", "low"), ("net.new-endpoint", "c", "INFO", "medium"), ("net.new-endpoint", "c", "WARN", "medium"),
        ("fs.new-hotpath-write", "c", "BLOCK", "high"), ("fs.new-hotpath-read", "c", "BLOCK", "high"), ("env.token-harvest", "c", "BLOCK", "high"), ("env.token-harvest", "c", "BLOCK", "high"),
        ("code.dynamic-loading-added", "c", "BLOCK", "high"), ("code.dynamic-loading-added", "c", "WARN", "medium"), ("code.dynamic-loading-added", "c", "WARN", "medium"),
        ("bin.new-native-artifact", "c", "BLOCK", "high"), ("net.encoded-endpoint", "c", "BLOCK", "high"), ("wasm.suspicious-import", "c", "BLOCK", "high"),
    ])


def test_best_url_evidence_and_first_evidence(spark):
    rows = [
        fact("new", "url", "https://a", path="z.txt", context="comment", order=1), fact("new", "url", "https://a", path="b.js", context="network-arg", order=9),
        fact("new", "url", "https://a", path="c.js", context="network-arg", order=12), fact("new", "net_module", "ws", path="late.js", order=5), fact("new", "net_module", "ws", path="early.js", order=2),
    ]
    found = {r.detector: r.evidence[0].file for r in delta.capability_findings(spark.createDataFrame(rows, FACTS)).collect()}
    assert found == {"net.new-endpoint": "b.js", "net.new-module": "early.js"}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_a_hot_package_and_any_partitioning(spark, parts):
    """One package holds most rows; the result does not depend on how rows are spread."""
    rows = [fact("new" if i % 3 else "old", "url", f"https://h{i % 97}", "hot", order=i) for i in range(3000)]
    rows += [fact("new", "url", f"https://h{i}", f"p{i}", order=i) for i in range(50)]
    found = delta.capability_findings(spark.createDataFrame(rows, FACTS).repartition(parts))
    old = {i % 97 for i in range(3000) if i % 3 == 0}
    expected = {i % 97 for i in range(3000) if i % 3} - old
    assert found.filter("change_id = 'hot'").count() == len(expected) and found.filter("change_id != 'hot'").count() == 50


def test_concealment_in_files(spark):
    rows = [
        file("old", "a.js", 3.0), file("new", "a.js", 5.0), file("old", "dist/b.js", 4.6), file("new", "dist/b.js", 7.0),
        file("old", "c.js"), file("new", "c.js", minified=True), file("old", "d.js"), file("new", "d.js", suspicious=2), file("old", "e.js", suspicious=1), file("new", "e.js", suspicious=3),
        file("new", "lib/f.js", minified=True), file("new", "g.js", minified=True), file("new", "plain.js"), file("new", "h.js", minified=True, change="n", added=True),
    ]
    entries = spark.createDataFrame([("r", "c", "lib/f.js"), ("r", "c", "g.js")], "run_id string, change_id string, path string")
    found = {(r.detector, r.evidence[0].file): (r.severity, r.confidence) for r in obfuscation.obfuscation_findings(spark.createDataFrame(rows, FILES), entries).collect()}
    assert found == {
        ("obf.entropy-jump", "a.js"): ("WARN", "medium"), ("obf.entropy-jump", "c.js"): ("WARN", "medium"), ("obf.entropy-jump", "d.js"): ("WARN", "medium"),
        ("obf.new-obfuscated-file", "lib/f.js"): ("INFO", "low"), ("obf.new-obfuscated-file", "g.js"): ("WARN", "medium"), ("obf.new-obfuscated-file", "h.js"): ("WARN", "low"),
    }


def test_look_alike_letters(spark):
    rows = [fact("new", "url", "https://pаypal.example", path=p) for p in ("a.js", "b.txt", "c.js")] + [fact("old", "url", "https://gооgle.example", path="c.js"), fact("new", "url", "https://ünïcode.example", path="d.js")]
    found = obfuscation.confusable_boundaries(spark.createDataFrame(rows, FACTS)).collect()
    assert [r.evidence[0].file for r in found] == ["a.js"]


def test_first_version_cluster_and_fallback(spark):
    def four(change, added):
        return [fact("new", cap, k, change, added=added) for cap, k in (("net_module", "http"), ("exec_module", "vm"), ("fs_module", "fs"), ("env", "NPM_TOKEN"))]

    facts = spark.createDataFrame(four("a", True) + four("b", False) + four("c", True)[:3], FACTS)
    files = spark.createDataFrame([file("new", "x.js", change=c, added=True) for c in ("a", "c")], FILES)
    assert [r.change_id for r in delta.first_version_cluster(facts, files).collect()] == ["a"]
    whole = [fact("new", "net_module", "http", "w", added=True), fact("new", "env", "*", "w", added=True)]
    few = [fact("new", "net_module", "http", "f", added=True)] + [fact("new", "env", k, "f", added=True) for k in ("NPM_TOKEN", "GH_TOKEN")]
    found = delta.capability_findings(spark.createDataFrame(whole + few, FACTS))
    assert [r.change_id for r in delta.first_install_fallback(found).collect()] == ["w"]


@pytest.mark.parametrize("old, new, anchors, expected", [
    (["a@t.example"], [], ["@t.example"], ("BLOCK", "high")), (["a@t.example"], [], [], ("WARN", "medium")), ([], ["a@t.example"], [], ("WARN", "medium")),
    (["a@t.example"], ["z@x.example"], ["@t.example"], ("BLOCK", "high")), (["a@t.example"], ["a@t.example", "z@x.example"], ["@t.example"], ("WARN", "medium")),
    (["a@t.example"], ["b@t.example"], ["@t.example"], ("INFO", "high")), (["a@x.example"], ["b@t.example"], ["@t.example"], ("INFO", "medium")),
    (["a@x.example"], ["b@x.example"], [], ("WARN", "medium")), (["a@t.example"], ["a@t.example"], ["@t.example"], None), (["a@x.example", "b@t.example"], ["b@t.example"], ["@t.example"], ("INFO", "medium")),
])
def test_maintainer_decision_table(spark, old, new, anchors, expected):
    rows = [("r", "c", "p", "1", "2", side, "maintainer", e) for side, emails in (("old", old), ("new", new)) for e in emails]
    emails = spark.createDataFrame(rows, PAIR + ", source string, email string")
    trust = spark.createDataFrame([("p", a) for a in anchors], "package string, anchor string")
    found = [(r.severity, r.confidence) for r in manifest.maintainer_changes(emails, trust).collect()]
    assert found == ([expected] if expected else [])


POPULAR = ["lodash", "debug", "@babel/core", "react-router-dom", "date-fns", "axios"]


@pytest.mark.parametrize("name, target", [
    ("lodahs", "lodash"), ("debgu", "debug"), ("@babel/cord", "@babel/core"), ("@evil/lodash", None), ("@my-org/lodash", "lodash"), ("lodash", None), ("unrelated", None), ("axois", "axios"), ("lodashxy", "lodash"), ("lodashxyz", None),
])
def test_typosquat(spark, name, target):
    popular = spark.createDataFrame([(n, i) for i, n in enumerate(POPULAR)], "name string, ord long")
    found = lookalike.nearest_popular(spark.createDataFrame([(name,)], "name string"), popular).collect()
    assert [r.target for r in found] == ([target] if target else [])


def test_hyphen_permutation(spark):
    popular = spark.createDataFrame([(n, i) for i, n in enumerate(POPULAR)], "name string, ord long")
    asked = ["dom-router-react", "react-router", "react-router-dom-plus", "fns-date", "date-utils", "react-router-dom"]
    found = {r.name: (r.target, r.shape) for r in lookalike.hyphen_neighbours(spark.createDataFrame([(n,) for n in asked], "name string"), popular).collect()}
    assert found == {
        "dom-router-react": ("react-router-dom", "reorder"), "react-router": ("react-router-dom", "drop-token"), "react-router-dom-plus": ("react-router-dom", "add-token"), "fns-date": ("date-fns", "reorder"),
    }


def test_image_and_reader(spark):
    files = spark.createDataFrame([file("new", "assets/logo.png"), file("old", "assets/same.png"), file("new", "assets/same.png")], FILES)
    facts = spark.createDataFrame([fact("new", "fs_read", "x/logo.png", path="r.js"), fact("new", "fs_read", "assets/same.png", path="r.js"), fact("new", "dynamic_code", "k", path="s.js", kind="eval")], FACTS)
    found = delta.image_decode_exec(files, facts).collect()
    assert [(r.evidence[0].file, "logo.png" in r.message) for r in found] == [("r.js", True)]
    assert delta.image_decode_exec(files, facts.filter(F.col("cap") != "dynamic_code")).count() == 0


def plain_distance(a, b):
    """Edits with swaps of neighbours, each part of a word edited once."""
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i][j] = min(table[i][j], table[i - 2][j - 2] + 1)
    return table[-1][-1]


def edited(rng, word):
    """The word after up to two random edits, swaps over any border included."""
    for _ in range(rng.randrange(3)):
        at, kind = rng.randrange(len(word) + 1), rng.randrange(4)
        if kind == 0:
            word = word[:at] + rng.choice("abcd-é") + word[at:]
        elif kind == 1:
            word = word[:at] + word[at + 1 :]
        elif kind == 2:
            word = word[:at] + rng.choice("abcd") + word[at + 1 :]
        else:
            word = word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]
    return word


def test_segments_meet_every_word_within_two_edits(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 14))) for _ in range(150)]
    popular = [(w, i) for i, w in enumerate(dict.fromkeys(words))]
    names = sorted({edited(rng, rng.choice(words)) for _ in range(900)} | {"".join(rng.choices("abcdxyz", k=k)) for k in (1, 2, 3, 4) for _ in range(40)} - {""})
    found = {r.name: (r.target, r.distance) for r in lookalike.nearest_popular(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(popular, "name string, ord int")
    ).collect()}
    listed = {w for w, _ in popular}
    for name in names:
        if name and name not in listed:
            best = min((plain_distance(name, w), i, w) for w, i in popular)
            assert found.get(name) == ((best[2], best[0]) if best[0] <= 2 else None), name


def test_few_keys_for_a_name(spark):
    frame = spark.createDataFrame([("x" * n,) for n in range(1, 6)] + [("abcdefghij" * 4,), ("abcdefghij" * 20,)], "w string")
    sizes = frame.select(F.size(N.segment_probes(F.col("w"))).alias("p"), F.size(N.segments(F.col("w"))).alias("s"), F.size(N.short_forms(F.col("w"), 4)).alias("f")).collect()
    assert all(r.p <= 49 and r.s <= 3 and r.f <= 11 for r in sizes)


def test_candidates_of_long_names_are_few(spark):
    """Of a thousand names of twenty letters hardly any pair but the planted ones is compared."""
    rng = random.Random(3)
    popular = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(300)]
    names = [edited(rng, w) for w in popular] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(700)]
    listed = spark.createDataFrame([(w, i) for i, w in enumerate(popular)], "name string, ord int")
    assert 150 < lookalike.candidate_pairs(spark.createDataFrame([(n,) for n in names], "name string"), listed).count() < 350
