"""Leaves of nested JSON and totals at several levels against plain recursion."""

import json

from driftlens.operators import aggregate as A
from driftlens.sources import json_tree
from driftlens.sources import manifests as S
from driftlens.sources.json_tree import string_leaves, unreadable

TEXTS = [
    '{"a":"x","b":{"c":"y","d":[{"e":"z"},"w",1,null,true]}}', '["p",["p",["p"]]]', '{"q\\"":"say \\"hi\\"","n":{}}', "[]", '{"a":{"b":{"c":{"d":{"e":{"f":"deep"}}}}}}',
    '"bare"', "{broken", "", None, '{"empty":""}',
]


def walk(value, depth=0):
    if isinstance(value, str) and depth:
        yield value, depth
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from walk(child, depth + 1)


def test_leaves_equal_recursion(spark):
    expected = []
    for k, text in enumerate(TEXTS):
        try:
            expected += [(k, *x) for x in walk(json.loads(text or "null"))]
        except ValueError:
            continue
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    assert sorted(map(tuple, string_leaves(frame, ["k"]).collect())) == sorted(expected)
    assert string_leaves(frame.where("false"), ["k"]).count() == 0
    assert [r["k"] for r in unreadable(frame).collect()] == [6]


def nest(depth, inner):
    for k in range(depth):
        inner = {"a": inner, "s": f"s{k}", "n": k} if k % 2 else [inner, f"e{k}", None]
    return inner


def test_leaves_below_one_pass_and_at_its_end(spark):
    inner = ["x", 1, None, True, {}, [], "", "null", "{}", "1", "ü\u0000", {"k": "y"}]
    texts = [json.dumps(nest(depth, value)) for depth in range(2 * json_tree.LEVELS + 2) for value in inner]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    expected = [(k, *x) for k, text in enumerate(texts) for x in walk(json.loads(text))]
    assert sorted(map(tuple, string_leaves(frame, ["k"]).collect())) == sorted(expected)


def test_a_usual_document_is_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(json_tree, "cut_lineage", lambda step, cut=json_tree.cut_lineage: written.append(cut(step)) or written[-1])
    frame = spark.createDataFrame([(1, '{"a":"x","b":[{"c":"y","d":[{"e":"z"},{"e":null}],"w":1}]}')], "k long, text string")
    assert sorted(map(tuple, string_leaves(frame, ["k"]).collect())) == [(1, "x", 1), (1, "y", 3), (1, "z", 5)]
    assert len(written) == 1 and written[0].count() == 3


def test_entries_of_nested_and_repeated_conditions(spark):
    texts = [
        ("a", "1", '{"main":"./m.js","exports":{".":{"import":{"types":"./t.d.ts","default":"./i.mjs"},"require":["./r.cjs",{"default":"/s.cjs"}]}},"bin":"./b.js"}'),
        ("b", "1", '{"exports":"./e.js","bin":{"x":"bin/x.js"},"browser":{"./m.js":"./no.js"}}'), ("c", "1", '{"exports":{"a":"./one.js","a":"./two.js"}}'), ("d", "1", "no json"),
    ]
    found = S.entry_files(S.package_manifests(spark.createDataFrame(texts, "name string, version string, text string")))
    assert sorted((r["name"], r["path"]) for r in found.collect()) == [
        ("a", "b.js"), ("a", "i.mjs"), ("a", "m.js"), ("a", "r.cjs"), ("a", "s.cjs"), ("a", "t.d.ts"), ("b", "bin/x.js"), ("b", "e.js"), ("c", "one.js"), ("c", "two.js"),
    ]


def test_totals_tell_no_data_from_nothing_caught(spark):
    fixtures = spark.createDataFrame(
        [("a", 2020, "t", True), ("b", 2020, "t", True), ("c", 2021, "t", False), ("d", None, "u", True)], "fixture_id string, year int, threat string, active boolean"
    )
    findings = spark.createDataFrame([("a", "d2", "INFO"), ("a", "d1", "BLOCK"), ("a", "d1", "WARN"), ("c", "d1", "WARN"), ("x", "d1", "WARN")], "fixture_id string, detector string, severity string")
    results = A.fixture_results(fixtures, findings)
    rows = {r["fixture_id"]: (r["verdict"], r["findings"], r["detectors"]) for r in results.collect()}
    assert rows == {"a": ("BLOCK", 3, ["d1", "d2"]), "b": ("CLEAN", 0, []), "c": ("WARN", 1, ["d1"]), "d": ("CLEAN", 0, [])}
    totals = {(r["level"], r["threat"], r["year"]): (r["fixtures"], r["caught"], r["missed"], r["rate"], r["rate_text"]) for r in A.detection_totals(results).collect()}
    assert totals["all", None, None] == (4, 1, 2, 0.333, "33.3%")
    assert totals["year", None, 2021] == (1, 0, 0, None, "no data") and totals["year", None, None] == (1, 0, 1, 0.0, "0.0%")
    assert totals["threat", "t", None] == (3, 1, 1, 0.5, "50.0%") and len(totals) == 3 + 2 + 3 + 1
    assert A.detection_totals(A.fixture_results(fixtures.where("false"), findings)).count() == 0
