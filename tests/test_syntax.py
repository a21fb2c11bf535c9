"""Brackets, literals and patterns of JavaScript: where text stops being well formed."""

import random

import pytest
from pyspark.sql import functions as F

from driftlens.operators import syntax_javascript as S

FINE = [
    "", "a = b / c / d;", "x = /[/'\"]/g; y = 'z'", "if (a) /re'/.test(b)", "f(a)/2; g('x')", "return /[']/", "`a ${b + `c ${d}` } e`", "a = {b: 1} / 2; s = '/'",
    "// it's\n/* don't */ x()", "#!/usr/bin/env node\nvar a = 'b'", "a\n/b/g", "x = a++ / 2; y = \"'\"", "'a\\\nb'", "/* a/*/ b()", "/* \\*/ c()", "// \\\nd('e')",
    "(" + " " * 200 + "/['\"]/)", "y = x => /'/", "function f() {}\n/'/.exec(s)", "a = b\n{ /'/ }", "a.return / 2; c = \"'\"", "x = `\\`` + '`'", "p = /a\\/'/", "t = `$` + `$a` + '}'", "z = /[\\]'/]/",
    "case /'/: break", "w = a / (b) / c", "ü = 1 / 2; v = '\"'", "é / 2 / \"'\".length", "a$ / 2 / \"'\".length", "$return / 2 / \"'\".x", "éreturn / 2 / \"'\".x", "'a\\\r\nb'", "$${a}", "$\nreturn /'/", "x.in / 2 / \"'\"",
]
BROKEN = {
    "f(": "Unexpected token (1:2)", "a)": "Unexpected token (1:1)", "x = 'abc\ny": "Unterminated string constant (1:4)", "a\nb = \"c": "Unterminated string constant (2:4)",
    "/* a\n": "Unterminated comment (1:0)", "x = `a ${b": "Unexpected token (1:10)", "x = `a": "Unterminated template (1:4)", "x = /ab\nc": "Unterminated regular expression (1:4)",
    "x = /a[/]": "Unterminated regular expression (1:4)", "{ ( }": "Unexpected token (1:4)", "a]\n": "Unexpected token (1:1)", "don't do that": "Unterminated string constant (1:3)",
    "a\r\nb\rc)": "Unexpected token (3:1)", "x = /\\\n/": "Unterminated regular expression (1:4)", "f(`${a)}`)": "Unexpected token (1:6)", "({": "Unexpected token (1:2)",
}


def run(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r.id: r for r in S.parsed(frame).select("id", S.parse_error().alias("error"), S.without_patterns("/./").alias("rest")).collect()}


def test_well_formed(spark):
    found = run(spark, FINE)
    assert {FINE[i]: r.error for i, r in found.items() if r.error} == {}


def test_first_error_and_its_place(spark):
    texts = list(BROKEN)
    assert {texts[i]: r.error for i, r in run(spark, texts).items()} == {t: e.replace(" (", ". (") for t, e in BROKEN.items()}


def test_patterns_are_replaced_and_the_rest_cut(spark):
    found = run(spark, ["a = /x'/g + b/2; /[/]/.test('q') + '", "s = 1", "f(/a/, /b/) /c", None])
    assert [found[i].rest for i in range(4)] == ["a = /./g + b/2; /./.test('q') + ", "s = 1", "f(/./, /./) /c", ""]


@pytest.mark.parametrize("size", [200_000])
def test_work_is_linear(spark, size):
    """Long runs of what once needed look-behind or nesting end in seconds."""
    texts = [" " * size + "/'/", "(" * (size // 20) + ")" * (size // 20), "a = /x/; " * (size // 50), "\n" * size, "'" * size, "a$" * size, "$" * size]
    found = run(spark, texts)
    assert [found[i].error for i in range(7)] == [None] * 7


def test_errors_of_files(spark):
    rows = [("p", "1", "a.js", "f("), ("p", "1", "b.json", "{"), ("p", "1", "c.tsx", "<p>don't</p>"), ("p", "1", "d.mjs", "g()"), (None, None, "e.js", None)]
    files = spark.createDataFrame(rows, "name string, version string, path string, text string")
    assert [tuple(r) for r in S.parse_errors(files.withColumn("lexeme", F.lit(1))).collect()] == [("p", "1", "a.js", "Unexpected token. (1:2)")]


def test_plain_texts_need_no_machine(spark, monkeypatch):
    """A text without patterns is one lexeme; what the shortcut takes is what the machine finds sound and leaves as it is."""
    rng = random.Random(5)
    parts = ["a", "1 ", "'x'", '"y', '"', "'", "`", "${", "}", "{", "(", ")", "[", "]", "//", "/*", "*/", "/", "\\", "\n", "\r", "$", "#!", "=>", ";", "it's"]
    sound = "const m = f({a: [1, \"b'\"]}); // it's\n/* don't */ g(`x\n$`, 'c\\'d')"
    texts = [sound, "(" * 20 + ")" * 20, *FINE, *BROKEN, *("".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(3000))]
    quick = run(spark, texts)
    frame = spark.createDataFrame([(0, sound)], "id int, text string")
    assert S.parsed(frame).select(F.size("lexemes")).first()[0] == 1
    monkeypatch.setattr(S, "_plainly_sound", lambda text: F.lit(False))
    slow = run(spark, texts)
    assert {texts[i]: (quick[i], slow[i]) for i in slow if quick[i] != slow[i]} == {}
