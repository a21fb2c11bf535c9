"""Facts found in source text, and text that must not produce any."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.functions import folding, names, text
from driftlens.operators import dataflow_javascript as D
from driftlens.operators import scan_javascript as J
from driftlens.operators.scan_javascript import javascript_facts
from driftlens.operators.scan_python import python_facts, setup_hooks

FILES = "name string, version string, path string, text string, ord long"
SECRET = base64.b64encode(b"https://evil.example/collect?x=1").decode()
OPAQUE = "".join(random.Random(1).choices([chr(c) for c in range(40, 91)], k=400))


def facts(spark, scanner, body, path):
    frame = spark.createDataFrame([("p", "1", path, body, 0)], FILES)
    return {(r.cap, r.key, r.line) for r in scanner(frame).collect()}


def js(spark, body):
    return {(c, k) for c, k, _ in facts(spark, javascript_facts, body, "a.js")}


JS = [
    ("require('htt' + 'ps')", ("net_module", "https")), ("const m = 'child_process'; require(m);", ("exec_module", "child_process")),
    ("require(['f','s'].join(''))", ("fs_module", "fs")), ("require(String.fromCharCode(110,101,116))", ("net_module", "net")),
    ("require(atob('aHR0cA=='))", ("net_module", "http")), ("require(Buffer.from('6e6574','hex').toString())", ("net_module", "net")),
    ("require(`dns`)", ("net_module", "dns")), ("import x from 'axios';", ("net_module", "axios")), ("import 'vm';", ("exec_module", "vm")),
    ("require.call(null, 'ws')", ("net_module", "ws")), ("process.mainModule.require('tls')", ("net_module", "tls")), ("Module._load('got')", ("net_module", "got")),
    ("eval(\"require('undici')\")", ("net_module", "undici")), ("import('node:dns')", ("net_module", "node:dns")), (r"require('\x68ttp')", ("net_module", "http")),
    ("process.env['NPM_' + 'TOKEN']", ("env", "NPM_TOKEN")), ("const e = process.env; e.GH_TOKEN;", ("env", "GH_TOKEN")),
    ("const p = process; const q = p.env; q.GH_TOKEN;", ("env", "GH_TOKEN")), ("const {A: b, ...r} = process.env;", ("env", "*")),
    ("Object.keys(process.env)", ("env", "*")), ("x = {...process.env}", ("env", "*")), ("Reflect.get(process.env, 'K')", ("env", "K")),
    ("fs.writeFileSync('/etc/x', 1)", ("fs_write", "/etc/x")), ("fs.readFile(path.join(os.homedir(), '.ssh', x), cb)", ("fs_read", "~/.ssh/?")),
    ("fs.promises.unlink('a/b')", ("fs_write", "a/b")), ("const g = require('fs'); g.appendFile('z/q', 1)", ("fs_write", "z/q")),
    (f"const s = '{SECRET}';", ("encoded_url", "https://evil.example/collect?x=1")), (f"const s = '{OPAQUE}';", ("suspicious_literal", "")),
    ("const u = 'api.attacker.app/x';", ("url", "api.attacker.app/x")),
]


@pytest.fixture(scope="module")
def js_found(spark):
    frame = spark.createDataFrame([("p", str(i), "a.js", body, 0) for i, (body, _) in enumerate(JS)], FILES)
    found = {}
    for r in javascript_facts(frame).collect():
        found.setdefault(int(r.version), set()).add((r.cap, r.key))
    return found


@pytest.mark.parametrize("index", range(len(JS)), ids=[b[:30] for b, _ in JS])
def test_javascript_fact(js_found, index):
    assert JS[index][1] in js_found.get(index, set())


@pytest.mark.parametrize("body", [
    "// require('http') and process.env.TOKEN", "/* eval(x) */ const a = 1;", "const s = \"require('http')\";", "const s = 'it\\'s eval(1)';",
    "const s = `fs.readFile('/etc/x')`;", "obj.eval(1); obj.require('http');", "const r = /require('http')/;", "Cursor.app",
])
def test_javascript_words_that_are_not_code(spark, body):
    assert js(spark, body) == set()


def test_javascript_lines_and_call_sites(spark):
    found = facts(spark, javascript_facts, "\n/* a\n b */\neval(x); eval(y);\nconst t = `1\n2`;\nnew Function(z);\n", "a.js")
    assert ("dynamic_code", "a.js:4:eval", 4) in found and ("dynamic_code", "a.js:7:new-function", 7) in found
    frame = spark.createDataFrame([("p", "1", "a.js", "eval(x); eval(y);", 0)], FILES)
    assert javascript_facts(frame).filter("kind = 'eval'").count() == 2


def test_facts_before_a_syntax_error_stay(spark):
    found = facts(spark, javascript_facts, "require('net');\nx = 'it\nrequire('http'); eval(y)", "a.js")
    assert found == {("net_module", "net", 1), ("parse_error", "Unterminated string constant. (2:4)", 2)}
    assert ("net_module", "http", 1) in facts(spark, javascript_facts, "require('http'); let a = <p>it's</p>;", "a.jsx")
    blanks = " " * 100
    assert facts(spark, javascript_facts, f"f({blanks}/['\"]/); require('net')", "a.js") == {("net_module", "net", 1)}


def test_javascript_url_contexts(spark):
    body = 'fetch("https://a.example/1"); const c = {url: "https://b.example/2", z: "https://c.example/3"}; // https://d.example/4\nconst j = "https://" + "e.example/5";'
    frame = spark.createDataFrame([("p", "1", "a.js", body, 0)], FILES)
    found = {r.key: r.context for r in javascript_facts(frame).filter("cap = 'url'").collect()}
    assert found == {"https://a.example/1": "network-arg", "https://b.example/2": "config-value", "https://c.example/3": "literal", "https://d.example/4": "comment", "https://e.example/5": None}


def test_json_files(spark):
    body = '{"x": "https://a.example/1"}'
    assert facts(spark, javascript_facts, body, "data.json") == {("url", "https://a.example/1", 1)}
    assert facts(spark, javascript_facts, body, "package.json") == set()


def test_long_strings_with_many_escapes(spark):
    body = 'const s = "' + "\\x41" * 20000 + "\\\"" * 5000 + '"; require("http");'
    assert ("net_module", "http") in js(spark, body)


PY = '''
import os
import subprocess
from urllib.request import urlopen as u, Request
"""import socket"""
a = os.environ.get("NPM_TOKEN"); b = os.environ["HOME"]
for k in os.environ: pass
c = os.getenv('PYPI_TOKEN')
open("/etc/passwd"); open('/root/x', 'w')
Path("~/.netrc").read_text(); shutil.copy("a", "/etc/b"); os.remove("gone")
exec(code)  # eval(
d = "exec(" + 'it\\'s'
__import__("x")
compile(src, "f", "exec")
marshal.loads(q)
e = "https://py.example/p"
'''


def test_python_facts(spark):
    found = facts(spark, python_facts, PY, "a.py")
    keys = {(c, k) for c, k, _ in found}
    assert {
        ("fs_module", "os"), ("exec_module", "subprocess"), ("net_module", "urllib.request"), ("net_module", "urllib.request.urlopen"), ("net_module", "urllib.request.Request"),
        ("env", "NPM_TOKEN"), ("env", "HOME"), ("env", "*"), ("env", "PYPI_TOKEN"), ("fs_read", "/etc/passwd"), ("fs_write", "/root/x"), ("fs_read", "~/.netrc"),
        ("fs_write", "/etc/b"), ("fs_write", "gone"), ("exec_module", "importlib"), ("exec_module", "marshal"), ("url", "https://py.example/p"),
        ("dynamic_code", "a.py:11:eval"), ("dynamic_code", "a.py:13:dynamic-require"), ("dynamic_code", "a.py:14:new-function"), ("dynamic_code", "a.py:15:new-function"),
    } <= keys
    assert ("net_module", "socket") not in keys and sum(k[0] == "dynamic_code" for k in keys) == 4


def test_python_decoders_and_literals(spark):
    body = f"import base64\nexec(base64.b64decode(x))\ny = ''.join(chr(1))\nz = '{SECRET}'\n\nw = '''\n{OPAQUE.replace(chr(39), '')}'''\n"
    found = facts(spark, python_facts, body, "a.py")
    assert ("url", "https://evil.example/collect?x=1", 1) in found and ("suspicious_literal", "", 6) in found
    frame = spark.createDataFrame([("p", "1", "a.py", body, 0)], FILES)
    assert python_facts(frame).filter("kind = 'char-arithmetic-decoder'").count() == 2


def test_setup_hooks(spark):
    bodies = [("1", "import os\nos.system('x')\nsetup()"), ("2", "def f():\n    os.system('x')\nsetup(cmdclass={})"), ("3", "setup()")]
    found = {r.version: r.body for r in setup_hooks(spark.createDataFrame([("p", v, "setup.py", b, 0) for v, b in bodies], FILES)).collect()}
    assert set(found) == {"1", "2"} and "os.system" in found["1"] and "cmdclass" in found["2"]


def entropy(body):
    counts = np.bincount(np.frombuffer(body.encode(), dtype=np.uint8))
    p = counts[counts > 0] / len(body.encode())
    return float(-(p * np.log2(p)).sum()) if body else 0.0


def test_entropy_matches_its_definition(spark):
    bodies = ["", "a", "aab", "ünïcödé" * 5, OPAQUE, None]
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, t string")
    found = {r.i: r.e for r in frame.select("i", text.byte_entropy(F.col("t")).alias("e")).collect()}
    assert found[5] is None
    for i, b in enumerate(bodies[:-1]):
        assert found[i] == pytest.approx(entropy(b), abs=1e-9)


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance_and_candidate_forms(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 8))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words[:30]]
    assert list(names.edit_distances([a for a, _ in pairs], [b for _, b in pairs])) == [osa(a, b) for a, b in pairs]
    frame = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", F.arrays_overlap(names.deletions_up_to_two(F.col("a")), names.deletions_up_to_two(F.col("b"))).alias("meet")
    )
    assert all(r.meet for r in frame.collect() if osa(r.a, r.b) <= 2)


def test_files_are_dealt_and_tokenised_once(spark, monkeypatch):
    """A table of sources in one part keeps every task busy, and both readers share the tokens."""
    seen, whole = [], J.tokenised
    monkeypatch.setattr(J, "tokenised", lambda files: seen.append(files.rdd.getNumPartitions()) or whole(files))
    frame = spark.createDataFrame([("p", "1", f"f{i}.js", "const e = process.env; e.HOME", i) for i in range(40)], FILES).coalesce(1)
    found = {(r.path, r.key) for r in javascript_facts(frame).collect()}
    assert found == {(f"f{i}.js", "HOME") for i in range(40)} and len(seen) == 1 and seen[0] > 1


def test_python_files_are_dealt(spark):
    """A table of sources in one part keeps every task busy."""
    frame = spark.createDataFrame([("p", "1", f"f{i}.py", "import os\neval(os.environ['A'])", i) for i in range(40)], FILES).coalesce(1)
    found = python_facts(frame)
    assert found.rdd.getNumPartitions() > 1
    assert {(r.path, r.key) for r in found.collect() if r.cap == "env"} == {(f"f{i}.py", "A") for i in range(40)}


def test_one_table_is_written_whatever_the_flow(spark, monkeypatch):
    """Facts need no other file, so nothing is joined and no round of the flow writes a table."""
    written, cut = [], J.cut_lineage
    for module in (J, D):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(df) or cut(df), raising=False)
    chain = "const n0 = process;" + "".join(f"n{i + 1} = n{i};" for i in range(9)) + "const { env: e } = n9; e.HOME"
    frame = spark.createDataFrame([("p", "1", f"f{i}.js", chain, i) for i in range(3)] + [("p", "1", "f0.js", chain, 0)], FILES)
    assert sorted((r.path, r.cap, r.key) for r in javascript_facts(frame).collect()) == [(f"f{i}.js", "env", "HOME") for i in range(3)]
    assert len(written) == 1


def test_folding_compiles_no_pattern_for_a_file(monkeypatch):
    def refuse(*_):
        raise AssertionError("a pattern is compiled")

    text = "const a$1 = «61»; const p = process; const q = p.env;\nlet fs = require(«6673»); x = (a$1 + «62»); b = q;\nq = q;\nfs.x; q.K"
    expected = "const a$1 = «61»; const p = process; const q = process.env;\nlet fs = require(«6673»); x = ‹6162›; b = process.env;\nq = q;\nfs.x; process.env.K"
    assert folding.fold_text(text) == expected
    monkeypatch.setattr(folding.re, "compile", refuse)
    monkeypatch.setattr(folding.re, "_compile", refuse, raising=False)
    assert folding.fold_text(text) == expected
