"""Aliases, destructuring, arguments and results of JavaScript, up to environment and file facts."""

import pytest

from driftlens.operators.scan_javascript import javascript_facts

CASES = {
    "const p = process; const e = p.env; const f = e; f.NPM_TOKEN": {("env", "NPM_TOKEN")},
    "const { env } = process; env.A": {("env", "A")},
    "const { env: { NPM_TOKEN: t, HOME } } = process;": {("env", "NPM_TOKEN"), ("env", "HOME")},
    "const { ...rest } = e; let e = process.env": {("env", "*")},
    "function f(x, y) { return y.KEY } f(1, process.env)": {("env", "KEY")},
    "const g = v => v.K2; const q = process['env']; g(q)": {("env", "K2")},
    "function h() { return process.env } const z = h(); z['Q' + 'R']": {("env", "QR")},
    "const k = () => process?.env; const { AB } = k()": {("env", "AB")},
    "const r = Reflect.get(process, 'env'); for (const i in r) {}": {("env", "*")},
    "a = b; b = a; b = process.env; Object.keys(a)": {("env", "*")},
    "const s = process.env; s[name]": {("env", "*")},
    "const m = require('fs'); const w = m; w.writeFileSync('/etc/x', 1)": {("fs_write", "/etc/x")},
    "const { promises: { readFile: rf } } = require('fs'); rf('/k')": {("fs_read", "/k")},
    "function use(lib) { lib.promises.unlink('a/b') } use(require('node:fs'))": {("fs_write", "a/b")},
    "const env = other; env.X; process.cwd(); const c = process.argv; c.env": set(),
    "import fs from 'fs'; const save = fs; function put(t) { t.appendFile('log/z', 1) } put(save)": {("fs_write", "log/z")},
    "x = y; y = x; x.env": set(),
    "": set(),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [("p", "1", f"f{i}.js", t, i) for i, t in enumerate(CASES)]
    rows += [("p", "1", "null.js", None, 99)]
    out = {}
    frame = spark.createDataFrame(rows, "name string, version string, path string, text string, ord long")
    for r in javascript_facts(frame).filter("cap IN ('env', 'fs_read', 'fs_write')").collect():
        out.setdefault(r.path, []).append((r.cap, r.key))
    return out


@pytest.mark.parametrize("index", range(len(CASES)))
def test_flow(found, index):
    facts = found.get(f"f{index}.js", [])
    assert set(facts) == list(CASES.values())[index] and len(facts) == len(set(facts))


def test_files_do_not_share_names(spark):
    """Two versions of a file have the same path and place in their archives, but each its own names."""
    rows = [("p", "1", "a.js", "const e = process.env;", 0), ("p", "2", "a.js", "const e = other; e.TOKEN", 0)]
    frame = spark.createDataFrame(rows, "name string, version string, path string, text string, ord long")
    assert javascript_facts(frame).filter("cap = 'env'").count() == 0
