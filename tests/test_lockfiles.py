"""Every lockfile layout into nodes and edges."""

import json

import pytest
from pyspark.sql import functions as F

from driftlens.sources import lists, lockfiles

FILES = "run_id string, side string, filename string, text string"

PNPM = """
lockfileVersion: '9.0'
importers:
  .:
    dependencies:
      express: {specifier: ^4, version: 4.18.0}
    devDependencies:
      left: {specifier: ^1, version: 1.0.0}
packages:
  /Express@4.18.0(supports@1):
    resolution: {integrity: sha512-x, tarball: https://r.example/e.tgz}
    dependencies: {body: 1.0.0}
  body@1.0.0:
    resolution: {integrity: sha512-y}
  body@2.0.0:
    resolution: {integrity: sha512-z}
  '@s/left@1.0.0':
    resolution: {integrity: sha512-l}
snapshots:
  body@1.0.0:
    dependencies: {'@s/left': 1.0.0}
"""
YARN = """# yarn lockfile v1


"@scope/a@^1.0.0", "@scope/a@^1.1.0":
  version "1.1.0"
  resolved "https://r.example/a.tgz#abc"
  integrity sha512-aaaa
  dependencies:
    chalk "^2.0.0"

chalk@^2.0.0:
  version "2.4.2"
  integrity not-sri

"alias@npm:real@^3.0.0":
  version "3.0.0"
"""
BERRY = """
__metadata:
  version: 6

"chalk@npm:^2.0.0, chalk@npm:^2.1.0":
  version: 2.4.2
  checksum: sha512-bbbb
  dependencies:
    ansi: ^1.0.0

"ansi@npm:1.0.0":
  version: 1.0.0
"""
REQUIREMENTS = """# comment
Flask[async]==2.0.1 \\
    --hash=sha256:ab --hash=sha256:cd ; python_version > '3'
-r other.txt
requests>=2.0
flask==2.0.2
A__b.c-d == 1.0  # trailing
"""
POETRY = """
[[package]]
name = "Flask_Login"
version = "0.6"
files = [{file = "x.whl", hash = "sha256:ab"}]

[package.dependencies]
Werkzeug = ">=1"

[[package]]
name = "werkzeug"
version = "2.0"

[metadata]
lock-version = "2.0"
"""
UV = """
version = 1

[[package]]
name = "app"
version = "1.0"
dependencies = [{ name = "requests" }]

[[package]]
name = "requests"
version = "2.0"
sdist = { url = "https://x.example/r.tar.gz", hash = "sha256:cd" }
"""
NPM = json.dumps({
    "name": "root", "lockfileVersion": 3,
    "packages": {
        "": {"name": "root", "version": "1.0.0", "dependencies": {"a": "1", "B": "1", "missing": "1"}},
        "node_modules/a": {"version": "1.0.0", "integrity": "sha512-a", "dependencies": {"b": "1"}, "peerDependencies": {"c": "1"}},
        "node_modules/a/node_modules/b": {"version": "2.0.0", "optionalDependencies": {"c": "1"}},
        "node_modules/B": {"version": "1.0.0"}, "node_modules/c": {"version": "1.0.0"},
        "node_modules/l": {"link": True, "resolved": "packages/l"},
        "packages/l": {"version": "1.0.0"},
    },
})


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        ("npm", "new", "package-lock.json", NPM), ("pnpm", "new", "pnpm-lock.yaml", PNPM), ("yarn", "new", "yarn.lock", YARN),
        ("berry", "new", "yarn.lock", BERRY), ("req", "new", "requirements-dev.txt", REQUIREMENTS), ("poetry", "new", "poetry.lock", POETRY),
        ("uv", "new", "uv.lock", UV), ("old", "new", "package-lock.json", '{"lockfileVersion": 1}'), ("bad", "new", "package-lock.json", "{nope"),
        ("deep", "new", "pnpm-lock.yaml", "a: " + "[" * 3000), ("what", "new", "x.bin", "???"), ("toml", "new", "uv.lock", "version = 2\n"),
    ]
    return lockfiles.lock_tables(spark.createDataFrame(rows, FILES))


def nodes(tables, run):
    return {r.key: (r.name, r.version, r.integrity) for r in tables["nodes"].filter(F.col("run_id") == run).collect()}


def edges(tables, run):
    return {(r.parent_key, r.child_key) for r in tables["edges"].filter(F.col("run_id") == run).collect()}


def test_npm(tables):
    found = nodes(tables, "npm")
    assert found["node_modules/a/node_modules/b"] == ("b", "2.0.0", "") and found["node_modules/B"] == ("b", "1.0.0", "")
    assert found[""][0] == "root" and "packages/l" not in found and "node_modules/l" not in found
    assert edges(tables, "npm") == {
        ("", "node_modules/a"), ("", "node_modules/B"), ("node_modules/a", "node_modules/a/node_modules/b"), ("node_modules/a", "node_modules/c"),
        ("node_modules/a/node_modules/b", "node_modules/c"),
    }
    assert [(r.key, r.name) for r in tables["links"].collect()] == [("node_modules/l", "l")]


def test_pnpm(tables):
    found = nodes(tables, "pnpm")
    assert found["node_modules/express"] == ("express", "4.18.0", "sha512-x")
    assert found["node_modules/body"][1] == "1.0.0" and found["node_modules/body@2.0.0"][1] == "2.0.0"
    assert edges(tables, "pnpm") == {("", "node_modules/express"), ("node_modules/express", "node_modules/body"), ("node_modules/body", "node_modules/@s/left")}


def test_yarn_classic(tables):
    found = nodes(tables, "yarn")
    assert found["node_modules/@scope/a"] == ("@scope/a", "1.1.0", "sha512-aaaa")
    assert found["node_modules/chalk"] == ("chalk", "2.4.2", "")
    assert edges(tables, "yarn") == {("node_modules/@scope/a", "node_modules/chalk")}
    assert [(r.declared_name, r.real_name, r.version) for r in tables["aliases"].filter("run_id = 'yarn'").collect()] == [("alias", "real", "3.0.0")]


def test_yarn_berry(tables):
    found = nodes(tables, "berry")
    assert found["node_modules/chalk"] == ("chalk", "2.4.2", "sha512-bbbb") and found["node_modules/ansi"][1] == "1.0.0"
    assert edges(tables, "berry") == {("node_modules/chalk", "node_modules/ansi")}
    assert tables["aliases"].filter("run_id = 'berry'").count() == 0


def test_requirements(tables):
    found = nodes(tables, "req")
    assert found["pypi/flask"] == ("flask", "2.0.1", "sha256-ab") and found["pypi/flask@2.0.2"] == ("flask", "2.0.2", "")
    assert found["pypi/requests"] == ("requests", "", "") and found["pypi/a-b-c-d"] == ("a-b-c-d", "1.0", "")
    assert {p for p, _ in edges(tables, "req")} == {""} and len(edges(tables, "req")) == 4


def test_poetry_and_uv(tables):
    assert nodes(tables, "poetry")["pypi/flask-login"] == ("flask-login", "0.6", "sha256-ab")
    assert edges(tables, "poetry") == {("pypi/flask-login", "pypi/werkzeug")}
    assert nodes(tables, "uv")["pypi/requests"] == ("requests", "2.0", "sha256-cd")
    assert edges(tables, "uv") == {("pypi/app", "pypi/requests")}


def test_bad_files_become_error_rows(tables):
    assert {r.run_id for r in tables["errors"].collect()} == {"old", "bad", "deep", "what", "toml"}


@pytest.mark.parametrize("text, kind", [
    ("  {}", "npm"), ("lockfileVersion: 9\n", "pnpm"), ("__metadata:\n  version: 6\n", "yarn-berry"), ("# yarn lockfile v1\n", "yarn-classic"),
    ("# This file was autogenerated by uv\n", "pypi-uv"), ('[metadata]\nlock-version = "2.0"\n', "pypi-poetry"), ("[[package]]\nname = 'a'\nversion = 1\n", "pypi-uv"),
    ("flask==1.0\n", "pypi-requirements"), ("prose\n", None),
])
def test_content_detection(spark, text, kind):
    frame = spark.createDataFrame([(None, text)], "filename string, text string")
    assert frame.select(lockfiles.lockfile_kind(F.col("filename"), F.col("text")).alias("k")).collect()[0].k == kind


def test_folder_layout_and_bump_list(spark, tmp_path):
    folder = tmp_path / "runs" / "r1" / "new"
    folder.mkdir(parents=True)
    (folder / "requirements.txt").write_text("flask==1.0\n")
    row = lockfiles.read_lockfiles(spark, str(tmp_path / "runs")).collect()[0]
    assert (row.run_id, row.side, row.filename) == ("r1", "new", "requirements.txt")
    listed = tmp_path / "bumps.txt"
    listed.write_text("# header\n@s/a@1.0.0..1.1.0\nb@1..b@2\n\nnonsense\n")
    assert [(r.package, r.old_version, r.new_version) for r in lists.read_bumps(spark, str(listed)).orderBy("ord").collect()] == [("@s/a", "1.0.0", "1.1.0"), ("b", "1", "2")]


def test_documents_are_read_once_for_the_nodes(spark):
    """Keys of repeated names need no second reading of the files, and files of one part are dealt."""
    text = '# yarn lockfile v1\n\n\na@1:\n  version "1"\n\na@2:\n  version "2"\n\na@3:\n  version "2"\n'
    files = spark.createDataFrame([(f"r{i}", "new", "yarn.lock", text) for i in range(40)], "run_id string, side string, filename string, text string").coalesce(1)
    nodes = lockfiles.lock_tables(files)["nodes"]
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r.run_id, r.key) for r in nodes.collect()} == {(f"r{i}", k) for i in range(40) for k in ("", "node_modules/a", "node_modules/a@2", "node_modules/a@2#2")}
