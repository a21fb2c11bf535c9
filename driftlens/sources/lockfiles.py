"""Lockfiles as node and edge tables.

Input: (run_id, side, filename, text), one row per lockfile. npm and requirements files are read with
JSON and string functions. YAML, TOML and the yarn v1 layout have no Spark reader, so a small function
turns each such file into rows inside a task; one lockfile is a few megabytes at most.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions.names import canonical_pypi, normalized_hash
from driftlens.session import spread

FILE = ["run_id", "side"]


def read_lockfiles(spark: SparkSession, path: str) -> DataFrame:
    """Files laid out as ``<path>/<run_id>/<side>/<filename>``."""
    parts = F.split(F.input_file_name(), "/")
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.element_at(parts, -3).alias("run_id"), F.element_at(parts, -2).alias("side"),
        F.element_at(parts, -1).alias("filename"), F.col("value").alias("text"),
    )


def lockfile_kind(filename: Column, text: Column) -> Column:
    """Format by file name first, then by content; NULL when nothing fits."""
    base = F.element_at(F.split(F.coalesce(filename, F.lit("")), r"[\\/]"), -1)
    head = F.ltrim(text)
    return (
        F.when(base.isin("package-lock.json", "npm-shrinkwrap.json"), "npm")
        .when(base.isin("pnpm-lock.yaml", "pnpm-lock.yml"), "pnpm")
        .when((base == "yarn.lock") & text.rlike(r"(?m)^\s*__metadata:"), "yarn-berry")
        .when(base == "yarn.lock", "yarn-classic")
        .when(base.rlike(r"^requirements[-.\w]*\.txt\z"), "pypi-requirements")
        .when(base == "poetry.lock", "pypi-poetry")
        .when(base == "uv.lock", "pypi-uv")
        .when(head.startswith("{"), "npm")
        .when(head.rlike(r"(?m)^lockfileVersion:"), "pnpm")
        .when(head.rlike(r"(?m)^__metadata:"), "yarn-berry")
        .when(head.rlike(r"(?m)^# yarn lockfile v1") | head.rlike(r"(?m)^\w[\w./@-]*@[^:]+:\s*$"), "yarn-classic")
        .when(text.rlike(r"(?i)# This file (?:was )?autogenerated by uv"), "pypi-uv")
        .when(text.rlike(r"(?m)^\[metadata\][\s\S]*lock-version\s*="), "pypi-poetry")
        .when(text.rlike(r"(?m)^\[\[package\]\]") & text.rlike(r"(?m)^\s*version\s*=\s*\d"), "pypi-uv")
        .when(text.rlike(r"(?m)^[A-Za-z0-9_.-]+\s*==\s*[\w.+-]+"), "pypi-requirements")
    )


# --- npm ---------------------------------------------------------------------------------------

NPM_ENTRY = (
    "struct<name:string, version:string, integrity:string, resolved:string, link:boolean, "
    "dependencies:map<string,string>, optionalDependencies:map<string,string>, peerDependencies:map<string,string>>"
)
NPM_LOCK = f"name string, version string, lockfileVersion double, packages map<string,{NPM_ENTRY}>"


def _npm_entries(files: DataFrame) -> DataFrame:
    doc = F.from_json("text", NPM_LOCK)
    parsed = files.select(*FILE, doc.alias("doc"))
    readable = parsed.filter((F.col("doc.lockfileVersion") >= 2) & F.col("doc.packages").isNotNull())
    entries = readable.select(
        *FILE, F.col("doc.name").alias("lock_name"), F.col("doc.version").alias("lock_version"),
        F.posexplode(F.map_entries("doc.packages")).alias("ord", "e"),
    )
    key = F.col("e.key")
    from_key = F.when(
        key.contains("node_modules/"), F.substring_index(key, "node_modules/", -1)
    )
    return entries.select(
        *FILE, "ord", "lock_name", "lock_version", key.alias("key"),
        F.coalesce("e.value.name", F.when(from_key != "", from_key)).alias("raw_name"),
        F.coalesce("e.value.version", F.lit("")).alias("version"),
        F.coalesce("e.value.integrity", F.lit("")).alias("integrity"),
        F.col("e.value.resolved").alias("resolved"),
        F.coalesce("e.value.link", F.lit(False)).alias("link"),
        F.array_distinct(
            F.concat(*[
                F.coalesce(F.map_keys(f"e.value.{m}"), F.array().cast("array<string>"))
                for m in ("dependencies", "optionalDependencies", "peerDependencies")
            ])
        ).alias("deps"),
    )


def npm_errors(files: DataFrame) -> DataFrame:
    doc = F.from_json("text", NPM_LOCK)
    version = F.col("doc.lockfileVersion")
    problem = (
        F.when(F.col("doc").isNull() | (version.isNull() & F.col("doc.packages").isNull()), "not a readable lockfile object")
        .when(version.isNull(), "lockfileVersion is missing")
        .when(version < 2, F.concat(F.lit("lockfileVersion "), version.cast("string"), F.lit(" is not supported")))
        .when(F.col("doc.packages").isNull(), "no packages map")
    )
    return files.select(*FILE, doc.alias("doc")).select(*FILE, problem.alias("error")).filter("error is not null")


def npm_tables(files: DataFrame) -> dict[str, DataFrame]:
    entries = _npm_entries(files)
    # The root keeps its node even without a name: it anchors the graph.
    root_name = F.when(F.col("key") == "", F.coalesce("raw_name", "lock_name", F.lit("")))
    plain = entries.filter(~F.col("link") & (F.col("raw_name").isNotNull() | (F.col("key") == "")))
    nodes = plain.select(
        *FILE, "key", F.coalesce(root_name, F.lower("raw_name")).alias("name"), "version", "integrity", "resolved",
        F.col("ord").cast("long").alias("ord"),
    )
    links = entries.filter(F.col("link") & F.col("raw_name").isNotNull()).select(
        *FILE, "key", F.col("raw_name").alias("name"), "version", "resolved"
    )
    # A dependency resolves to the deepest node_modules folder on the way up from its parent.
    segments = F.split("parent_key", "/node_modules/")
    wanted = (
        plain.select(*FILE, F.col("key").alias("parent_key"), F.posexplode("deps").alias("ord", "dep"))
        .withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("parent_key") == "", 0).otherwise(F.size(segments)))))
        .withColumn("folder", F.array_join(F.slice(segments, F.lit(1), F.col("depth")), "/node_modules/"))
        .withColumn(
            "child_key",
            F.when(F.col("folder") == "", F.concat(F.lit("node_modules/"), "dep")).otherwise(
                F.concat(F.col("folder"), F.lit("/node_modules/"), F.col("dep"))
            ),
        )
    )
    edges = (
        wanted.join(nodes.select(*FILE, F.col("key").alias("child_key")), [*FILE, "child_key"])
        .groupBy(*FILE, "parent_key", "dep")
        .agg(F.max_by("child_key", "depth").alias("child_key"), F.min("ord").cast("long").alias("ord"))
        .groupBy(*FILE, "parent_key", "child_key")
        .agg(F.min("ord").alias("ord"))
    )
    return {"nodes": nodes, "edges": edges, "links": links}


# --- requirements.txt ---------------------------------------------------------------------------

def requirement_entries(files: DataFrame) -> DataFrame:
    joined = F.regexp_replace("text", r"\\\r?\n", " ")
    line = F.trim(F.regexp_replace(F.trim(F.regexp_replace("raw", r"[\r\t]", " ")), r"\s+#.*$", ""))
    bare = F.trim(F.substring_index("line", ";", 1))
    spec = r"^([A-Za-z0-9_.\-\[\]]+)\s*(===|==|>=|<=|~=|!=|>|<)?\s*([\w.+-]*)"
    name = F.regexp_replace(F.regexp_extract("spec", spec, 1), r"\[.*?\]$", "")
    return (
        files.select(*FILE, F.posexplode(F.split(joined, "\n")).alias("ord", "raw"))
        .withColumn("line", line)
        .filter((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("-"))
        .withColumn("hash", F.regexp_extract(bare, r"--hash=([a-z0-9]+:[A-Fa-f0-9]+)", 1))
        .withColumn("spec", F.trim(F.regexp_replace(bare, r"--hash=[a-z0-9]+:[A-Fa-f0-9]+", "")))
        .withColumn("name", canonical_pypi(name))
        .filter(F.col("name") != "")
        .select(
            *FILE, F.col("ord").cast("long").alias("ord"), "name",
            F.when(F.regexp_extract("spec", spec, 2) == "==", F.regexp_extract("spec", spec, 3)).otherwise("").alias("version"),
            F.regexp_replace("hash", ":", "-").alias("integrity"),
            F.lit(None).cast("string").alias("resolved"),
        )
    )


def requirement_tables(files: DataFrame) -> dict[str, DataFrame]:
    entries = requirement_entries(files)
    # Repeated names get a version suffix, then a line suffix; the first keeps the plain key.
    plain = F.concat(F.lit("pypi/"), F.col("name"))
    versioned = F.concat(plain, F.lit("@"), F.col("version"))
    key = F.when(F.col("ord") == F.col("first"), plain).when(F.col("ord") == F.col("second"), versioned).otherwise(
        F.concat(versioned, F.lit("#"), F.col("ord").cast("string"))
    )
    keyed = _numbered(entries).withColumn("key", key)
    roots = _roots(files)
    nodes = keyed.select(*FILE, "key", "name", "version", "integrity", "resolved", "ord").unionByName(roots)
    edges = keyed.select(*FILE, F.lit("").alias("parent_key"), F.col("key").alias("child_key"), "ord")
    return {"nodes": nodes, "edges": edges}


def _numbered(entries: DataFrame) -> DataFrame:
    """Adds the first place of a name in its file and, of the others, the first place of its version.

    A window sorts the entries of one name in one file; the file is read once, not once a join.
    """
    same = Window.partitionBy(*FILE, "name")
    placed = entries.withColumn("first", F.min("ord").over(same))
    return placed.withColumn("second", F.min(F.when(F.col("ord") > F.col("first"), F.col("ord"))).over(Window.partitionBy(*FILE, "name", "version")))


def _roots(files: DataFrame) -> DataFrame:
    empty = F.lit("")
    return files.select(
        *FILE, empty.alias("key"), empty.alias("name"), empty.alias("version"), empty.alias("integrity"),
        F.lit(None).cast("string").alias("resolved"), F.lit(-1).cast("long").alias("ord"),
    )


# --- YAML, TOML and yarn v1: one small reader per layout -------------------------------------------

def _pnpm(text: str) -> tuple[list[dict], list[str]]:
    doc = yaml.load(text, Loader=yaml.CBaseLoader)
    if not isinstance(doc, dict):
        raise ValueError("the file is not a mapping")
    if not float(doc.get("lockfileVersion") or 0) >= 5:
        raise ValueError("lockfileVersion 5 or later is needed")
    importer = (doc.get("importers") or {}).get(".") or doc
    fields = ("dependencies", "devDependencies", "optionalDependencies")
    top = [name for field in fields for name in (importer.get(field) or {})]
    snapshots = doc.get("snapshots") or {}
    entries = []
    for raw, body in (doc.get("packages") or {}).items():
        name, _, version = raw.removeprefix("/").split("(")[0].rpartition("@")
        if not name or not version:
            continue
        body = body or {}
        sources = [part.get(f) or {} for part in (body, snapshots.get(raw) or {}) for f in ("dependencies", "optionalDependencies", "peerDependencies")]
        resolution = body.get("resolution") or {}
        entries.append({
            "name": name.lower(), "version": version, "integrity": resolution.get("integrity") or "",
            "resolved": resolution.get("tarball"), "deps": [dep for source in sources for dep in source],
        })
    return entries, top


def _yarn_v1(text: str) -> dict[str, dict]:
    """Blocks of ``key, key:`` with indented fields; nested maps sit two spaces deeper."""
    packages, entry, nested = {}, None, None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        content = line.strip()
        if depth == 0:
            entry, nested = {}, None
            packages[content.removesuffix(":").replace('"', "")] = entry
        elif depth <= 2 and content.endswith(":"):
            nested = entry.setdefault(content[:-1], {})
        else:
            field, _, value = re.sub(r'^"([^"]*)"', lambda m: m[1].replace(" ", "\0"), content).partition(" ")
            target = nested if depth > 2 and nested is not None else entry
            target[field.replace("\0", " ")] = value.strip('"')
    return packages


SRI = re.compile(r"sha(?:1|256|384|512)-[A-Za-z0-9+/=]+")


def _yarn(packages: dict[str, dict]) -> list[dict]:
    entries = []
    for raw, body in packages.items():
        version = body.get("version") if isinstance(body, dict) else None
        if raw == "__metadata" or not version:
            continue
        found = [re.fullmatch(r"(@?[^@]+)@(.+)", alias.strip()) for alias in raw.split(",")]
        found = [(m[1], m[2]) for m in found if m]
        if not found:
            continue
        aliases = []
        for name, spec in dict.fromkeys(found):
            real = re.fullmatch(r"npm:(.+)@[^@]+", spec)
            if real and real[1] != name and name not in [a[0] for a in aliases]:
                aliases.append((name, real[1]))
        sri = [v for v in (body.get("integrity"), body.get("checksum")) if isinstance(v, str) and SRI.fullmatch(v)]
        deps = [d for f in ("dependencies", "optionalDependencies", "peerDependencies") for d in (body.get(f) or {})]
        entries.append({
            "name": found[0][0], "version": version, "integrity": sri[0] if sri else "",
            "resolved": body.get("resolved"), "deps": deps, "aliases": aliases,
        })
    return entries


def _toml_packages(text: str, kind: str) -> list[dict]:
    doc = tomllib.loads(text)
    if kind == "pypi-uv" and int(doc.get("version", 1)) != 1:
        raise ValueError(f"uv.lock version {doc['version']} is not supported")
    entries = []
    for table in doc.get("package", []):
        name = table.get("name")
        if not isinstance(name, str) or not name:
            continue
        listed = [*(table.get("files", []) if kind == "pypi-poetry" else []), *table.get("wheels", [])]
        sdist = table.get("sdist", [])
        listed += sdist if isinstance(sdist, list) else [sdist]
        hashes = [f["hash"] for f in listed if isinstance(f, dict) and isinstance(f.get("hash"), str)]
        hashes += [table["hash"]] if isinstance(table.get("hash"), str) else []
        deps = table.get("dependencies", [])
        source = table.get("source") or {}
        entries.append({
            "name": name, "version": table.get("version", ""), "integrity": hashes[0] if hashes else "",
            "resolved": table.get("url") or source.get("url"),
            "deps": [d["name"] for d in deps if d.get("name")] if isinstance(deps, list) else list(deps),
        })
    return entries


def _read_entries(kind: str, text: str) -> tuple[list[dict], list[str]]:
    if kind == "pnpm":
        return _pnpm(text)
    if kind == "yarn-classic":
        return _yarn(_yarn_v1(text)), []
    if kind == "yarn-berry":
        return _yarn(yaml.load(text, Loader=yaml.CBaseLoader)), []
    return _toml_packages(text, kind), []


ENTRIES = (
    "run_id string, side string, kind string, error string, "
    "entries array<struct<ord:long,name:string,version:string,integrity:string,resolved:string,deps:array<string>,"
    "aliases:array<struct<declared:string,real:string>>>>, top array<string>"
)


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for run_id, side, kind, text in batch[["run_id", "side", "kind", "text"]].itertuples(index=False):
            try:
                entries, top = _read_entries(kind, text)
                shaped = [
                    {**e, "ord": i, "aliases": [{"declared": a, "real": b} for a, b in e.get("aliases", [])]} for i, e in enumerate(entries)
                ]
                rows.append((run_id, side, kind, None, shaped, top))
            except Exception as error:  # a bad file becomes an error row, never a failed task
                rows.append((run_id, side, kind, f"{type(error).__name__}: {str(error)[:200]}", [], []))
        yield pd.DataFrame(rows, columns=["run_id", "side", "kind", "error", "entries", "top"])


def document_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of pnpm, yarn, poetry and uv lockfiles."""
    parsed = files.select(*FILE, "kind", "text").mapInPandas(_read_batches, ENTRIES)
    pypi = F.col("kind").startswith("pypi")
    entries = parsed.select(*FILE, "kind", F.explode("entries").alias("e")).select(
        *FILE, "kind", "e.ord", F.when(pypi, canonical_pypi(F.col("e.name"))).otherwise(F.col("e.name")).alias("name"),
        F.coalesce("e.version", F.lit("")).alias("version"),
        F.when(pypi, normalized_hash(F.col("e.integrity"))).otherwise(F.col("e.integrity")).alias("integrity"),
        "e.resolved", "e.deps", "e.aliases",
    )
    plain = F.concat(F.when(pypi, "pypi/").otherwise("node_modules/"), F.col("name"))
    versioned = F.concat(plain, F.lit("@"), F.col("version"))
    key = F.when(F.col("ord") == F.col("first"), plain).when(F.col("ord") == F.col("second"), versioned).otherwise(
        F.concat(versioned, F.lit("#"), F.col("ord").cast("string"))
    )
    keyed = _numbered(entries).withColumn("key", key)
    nodes = keyed.select(*FILE, "key", "name", "version", "integrity", "resolved", "ord").unionByName(_roots(files))
    # Edges name packages only: they lead to the first entry of a name. pnpm edges also start there.
    start = F.when((F.col("kind") == "pnpm") & (F.col("ord") != F.col("first")), plain).otherwise(F.col("key"))
    dep = F.when(pypi, canonical_pypi(F.col("dep"))).otherwise(F.col("dep"))
    named = keyed.select(*FILE, "kind", start.alias("parent_key"), F.col("ord").alias("entry"), F.posexplode("deps").alias("place", "dep")).select(
        *FILE, "parent_key", dep.alias("name"), (F.col("entry") * 100000 + F.col("place")).alias("ord")
    )
    top = parsed.select(*FILE, F.posexplode("top").alias("ord", "name")).select(
        *FILE, F.lit("").alias("parent_key"), "name", F.col("ord").cast("long").alias("ord")
    )
    target = keyed.filter("ord = first").select(*FILE, "name", F.col("key").alias("child_key"))
    edges = (
        named.unionByName(top).join(target, [*FILE, "name"])
        .groupBy(*FILE, "parent_key", "child_key").agg(F.min("ord").alias("ord"))
    )
    aliases = keyed.select(*FILE, "version", "ord", F.explode("aliases").alias("a")).select(
        *FILE, F.col("a.declared").alias("declared_name"), F.col("a.real").alias("real_name"), "version", "ord"
    )
    errors = parsed.filter("error is not null").select(*FILE, "error")
    return {"nodes": nodes, "edges": edges, "aliases": aliases, "errors": errors}


def lock_tables(files: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, links, aliases and errors of any mix of lockfiles.

    Files are dealt by hash first: many lockfiles may come as one small table, and reading one is heavy.
    """
    kinded = spread(files, *FILE).withColumn("kind", lockfile_kind(F.col("filename"), F.col("text")))
    npm = kinded.filter(F.col("kind") == "npm")
    requirements = kinded.filter(F.col("kind") == "pypi-requirements")
    documents = kinded.filter(~F.col("kind").isin("npm", "pypi-requirements"))
    npm_part, req_part, doc_part = npm_tables(npm), requirement_tables(requirements), document_tables(documents)
    unknown = kinded.filter(F.col("kind").isNull()).select(*FILE, F.lit("unknown lockfile format").alias("error"))
    parts = (npm_part, req_part, doc_part)

    def union(name):
        first, *rest = [p[name] for p in parts]
        for part in rest:
            first = first.unionByName(part)
        return first

    return {
        "nodes": union("nodes"), "edges": union("edges"), "links": npm_part["links"], "aliases": doc_part["aliases"],
        "errors": doc_part["errors"].unionByName(npm_errors(npm)).unionByName(unknown),
    }
