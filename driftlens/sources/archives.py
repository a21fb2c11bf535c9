"""Package archives as file rows. Entries are read in memory inside tasks and never written or run."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import fixed_values as V

# Fixed limits on untrusted archives.
MAX_ENTRY_BYTES = 50 * 1024 * 1024
MAX_TOTAL_BYTES = 500 * 1024 * 1024
MAX_ENTRIES = 10_000
MAX_WASM_BYTES = 20 * 1024 * 1024
WASM_MAGIC = b"\0asm"

ENTRY_SCHEMA = (
    "name string, version string, ecosystem string, path string, bytes long, sha256 string, text string, native string, ord int, "
    "wasm_imports array<struct<module:string,name:string,kind:string>>, wasm_error string, error string"
)


class UnsafeArchive(ValueError):
    """The archive breaks a safety rule."""


def _check_path(name: str) -> str:
    if name.startswith("/") or re.match(r"[A-Za-z]:", name):
        raise UnsafeArchive(f"absolute path: {name}")
    if ".." in re.split(r"[\\/]+", name):
        raise UnsafeArchive(f"path traversal: {name}")
    return name


def _tar_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as archive:
        for member in archive:
            if member.issym() or member.islnk():
                raise UnsafeArchive(f"link entry: {member.name}")
            if not (member.isfile() or member.isdir()):
                raise UnsafeArchive(f"unsupported entry type: {member.name}")
            path = _check_path(member.name)
            if member.isdir():
                yield path, None
                continue
            if member.size > MAX_ENTRY_BYTES:
                raise UnsafeArchive(f"entry too large: {member.name}")
            yield path, archive.extractfile(member).read(MAX_ENTRY_BYTES + 1)


def _zip_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            path = _check_path(info.filename)
            if info.flag_bits & 1:
                raise UnsafeArchive(f"encrypted entry: {path}")
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise UnsafeArchive(f"unsupported compression: {path}")
            if (info.external_attr >> 16) & 0o170000 == 0o120000:
                raise UnsafeArchive(f"link entry: {path}")
            if info.is_dir():
                yield path, None
                continue
            with archive.open(info) as stream:
                yield path, stream.read(MAX_ENTRY_BYTES + 1)


def wasm_imports(data: bytes) -> list[dict]:
    """The import section: (module, name, kind) per import."""
    if data[:4] != WASM_MAGIC or len(data) < 8:
        raise ValueError("not a WASM binary (magic bytes missing)")
    if len(data) > MAX_WASM_BYTES:
        raise ValueError(f"WASM binary too large to parse safely ({len(data)} bytes)")
    at = 8

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    def name():
        nonlocal at
        size = number()
        at += size
        return data[at - size : at].decode("utf-8")

    found = []
    while at < len(data):
        section, size = number(), number()
        end = at + size
        if end > len(data):
            raise ValueError("section runs past the end")
        if section == 2:
            for _ in range(number()):
                module, field, kind = name(), name(), number()
                found.append({"module": module, "name": field, "kind": ["func", "table", "memory", "global"][kind] if kind < 4 else "unknown"})
                if kind == 0:
                    number()
                elif kind == 3:
                    at += 2
                else:
                    at += kind == 1
                    limited = number()
                    number()
                    if limited & 1:
                        number()
        at = end
    return found


def _inner_path(name: str, kind: str) -> str:
    if kind == "npm":
        return name.removeprefix("package/")
    head, slash, rest = name.partition("/")
    return rest if kind == "sdist" and slash and "-" in head else name


def _rows(data: bytes, kind: str) -> Iterator[tuple]:
    source = _zip_entries(data) if kind == "wheel" else _tar_entries(data)
    suffix = V.PY_NATIVE_SUFFIX if kind in ("wheel", "sdist") else V.NATIVE_SUFFIX
    text_file = re.compile(r"(?i)(\.(m?js|cjs|jsx|ts|tsx|json|py|pyi|pyx|toml)|(^|/)(METADATA|PKG-INFO))$")
    native_file = re.compile(suffix.replace(r"\z", "$"))
    total = 0
    for order, (name, body) in enumerate(source):
        if order >= MAX_ENTRIES:
            raise UnsafeArchive(f"more than {MAX_ENTRIES} entries")
        if body is None:
            continue
        total += len(body)
        if len(body) > MAX_ENTRY_BYTES or total > MAX_TOTAL_BYTES:
            raise UnsafeArchive("extracted bytes exceed the limit")
        path = _inner_path(name, kind)
        native = native_file.search(path)
        native = native[1].lower().replace("pyd", "dll") if native else None
        text = body.decode("utf-8", errors="replace") if native is None and text_file.search(path) else None
        imports = wasm_error = None
        if native == "wasm":
            try:
                imports = wasm_imports(body)
            except (ValueError, IndexError, UnicodeDecodeError) as error:
                wasm_error = str(error)[:240]
        yield path, len(body), hashlib.sha256(body).hexdigest(), text, native, order, imports, wasm_error, None


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "bytes", "sha256", "text", "native", "ord", "wasm_imports", "wasm_error", "error"]
    for batch in batches:
        for name, version, data, kind in batch[["name", "version", "content", "kind"]].itertuples(index=False):
            try:
                rows = list(_rows(bytes(data), kind))
            except Exception as error:  # an unreadable archive is a finding, not a failed task
                rows = [(None,) * 8 + (f"{type(error).__name__}: {str(error)[:200]}",)]
            ecosystem = "npm" if kind == "npm" else "pypi"
            yield pd.DataFrame(rows, columns=columns, dtype=object).assign(name=name, version=version, ecosystem=ecosystem)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, kind, content) of archives laid out as ``<path>/<name>/<version>/<file>``.

    A slash in a scoped name is written as ``%2f`` in the folder name.
    """
    parts = F.split("path", "/")
    file = F.element_at(parts, -1)
    kind = F.when(file.endswith(".whl"), "wheel").when(file.endswith(".tar.gz"), "sdist").otherwise("npm")
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(
            F.regexp_replace(F.element_at(parts, -3), "%2f", "/").alias("name"), F.element_at(parts, -2).alias("version"),
            kind.alias("kind"), "content",
        )
    )


def unpack(archives: DataFrame) -> DataFrame:
    """File rows of each archive; exactly one row with ``error`` for an archive that is not acceptable."""
    return archives.select("name", "version", "content", "kind").mapInPandas(_unpack, ENTRY_SCHEMA)


def preferred_artifacts(artifacts: DataFrame) -> DataFrame:
    """One artifact per (name, version): a pure wheel, else any wheel, else a source archive."""
    rank = (
        F.when(F.col("filename").endswith("py3-none-any.whl"), 0)
        .when(F.col("filename").endswith(".whl"), 1)
        .when(F.col("filename").endswith(".tar.gz"), 2)
    )
    return (
        artifacts.withColumn("rank", rank).filter("rank is not null")
        .groupBy("name", "version").agg(F.min_by("filename", F.struct("rank", "filename")).alias("filename"))
    )


def routed(entries: DataFrame, bundled: DataFrame) -> DataFrame:
    """Adds ``route``: native, media, javascript, python or other.

    Files below node_modules count only for declared bundled packages (name, version, bundle), one level
    deep. Only those few paths take part in the join.
    """
    path = F.col("path")
    inner = r"^node_modules/((?:@[^/]+/)?[^/]+)/"
    below = path.startswith("node_modules/")
    nested = path.rlike(r"^node_modules/(?:@[^/]+/)?[^/]+/node_modules/")
    declared = (
        entries.filter(below & ~nested).withColumn("bundle", F.regexp_extract(path, inner, 1))
        .join(bundled, ["name", "version", "bundle"], "left_semi").drop("bundle")
    )
    python = F.col("ecosystem") == "pypi"
    return entries.filter(~below | F.col("native").isNotNull()).unionByName(declared.filter("native is null")).withColumn(
        "route",
        F.when(F.col("native").isNotNull(), "native")
        .when(python & path.rlike(V.PY_SOURCE), "python")
        .when(python, "other")
        .when(path.rlike(V.MEDIA_SUFFIX), "media")
        .when(path.rlike(V.ANALYZABLE_SOURCE), "javascript")
        .otherwise("other"),
    )
