"""Text measures and extractors: JVM-side column expressions, plus one Arrow UDF for byte counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions import fixed_values as V

URL_TAIL = r"[^\s'\"`<>]"
JS_URL = (
    r"(?i)\b(https?://" + URL_TAIL + r"+"
    r"|(?:[a-z0-9-]+\.)+(?:" + "|".join(V.AMBIGUOUS_TLDS) + r")[:/?#]" + URL_TAIL + r"*"
    r"|(?:[a-z0-9-]+\.)+(?:" + "|".join(V.PLAIN_TLDS) + r"))\b"
)
PY_URL = r"(?i)\b(https?://" + URL_TAIL + r"+|(?:[a-z0-9-]+\.)+(?:" + "|".join(V.PY_TLDS) + r"))\b"


@F.arrow_udf(T.DoubleType())
def byte_entropy(texts: pa.Array) -> pa.Array:
    """Shannon entropy in bits per byte over the UTF-8 bytes; 0 for empty text.

    Counts come straight from the Arrow buffer of the batch: no copy and no Python string per row.
    """
    values = texts.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    octets = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    result = np.zeros(len(values))
    for first in range(0, len(values), 4096):  # rows whose tables of byte counts fit a few megabytes
        last = min(first + 4096, len(values))
        lengths = np.diff(ends[first : last + 1])
        cell = np.repeat(np.arange(last - first, dtype=np.int64) * 256, lengths) + octets[ends[first] : ends[last]]
        counts = np.bincount(cell, minlength=(last - first) * 256).reshape(-1, 256).astype(float)
        total = np.maximum(lengths, 1).astype(float)
        result[first:last] = np.where(lengths > 0, np.log2(total) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=1) / total, 0.0)
    return pa.array(result, mask=values.is_null().to_numpy(zero_copy_only=False))


def minified(text: Column) -> Column:
    """Long lines dominate: one line over 400 with few short lines, or a long average line."""
    lines = F.split(text, "\n", -1)
    count = F.size(lines)
    longest = F.array_max(F.transform(lines, F.length))
    short_share = F.size(F.filter(lines, lambda line: F.length(line) < 60)) / count
    average = F.length(text) / count
    return (F.length(text) >= 200) & (
        ((longest > 400) & (short_share < 0.3)) | ((average > 120) & (short_share < 0.1))
    )


def urls(text: Column, pattern: str = JS_URL) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def printable_share(text: Column) -> Column:
    kept = F.length(F.regexp_replace(text, r"[^\x20-\x7e\t\n\r]", ""))
    return kept / F.length(text)


def mangled_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + V.MANGLED_ID + ")"), F.lit(1))


def has_confusable_boundary(text: Column) -> Column:
    pattern = f"[A-Za-z]{V.CONFUSABLE_CLASS}|{V.CONFUSABLE_CLASS}[A-Za-z]"
    return text.rlike(pattern)


def is_hot_path(target: Column) -> Column:
    return target.rlike("(?i)" + "|".join(V.HOT_PATHS_ANY_CASE)) | target.rlike("|".join(V.HOT_PATHS_EXACT_CASE))


def is_sensitive_env(keys: Column) -> Column:
    """``keys`` NULL stands for reading the whole environment, which is sensitive by itself."""
    wanted = F.array(*[F.lit(k) for k in V.SENSITIVE_ENV_KEYS])
    return keys.isNull() | F.arrays_overlap(keys, wanted)


def is_suspicious_wasm_import(module: Column, name: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, r"(?i)\s+as\s+[\w$.-]+\z", ""))
    qualified = F.concat(module, F.lit("."), bare)
    wasi = module.rlike(V.WASI_MODULE) & bare.rlike(V.WASI_NAMES)
    host = module.rlike(V.WASM_HOST_MODULE) & (bare.rlike(V.WASM_NAMES) | qualified.rlike(V.WASM_NAMES))
    return wasi | host


def dep_spec_class(spec: Column) -> Column:
    """plain-http, non-registry-https or NULL for a dependency specification."""
    trimmed = F.trim(spec)
    host = spec_host(spec)
    return (
        F.when(trimmed.startswith("http://"), "plain-http")
        .when(trimmed.startswith("https://") & (host != "") & ~host.isin(V.REGISTRY_HOSTS), "non-registry-https")
    )


def spec_host(spec: Column) -> Column:
    """Host of a URL with its port when not the default one, lower case, without credentials."""
    authority = F.lower(F.regexp_extract(F.trim(spec), r"^https?://(?:[^/?#@]*@)?([^/?#]*)", 1))
    without_default = F.when(
        F.trim(spec).startswith("https://"), F.regexp_replace(authority, r":443\z", "")
    ).otherwise(F.regexp_replace(authority, r":80\z", ""))
    return without_default


def resolved_kind(resolved: Column) -> Column:
    """git, file or NULL for the resolved field of a lockfile entry."""
    r = F.trim(resolved)
    after = F.substr(r, F.lit(6))
    git = r.rlike(r"^(git\+|git://|github:|bitbucket:|gitlab:)")
    absolute = after.startswith("///") | after.rlike(r"^//[^./]") | (
        after.startswith("/") & ~after.startswith("/../") & ~after.startswith("/./") & (F.substring(after, 2, 1) != ".")
    )
    return F.when(git, "git").when(r.startswith("file:") & absolute, "file")


def hook_severity(hook: Column) -> Column:
    return (
        F.when(hook.isin(V.INSTALL_HOOKS), "BLOCK")
        .when(hook.isin(V.PREPARE_HOOKS), "INFO")
        .when(hook.isin(V.PUBLISH_HOOKS), "WARN")
        .when(hook.isin(V.CI_HOOKS), "INFO")
    )


def hook_confidence(hook: Column) -> Column:
    return (
        F.when(hook.isin(V.INSTALL_HOOKS), "high")
        .when(hook.isin(V.PREPARE_HOOKS), "medium")
        .when(hook.isin(V.PUBLISH_HOOKS), "medium")
        .when(hook.isin(V.CI_HOOKS), "low")
    )


def code_kind_severity(kind: Column) -> Column:
    return (
        F.when(kind == "vm", "BLOCK")
        .when(kind.isin("eval", "new-function", "char-arithmetic-decoder"), "WARN")
        .otherwise("INFO")
    )


def code_kind_confidence(kind: Column) -> Column:
    return (
        F.when(kind == "vm", "high")
        .when(kind.isin("eval", "new-function", "char-arithmetic-decoder"), "medium")
        .otherwise("low")
    )


def url_context_severity(context: Column) -> Column:
    return F.when(context.isin("literal", "comment"), "INFO").otherwise("WARN")


def url_context_priority(context: Column) -> Column:
    return (
        F.when(context == "network-arg", 3)
        .when(context == "config-value", 2)
        .when(context == "literal", 1)
        .when(context == "comment", 0)
    )


def url_evidence_score(context: Column, path: Column, snippet: Column) -> Column:
    """Rank of a URL sighting, in thousandths so that ties are exact."""
    by_context = (
        F.when(context == "network-arg", 40)
        .when(context == "config-value", 30)
        .when(context == "literal", 20)
        .when(context == "comment", 10)
        .otherwise(0)
    )
    by_suffix = (
        F.when(path.rlike(r"(?i)\.[cm]?[jt]sx?\z"), 5).when(path.rlike(r"(?i)\.json\z"), 3).otherwise(1)
    )
    brevity = F.greatest(F.lit(0), F.lit(240) - F.length(snippet))
    return (by_context + by_suffix) * 1000 + brevity
