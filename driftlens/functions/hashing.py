"""Digests: content hashes in the JVM, keyed digests in a small Arrow UDF."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def json_string(text: Column) -> Column:
    """A JSON string literal, NULL as null."""
    body = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}\z', 1)
    return F.when(text.isNull(), F.lit("null")).otherwise(body)


def canonical_object(fields: dict[str, Column]) -> Column:
    """Object text with keys in code-unit order and no spaces; values are string columns."""
    parts = []
    for index, key in enumerate(sorted(fields)):
        lead = "{" if index == 0 else ","
        parts += [F.lit(f'{lead}"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def keyed_digest(key: bytes):
    """HMAC-SHA256 of a text column under a key held by the job, as hex."""

    @F.pandas_udf(T.StringType())
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key, t.encode("utf-8"), hashlib.sha256).hexdigest())

    return digest
