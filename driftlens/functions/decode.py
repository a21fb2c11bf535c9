"""Decoding of encoded literals: the only text work the JVM functions cannot express."""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions.text import JS_URL, PY_URL

DECODED = T.StructType().add("url", T.StringType()).add("encoding", T.StringType())
BASE64_SHAPE = re.compile(r"[A-Za-z0-9+/=_-]+")
HEX_SHAPE = re.compile(r"[0-9a-fA-F]+")


def lenient_base64(text: str) -> bytes:
    """Decode like a forgiving reader: both alphabets, stop at padding, missing padding allowed."""
    body = re.sub(r"[^A-Za-z0-9+/]", "", text.replace("-", "+").replace("_", "/").split("=")[0])
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _readable(raw: bytes) -> str | None:
    text = raw.decode("utf-8", errors="replace")
    good = sum(1 for c in text if " " <= c <= "~" or c in "\t\n\r")
    return text if text and good / len(text) >= 0.9 else None


def _url_in(literal: str | None, pattern: re.Pattern) -> tuple[str | None, str | None]:
    if literal is None or not 24 <= len(literal) <= 4096:
        return None, None
    attempts = []
    if BASE64_SHAPE.fullmatch(literal) and len(literal) % 4 <= 1:
        attempts.append(("base64", lenient_base64))
    if HEX_SHAPE.fullmatch(literal) and len(literal) % 2 == 0:
        attempts.append(("hex", binascii.unhexlify))
    for encoding, decoder in attempts:
        text = _readable(decoder(literal))
        found = pattern.search(text) if text else None
        if found:
            return found.group(0), encoding
    return None, None


def _url_decoder(url_pattern: str):
    @F.pandas_udf(DECODED)
    def decode(literals: pd.Series) -> pd.DataFrame:
        pattern = re.compile(url_pattern)
        return pd.DataFrame([_url_in(v, pattern) for v in literals], columns=["url", "encoding"])

    return decode


decode_js_url = _url_decoder(JS_URL)
decode_py_url = _url_decoder(PY_URL)
