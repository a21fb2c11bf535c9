"""Legacy archive converter: ARC files to WARC files (operator 5).

`write_arc` writes pages as ARC files of version 1 or 2 (a version block, then one URL line with the declared length and
the HTTP response per record). `convert` reads ARC files of either version: the version block names the fields of the URL
lines, and each record's bytes are taken by its declared length. Every record becomes a WARC/1.1 record with a
synthesised identifier, W3C timestamp, type and base32 SHA-1 digests, its own bytes and HTTP head, its IP address, and the
other fields of its URL line. What has an HTTP head is a response; any other record (dns and the like) is a resource of
its declared type. Of records with equal payloads of at least `least` bytes, one stays whole and the others are revisits
that name it. `read_warc` reads WARC files back.

Both kinds of archives are written by Spark's text sink: the separator of the lines is what ends a record (a line feed in
ARC, two line ends in WARC), so each file is a valid archive on any file system that Spark reaches. They are read by
declared lengths, never by separators, because payloads may hold those.

Defined results: a null html is an empty payload. A null url is written as "urn:none" and read back as null; blanks and
control characters in a url are percent-encoded in the archive. A null page id gives a record without the page header
and a null id. Pages that repeat an id and payload are records of their own; ties for the largest page id are broken by
nothing but the id, so equal ids with equal payloads are all responses. An empty table gives archives without records.
Other columns of the pages are not archived. A record that is cut short by the end of its file raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch, read

#: Fields of a URL line by the version that the version block declares: fixed values of the two formats.
FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"),
}
TITLES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARCHIVED = "20240101000000"
#: Rows of an archive file, at most: bounds what one task reads at once.
FILE_ROWS = 2000
RECORDS = "page_id long, url string, date string, mime string, ip string, code string, checksum string, location string, head binary, payload binary, payload_bytes long, payload_digest string"


def _safe_url(url: str | None) -> str:
    return "urn:none" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "urn:empty"


def write_arc(pages: DataFrame, path: str, version: str = "1") -> None:
    """Writes page_id, url and html as gzipped ARC files, one per partition and at most FILE_ROWS records."""

    def lines(batches: Iterator[pa.RecordBatch]):
        at = 0
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
                if at % FILE_ROWS == 0:
                    title = f"{version} 0 driftlens\n{TITLES[version]}\n"
                    size = len(title.encode())
                    tail = f"text/plain {size}" if version == "1" else f"text/plain 200 - - 0 part.arc {size}"
                    out.append(f"filedesc://part.arc 0.0.0.0 {ARCHIVED} {tail}\n{title}")
                at += 1
                payload = html or ""
                page_line = "" if page is None else f"X-Page-Id: {page}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page_line}Content-Length: {len(payload.encode())}\r\n\r\n{payload}"
                size = len(body.encode())
                tail = f"text/html {size}" if version == "1" else f"text/html 200 - - 0 part.arc {size}"
                out.append(f"{_safe_url(url)} 0.0.0.0 {ARCHIVED} {tail}\n{body}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows = pages.select("page_id", "url", "html").mapInArrow(lines, "value string")
    # the version block is one more line of the file, so a file ends where the next version block begins
    rows.write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS + 1).text(path)


def parse_arc(data: bytes) -> Iterator[dict[str, object]]:
    """Records of one ARC file by declared lengths: the fields of the URL line and the content."""
    at, fields = 0, None
    while at < len(data):
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)]
        at = (stop if stop >= 0 else len(data)) + 1
        if not line.strip():
            continue
        words = _decoded(line.rstrip(b"\r")).split(" ")
        size = int(words[-1])
        if at + size > len(data):
            raise ValueError("an ARC record is cut short")
        content = data[at : at + size]
        at += size
        if words[0].startswith("filedesc://"):
            fields = FIELDS[content.split(b" ", 1)[0].decode()]
        elif fields is None or len(words) != len(fields):
            raise ValueError("an ARC URL line does not fit the version block")
        else:
            yield dict(zip(fields, words)) | {"content": content}


def _decoded(line: bytes) -> str:
    """The text of a URL line; bytes that are not UTF-8 are percent-encoded."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(chr(b) if b < 128 else f"%{b:02X}" for b in line)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _split(url: str, content: bytes) -> tuple[bytes | None, bytes]:
    """The HTTP head with its blank line, and the payload. Without a head, or with a scheme that has none, all is payload."""
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", url)
    if not content.startswith(b"HTTP/") or scheme and scheme[1].lower() not in ("http", "https", "urn"):
        return None, content
    stop = re.search(rb"\r?\n\r?\n", content)
    return (content[: stop.end()], content[stop.end() :]) if stop else (content, b"")


def _headers(head: bytes | None) -> dict[str, str]:
    lines = (head or b"").decode("latin-1").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(headers: dict[str, str]) -> int | None:
    """The page id that `write_arc` put into a head."""
    page = headers.get("x-page-id", "")
    return int(page) if re.fullmatch(r"-?[0-9]{1,19}", page) and -(1 << 63) <= int(page) < 1 << 63 else None


def _unzipped(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files: page_id, the fields of the URL line, HTTP head (null without), payload, its size and digest."""

    def parse(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for cell in batch["content"]:
                rows = []
                for record in parse_arc(_unzipped(cell.as_py())):
                    head, payload = _split(record["url"], record["content"])
                    url = {"urn:none": None, "urn:empty": ""}.get(record["url"], record["url"])
                    line = (record.get(f) for f in ("date", "type", "ip", "code", "checksum", "location"))
                    rows.append((_page(_headers(head)), url, *line, head, payload, len(payload), digest(payload)))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    types = [pa.int64(), *[pa.string()] * 7, pa.binary(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]

    def _batch(rows):
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _files(spark, path).mapInArrow(parse, RECORDS)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole archive files, one per row; their size is bounded by the rows that were written to each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def record_id(page_id: Column, payload_digest: Column, *more: Column) -> Column:
    """A UUID of the custom layout (version 8): the page id in the first 48 and last 16 bits around digest bits. Without a
    page id it is made from the digest and what else tells the record from others."""
    key = F.lpad(F.lower(F.hex(page_id)), 16, "0")
    bits = F.md5(F.concat_ws(":", payload_digest, page_id.cast("string")))
    uuid = F.concat(F.substring(key, 1, 8), F.lit("-"), F.substring(key, 9, 4), F.lit("-8"), F.substring(bits, 1, 3), F.lit("-8"), F.substring(bits, 4, 3), F.lit("-"), F.substring(key, 13, 4), F.substring(bits, 7, 8))
    bits = F.md5(F.concat_ws(":", payload_digest, *more))
    nameless = F.concat(F.substring(bits, 13, 8), F.lit("-"), F.substring(bits, 21, 4), F.lit("-4"), F.substring(bits, 1, 3), F.lit("-8"), F.substring(bits, 4, 3), F.lit("-"), F.substring(bits, 7, 12))
    return F.concat(F.lit("<urn:uuid:"), F.coalesce(uuid, nameless), F.lit(">"))


def page_of(identifier: str | None) -> int | None:
    """The page id in an identifier made by `record_id`."""
    found = re.fullmatch(r"<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-8[0-9a-f]{3}-[0-9a-f]{4}-([0-9a-f]{4})[0-9a-f]{8}>", identifier or "")
    number = int("".join(found.groups()), 16) if found else None
    return number - (1 << 64) if number is not None and number >> 63 else number


def convert(spark: SparkSession, arc: str, warc: str, scratch: Scratch, least: int = 0) -> None:
    """Reads ARC files and writes WARC files. A page id with a third of all records of equal payload costs one row per task."""
    records = read_arc(spark, arc)
    kept = records.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= least)
    first = scratch.cut(kept.groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "first")
    joined = records.join(first.select(F.col("payload_digest").alias("d"), "first_id"), F.col("payload_digest") == F.col("d"), "left")
    revisit = F.coalesce((F.col("first_id") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("first_id").isNotNull()), F.lit(False))
    url = F.coalesce(F.col("url"), F.lit("urn:none"))
    when = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    http = F.coalesce("head", F.lit(b""))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))

    def field(name: str, value: Column, *unknown: str) -> Column:
        return F.when(value.isNotNull() & ~value.isin("-", "", *unknown), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")

    mime = F.when(F.col("mime").isin("-", ""), "application/octet-stream").otherwise(F.col("mime"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").when(F.col("head").isNull(), "resource").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id"), F.col("payload_digest"), url, F.col("date"), F.col("ip")),
        F.lit("\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            record_id(F.col("first_id"), F.col("payload_digest")),
        )).otherwise(""),
        field("WARC-IP-Address", F.col("ip"), "0.0.0.0"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),  # a revisit has no other place for it
        field("X-ARC-Content-Type", F.col("mime")), field("X-ARC-Result-Code", F.col("code")),
        field("X-ARC-Checksum", F.col("checksum")), field("X-ARC-Location", F.col("location")),
        F.lit("\r\nContent-Type: "), F.when(F.col("head").isNull(), mime).otherwise("application/http; msgtype=response"),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    lines = joined.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))  # bytes of any encoding, as they are
    lines.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(warc)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError("a WARC header is cut short")
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a WARC record does not begin with its version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError("a WARC record is cut short")
        yield headers, block
        at = stop + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record; digests of whole payloads are checked."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def parse(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for cell in batch["content"]:
                rows = []
                for headers, block in parse_warc(_unzipped(cell.as_py())):
                    whole = headers["warc-type"] != "revisit"
                    head, payload = _split(headers["warc-target-uri"], block) if headers["warc-type"] != "resource" else (None, block)
                    http = _headers(head)
                    sha = headers["warc-payload-digest"].removeprefix("sha1:")
                    if whole and digest(payload) != sha:
                        raise ValueError("a payload does not fit its digest")
                    url = {"urn:none": None, "urn:empty": ""}.get(headers["warc-target-uri"], headers["warc-target-uri"])
                    size = len(payload) if whole else int(headers.get("x-payload-length", http.get("content-length")))
                    rows.append((_page(http), url, size, sha, headers["warc-type"], page_of(headers.get("warc-refers-to"))))
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _files(spark, path).mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5_archives: pages to ARC, ARC to WARC, WARC read back."""
    scratch = Scratch(spark, "archives")
    write_arc(read(spark, sf_dir, "pages"), scratch.path("arc"))
    convert(spark, scratch.path("arc"), scratch.path("warc"), scratch)
    scratch.drop("arc")
    return read_warc(spark, scratch.path("warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
