import base64
import gzip
import hashlib

import pytest

from driftlens.llm import archives
from driftlens.llm.common import Scratch

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://b.example/ y", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "", "two\r\n\r\nWARC/1.1\nlines"),
    (4, "http://c.example", None), (5, "http://c.example", ""), (6, "http://d.example/é", "é\U0001f600\n"), (7, "u", "x" * 200_000), (None, "n", "<p>one</p>"),
    (-8, "neg", "neg"), (2**62, "big", "neg"), (11, "rep", "rep"), (11, "rep", "rep"),
]


def expected(pages, least=0):
    rows = []
    for page, _, text in pages:
        data = (text or "").encode()
        same = [p for p, _, t in pages if (t or "").encode() == data]
        first = max((p for p in same if p is not None), default=None)
        revisit = len(same) > 1 and len(data) >= least and first is not None and page != first
        rows.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("version", ["1", "2"])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, version, least):
    scratch = Scratch(spark, "test")
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string").repartition(2)
    archives.write_arc(pages, scratch.path("arc"), version)
    archives.convert(spark, scratch.path("arc"), scratch.path("warc"), scratch, least)
    found = archives.read_warc(spark, scratch.path("warc"))
    assert sorted(map(tuple, found.drop("url").collect()), key=repr) == expected(PAGES, least)
    urls = {r["page_id"]: r["url"] for r in found.collect()}
    assert urls[2] == "http://b.example/%20y" and urls[9] is None and urls[3] == ""


def test_many_records_are_split_into_files(spark):
    scratch = Scratch(spark, "test")
    pages = spark.range(4500).selectExpr("id AS page_id", "'u' AS url", "concat('t', id) AS html").coalesce(1)
    archives.write_arc(pages, scratch.path("arc"))
    assert archives.read_arc(spark, scratch.path("arc")).agg({"page_id": "sum"}).first()[0] == 4500 * 4499 // 2


@pytest.mark.parametrize("version", ["1", "2"])
def test_records_of_real_archives_keep_their_bytes(spark, version, tmp_path):
    missing = b"HTTP/1.1 404 Not Found\r\nContent-Type: image/gif\r\nX-A: 1\r\n\r\nGIF\xff\x00"
    latin = b"HTTP/1.0 200 OK\nContent-Type: text/html; charset=iso-8859-1\n\ncaf\xe9\r\n\r\n"
    records = [
        ("dns:a.example", "9.9.9.9", "text/dns", "200", b"20240101000000\na.example. 60 IN A 1.2.3.4\n"),
        ("http://a.example/no.gif", "1.2.3.4", "image/gif", "404", missing), ("http://a.example/caf\u00e9", "1.2.3.4", "text/html", "200", latin),
        ("http://b.example/old", "0.0.0.0", "text/plain", "200", b"no head at all"), ("http://c.example/", "-", "no-type", "204", b"HTTP/1.1 204 No Content\r\nX: y"),
        ("http://d.example/", "1.2.3.4", "image/gif", "404", missing), ("ftp://d.example/f", "1.2.3.4", "-", "226", missing),
    ]
    title = {"1": b"1 0 x\n", "2": b"2 0 x\n"}[version]
    data = b"".join(
        f"{url} {ip} 20000102030405 {mime} {f'{code} sum - 0 f ' if version == '2' else ''}{len(body)}\n".encode() + body + b"\n"
        for url, ip, mime, code, body in [("filedesc://x", "0.0.0.0", "text/plain", "200", title), *records]
    )
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0").write_bytes(data)
    archives.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc", Scratch(spark, "test"))
    found = {h["warc-target-uri"]: (h, b) for p in (tmp_path / "warc").glob("part-*") for h, b in archives.parse_warc(gzip.decompress(p.read_bytes()))}
    assert {u: b for u, (_, b) in found.items()} == {u: b for u, _, _, _, b in records}
    assert len({h["warc-record-id"] for h, _ in found.values()}) == len(records)
    for url, ip, mime, code, body in records:
        head = found[url][0]
        response = url.startswith("http") and body.startswith(b"HTTP/")
        assert head["warc-type"] == ("response" if response else "resource") and head["warc-date"] == "2000-01-02T03:04:05Z"
        assert head["content-type"] == ("application/http; msgtype=response" if response else "application/octet-stream" if mime == "-" else mime)
        assert head.get("warc-ip-address") == (None if ip in ("-", "0.0.0.0") else ip)
        assert version == "1" or head["x-arc-result-code"] == code
    sizes = {r["url"]: r["payload_bytes"] for r in archives.read_warc(spark, f"file://{tmp_path}/warc").collect()}
    assert sizes["dns:a.example"] == len(records[0][4]) and sizes["http://a.example/no.gif"] == 5 and sizes["http://c.example/"] == 0


def test_empty_table(spark):
    scratch = Scratch(spark, "test")
    archives.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), scratch.path("arc"))
    archives.convert(spark, scratch.path("arc"), scratch.path("warc"), scratch)
    assert archives.read_warc(spark, scratch.path("warc")).count() == 0


def test_handmade_arc_of_both_versions_is_read_by_declared_length():
    one = b"filedesc://x 0.0.0.0 20000101000000 text/plain 5\n1 0 x\nhttp://u/ 1.2.3.4 20000102030405 text/html 7\nab\n\ncd\n\n"
    two = b"filedesc://x 0.0.0.0 20000101000000 text/plain 200 - - 0 f 5\n2 0 x\nhttp://u/ 1.2.3.4 20000102030405 text/html 200 - - 0 f 3\nabc\n"
    assert [r["content"] for r in archives.parse_arc(one)] == [b"ab\n\ncd\n"] and [r["date"] for r in archives.parse_arc(two)] == ["20000102030405"]
    with pytest.raises(ValueError):
        list(archives.parse_arc(one[:-4]))
    with pytest.raises(ValueError):
        list(archives.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    assert archives._unzipped(gzip.compress(b"x")) == b"x"
