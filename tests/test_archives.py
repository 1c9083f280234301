"""Archives of whole tasks: bytes equal to records that are put together one by one, offsets, index order, packages, nulls."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from captureq.operators import archives, records, replay
from captureq.sources import archive, files

SCHEMA = (
    "task_id long, request_id string, round long, url string, method string, resource_type string, outcome string, status int, status_text string, request_headers map<string,string>, response_headers map<string,string>, body_bytes long, "
    "skip_reason string, encoded_length long, error_text string, canceled boolean, blocked_reason string, opened_at long, captured_at timestamp, mime string, ip string, body binary, request_body binary, record string, block string"
)
AT = datetime.datetime(2026, 7, 26, 12, 34, 56)
URL = "https://H.example/a?b"


def settled(spark):
    got = {"Content-Type": "text/html", "Content-Encoding": "br", "Set-Cookie": "a=1\nb=2", "X-Null": None}
    whole = (1, "r1", 1, URL, "POST", "Document", "recorded", 200, "", {"Accept": "*/*", ":path": "/"}, got, 5, None, 9, None, None, None, 10, AT, "text/html", "10.0.0.1", bytearray("hé\r\n".encode()), bytearray(b"q=1"), "x", "y")
    cut = (1, "r2", 1, URL, "GET", None, "recorded", 200, "", {}, got, None, "too-large", 99, None, None, None, 20, AT, None, None, None, None, "x", "y")
    failed = (1, "r3", 1, URL, "GET", None, "failed", None, None, None, None, None, None, None, "net::ERR", None, None, 5, AT, None, None, None, None, "x", "y")
    bare = (2, "r4", 1, None, None, None, "recorded", None, None, None, None, None, None, None, None, None, None, 1, None, None, None, None, None, "x", "y")
    lone = (None, "r5", 1, URL, None, None, "incomplete", None, None, None, None, None, None, None, None, None, None, 1, None, None, None, None, None, "x", "y")
    blocked = (3, "r6", 1, URL, "GET", None, "blocked", None, None, None, None, None, None, None, None, None, None, 1, AT, None, None, None, None, "x", "y")
    rows = spark.createDataFrame([cut, failed, whole, bare, lone, blocked], SCHEMA)
    # A map of fixed order, which one from Python has not.
    headers = F.create_map(*[F.lit(x).cast("string") for pair in got.items() for x in pair])
    return rows.withColumn("response_headers", F.when(F.col("response_headers").isNotNull(), headers))


def test_bytes_of_records(spark):
    """The same bytes as from the record builders, which put each together in Python."""
    rid = lambda *p: archive.record_id("/".join(p))
    day = "2026-07-26T12:34:56Z"
    body = "hé\r\n".encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Null: \r\nContent-Length: 5\r\n\r\n" + body
    short = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Null: \r\nContent-Length: 0\r\n\r\n"
    want = [
        archive.warcinfo(rid("1", "info"), day, "data.warc.gz", archives.INFO),
        archive.metadata(rid("1", "r3", "1", "metadata"), day, {"incomplete": "true", "reason": "loadingFailed", "errorText": "net::ERR", "canceled": "false", "method": "GET"}, URL),
        archive.http_record("response", rid("1", "r1", "1", "response"), day, URL, block, rid("1", "r1", "1", "request"), "10.0.0.1", body),
        archive.http_record("request", rid("1", "r1", "1", "request"), day, URL, archive.http_request("POST", "/a?b", [("Accept", "*/*"), ("Host", "h.example")], b"q=1"), rid("1", "r1", "1", "response"), payload=b"q=1"),
        archive.http_record("response", rid("1", "r2", "1", "response"), day, URL, short, rid("1", "r2", "1", "request"), payload=b"", truncated="length"),
        archive.http_record("request", rid("1", "r2", "1", "request"), day, URL, archive.http_request("GET", "/a?b", [("Host", "h.example")]), rid("1", "r2", "1", "response")),
        archive.metadata(rid("1", "r2", "1", "metadata"), day, {"truncated": "too-large", "encodedDataLength": "99"}, URL, rid("1", "r2", "1", "response")),
    ]
    rows = archives.placed(archives.warc_records(settled(spark)), compress=False).filter("task_id = 1").orderBy("seq").collect()
    assert [bytes(r.member).decode() for r in rows] == [archive.serialise(r).decode() for r in want]
    at = 0
    for r in rows:
        assert (r.offset, r.length) == (at, len(r.member))
        at += r.length


def test_nulls_have_a_form(spark):
    rows = archives.placed(archives.warc_records(settled(spark)), compress=False).collect()
    of = lambda t: [bytes(r.member).decode() for r in sorted((r for r in rows if r.task_id == t), key=lambda r: r.seq)]
    info, response, request = of(2)
    assert "WARC-Date: 1970-01-01T00:00:00Z" in info and "\r\n\r\nHTTP/1.1 0\r\n\r\n" in response and "Target-URI" not in response and "\r\n\r\nGET / HTTP/1.1\r\n\r\n" in request
    assert "Payload-Digest: sha256:4OYMIQUY7QOBJGX36TEJS35ZEQT24QPEMSNZGTFESWMRW6CSXBKQ" in response and "Payload-Digest" not in request
    assert len(of(None)) == 2 and len(of(3)) == 1  # an exchange that gives no record still has its task's first one
    assert archives.placed(archives.warc_records(settled(spark).limit(0))).count() == 0


def test_archives_and_packages_as_files(spark, tmp_path):
    places = archives.placed(archives.warc_records(settled(spark))).cache()
    files.write_files(archives.archive_files(places), str(tmp_path / "w"))
    assert sorted(p.parent.name for p in (tmp_path / "w").glob("*/data.warc.gz")) == ["1", "2", "3", "null"]
    data = (tmp_path / "w" / "1" / "data.warc.gz").read_bytes()
    assert [r.get("WARC-Type") for r in archive.read_archive(data)] == ["warcinfo", "metadata", "response", "request", "response", "request", "metadata"]
    mine = places.filter("task_id = 1").select(F.lit("1/data.warc.gz").alias("name"), "offset", "length", "kind")
    for r in files.read_ranges(mine, str(tmp_path / "w")).collect():
        assert r.data == data[r.offset : r.offset + r.length] and f"WARC-Type: {r.kind}".encode() in gzip.decompress(r.data)
    pages = spark.createDataFrame([(1, URL, "T é", AT), (2, None, None, None), (9, URL, "", AT)], "task_id long, page_url string, title string, captured_at timestamp")
    files.write_files(archives.package_files(places, pages, ["_", "ts"]), str(tmp_path / "p"), packages=True)
    assert sorted(p.name for p in (tmp_path / "p").glob("*.wacz")) == ["1.wacz", "2.wacz", "9.wacz"]
    got = archive.unpack((tmp_path / "p" / "1.wacz").read_bytes())  # checks every hash
    assert list(got) == ["archive/data.warc.gz", "pages/pages.jsonl", "indexes/index.cdxj", "fuzzy.json", "datapackage.json"]
    assert got["archive/data.warc.gz"] == data and got["pages/pages.jsonl"].decode() == archive.pages_jsonl([{"id": "1", "url": URL, "ts": "2026-07-26T12:34:56Z", "title": "T é"}])
    assert got["fuzzy.json"].decode() == archive.fuzzy_json(["_", "ts"])
    lines = [r.line for r in archives.index_lines(places).filter("task_id = 1").collect()]
    assert got["indexes/index.cdxj"].decode() == archive.cdxj_index(lines) and len(lines) == 2
    parts = [(n, got[n]) for n in list(got)[:4]]
    assert got["datapackage.json"].decode() == archive.datapackage(parts, URL, "2026-07-26T12:34:56Z", "T é", "capture-1", "captureq")
    none = archive.unpack((tmp_path / "p" / "9.wacz").read_bytes())
    assert none["archive/data.warc.gz"] == b"" and none["indexes/index.cdxj"] == b"" and f'"title": "{URL}"'.encode() in none["datapackage.json"]
    places.unpersist()


def test_index_is_sorted(spark):
    places = archives.placed(archives.warc_records(settled(spark)))
    got = [r.line for r in archives.sorted_index(places).collect()]
    assert got == sorted(got) and len(got) == 3 and got[0].startswith(" 19700101000000 ")


def test_nearest_with_nulls(spark):
    at = [datetime.datetime(2026, 1, d) for d in range(1, 20)]
    asked = spark.createDataFrame([(1, "a", at[5]), (2, None, at[5]), (3, "a", None), (4, None, None), (None, "a", at[9]), (5, "b", at[5]), (1, "a", at[5])], "id long, key string, at timestamp")
    index = spark.createDataFrame([("a", at[2], 7), ("a", at[9], 8), (None, at[5], 9), ("a", None, 10), ("a", at[5], None)], "key string, at timestamp, ref long")
    got = sorted(((r.id, r.ref) for r in replay.nearest(asked, index).collect()), key=repr)
    assert got == sorted([(1, 7), (2, None), (3, None), (4, None), (None, 8), (5, None), (1, 7)], key=repr)


def test_heads_with_nulls(spark):
    head = records.head_text(F.lit("x"), F.create_map(F.lit("A"), F.lit(None).cast("string"), F.lit("B"), F.lit("1\n2")))
    assert spark.range(1).select(head.alias("h")).first().h == "x\r\nA: \r\nB: 1\r\nB: 2\r\n\r\n"


@pytest.mark.parametrize("name", ["", "/abs", "a/../b", "a//b", None])
def test_names_that_are_refused(name):
    with pytest.raises(ValueError):
        files._safe(name)
