"""WARC records and WACZ packages as bytes, and DataFrame operators that write and read one archive per capture.

Python is needed for gzip and ZIP bytes only; each row is one capture, taken and handed on in batches of a few MB, so memory
is bounded by one archive, whatever the number and the size of the others."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captureq.functions.url import host_port, request_target, surt

from .batches import batches_of, bounded_batches, released, rows_of

VERSION, CRLF = b"WARC/1.1", b"\r\n"
#: Entries of a package.
WARC_ENTRY, PAGES_ENTRY, INDEX_ENTRY, FUZZY_ENTRY, PACKAGE_ENTRY, DIGEST_ENTRY = "archive/data.warc.gz", "pages/pages.jsonl", "indexes/index.cdxj", "fuzzy.json", "datapackage.json", "datapackage-digest.json"
#: Query parameters that a fuzzy lookup ignores by default.
FUZZY_PARAMS = ["_", "cb", "nocache", "t", "nonce", "timestamp", "_t", "_v", "ts"]


def sha256_base32(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record_id(seed: str) -> str:
    """A record id that depends on its seed alone, so that a repeated task writes the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>"


@dataclass
class Record:
    headers: list[tuple[str, str]]
    body: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def header_list(headers: Mapping[str, str]) -> list[tuple[str, str]]:
    """Headers in order; a value of several lines is a repeated header."""
    return [(k, v) for k, value in headers.items() for v in value.split("\n")]


def request_headers(headers: Mapping[str, str], host: str | None) -> dict[str, str]:
    out = {k: v for k, v in headers.items() if not k.startswith(":")}
    return out if host is None or any(k.lower() == "host" for k in out) else out | {"Host": host}


def response_headers(headers: Mapping[str, str], rewrite_length: bool) -> dict[str, str]:
    gone = {"content-encoding", "transfer-encoding", "content-length"} if rewrite_length else set()
    return {k: v for k, v in headers.items() if not k.startswith(":") and k.lower() not in gone}


def http_request(method: str, target: str, headers: Sequence[tuple[str, str]], body: bytes = b"") -> bytes:
    lines = [f"{method} {target} HTTP/1.1", *(f"{k}: {v}" for k, v in headers)]
    return "\r\n".join(lines).encode() + CRLF * 2 + body


def http_response(version: str, status: int, reason: str, headers: Sequence[tuple[str, str]], body: bytes = b"") -> bytes:
    lines = [f"{version} {status}" + (f" {reason}" if reason else ""), *(f"{k}: {v}" for k, v in headers)]
    return "\r\n".join(lines).encode() + CRLF * 2 + body


def warc_fields(fields: Mapping[str, str]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()


def _record(kind: str, rid: str, date: str, middle: list[tuple[str, str]], content_type: str, body: bytes, tail: Sequence[tuple[str, str | None]] = ()) -> Record:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *middle, ("Content-Type", content_type), ("Content-Length", str(len(body))), ("WARC-Block-Digest", sha256_base32(body))]
    return Record(head + [(k, v) for k, v in tail if v is not None], body)


def warcinfo(rid: str, date: str, filename: str, fields: Mapping[str, str]) -> Record:
    return _record("warcinfo", rid, date, [("WARC-Filename", filename)], "application/warc-fields", warc_fields(fields))


def http_record(kind: str, rid: str, date: str, uri: str, block: bytes, concurrent_to: str | None = None, ip: str | None = None, payload: bytes | None = None, truncated: str | None = None) -> Record:
    tail = [("WARC-Concurrent-To", concurrent_to), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", None if payload is None else sha256_base32(payload)), ("WARC-Truncated", truncated)]
    return _record(kind, rid, date, [("WARC-Target-URI", uri)], f"application/http;msgtype={kind}", block, tail)


def metadata(rid: str, date: str, fields: Mapping[str, str], uri: str | None = None, refers_to: str | None = None) -> Record:
    return _record("metadata", rid, date, [], "application/warc-fields", warc_fields(fields), [("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to)])


def serialise(record: Record) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in record.headers).encode()
    return VERSION + CRLF + head + CRLF + record.body + CRLF * 2


def write_archive(records: Sequence[Record]) -> tuple[bytes, list[tuple[int, int]]]:
    """An independent gzip member per record, and each one's (offset, length)."""
    out, places = io.BytesIO(), []
    for r in records:
        member = gzip.compress(serialise(r), 6, mtime=0)
        places.append((out.tell(), len(member)))
        out.write(member)
    return out.getvalue(), places


def read_archive(data: bytes) -> list[Record]:
    """The records of an archive, by their own lengths from its start."""
    raw, at, out = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0, []
    while at < len(raw):
        stop = raw.index(CRLF * 2, at)
        lines = raw[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = [tuple(x.split(": ", 1)) for x in lines[1:]]
        n = int(next(v for k, v in headers if k == "Content-Length"))
        out.append(Record(headers, raw[stop + 4 : stop + 4 + n]))
        at = stop + 4 + n + 4
    return out


def metadata_field(body: str, name: str) -> str | None:
    m = re.search(rf"(?m)^{re.escape(name)}: (.*?)\r?$", body)
    return m[1] if m else None


def pages_jsonl(entries: Sequence[Mapping[str, str]]) -> str:
    head = {"format": "json-pages-1.0", "id": "pages", "title": "All Pages"}
    return "".join(json.dumps(x, separators=(",", ":"), ensure_ascii=False) + "\n" for x in [head, *entries])


def fuzzy_json(params: Sequence[str]) -> str:
    return json.dumps({"version": 1, "rules": [{"rule": "strip-query-param", "name": p} for p in params]}, indent=2) + "\n"


def cdxj_index(lines: Sequence[str]) -> str:
    return "".join(x + "\n" for x in sorted(lines))


def datapackage(resources: Sequence[tuple[str, bytes]], url: str, date: str, title: str, name: str, software: str, capture: dict | None = None) -> str:
    body = {
        "profile": "data-package", "wacz_version": "1.1.1", "name": name, "software": software, "created": date, "mainPageURL": url, "mainPageDate": date,
        "resources": [{"name": p.rsplit("/", 1)[-1], "path": p, "hash": "sha256:" + hashlib.sha256(b).hexdigest(), "bytes": len(b)} for p, b in resources], "title": title or url,
    }
    return json.dumps(body | ({"capture": capture} if capture is not None else {}), indent=2, ensure_ascii=False) + "\n"


class SigningRequired(Exception):
    """A package that had to be signed was not; nothing is written."""


def pack(warc: bytes, index: str, page: Mapping[str, str], software: str = "captureq", fuzzy: Sequence[str] = (), signature: bytes | None = None, require_signature: bool = False) -> bytes:
    """A ZIP package: the archive stored, everything else deflated, the digest entry only when signed."""
    if require_signature and signature is None:
        raise SigningRequired(page["id"])
    parts = [(WARC_ENTRY, warc), (PAGES_ENTRY, pages_jsonl([page]).encode()), (INDEX_ENTRY, index.encode()), (FUZZY_ENTRY, fuzzy_json(fuzzy).encode())]
    package = datapackage(parts, page["url"], page["ts"], page["title"], f"capture-{page['id']}", software).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in [*parts, (PACKAGE_ENTRY, package), *([(DIGEST_ENTRY, signature)] if signature is not None else [])]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == WARC_ENTRY else zipfile.ZIP_DEFLATED
            z.writestr(info, data, compresslevel=6)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, bytes]:
    """The entries of a package, each resource checked against the hash that the package states."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = {n: z.read(n) for n in z.namelist()}
    for r in json.loads(out[PACKAGE_ENTRY])["resources"]:
        if "sha256:" + hashlib.sha256(out[r["path"]]).hexdigest() != r["hash"]:
            raise ValueError(f"{r['path']} does not have its hash")
    return out


def _each(rows: DataFrame, make: Callable[..., tuple | Iterator[tuple]], schema: pa.Schema, kinds: str) -> DataFrame:
    """make(*row), one row or several, for each row: one at a time, in batches of a few MB on either side."""
    bounded_batches(rows.sparkSession)

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in parts:
            for row in rows_of(batch):
                got = make(*row)
                if isinstance(got, tuple):
                    yield got
                else:
                    yield from got

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(made(parts), schema)

    return rows.mapInArrow(run, kinds)


def page_packages(pages: DataFrame, packages: bool = True) -> DataFrame:
    """page_id, url, warc, wacz: an archive and a package (null without `packages`) for each page (page_id, url, html,
    captured_at).

    Null urls and null html count as empty, a null captured_at as the start of 1970; a url without a host gives a request
    without a Host header."""
    url = F.coalesce("url", F.lit(""))
    title = F.coalesce(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    date = F.date_format(F.coalesce("captured_at", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = pages.select("page_id", url.alias("url"), "html", date.alias("date"), surt(url).alias("surt"), request_target(url).alias("target"), host_port(url).alias("host"), title.alias("title"))

    def package(page_id: int, url: str, html: str | None, date: str, key: str, target: str, host: str | None, title: str) -> tuple:
        body = (html or "").encode()
        rid, qid = record_id(f"{page_id}/response"), record_id(f"{page_id}/request")
        block = http_response("HTTP/1.1", 200, "OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))], body)
        records = [
            warcinfo(record_id(f"{page_id}/info"), date, "data.warc.gz", {"software": "captureq", "format": "WARC File Format 1.1"}),
            http_record("response", rid, date, url, block, qid, payload=body),
            http_record("request", qid, date, url, http_request("GET", target, header_list(request_headers({}, host or None))), rid),
        ]
        warc, places = write_archive(records)
        if not packages:
            return page_id, url, warc, None
        entry = {"url": url, "mime": "text/html", "status": "200", "digest": sha256_base32(body), "length": str(places[1][1]), "offset": str(places[1][0]), "filename": "data.warc.gz"}
        line = f"{key} {re.sub('[-:TZ]', '', date)[:14]} {json.dumps(entry, separators=(',', ':'), ensure_ascii=False)}"
        page = {"id": str(page_id), "url": url, "ts": date, "title": title}
        return page_id, url, warc, pack(warc, cdxj_index([line]), page, fuzzy=FUZZY_PARAMS)

    return _each(base, package, pa.schema({"page_id": pa.int64(), "url": pa.string(), "warc": pa.binary(), "wacz": pa.binary()}), "page_id long, url string, warc binary, wacz binary")


def read_warcs(archives: DataFrame) -> DataFrame:
    """page_id, url, payload: the response records of each archive in column warc."""

    def read(page_id: int, warc: bytes) -> Iterator[tuple]:
        for rec in read_archive(warc):
            if rec.get("WARC-Type") == "response":
                yield page_id, rec.get("WARC-Target-URI"), rec.body.split(CRLF * 2, 1)[1]

    return _each(archives.select("page_id", "warc"), read, pa.schema({"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary()}), "page_id long, url string, payload binary")


def read_packages(packages: DataFrame) -> DataFrame:
    """page_id, url, title, status, payload: page entry, index entry and the payload of the record that the index points at."""

    def read(page_id: int, wacz: bytes) -> tuple:
        got = unpack(wacz)
        page = json.loads(got[PAGES_ENTRY].decode().split("\n")[1])
        line = next(x for x in got[INDEX_ENTRY].decode().split("\n") if x)
        entry = json.loads(line[line.index("{") :])
        a, n = int(entry["offset"]), int(entry["length"])
        rec = read_archive(got[WARC_ENTRY][a : a + n])[0]
        return page_id, page["url"], page["title"], int(entry["status"]), rec.body.split(CRLF * 2, 1)[1]

    kinds = pa.schema({"page_id": pa.int64(), "url": pa.string(), "title": pa.string(), "status": pa.int32(), "payload": pa.binary()})
    return _each(packages.select("page_id", "wacz"), read, kinds, "page_id long, url string, title string, status int, payload binary")
