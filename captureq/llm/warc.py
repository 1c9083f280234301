"""WARC archives of pages: writing with revisit records, and reading by boundary-chain verification.

Archives are plain concatenations of records, written by Spark's text writer with the record separator as line
separator, so they land wherever Spark can write. A reader cannot trust a record's magic: a payload may hold it. So
every place where the magic stands is a candidate with the offset that its own length names as successor, and pointer
jumping over these links from the start of each file keeps only candidates that the chain reaches."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, frequent_join, released, text_slices, written

MAGIC, END = b"WARC/1.0\r\n", b"\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_ID = "urn:captureq:page:"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record (without payload) where refers_to is given; no trailing separator."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{RECORD_ID}{page_id}>".encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    head += [b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha1:" + sha1_base32(payload).encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE, f"WARC-Refers-To: <{RECORD_ID}{refers_to}>".encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return MAGIC + b"\r\n".join(head) + END + block


def revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload, of at least least_bytes, also stands under a larger id."""
    slim = written(pages.select(F.col(id_col).alias("id"), F.sha2(payload_col, 256).alias("digest"), F.octet_length(payload_col).alias("n")).filter((F.col("n") >= least_bytes) & F.col("id").isNotNull()).drop("n"), "digests")
    first = slim.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("least"), F.count(F.lit(1)).alias("w")).filter("least < refers_to").drop("least")
    return frequent_join(slim, first, ["digest"], "w", "inner").filter("id < refers_to").distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", bytes_per_file: int = 64 << 20) -> None:
    """Write one record per row below path, in files that hold at most bytes_per_file before compression, or one record.

    Of rows with equal payloads (null html: empty) of at least least_bytes the one with the largest id is a response,
    the others are revisits of it; rows repeated under the largest id are all responses, and so is a row with a null id,
    which nothing refers to. A null url has no target line. An empty table writes no record."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits(rows, "id", "payload", least_bytes), ["id", "digest"], "left")

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, room = 0, bytes_per_file
        for batch in parts:
            ids, urls, refers = (batch.column(k).to_pylist() for k in range(3))
            for a, b, col in text_slices(batch, 3):
                out = [record(ids[a + i], urls[a + i], p, refers[a + i], date) for i, p in enumerate(col.to_pylist())]
                places = []
                for r in out:
                    room -= len(r) + len(END)
                    if room < 0:
                        file, room = file + 1, bytes_per_file - len(r) - len(END)
                    places.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(places, pa.int32())], names=["record", "part"])

    lines = rows.select("id", "url", "refers_to", "payload").mapInArrow(run, "record binary, part int").select(F.col("record").cast("string").alias("value"), "part")
    lines.write.option("lineSep", END.decode()).option("compression", compression).partitionBy("part").text(path)


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return m[1] if m else None


def parse_candidates(data: bytes) -> Iterator[dict]:
    """Everything in an archive that looks like a record, with the offset that its length names as successor."""
    at = data.find(MAGIC)
    while at >= 0:
        stop = data.find(END, at)
        head = data[at : stop + 2] if stop >= 0 else b""
        size = _field(head, b"Content-Length")
        if size is not None and size.isdigit() and stop + 4 + int(size) <= len(data):
            block = data[stop + 4 : stop + 4 + int(size)]
            cut = block.find(END)
            http, payload = (block[:cut + 2], block[cut + 4 :]) if cut >= 0 else (b"", block)
            kind = (_field(head, b"WARC-Type") or b"").decode("latin-1")
            n = _field(http, b"Content-Length")
            digest = (_field(head, b"WARC-Payload-Digest") or b"").decode("latin-1").removeprefix("sha1:")
            own, refers = ((_field(head, x) or b"").decode("latin-1").removeprefix(f"<{RECORD_ID}").removesuffix(">") for x in (b"WARC-Record-ID", b"WARC-Refers-To"))
            whole = kind != "revisit"
            own_digest = sha1_base32(payload) if whole else digest
            yield {
                "at": at, "next": stop + 8 + int(size), "record_type": kind, "id": int(own) if re.fullmatch(r"-?\d+", own) else None, "refers_to": int(refers) if re.fullmatch(r"-?\d+", refers) else None,
                "payload_bytes": len(payload) if whole else int(n or 0), "payload_digest": own_digest, "sound": own_digest == digest,
            }
        at = data.find(MAGIC, at + 1)


CANDIDATE = "file string, at long, next long, record_type string, id long, refers_to long, payload_bytes long, payload_digest string, sound boolean"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of every archive file below path; files may be compressed by gzip."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()), ("id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("sound", pa.bool_())])
        for batch in parts:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = [{"file": name.as_py(), **c} for c in parse_candidates(data)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, CANDIDATE)


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the candidates that the chain from offset 0 of their file reaches, by pointer jumping.

    Each round doubles every pointer and hands reachedness to its target; after log2 of the longest chain no reached
    candidate has a pointer left."""
    now = written(links.select("file", "at", "next", (F.col("at") == 0).alias("reached")), "chain")
    while now.filter("next is not null").limit(1).count():
        ahead = now.select("file", F.col("at").alias("next"), F.col("next").alias("far"), F.lit(True).alias("known"))
        jumped = now.join(ahead, ["file", "next"], "left")
        told = jumped.select("file", F.explode(F.array(F.struct("at", F.when(F.col("known"), F.col("far")).alias("next"), "reached"), F.struct(F.when(F.col("known") & F.col("reached"), F.col("next")).alias("at"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("reached")))).alias("x"))
        old, told = now, told.select("file", "x.*").filter("at is not null").groupBy("file", "at")
        now = written(told.agg(F.max("next").alias("next"), F.max("reached").alias("reached")), "chain")
        discard(old)
    return now.filter("reached").select("file", "at")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, at (offset), record_type, id, refers_to, payload_bytes, payload_digest, sound: the true records of all
    archives below path. sound is false where a stored payload does not have its digest. A file that does not start with
    a record has none; after a damaged length its chain ends."""
    found = written(candidates(spark, path), "candidates")
    return found.join(reachable(found), ["file", "at"], "left_semi").drop("next")
