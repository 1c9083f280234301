"""A task's archive: its settled exchanges as WARC records of bytes, their places, index lines, files and packages.

Records are put together by built-in functions, one row a record; Python runs only to compress them. Order within a task
is that in which its exchanges opened."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captureq.functions.digest import sha256_base32
from captureq.functions.url import cdx_timestamp
from captureq.operators.records import exchange_records, record_id
from captureq.operators.replay import cdxj_line

_CRLF = "\r\n"
#: File names and entries of an archive, fields of its first record.
ARCHIVE, WARC_ENTRY, INDEX_ENTRY, PAGES_ENTRY, FUZZY_ENTRY = "data.warc.gz", "archive/data.warc.gz", "indexes/index.cdxj", "pages/pages.jsonl", "fuzzy.json"
INFO = {"software": "captureq", "format": "WARC File Format 1.1"}
#: Columns that settled exchanges have besides those of exchange_records.
EXTRA = ("opened_at", "url", "captured_at", "mime", "ip", "status", "body", "request_body")


def _lines(*pairs: tuple[str, Column | str | None]) -> Column:
    """Header lines of those fields that are not null."""
    every = [F.concat(F.lit(f"{k}: "), (F.lit(v) if isinstance(v, str) else v).cast("string"), F.lit(_CRLF)) for k, v in pairs]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in every])


def _fields_text(fields: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(_CRLF))), "")


def _record(kind: Column | str, rid: Column, date: Column, block: Column, content_type: Column | str, middle: Sequence[tuple] = (), tail: Sequence[tuple] = ()) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = _lines(
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *middle, ("Content-Type", content_type), ("Content-Length", F.octet_length(block)), ("WARC-Block-Digest", sha256_base32(block)), *tail,
    )
    return F.concat(F.concat(F.lit("WARC/1.1" + _CRLF), head, F.lit(_CRLF)).cast("binary"), block, F.lit(_CRLF * 2).cast("binary"))


def warc_records(settled: DataFrame) -> DataFrame:
    """task_id, opened_at, request_id, round, pos, kind, url, status, mime, date, payload_digest, record (bytes).

    Each task begins with a warcinfo record (pos -1, before all), dated like its first exchange. settled: the columns of
    exchange_records and EXTRA: captured_at timestamp, ip, body and request_body (binary). A body counts only where
    nothing was dropped. Null bodies are empty, but a request has a payload digest only where it has a body; a null url,
    ip or mime gives no such header (an empty mime in the index); a null captured_at is the start of 1970. Tasks of a
    null task_id are one task."""
    date = F.date_format(F.coalesce("captured_at", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    nothing = F.lit("").cast("binary")
    rows = exchange_records(settled, carry=[*EXTRA, "skip_reason"]).withColumn("date", date)
    response, request = F.col("kind") == "response", F.col("kind") == "request"
    kept = F.when(F.col("skip_reason").isNull(), F.coalesce("body", nothing)).otherwise(nothing)
    payload = F.when(response, kept).when(request, F.col("request_body"))
    rows = rows.withColumn("payload", payload)
    # Worked out once: what follows names the block several times.
    block = F.when(F.col("kind") == "metadata", _fields_text(F.col("fields")).cast("binary")).otherwise(F.concat(F.col("head").cast("binary"), F.coalesce("payload", nothing)))
    kind_type = F.when(F.col("kind") == "metadata", F.lit("application/warc-fields")).otherwise(F.concat(F.lit("application/http;msgtype="), F.col("kind")))
    of_http = F.when(F.col("kind") != "metadata", F.col("url"))
    digest = F.when(F.col("payload").isNotNull(), sha256_base32(F.col("payload")))
    rows = rows.withColumns({"block": block, "payload_digest": digest})
    record = _record(
        F.col("kind"), F.col("record_id"), F.col("date"), F.col("block"), kind_type, [("WARC-Target-URI", of_http)],
        [("WARC-Concurrent-To", F.col("concurrent_to")), ("WARC-IP-Address", F.when(response, F.col("ip"))), ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Truncated", F.col("truncated")),
         ("WARC-Target-URI", F.when(F.col("kind") == "metadata", F.col("url"))), ("WARC-Refers-To", F.col("refers_to"))],
    )
    names = ["task_id", "opened_at", "request_id", "round", "pos", "kind", "url", "status", "mime", "date", "payload_digest"]
    out = rows.select(*names, record.alias("record"))
    first = settled.groupBy("task_id").agg(F.min_by(F.coalesce("captured_at", F.timestamp_seconds(F.lit(0))), "opened_at").alias("captured_at"))
    first = first.withColumn("date", date).withColumn("block", F.lit("".join(f"{k}: {v}{_CRLF}" for k, v in INFO.items())).cast("binary"))
    info = _record("warcinfo", record_id(F.coalesce(F.col("task_id").cast("string"), F.lit("")), F.lit("info")), F.col("date"), F.col("block"), "application/warc-fields", [("WARC-Filename", ARCHIVE)])
    kinds = {f.name: f.dataType for f in out.schema.fields}
    fixed = {"pos": F.lit(-1), "kind": F.lit("warcinfo"), "date": F.col("date"), "task_id": F.col("task_id")}
    return first.select(*[fixed.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names], info.alias("record")).unionByName(out)


def _compressed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        members = pa.array([gzip.compress(x.as_py(), 6, mtime=0) for x in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], members], names=batch.schema.names)


def placed(records: DataFrame, compress: bool = True) -> DataFrame:
    """records with member (an independent gzip member each, or the plain record), seq, offset and length in the archive
    of their task. One shuffle by task, which also serves the files that are written of it."""
    order = ["opened_at", "request_id", "round", "pos"]
    rows = records.withColumnRenamed("record", "member")
    if compress:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        rows = rows.mapInArrow(_compressed, kinds)
    in_task = Window.partitionBy("task_id").orderBy(F.col("pos") >= 0, *order)
    before = in_task.rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length("member").cast("long")
    rows = rows.withColumn("length", length)
    return rows.withColumns({"seq": F.row_number().over(in_task).cast("long"), "offset": F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")})


def index_lines(places: DataFrame) -> DataFrame:
    """task_id, line, offset, length: a CDXJ line for each response of placed records."""
    line = cdxj_line(F.coalesce("url", F.lit("")), cdx_timestamp(F.col("date")), F.col("mime"), F.col("status"), F.col("payload_digest"), F.col("length"), F.col("offset"), F.lit(ARCHIVE))
    return places.filter("kind = 'response'").select("task_id", line.alias("line"), "offset", "length")


def sorted_index(places: DataFrame) -> DataFrame:
    """All lines in the order of their bytes: a range-partitioned sort, so that written files follow one another."""
    return index_lines(places).select("task_id", "line").orderBy("line", "task_id")


def _task_file(ending: str) -> Column:
    return F.concat(F.coalesce(F.col("task_id").cast("string"), F.lit("null")), F.lit(ending))


def archive_files(places: DataFrame) -> DataFrame:
    """(name, part, data) for `files.write_files`: one archive for each task."""
    return places.select(_task_file("/" + ARCHIVE).alias("name"), F.col("seq").alias("part"), F.col("member").alias("data"))


def package_files(places: DataFrame, pages: DataFrame, fuzzy: Sequence[str] = ()) -> DataFrame:
    """(name, entry, place, part, data) for `files.write_files` with packages: a ZIP for each task.

    pages: task_id, page_url, title, captured_at: what the package says of its page; a null or empty title is the url.
    A task without a page gets no package, one without exchanges an empty archive."""
    name = _task_file(".wacz").alias("name")
    date = F.date_format(F.coalesce("captured_at", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = pages.select("task_id", F.coalesce("page_url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), date.alias("date"))
    known = said.select("task_id")
    ours = places.join(known, places["task_id"].eqNullSafe(known["task_id"]), "left_semi")
    archive = ours.select(name, F.lit(WARC_ENTRY).alias("entry"), F.lit(0).alias("place"), F.col("seq").alias("part"), F.col("member").alias("data"))
    empty = said.select(name, F.lit(WARC_ENTRY).alias("entry"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("part"), F.lit("").cast("binary").alias("data"))
    in_order = F.row_number().over(Window.partitionBy("task_id").orderBy("line")).cast("long")
    lines = index_lines(ours).withColumn("n", in_order).select(name, F.lit(INDEX_ENTRY).alias("entry"), F.lit(2).alias("place"), F.col("n").alias("part"), F.concat("line", F.lit("\n")).cast("binary").alias("data"))
    no_lines = said.select(name, F.lit(INDEX_ENTRY).alias("entry"), F.lit(2).alias("place"), F.lit(0).cast("long").alias("part"), F.lit("").cast("binary").alias("data"))
    head = '{"format":"json-pages-1.0","id":"pages","title":"All Pages"}\n'
    shown = F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title"))
    page = F.concat(F.lit(head), F.to_json(F.struct(F.col("task_id").cast("string").alias("id"), "url", F.col("date").alias("ts"), "title")), F.lit("\n"))
    rules = ",\n".join(f'    {{\n      "rule": "strip-query-param",\n      "name": "{p}"\n    }}' for p in fuzzy)
    fuzzy_text = '{\n  "version": 1,\n  "rules": [' + (f"\n{rules}\n  " if fuzzy else "") + "]\n}\n"
    stated = F.to_json(
        F.struct(
            F.lit("data-package").alias("profile"), F.lit("1.1.1").alias("wacz_version"), F.concat(F.lit("capture-"), F.col("task_id").cast("string")).alias("name"), F.lit(INFO["software"]).alias("software"),
            F.col("date").alias("created"), F.col("url").alias("mainPageURL"), F.col("date").alias("mainPageDate"), shown.alias("title"),
        )
    )
    rest = F.explode(F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(p).alias("place"), d.alias("text")) for e, p, d in ((PAGES_ENTRY, 1, page), (FUZZY_ENTRY, 3, F.lit(fuzzy_text)), ("datapackage.json", 4, stated))]))
    small = said.select(name, rest.alias("r")).select("name", "r.entry", "r.place", F.lit(1).cast("long").alias("part"), F.col("r.text").cast("binary").alias("data"))
    return archive.unionByName(empty).unionByName(lines).unionByName(no_lines).unionByName(small)
