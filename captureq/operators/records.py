"""Settled exchanges as archive records: merged headers, request and response pairs, metadata, counters.

Everything here is built-in functions over one row an exchange; a record's id depends on its exchange alone, so a
repeated task names it alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captureq.functions.text import recorder_reason
from captureq.functions.url import host_port, request_target
from captureq.operators.events import OPENING, exchange_rounds

#: Event kinds that bring the headers as they went over the wire, and the reasons that cut a body short.
EXTRA_REQUEST, EXTRA_RESPONSE = "requestWillBeSentExtraInfo", "responseReceivedExtraInfo"
CUT = ("too-large", "task-cap")
#: Headers that no longer hold once a body is stored decoded.
_STALE = ("content-encoding", "transfer-encoding", "content-length")
#: The UUID namespace of urls.
_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(seed: Column) -> Column:
    """Name-based UUID of a text in the namespace of urls."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), seed.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3) + 8))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def record_id(*parts: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), uuid5(F.concat_ws("/", *[p.cast("string") for p in parts])), F.lit(">"))


def exchange_headers(events: DataFrame) -> DataFrame:
    """request_id, round, request_headers, response_headers: what the extra events told where there were any, else the
    basic ones, whichever came first. events: request_id, seq, kind, headers map<string, string>. Extra events without
    a live exchange are dropped; a side that nothing told is null."""
    live = exchange_rounds(events).filter("round > 0 and not ended")
    last = lambda *kinds: F.max_by("headers", F.when(F.col("kind").isin(*kinds), F.col("seq")))
    told = live.groupBy("request_id", "round").agg(last(EXTRA_REQUEST).alias("q1"), last(*OPENING).alias("q0"), last(EXTRA_RESPONSE).alias("r1"), last("responseReceived").alias("r0"))
    return told.select("request_id", "round", F.coalesce("q1", "q0").alias("request_headers"), F.coalesce("r1", "r0").alias("response_headers"))


def _plain(headers: Column) -> Column:
    """Headers without those of newer protocols that are none (`:status`); null counts as none."""
    return F.map_filter(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, v: ~k.startswith(":"))


def sent_headers(headers: Column, url: Column) -> Column:
    """Request headers as HTTP/1.1 writes them: a Host is added where none stands and the url has one."""
    plain, host = _plain(headers), host_port(url)
    none = ~F.exists(F.map_keys(plain), lambda k: F.lower(k) == "host") & (F.coalesce(host, F.lit("")) != "")
    return F.when(none, F.map_concat(plain, F.create_map(F.lit("Host"), host))).otherwise(plain)


def stored_headers(headers: Column, own_length: Column, stored_bytes: Column) -> Column:
    """Response headers of what the archive holds: with own_length (a body was stored, or dropped on purpose) encodings
    and the origin's length go, and Content-Length says how many bytes are there."""
    plain = _plain(headers)
    kept = F.map_filter(plain, lambda k, v: ~F.lower(k).isin(*_STALE))
    length = F.coalesce(stored_bytes, F.lit(0)).cast("string")
    return F.when(own_length, F.map_concat(kept, F.create_map(F.lit("Content-Length"), length))).otherwise(plain)


def head_text(first: Column, headers: Column) -> Column:
    """A message head: the first line, a line for each header (a value of several lines is a repeated header, a null one is
    empty), a blank."""
    lines = F.flatten(F.transform(F.map_entries(headers), lambda e: F.transform(F.split(F.coalesce(e["value"], F.lit("")), "\n"), lambda v: F.concat(e["key"], F.lit(": "), v))))
    return F.concat(F.array_join(F.concat(F.array(first), lines), "\r\n"), F.lit("\r\n\r\n"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """A map of those fields whose value is not null, in order."""
    every = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(every, lambda e: e["value"].isNotNull()))


def exchange_records(settled: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """task_id, request_id, round, the columns of `carry`, pos, kind, record_id, concurrent_to, refers_to, truncated, head,
    fields.

    An exchange that was recorded (or answered by a redirect) gives a response and a request that name each other, and
    a metadata record that refers to the response where its body was dropped; one that failed, ended without a response
    or was pending at the end gives a metadata record that says so. Blocked and replaced ones give nothing.

    settled: task_id, request_id, round, url, method, resource_type, outcome, status, status_text, request_headers,
    response_headers, body_bytes (null: none stored), skip_reason, encoded_length, error_text, canceled,
    blocked_reason; any may be null but the first three and the outcome. A null status is written as 0 without a reason, a
    null url asks for `/`, a null method is GET, null headers are none."""
    c = F.col
    ident = [c("task_id"), c("request_id"), c("round")]
    response, request = (record_id(*ident, F.lit(k)) for k in ("response", "request"))
    pair, dropped = c("outcome").isin("recorded", "redirected"), c("skip_reason").isNotNull()
    stored = F.when(~dropped, c("body_bytes"))
    known = F.concat(c("status").cast("string"), F.lit(" "), recorder_reason(c("status"), F.coalesce("status_text", F.lit(""))))
    status_line = F.concat(F.lit("HTTP/1.1 "), F.coalesce(known, F.lit("0")))
    request_line = F.concat(F.coalesce("method", F.lit("GET")), F.lit(" "), F.coalesce(request_target(c("url")), F.lit("/")), F.lit(" HTTP/1.1"))
    missing = F.when(c("outcome") == "no-response", "loadingFinished-without-response").when(c("outcome") == "failed", "loadingFailed").when(c("outcome") == "incomplete", "stop-while-pending")
    failed, named = c("outcome") == "failed", c("outcome") != "failed"
    why = _fields(
        ("incomplete", F.lit("true")),
        ("reason", missing),
        ("requestId", F.when(named, c("request_id"))),
        ("errorText", F.when(failed, c("error_text"))),
        ("canceled", F.when(failed, F.coalesce("canceled", F.lit(False)))),
        ("method", F.when(c("outcome") != "no-response", c("method"))),
        ("resourceType", c("resource_type")),
        ("blockedReason", F.when(failed, c("blocked_reason"))),
        ("status", F.when(failed, c("status"))),
    )
    omitted = _fields(("truncated", c("skip_reason")), ("encodedDataLength", c("encoded_length")))
    none = F.lit(None).cast("string")

    def record(kind: str, when: Column, rid: Column, concurrent: Column, refers: Column, truncated: Column, head: Column, fields: Column) -> Column:
        values = (("kind", F.lit(kind)), ("record_id", rid), ("concurrent_to", concurrent), ("refers_to", refers), ("truncated", truncated), ("head", head), ("fields", fields))
        return F.when(when, F.struct(*[v.alias(k) for k, v in values]))

    empty = F.lit(None).cast("map<string,string>")
    rows = F.array(
        record("response", pair, response, request, none, F.when(c("skip_reason").isin(*CUT), "length"), head_text(status_line, stored_headers(c("response_headers"), dropped | stored.isNotNull(), stored)), empty),
        record("request", pair, request, response, none, none, head_text(request_line, sent_headers(c("request_headers"), c("url"))), empty),
        record("metadata", pair & dropped, record_id(*ident, F.lit("metadata")), none, response, none, none, omitted),
        record("metadata", missing.isNotNull(), record_id(*ident, F.lit("metadata")), none, none, none, none, why),
    )
    each = settled.select("task_id", "request_id", "round", *carry, F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("pos", "r"))
    return each.select("task_id", "request_id", "round", *carry, "pos", "r.*")


#: Counter names by what they count.
REJECTIONS = {"blocked": "blocked", "skipped_content_type": "content-type", "truncated_too_large": "too-large", "truncated_task_cap": "task-cap"}


def recorder_counters(settled: DataFrame, samples: int = 5) -> DataFrame:
    """The eight counters of each task, and the first urls (by opened_at) of each kind of rejection as arrays.

    settled: task_id, opened_at, url, outcome, skip_reason, body_bytes."""
    reason = F.coalesce("skip_reason", F.when(F.col("outcome") == "blocked", "blocked"), F.lit(""))
    pair = F.col("outcome").isin("recorded", "redirected")
    told = settled.withColumn("_r", reason).withColumn("_whole", pair & (reason == ""))
    count = [F.count_if(F.col("_r") == v).alias(k) for k, v in REJECTIONS.items()]
    first = [F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("_r") == v, F.struct("opened_at", "url")))), 1, samples), lambda x: x["url"]).alias(f"{k}_urls") for k, v in REJECTIONS.items()]
    return told.groupBy("task_id").agg(
        F.count_if("_whole").alias("total_recorded"),
        *count,
        F.count_if(F.col("outcome").isin("failed", "no-response")).alias("failed"),
        F.count_if(F.col("outcome") == "incomplete").alias("incomplete"),
        F.coalesce(F.sum(F.when(F.col("_whole"), F.col("body_bytes"))), F.lit(0)).alias("total_body_bytes"),
        *first,
    )
