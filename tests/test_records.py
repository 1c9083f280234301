"""Recorded exchanges, archive bytes and links where they went wrong before, and odd rows of the capture operators."""

import uuid

import pytest
from pyspark.sql import functions as F

from captureq.functions import text, url
from captureq.functions.digest import EMPTY_SHA256
from captureq.operators import events, links, recorder, records, replay, tasks
from captureq.sources import archive
from captureq.sources.archive import read_archive

EXCHANGE = "task_id long, seq long, url string, status int, mime string, body_bytes long, declared_bytes long"


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_null_bodies_use_no_budget(spark):
    bodies = [None, 80, None, 80, 20]
    df = spark.createDataFrame([(1, k, "u", 200, None, b, None) for k, b in enumerate(bodies)], EXCHANGE)
    folded = recorder.body_budget(df, 1000, 100)
    assert [r.skip_reason for r in folded.orderBy("seq").collect()] == [None, None, None, "task-cap", None]
    assert recorder.recorder_stats(folded).first().total_body_bytes == 100
    assert recorder.body_budget(df.limit(0), 1000, 100).count() == 0


def test_budget_of_a_long_task(spark):
    """A plain loop over 3000 exchanges tells the same."""
    bodies = [(k * 7919) % 90 for k in range(3000)]
    want, total = [], 0
    for b in bodies:
        reason = "task-cap" if total >= 60_000 else "too-large" if b > 80 else "task-cap" if total + b > 60_000 else None
        total += 0 if reason else b
        want.append(reason)
    df = spark.createDataFrame([(1, k, "u", 200, "", b, b) for k, b in enumerate(bodies)], EXCHANGE)
    assert [r.skip_reason for r in recorder.body_budget(df, 80, 60_000).orderBy("seq").collect()] == want


def test_request_record(spark):
    at = "timestamp'2024-01-01 00:00:00'"
    rows = spark.sql(f"select 1L page_id, 'https://WWW.Example.com:8443/a/b?q=1#z' url, 'x' html, {at} captured_at union all select 2L, null, null, {at}")
    got = {r.page_id: read_archive(bytes(r.warc)) for r in archive.page_packages(rows).collect()}
    request = next(x for x in got[1] if x.get("WARC-Type") == "request")
    assert request.body == b"GET /a/b?q=1 HTTP/1.1\r\nHost: www.example.com:8443\r\n\r\n"
    assert [x.get("WARC-Type") for x in got[2]] == ["warcinfo", "response", "request"] and got[2][1].get("WARC-Target-URI") == ""


def test_index_line_of_a_null_digest(spark):
    line = replay.cdxj_line(*[F.lit(x) for x in ("http://a/", "2024", "", 200)], F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(0), F.lit("f"))
    assert one(spark, line)[0].endswith(f'"digest":"sha256:{EMPTY_SHA256}","length":"","offset":"0","filename":"f"}}')


def test_invalid_and_finished_tasks_hold_no_url(spark):
    rows = [(1, "u", 1, "a b", "", "x"), (2, "u", 2, "ok", "", "x"), (3, "u", 3, "ok", "", "x"), (4, "v", 1, "ok", "", "success"), (5, "v", 2, "ok", "", "x"), (6, None, 1, "ok", "", "x"), (7, None, 2, "ok", "", "x")]
    df = spark.createDataFrame(rows, "task_id long, url string, enqueued_at int, label string, correlation_id string, status string")
    got = {r.task_id: r.http_status for r in tasks.admission(df, 1, F.col("status") == "success").collect()}
    assert got == {1: 400, 2: 202, 3: 409, 4: 202, 5: 202, 6: 202, 7: 202}
    assert {r.http_status for r in tasks.admission(df, 0).collect()} == {400, 503}
    assert {r.task_id for r in tasks.duplicate_urls(df).filter("rejected").collect()} == {2, 3, 5}


@pytest.mark.parametrize("protocol,version", [("h2", "HTTP/2.0"), ("HTTP/2", "HTTP/2.0"), ("http/2.0", "HTTP/2.0"), ("h2c", "HTTP/1.1"), ("h3", "HTTP/1.1"), ("http/1.0", "HTTP/1.0"), (None, "HTTP/1.1")])
def test_protocols(spark, protocol, version):
    assert one(spark, text.http_version(F.lit(protocol).cast("string"))) == [version]


def test_error_classes(spark):
    limit = "Navigation timeout of 30000 ms exceeded"
    kinds = [text.error_type(F.lit(c).cast("string"), F.lit(m).cast("string")) for c, m in (("TimeoutError", limit), ("Error", limit), (None, "Target closed"), ("SigningRequiredError", "closed"), (None, None))]
    assert one(spark, *kinds) == ["timeout", "internal", "connection", "signing", "internal"]
    assert one(spark, text.context_destroyed(F.lit("x EXECUTION Context was destroyed")), text.context_destroyed(F.lit(None).cast("string"))) == [True, False]
    assert one(spark, *[text.http_success(F.lit(s).cast("int")) for s in (199, 200, 299, 300, None)]) == [False, True, True, False, False]


def test_targets(spark):
    base = F.lit("http://h.org/a/b/c?q#f")
    told = {"../y": "http://h.org/a/y", "./d/../e/.": "http://h.org/a/b/e/", "../../../z": "http://h.org/z", "": "http://h.org/a/b/c?q", "?r": "http://h.org/a/b/c?r", "//x.org/..": "http://x.org/", "mailto:a": "mailto:a"}
    assert one(spark, *[url.absolute(F.lit(h), base) for h in told]) == list(told.values())
    assert one(spark, *[url.is_web(F.lit(u)) for u in ("http://[bad", "http://[::1]:80/", "http://a b/", "http://u@h:8/", "http://h:x/", "ftp://h/")]) == [False, True, False, True, False, False]


def test_attributes_of_one_element(spark):
    html = "<IMG src=a data-src='b' SRCSET=\"c 1x,d 2x\"><video src=v poster=\"p?x=1&amp;y=2\"></video><video src=no></video><p data-srcset='e, ,f 3w'><script src=s></script><img src=\"\" alt=\"a>b\" data-lazy-src=g>"
    df = spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", None)], "page_id long, url string, html string")
    got = {r.page_id: r.candidates for r in links.responsive_candidates(df).collect()}
    assert got == {1: [f"http://h/{x}" for x in ("a", "b", "c", "d", "v", "p?x=1&y=2", "e", "f", "g")], 2: []}


def test_links_however_they_are_written(spark):
    html = "<a class=x href=/u?a=1&amp;b=2 rel=nofollow>one</a><a name=n>none</a><A\nHREF='../v'>t\nwo</A><a title='href=\"no\"' href=\"http://[bad\">bad</a>"
    df = spark.createDataFrame([(1, "http://h/p/q", html), (2, None, "<a href=x>y</a>"), (3, "http://h/", None)], "page_id long, url string, html string")
    got = [(r.page_id, r.pos, r.href, r.rel) for r in links.anchors(df).orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, "http://h/u?a=1&b=2", "nofollow"), (1, 1, "http://h/v", None), (1, 2, "http://[bad", None), (2, 0, None, None)]
    assert [r.href for r in links.outbound_links(df).orderBy("pos").collect()] == ["http://h/u?a=1&b=2", "http://h/v"]


def test_banner_names_are_exact(spark):
    rows = ["<div id=onetrust-banner-sdk>", "<div id='ONETRUST-banner-sdk'>", "<p class='qc-cmp2-container x'>", "text id=\"didomi-host\"", "<p data-id=usercentrics-root>", None]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, html string")
    got = {r.page_id: (r.framework, r.removed) for r in links.consent_banners(df).collect()}
    assert got == {0: ("OneTrust", ["#onetrust-banner-sdk"]), 1: (None, []), 2: ("Quantcast", [".qc-cmp2-container"]), 3: (None, []), 4: (None, []), 5: (None, [])}


def test_record_ids_are_uuids(spark):
    seed = ["a", "7/r/1/response", "é"]
    assert one(spark, *[records.uuid5(F.lit(s)) for s in seed]) == [str(uuid.uuid5(uuid.NAMESPACE_URL, s)) for s in seed]


def test_headers_prefer_what_went_over_the_wire(spark):
    kinds = ["requestWillBeSent", records.EXTRA_RESPONSE, "responseReceived", records.EXTRA_REQUEST, "loadingFinished", records.EXTRA_REQUEST]
    rows = [("r", k, kind, {"n": str(k)}) for k, kind in enumerate(kinds)] + [("s", 0, "requestWillBeSent", {"n": "s"}), ("t", 0, records.EXTRA_REQUEST, {"n": "t"})]
    df = spark.createDataFrame(rows, "request_id string, seq long, kind string, headers map<string,string>")
    got = {r.request_id: (r.request_headers, r.response_headers) for r in records.exchange_headers(df).collect()}
    assert got == {"r": ({"n": "3"}, {"n": "1"}), "s": ({"n": "s"}, None)}


def test_message_heads(spark):
    given = F.create_map(*[F.lit(x) for x in (":status", "200", "Content-Encoding", "br", "content-length", "7", "Set-Cookie", "a\nb")])
    heads = [records.head_text(F.lit("X"), records.stored_headers(given, F.lit(own), F.lit(n).cast("long"))) for own, n in ((True, 3), (True, None), (False, None))]
    tail = "Set-Cookie: a\r\nSet-Cookie: b\r\n"
    assert one(spark, *heads) == [f"X\r\n{tail}Content-Length: 3\r\n\r\n", f"X\r\n{tail}Content-Length: 0\r\n\r\n", f"X\r\nContent-Encoding: br\r\ncontent-length: 7\r\n{tail}\r\n"]
    sent = records.sent_headers(F.create_map(F.lit("HOST"), F.lit("x")), F.lit("http://h/"))
    assert one(spark, sent, records.sent_headers(F.lit(None).cast("map<string,string>"), F.lit("data:x"))) == [{"HOST": "x"}, {}]


def test_records_of_each_outcome(spark):
    kinds = "task_id long, request_id string, round long, opened_at long, url string, method string, resource_type string, outcome string, status int, status_text string, request_headers map<string,string>, response_headers map<string,string>, body_bytes long, skip_reason string, encoded_length long, error_text string, canceled boolean, blocked_reason string"
    row = lambda k, outcome, **x: tuple({**dict(zip([c.split()[0] for c in kinds.replace("map<string,string>", "m").split(", ")], [1, f"r{k}", 1, k, "http://h/p", None, None, outcome, 200, None, None, None, None, None, None, None, None, None])), **x}.values())
    outcomes = ["recorded", "recorded", "no-response", "failed", "incomplete", "blocked", "replaced", "redirected"]
    rows = [row(k, o) for k, o in enumerate(outcomes)]
    rows[0], rows[1] = row(0, "recorded", body_bytes=5), row(1, "recorded", skip_reason="too-large", encoded_length=9)
    df = spark.createDataFrame(rows, kinds)
    got = {}
    for r in records.exchange_records(df).orderBy("request_id", "pos").collect():
        got.setdefault(r.request_id, []).append(r)
    assert {k: [r.kind for r in v] for k, v in got.items()} == {"r0": ["response", "request"], "r1": ["response", "request", "metadata"], "r2": ["metadata"], "r3": ["metadata"], "r4": ["metadata"], "r7": ["response", "request"]}
    a, b = got["r0"]
    assert a.concurrent_to == b.record_id and b.concurrent_to == a.record_id and "Content-Length: 5" in a.head and b.head == "GET /p HTTP/1.1\r\nHost: h\r\n\r\n"
    assert got["r1"][0].truncated == "length" and got["r1"][2].refers_to == got["r1"][0].record_id and got["r1"][2].fields == {"truncated": "too-large", "encodedDataLength": "9"}
    assert got["r3"][0].fields == {"incomplete": "true", "reason": "loadingFailed", "canceled": "false", "status": "200"}
    assert got["r4"][0].fields["reason"] == "stop-while-pending" and got["r2"][0].fields["requestId"] == "r2"
    c = records.recorder_counters(df).first()
    assert (c.total_recorded, c.blocked, c.truncated_too_large, c.failed, c.incomplete, c.total_body_bytes, c.blocked_urls, c.truncated_too_large_urls) == (2, 1, 1, 2, 1, 5, ["http://h/p"], ["http://h/p"])
    assert records.exchange_records(df.limit(0)).count() == 0 and records.recorder_counters(df.limit(0)).count() == 0


def test_report_text(spark):
    rows = [(1, k, f"http://h/{k}", 304 if k == 9 else 200, "video/x" if k < 7 else "", 10, 10) for k in range(10)]
    report = recorder.task_report(recorder.body_budget(spark.createDataFrame(rows, EXCHANGE), 100, 20, ["video/"]))
    extra = report.withColumns({"blocked": F.lit(2), "blocked_urls": F.array(F.lit("b")), "failed": F.lit(3), "incomplete": F.lit(4)})
    assert recorder.trace_lines(extra).first().report.split("\n") == [
        "in archive 10 (with body 2 / without body 8)", "never archived 2 — blocked by pattern", "  b", "  … 1 more", "body omitted 8 — in the archive, not replayable", "  content-type 7",
        *[f"    http://h/{k}" for k in range(5)], "  task-cap 1 — raise --wacz-max-task-bytes", "    http://h/9", "bodyless 1 — seen only as 304, replay cannot recover", "  http://h/9", "failed 3  incomplete 4  body 0KB", "complete = false",
    ]


def test_banner_options(spark):
    given = [None, "null", "true", "false", '{}', '{"extraSelectors": [".x"], "heuristic": {"minZIndex": 5}, "failOnError": true}']
    df = spark.createDataFrame(list(enumerate(given)), "id int, s string").select("id", F.parse_json("s").alias("spec"))
    got = {r.id: r for r in links.dismiss_options(df).collect()}
    assert [got[k].active for k in range(6)] == [False, False, True, False, True, True]
    assert got[5].custom == [".x"] and tuple(got[5].heuristic) == (True, 0.3, 5) and got[5].fail_on_error and not got[2].fail_on_error


def test_navigation_and_membership(spark):
    lost = "Execution context was destroyed"
    df = spark.createDataFrame([("a", 0, lost), ("a", 1, None), ("b", 0, lost), ("b", 1, lost), ("b", 2, lost), ("c", 0, "other")], "op string, seq int, message string")
    assert {r.op: (r.attempts, r.given_up) for r in events.navigation_retries(df, "op").collect()} == {"a": (2, False), "b": (3, True), "c": (1, False)}
    m = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "a")], "g int, m string")
    assert {r.g: r.key for r in events.membership_key(m, "g", "m").collect()} == {1: "a,b", 2: "a"}


def _noise_pages(session, n):
    """Pages of 64,000 bytes that hardly shrink, in one partition."""
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.sha2(F.concat_ws("/", "id", k), 256)), "")
    return session.range(0, n, 1, 1).select(F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"), noise.alias("html"), F.lit(None).cast("timestamp").alias("captured_at"))


def _batch_bytes(df):
    """The largest batch that the step behind df is handed."""
    import pyarrow as pa

    def sizes(parts):
        for b in parts:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    return df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_archives_pass_in_small_batches(spark):
    """Whatever the number and the size of pages: a session of its own has Spark's settings, 10000 rows of any size."""
    pages = _noise_pages(spark.newSession(), 500)
    archives = archive.page_packages(pages, packages=False)
    payloads = archive.read_warcs(archives)
    assert _batch_bytes(archives) < 10 << 20 and _batch_bytes(payloads) < 10 << 20
    left = payloads.withColumn("payload", F.col("payload").cast("string")).exceptAll(pages.select("page_id", "url", F.col("html").alias("payload")))
    assert payloads.count() == 500 and left.count() == 0


def test_rows_are_handed_on_by_their_bytes():
    import pyarrow as pa

    from captureq.sources.batches import BATCH_BYTES, BATCH_ROWS, batches_of, rows_of

    kinds = pa.schema({"n": pa.int64(), "b": pa.binary()})
    rows = [(1, None), (None, b"x" * (BATCH_BYTES + 1)), (3, b""), *[(k, b"y") for k in range(BATCH_ROWS)]]
    got = list(batches_of(iter(rows), kinds))
    assert [b.num_rows for b in got] == [2, BATCH_ROWS, 1] and [r for b in got for r in rows_of(b)] == rows
    assert list(batches_of([], kinds)) == []


def test_packages_pass_in_small_batches(spark):
    pages = _noise_pages(spark.newSession(), 500)
    packages = archive.page_packages(pages)
    read = archive.read_packages(packages)
    assert _batch_bytes(packages) < 10 << 20 and _batch_bytes(read) < 10 << 20
    got = read.select("page_id", "url", "title", "status", F.col("payload").cast("string").alias("html"))
    assert got.count() == 500 and got.exceptAll(pages.select("page_id", "url", F.lit("").alias("title"), F.lit(200).alias("status"), "html")).count() == 0
