"""Golden values and truth tables of the capture operators."""

import json

import pytest
from pyspark.sql import functions as F

from captureq.functions import digest, text, url
from captureq.operators import behaviors, events, links, recorder, replay, tasks
from captureq.sources import archive, inputs
from captureq.streaming import exchanges as ex


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_surt_and_time(spark):
    u = [F.lit(x) for x in ("https://www.Example.com/a/b?q=1", "not a url", "data:text/plain,hello", "https://user@a.b:8080#x")]
    assert one(spark, *[url.surt(x) for x in u]) == ["com,example,www)/a/b?q=1", "not a url", ")text/plain,hello", "b,a)/"]
    assert one(spark, url.cdx_timestamp(F.lit("2026-07-26T12:34:56.789Z"))) == ["20260726123456"]


def test_digests(spark):
    e = F.lit(b"")
    assert one(spark, digest.sha256_base32(e), digest.sha1_base32(e)) == ["sha256:" + digest.EMPTY_SHA256, "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"]


def test_names(spark):
    got = one(spark, *[text.name_error(F.lit(x)) for x in ("ok", "", "a_b", "a b", "x" * 101)], text.artifact_name(F.lit(7), F.lit("c"), F.array(F.lit("a"), F.lit("b")), "png"))
    assert got[0] is None and "empty" in got[1] and "invalid" in got[2] and "whitespace" in got[3] and "exceeds" in got[4] and got[5] == "7_c_a-b.png"


def test_text(spark):
    assert one(spark, text.human_bytes(F.lit(2 * 1048576)), text.human_bytes(F.lit(1536)), text.mask_key(F.lit("12345678")), text.mask_key(F.lit("123456789")), text.scale_dims(F.lit("http://a/b/10x21bb.png"), 2.0), text.scale_dims(F.lit("x"), 2.0)) == ["2.0MB", "2KB", "***", "1234***6789", "http://a/b/20x42bb.png", None]
    assert one(spark, text.recorder_reason(F.lit(299), F.lit("")), text.http_error_message(F.lit(404), F.lit("")), text.http_error_message(F.lit(299), F.lit("")), text.http_version(F.lit("h2"))) == ["OK", "HTTP 404: Not Found", "HTTP 299", "HTTP/2.0"]


def test_globs_and_fuzzy(spark):
    g = lambda s: url.matches_any(F.lit(s), recorder.BLOCK_GLOBS)
    assert one(spark, g("https://www.google-analytics.com/x"), g("https://example.com/"), url.fuzzy_key(F.lit("http://a/?_=1&b=2#f"), archive.FUZZY_PARAMS)) == [True, False, "http://a/?b=2"]


@pytest.mark.parametrize("bodies,limit,reasons", [([8, 8], 10, [None, "task-cap"]), ([8, 5, 2], 10, [None, "task-cap", None]), ([10, 1], 10, [None, "task-cap"])])
def test_budget(spark, bodies, limit, reasons):
    rows = [(1, i, f"u{i}", 200, "text/html", b, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "task_id long, seq long, url string, status int, mime string, body_bytes long, declared_bytes long")
    assert [r.skip_reason for r in recorder.body_budget(df, 100, limit).orderBy("seq").collect()] == reasons


@pytest.mark.parametrize("statuses,reason,complete,n304,ncut", [([304], None, False, 1, 0), ([200, 304], None, True, 0, 0), ([302, 204, 200], None, True, 0, 0), ([200], "too-large", False, 0, 1), ([200], "task-cap", False, 0, 1), ([200], "content-type", True, 0, 0)])
def test_completeness(spark, statuses, reason, complete, n304, ncut):
    df = spark.createDataFrame([(1, "u", s, reason, 1) for s in statuses], "task_id long, url string, status int, skip_reason string, body_bytes long")
    r = recorder.completeness(df).first()
    assert (r.complete, r.bodyless_n, r.truncated_n) == (complete, n304, ncut)


def test_links(spark):
    html = '<a href="/x" rel="nofollow"> Hi <b>there</b></a><a href="mailto:q">m</a><a href="/x">again</a><a href="http://[bad">b</a>'
    p = spark.createDataFrame([(1, "https://h.example/a/b", html)], "page_id long, url string, html string")
    got = links.outbound_links(p).orderBy("pos").collect()
    assert [(r.href, r.text, r.rel) for r in got] == [("https://h.example/x", "Hi there", "nofollow")]
    assert [r.href for r in links.anchors(p).orderBy("pos").collect()] == ["https://h.example/x", "mailto:q", "https://h.example/x", "http://[bad"]
    css = one(spark, links.stylesheet_urls(F.lit("a{b:url('x.png')} c{d:url(data:zz)} e{f:url(\"/y\")}"), F.lit("http://h/s/t.css")))
    assert css == [["http://h/s/x.png", "http://h/y"]]
    html = '<img src="a.png" srcset="b.png 1x, c.png 2x"><div id="sp_message_container_9" class="x cc-window">'
    p = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert links.responsive_candidates(p).first().candidates == ["http://h/a.png", "http://h/b.png", "http://h/c.png"]
    r = links.consent_banners(p).first()
    assert (r.framework, r.removed) == ("Sourcepoint", ['[id^="sp_message_container"]', ".cc-window"])
    assert links.consent_banners(p, ["Sourcepoint"], [("Own", ".x")]).first().framework == "InsitesCookieConsent"


def test_request_resolution(spark):
    rows = [(" ", ["a"], "", (True, False), None), ("u", [" a ", ""], "", (True, False), None), ("u", [], "", (False, False), None), ("u", [], "", (True, False), True), ("u", ["a_b"], "", (True, True), None), ("u", [], "c d", (True, True), None)]
    df = spark.createDataFrame(rows, "url string, labels array<string>, correlation_id string, formats struct<png:boolean,wacz:boolean>, signing boolean")
    got = [r.error for r in tasks.resolve_request(df).collect()]
    assert got[0] == "url is required" and got[1] is None and "format" in got[2] and "signing requires" in got[3] and "invalid" in got[4] and "whitespace" in got[5]
    assert "signs every" in tasks.resolve_request(spark.createDataFrame([("u", [], "", (True, True), False)], df.schema), "required").first().error


def test_cache_and_counters(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, s long, v string")
    assert [(r.k, r.v) for r in tasks.result_cache(df, "k", "s", "v", 1).collect()] == [("b", "y")]
    assert tasks.result_cache(df, "k", "s", "v", 0).count() == 0


def test_coverage_and_tls(spark):
    df = spark.createDataFrame([(1, [("autoscroll", 40, True)]), (2, [("autoscroll", None, True)]), (3, [])], "id int, ran array<struct<id:string,steps:long,exhausted:boolean>>")
    got = {r.id: r.coverage for r in behaviors.coverage(df, 800).collect()}
    assert got[1].scrolled_px == 32000 and got[2] is None and got[3] is None
    o = spark.createDataFrame([("https://h/", "h", 1, None), ("https://h/", "h", 2, "d2"), ("https://h/", "h", 3, "d3"), ("https://g/", "g", 4, None), ("http://x/", "x", 5, "d")], "url string, host string, seq long, details string")
    assert {r.host: r.details for r in behaviors.tls_hosts(o).collect()} == {"h": "d2", "g": None}
    c = spark.createDataFrame([("a", 0, "leaf", "mid"), ("a", 1, "mid", "root"), ("b", 0, "leaf", "mid"), ("b", 1, "other", "root")], "chain string, pos int, subject string, issuer string")
    assert {r.chain: r.reaches for r in behaviors.chain_reaches(c, ["root"]).collect()} == {"a": True, "b": False}
    # Out of order, cross-signed, in a loop, cut off after so many steps, trusted itself, nulls.
    links = {"o": "leaf>mid root>root mid>root", "x": "leaf>mid mid>other mid>root", "l": "leaf>mid mid>leaf", "d": " ".join(f"{k}>{k + 1}" for k in range(12)) + " 12>root", "t": "root>zzz", "n": "leaf>-"}
    rows = [(c, k, *[None if x == "-" else x for x in t.split(">")], 1) for c, s in links.items() for k, t in enumerate(s.split())]
    c = spark.createDataFrame([*rows, rows[0], (None, None, "root", None, 1)], "chain string, pos int, subject string, issuer string, c int")
    assert {r.chain: r.reaches for r in behaviors.issuers_reach(c, ["root"]).collect()} == {"o": True, "x": True, "l": False, "d": False, "t": True, "n": False, None: True}
    v = behaviors.verdict(spark.createDataFrame([(1, True, False, None, True)], "id int, hash boolean, signature boolean, domain boolean, timestamp boolean")).first()
    assert (v.hash, v.signature, v.domain, v.reason) == ("ok", "failed", "skipped", "signature")


def test_archive_bytes():
    block = archive.http_response("HTTP/1.1", 299, "", [("A", "b")], b"WARC/1.1\r\n\r\n")
    assert block.startswith(b"HTTP/1.1 299\r\nA: b\r\n\r\n")
    recs = [archive.warcinfo("<i>", "d", "f", {"software": "s"}), archive.http_record("response", "<r>", "d", "u", block, payload=b"x", truncated="length"), archive.metadata("<m>", "d", {"reason": "too-large"}, refers_to="<r>")]
    data, places = archive.write_archive(recs)
    assert archive.read_archive(data) == recs and [archive.read_archive(data[a : a + n])[0] for a, n in places] == recs
    assert [k for k, _ in recs[1].headers][-2:] == ["WARC-Payload-Digest", "WARC-Truncated"]
    assert archive.metadata_field(recs[2].body.decode(), "reason") == "too-large"
    assert archive.response_headers({":status": "200", "Content-Encoding": "br", "X": "y"}, True) == {"X": "y"} and archive.request_headers({"a": "b"}, "h")["Host"] == "h"
    assert archive.header_list({"a": "1\n2"}) == [("a", "1"), ("a", "2")]
    page = {"id": "1", "url": "u", "ts": "t", "title": ""}
    assert set(archive.unpack(archive.pack(data, "", page))) == {archive.WARC_ENTRY, archive.PAGES_ENTRY, archive.INDEX_ENTRY, archive.FUZZY_ENTRY, archive.PACKAGE_ENTRY}
    assert archive.DIGEST_ENTRY in archive.unpack(archive.pack(data, "", page, signature=b"{}"))
    with pytest.raises(archive.SigningRequired):
        archive.pack(data, "", page, require_signature=True)
    assert json.loads(archive.fuzzy_json([])) == {"version": 1, "rules": []}


def test_inputs(spark, tmp_path):
    assert [(r.labels, r.url) for r in inputs.batch_source(spark, '[{"labels": [1, true, "a"], "url": "u"}, {"labels": [], "url": "v"}]', 1).collect()][0][1] == "u"
    assert inputs.batch_source(spark, "").count() == 0
    with pytest.raises(ValueError):
        inputs.parse_entries([{"labels": "x", "url": "u"}])
    (tmp_path / "v1" / "h").mkdir(parents=True)
    (tmp_path / "v1" / "h" / "a.js").write_text("1")
    (tmp_path / "v1" / "h" / "notes.txt").write_text("1")
    (tmp_path / "v1" / "loose.js").write_text("1")
    assert [(r.host, r.behavior) for r in inputs.behavior_folder(spark, str(tmp_path), "v1").collect()] == [("h", "a.js")]
    assert inputs.behavior_folder(spark, str(tmp_path), "none").count() == 0
    assert inputs.resolve(None, {"X": "a, b"}, "X", []) == ["a", "b"] and inputs.resolve(3, {"X": "1"}, "X", 2) == 3 and inputs.resolve(None, {"X": "0"}, "X", True) is False
    (tmp_path / "i.cdxj").write_text('com,a)/ 2024 {"url":"http://a/","status":"200"}\n\n')
    r = inputs.read_cdxj(spark, str(tmp_path / "i.cdxj")).first()
    assert (r.surt, r.ts, r.url, r.status) == ("com,a)/", "2024", "http://a/", "200")
    seen = []

    def bad(df):
        raise ValueError("no")

    assert inputs.write_results(spark.range(2), [lambda df: seen.append(df.count()), bad, lambda df: seen.append(df.count())]) == [("bad", "no")] and seen == [2, 2]


def ev(seq, kind, rid="r", u="http://a/", status=200, mime="text/html", size=0, body=0, task=1):
    return {"task_id": task, "seq": seq, "kind": kind, "request_id": rid, "url": u, "status": status, "mime": mime, "encoded_length": size, "body_bytes": body}


def fold(rows, **o):
    state = {"pending": {}, "total": 0}
    out = [x for e in rows for x in ex.step(state, e, ex.Options(**o))]
    return [(x["outcome"], x["skip_reason"]) for x in out], ex.drain(1, state)


def test_fold():
    pair = lambda k, r, **x: [ev(k, "requestWillBeSent", r), ev(k + 1, "responseReceived", r), ev(k + 2, "loadingFinished", r, **x)]
    assert fold(pair(0, "a", body=8) + pair(3, "b", body=8), max_task=10)[0] == [("recorded", None), ("omitted", "task-cap")]
    assert fold(pair(0, "a", size=1000), max_response=100)[0] == [("omitted", "too-large")]
    assert fold(pair(0, "a"), skip_mime=["text/"])[0] == [("omitted", "content-type")]
    assert fold(pair(0, "a", size=1000), skip_mime=["text/"], max_response=100)[0] == [("omitted", "too-large")]
    got, left = fold(pair(0, "a"), block=["*://a/*"])
    assert got == [("blocked", None)] and left == []
    assert fold([ev(0, "requestWillBeSent")], block=["*"])[1][0]["outcome"] == "incomplete"
    assert fold([ev(0, "requestWillBeSent"), ev(1, "loadingFinished")])[0] == [("no-response", None)]
    assert fold([ev(0, "responseReceived"), ev(1, "loadingFailed")])[0] == []
    assert fold([ev(0, "requestWillBeSent"), ev(1, "redirect", status=302), ev(2, "loadingFailed")])[0] == [("recorded", None), ("failed", None)]
    assert [x["request_id"] for x in fold([ev(k, "requestWillBeSent", f"r{k}") for k in range(3)], max_pending=2)[1]] == ["r1", "r2"]


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["requestWillBeSent", "responseReceived", "loadingFinished", "loadingFailed", "redirect"]
    rows = [ev(k, kinds[(k * 7 + k // 5) % 5], f"r{k % 6}", f"http://a/{k % 6}", body=k, task=k % 3) for k in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ex.EVENT)
    df.filter("seq < 150").coalesce(1).write.parquet(str(tmp_path / "in"))
    o = ex.Options(max_task=2000)
    want = sorted(map(tuple, ex.assemble(df, o).filter("outcome <> 'incomplete'").collect()), key=repr)
    stream = ex.assemble_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), o)

    def go():
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    go()
    df.filter("seq >= 150").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    got = sorted(map(tuple, spark.read.schema(ex.OUTCOME).parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == want


def test_nearest_and_flips(spark):
    asked = spark.sql("select 1L id, 'k' key, timestamp_ntz'2024-01-01 00:00:10' at union all select 2L, 'z', timestamp_ntz'2024-01-01 00:00:00'")
    index = spark.sql("select 'k' key, timestamp_ntz'2024-01-01 00:00:00' at, 5L ref union all select 'k', timestamp_ntz'2024-01-01 00:00:20', 4L union all select 'k', timestamp_ntz'2024-01-01 00:00:00', 6L")
    assert {r.id: (r.ref, r.gap_ms) for r in replay.nearest(asked, index).collect()} == {1: (5, 10000), 2: (None, None)}
    f = events.flips(spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, True), (1, 4, None)], "k int, s int, v boolean"), "k", "s", "v")
    assert sorted(r.s for r in f.collect()) == [1, 3, 4]
