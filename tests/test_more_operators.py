"""Requests, worker lifecycles, media, overlays and behaviours."""

import datetime
import json

from pyspark.sql import functions as F

from captureq.operators import links, requests, workers
from captureq.streaming import behaviors as run


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_requests(spark, tmp_path):
    rows = [{"url": "https://a/"}, {"url": "x", "viewport": {"width": 0, "height": 10}, "deviceScaleFactor": 4, "archiveMode": "both"}, {"url": "mailto:a", "operationDelayMs": 10000, "acceptLanguage": "é"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    df = requests.read_requests(spark, str(tmp_path / "r.json"))
    got = [r.e for r in df.select(requests.schema_errors(df).alias("e")).collect()]
    assert got[0] == "" and got[1].count("; ") == 3 and got[2].startswith("acceptLanguage") and "url" in got[3]
    assert one(spark, requests.is_uuid(F.lit("0" * 8 + "-0000-0000-0000-" + "0" * 12)), requests.is_date_time(F.lit("2026-01-02T03:04:05.678Z")), requests.is_date_time(F.lit("2026-01-02"))) == [True, True, False]
    assert one(spark, requests.problem(F.lit(409), F.lit("d")))[0].title == "Duplicate URL"


def test_resolution(spark):
    s = "struct<cookies:boolean,pageContext:boolean>"
    spec = F.struct(F.lit(False).alias("cookies"), F.lit(None).cast("boolean").alias("pageContext"))
    null = F.lit(None).cast("boolean")
    got = one(spark, requests.reset_state(spec, null, True, True), requests.reset_state(F.lit(None).cast(s), F.lit(True), False, False), requests.reset_state(F.lit(None).cast(s), null, False, True))
    assert [tuple(x) for x in got] == [(False, True), (True, True), (False, True)]
    m = lambda x: F.from_json(F.lit(json.dumps(x)), "map<string,map<string,string>>")
    assert one(spark, requests.behavior_options(m({"a": {"x": "1", "y": "2"}}), m({"a": {"x": "3"}, "b": {"z": "4"}}), F.array(F.lit("c")))) == [{"a": {"y": "2", "x": "3"}, "b": {"z": "4"}, "c": {}}]
    assert one(spark, requests.ws_url(F.lit("ws://h:9222/x"), F.lit("::1"), F.lit(None).cast("int")), requests.ws_url(F.lit("ws://h/x"), F.lit("1.2.3.4"), F.lit(80))) == ["ws://[::1]:9222/x", "ws://1.2.3.4:80/x"]
    assert one(spark, requests.device_ratios(F.lit("multipass"), F.lit(3))) == [[1.0, 2.0]]
    assert requests.with_defaults(spark.range(1), {"k": 5}).first().k == 5
    t = spark.createDataFrame([(1, "see X-a and X-b")], "id int, text string")
    assert [r.k for r in requests.missing_references(t, r"X-(\w)", spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b"]
    assert [r.k for r in requests.duplicate_ids(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), "k").collect()] == ["a"]


def test_lifecycles(spark):
    e = spark.createDataFrame([("c", 1, "initialize"), ("c", 2, "ready"), ("c", 3, "nonsense"), ("c", 4, "degrade"), ("d", 1, "ready")], "k string, s int, e string")
    assert {r.k: r.state for r in workers.follow(e, "k", "s", "e").collect()} == {"c": "degraded", "d": "created"}
    w = workers.operational(spark.createDataFrame([(0, "idle", None), (1, "error", "boom"), (2, "processing", None)], "index int, state string, last_error string")).first()
    assert (w.operational, w.all_healthy, [tuple(x) for x in w.failed]) == (2, False, [(1, "boom")])
    m = spark.createDataFrame([("a", None), ("b", "NXDOMAIN"), ("c", "SERVFAIL")], "host string, error string")
    assert sorted(r.host for r in workers.present_members(m).collect()) == ["a", "c"]
    p = spark.createDataFrame([("k", 0, 10), ("k", 5, 8), ("k", 9, 12), ("k", 20, 25)], "k string, start_ms long, end_ms long")
    assert workers.paced_ms(p, "k").first().paced_ms == 17
    c = spark.createDataFrame([("h", 0, 86400, ["a", "b"]), ("g", 0, 1, ["a", "b"])], "host string, valid_from long, valid_to long, chain array<string>")
    assert workers.distinct_chains(workers.certificate_times(c)).count() == 1


def test_media_and_overlays(spark):
    html = '<video src="a.mp4" poster="/p.png"><source src="a.mp4"><source src="b.webm"></video><audio><source src="//c/d.mp3"></audio> https://is1.mzstatic.com/x/10x20bb.png'
    p = spark.createDataFrame([(1, "http://h/d/", html)], "page_id long, url string, html string")
    assert [r.urls for r in links.media_urls(p).orderBy("pos").collect()] == [["http://h/d/a.mp4", "http://h/p.png", "http://h/d/b.webm"], ["http://c/d.mp3"]]
    found = one(spark, links.size_siblings(links.image_urls(F.lit(html), "mzstatic")))[0]
    assert found == ["https://is1.mzstatic.com/x/10x20bb.png", "https://is1.mzstatic.com/x/20x40bb.png", "https://is1.mzstatic.com/x/5x10bb.png"]
    e = spark.createDataFrame([(1, "body/a", "fixed", 2000, 90.0, 100.0, False), (1, "body/a/b", "fixed", 2000, 90.0, 100.0, False), (1, "body/c", "static", 2000, 90.0, 100.0, False), (1, "body/n", "sticky", 2000, 90.0, 100.0, True), (1, "body/s", "fixed", 2000, 9.0, 100.0, False)], "page_id long, path string, position string, z int, area double, viewport_area double, landmark boolean")
    assert [r.path for r in links.overlays(e, 1000, 0.5).collect()] == ["body/a"]
    assert len(one(spark, links.pem_blocks(F.lit("-----BEGIN CERTIFICATE-----\nA\n-----END CERTIFICATE-----\n" * 2)))[0]) == 2


class Bad:
    id = "bad"

    def is_match(self, html):
        return True

    def run(self, html, options):
        yield "x"
        raise ValueError("no")


def test_behaviors(spark, monkeypatch):
    monkeypatch.setitem(run.REGISTRY, "bad", Bad)
    got = run.run_all("<video><p><p>", ["bad", "autoplay", "unknown", "autoscroll", "autoplay"], {"autoscroll": {"maxSteps": 1}})
    assert [(g[0], g[1], g[2]) for g in got] == [("bad", 1, "ValueError: no"), ("autoplay", 1, None), ("autoscroll", 1, None)]
    run.register(spark)
    rows = spark.sql("SELECT * FROM run_behaviors('<p>', 'autoscroll', '{}')").collect()
    assert rows[0].behavior == "autoscroll" and json.loads(rows[0].decisions) == {"reachedBottom": True, "scrollSteps": 1}


def test_attempts_of_a_task_log(spark):
    """Retries keep the time at which the task was queued; an end of any kind begins a new run."""
    from captureq.operators import tasks

    flags = {"s": (True, False), "r": (False, True), "f": (False, False), "n": (None, None)}
    script = {1: "rrrrs", 2: "rfrs", 3: "s", None: "rn", 4: "rrrrrr"}
    rows = [(t, k, datetime.datetime(2026, 1, 1, 0, k), *flags[c], 0) for t, s in script.items() for k, c in enumerate(s)]
    df = spark.createDataFrame(rows, "task_id long, seq long, at timestamp, succeeded boolean, retryable boolean, attempt int")
    got = {}
    for r in tasks.attempts(df).orderBy("seq").collect():
        got.setdefault(r.task_id, []).append((r.attempt, r.enqueued_at.minute, r.branch, r.retry_n, r.exhausted_n, r.failed_n))
    assert got[1] == [(0, 0, "retry", 1, 0, 0), (1, 0, "retry", 2, 0, 0), (2, 0, "exhausted", 2, 1, 0), (0, 3, "retry", 3, 1, 0), (1, 3, "success", 3, 1, 0)]
    assert got[2] == [(0, 0, "retry", 1, 0, 0), (1, 0, "failed", 1, 0, 1), (0, 2, "retry", 2, 0, 1), (1, 2, "success", 2, 0, 1)]
    assert got[3] == [(0, 0, "success", 0, 0, 0)] and got[None][1][2] == "failed" and [x[2] for x in got[4]] == ["retry", "retry", "exhausted"] * 2
    assert tasks.attempts(df.limit(0)).count() == 0
    waits = tasks.backoff(spark.createDataFrame([(0,), (3,), (70,), (None,)], "n int"), F.col("n"), 100, 1000)
    assert [r.delay_ms for r in waits.collect()] == [100, 800, 1000, None]


def test_validity_at_a_claimed_time(spark):
    from captureq.operators import behaviors

    day = lambda n: None if n is None else datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)
    periods = [("a", 10, 20), ("a", 15, 18), ("a", 100, 101), ("b", 5, None), ("c", None, 9), (None, 0, 9), ("d", 0, 400), ("e", 0, None), ("e", 0, None)]
    asked = [(1, "a", 9), (2, "a", 10), (3, "a", 20), (4, "a", 21), (5, "a", 99), (6, "a", 101), (7, "b", 900), (8, "c", 5), (9, "z", 5), (10, None, 5), (11, "a", None), (12, "d", 300), (12, "d", 300), (None, "d", 500), (13, "e", 0), (14, None, None)]
    v = spark.createDataFrame([(c, day(a), day(b), 0) for c, a, b in periods], "cert string, valid_from timestamp, valid_to timestamp, id int")
    s = spark.createDataFrame([(i, c, day(t), "x") for i, c, t in asked], "id int, cert string, claimed_at timestamp, state string")
    want = [(1, "not-yet-valid"), (2, "ok"), (3, "ok"), (4, "expired"), (5, "expired"), (6, "ok"), (7, "ok"), (8, "unknown"), (9, "unknown"), (10, "unknown"), (11, "skipped"), (12, "ok"), (12, "ok"), (None, "expired"), (13, "ok"), (14, "skipped")]
    for bucket in (86_400, behaviors.VALIDITY_BUCKET):
        assert sorted(map(repr, map(tuple, behaviors.validity_at(s, v, bucket).collect()))) == sorted(map(repr, want))
    plan = behaviors.validity_at(s, v)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert behaviors.validity_at(s.limit(0), v).count() == 0 and {r.state for r in behaviors.validity_at(s, v.limit(0)).collect()} == {"unknown", "skipped"}
