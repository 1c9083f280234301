"""The recorder as a stream: equal to the batch in any split, and the batch equal to the declarative one."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from captureq.operators import archives, events, records
from captureq.streaming import recorder
from captureq.streaming.exchanges import Options

OUT = ["task_id", "request_id", "round", "opened_at", "settled_at", "captured_at", "url", "method", "outcome", "status", "request_headers", "response_headers", "body", "body_bytes", "skip_reason", "encoded_length", "error_text", "canceled"]
KINDS = ["requestWillBeSent", "requestWillBeSentExtraInfo", "responseReceived", "responseReceivedExtraInfo", "loadingFinished", "loadingFailed", "redirect", "dataReceived"]
T0 = datetime.datetime(2026, 1, 1)


def made(spark, seed, n=500, tasks=4, ids=9):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind, rid = rng.choice(KINDS[:6] * 3 + KINDS[6:]), rng.randrange(ids)
        head = {"h": f"{kind[:3]}{k}"} if "Extra" in kind or kind in ("requestWillBeSent", "responseReceived", "redirect") else None
        body = bytearray(b"x" * rng.randrange(60)) if kind == "loadingFinished" and rng.random() < 0.8 else None
        rows.append((
            rng.randrange(tasks), k, T0 + datetime.timedelta(seconds=k), kind, f"r{rid}", f"https://{'ads.' if rid == 3 else ''}h.example/{rid}", "POST" if rid % 2 else "GET", None, head, 200 if kind == "responseReceived" else None, "",
            rng.choice(["text/html", "video/mp4", None]), None, rng.choice([None, 10, 70]) if kind.startswith("loading") else None, body, bytearray(b"q") if rid % 2 else None, "net::ERR", None, None,
        ))
    return spark.createDataFrame(rows, recorder.EVENT)


def rows_of(df):
    return sorted((repr(tuple(r)) for r in df.select(OUT).collect()))


LIMITS = Options(block=["https://ads.*"], skip_mime=["video/"], max_response=50, max_task=300, max_pending=5)


@pytest.mark.parametrize("options,per_file", [(None, 37), (LIMITS, 1000), (LIMITS, 11), (LIMITS, 90)])
def test_stream_equals_batch(spark, tmp_path, options, per_file):
    """Rows of the stream, over micro-batches of any size, are those of the batch but for what is still pending."""
    n = 60 if per_file == 11 else 500
    df = made(spark, per_file, n).cache()
    schema = df.schema
    for a in range(0, n, per_file):
        df.filter(F.col("seq").between(a, a + per_file - 1)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{a:06d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream = recorder.settle_stream(source, options)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = rows_of(recorder.settle(df, options).filter("outcome <> 'incomplete'"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) > 5
    df.unpersist()


def test_batch_equals_declarative_pairing(spark):
    """Without limits the outcomes are those of the windows over the event log, and so are the headers."""
    df = made(spark, 3, 900, tasks=1, ids=40)
    got = recorder.settle(df).select("request_id", "round", "opened_at", "outcome")
    want = events.paired_exchanges(df).select("request_id", "round", "opened_at", "outcome")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    heads = records.exchange_headers(df).select("request_id", "round", "request_headers", "response_headers")
    mine = recorder.settle(df).select("request_id", "round", "request_headers", "response_headers")
    assert sorted(map(repr, map(tuple, mine.collect()))) == sorted(map(repr, map(tuple, heads.collect())))


def test_settled_exchanges_become_archives(spark):
    places = archives.placed(archives.warc_records(recorder.settle(made(spark, 5), LIMITS)))
    told = {r.kind: r.n for r in places.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert told["response"] == told["request"] > 5 and told["warcinfo"] == 4 and told["metadata"] > 5


def step_all(script, options):
    r, out = recorder.Recorder(1, recorder.Memory(), options), []
    names = [c.split()[0] for c in recorder.EVENT.split(", ")]
    for k, (kind, rid, more) in enumerate(script):
        out += list(r.step({**dict.fromkeys(names), "kind": kind, "request_id": rid, "seq": k, "url": f"http://h/{rid}", **more}))
    return r, [(x["request_id"], x["outcome"], x.get("skip_reason"), x.get("body_bytes")) for x in out]


def test_oldest_is_evicted_first(spark):
    """A known id that is asked for again goes to the end of the order; a blocked one keeps its place."""
    ask = [("requestWillBeSent", i, {}) for i in ("a", "b", "c")]
    end = [(k, i, {}) for i in ("a", "b", "c", "d") for k in ("responseReceived", "loadingFinished")]
    r, out = step_all([*ask, ("loadingFailed", "b", {}), ("requestWillBeSent", "a", {}), ("requestWillBeSent", "b", {}), ("requestWillBeSent", "d", {}), *end], Options(max_pending=3))
    assert out == [("b", "failed", None, None), ("a", "replaced", None, None), ("a", "recorded", None, None), ("b", "recorded", None, None), ("d", "recorded", None, None)]
    assert not r.store.every("pending") and not r.store.every("order") and r._count("open") == 0
    r, out = step_all([("requestWillBeSent", "a", {}), ("requestWillBeSent", "b", {}), ("requestWillBeSent", "a", {"url": "http://ad/"}), ("requestWillBeSent", "c", {}), *end], Options(max_pending=2, block=["http://ad/*"]))
    assert out == [("a", "blocked", None, None), ("b", "recorded", None, None), ("c", "recorded", None, None)]


def test_budget_over_requests_of_a_task(spark):
    one = lambda i, n, declared=None: [("requestWillBeSent", i, {}), ("responseReceived", i, {"status": 200}), ("loadingFinished", i, {"body": b"x" * n, "encoded_length": declared})]
    _, out = step_all([*one("a", 8), *one("b", 8), *one("c", 2), *one("d", 0), *one("e", 1, 99), ("loadingFinished", "z", {}), (None, "a", {}), ("requestWillBeSent", None, {})], Options(max_response=20, max_task=10))
    assert out == [("a", "recorded", None, 8), ("b", "recorded", "task-cap", None), ("c", "recorded", None, 2), ("d", "recorded", "task-cap", None), ("e", "recorded", "task-cap", None)]


def test_silent_tasks_are_drained(spark, tmp_path):
    df = made(spark, 9, 40, tasks=2)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = recorder.settle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), None, drain_after=500)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    want = rows_of(recorder.settle(df))
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if (tmp_path / "out").exists() and len(rows_of(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))) >= len(want):
                break
    finally:
        q.stop()
    assert rows_of(spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))) == want


def test_no_events(spark):
    assert recorder.settle(made(spark, 1).limit(0)).count() == 0
