"""Event files as a stream: every event once, over restarts, growing files and ranges that cut lines."""

import io
import json

import pytest
from pyspark.sql import functions as F

from captureq.streaming import recorder, source


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 100])
def test_ranges_share_out_every_line(size, monkeypatch):
    monkeypatch.setattr(source, "BLOCK", 4)
    data = b"ab\n\ncdefg\nh\n" + "é\n".encode() + b"open"
    got = [x for a in range(0, len(data), size) for x in source.lines_between(io.BytesIO(data), a, min(a + size, len(data)))]
    assert got == [(0, b"ab"), (3, b""), (4, b"cdefg"), (10, b"h"), (12, "é".encode())]


def run(spark, tmp_path, range_bytes=50):
    stream = source.stream_lines(spark, str(tmp_path / "in"), range_bytes)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.file, r.offset, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_restarts_neither_lose_nor_repeat(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda name, text: (folder / name).open("a").write(text)
    whole = lambda: sorted((p.name, o, t) for p in folder.glob("[!_.]*") for o, t in offsets(p.read_bytes()))

    def offsets(data):
        at = 0
        for line in data.split(b"\n")[:-1]:
            yield at, line.decode()
            at += len(line) + 1

    write("0001", "".join(f"line {k} {'x' * (k % 90)}\n" for k in range(60)))
    write("_ignored", "no\n")
    assert run(spark, tmp_path) == whole()
    assert run(spark, tmp_path) == whole()  # nothing new
    write("0001", "grown\nnot ended")
    assert run(spark, tmp_path) == whole()
    write("0001", " yet\n")
    write("0002", "".join(f"two {k}\n" for k in range(30)))
    write("0003", "")
    assert run(spark, tmp_path) == whole()
    write("0003", "last\n")
    got = run(spark, tmp_path, 7)
    assert got == whole() and ("0001", max(o for f, o, _ in got if f == "0001"), "not ended yet") in got and len(got) == 93


def test_no_folder_yet(spark, tmp_path):
    reader = source._Reader(str(tmp_path / "none"), 10)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


def lines():
    one = lambda seq, method, body=None, b64=None, **params: json.dumps({"taskId": 1, "seq": seq, "at": f"2026-01-01T00:00:0{seq}Z", "method": f"Network.{method}", "params": {"requestId": "r", **params}, **({"body": body} if body else {}), **({"base64Encoded": b64} if b64 else {})})
    return [
        one(0, "requestWillBeSent", type="Document", request={"url": "http://h/a", "method": "POST", "headers": {"A": "1"}, "postData": "q"}),
        one(1, "requestWillBeSent", request={"url": "http://h/b", "method": "GET", "headers": {}}, redirectResponse={"status": 301, "statusText": "Moved", "headers": {}}),
        one(2, "requestWillBeSentExtraInfo", headers={"A": "2"}),
        one(3, "responseReceived", response={"status": 200, "statusText": "", "mimeType": "text/html", "headers": {"B": "1"}, "remoteIPAddress": "10.0.0.1"}),
        one(4, "responseReceivedExtraInfo", headers={"B": "2"}),
        one(5, "dataReceived", dataLength=3),
        one(6, "loadingFinished", body="aMOp", b64=True, encodedDataLength=12.0),
        "no json", "", "[1]", '{"method": 5}',
    ]


def test_lines_become_events(spark):
    df = source.network_events(spark.createDataFrame([(t,) for t in [*lines(), None]], "value string"))
    assert [f"{f.name} {f.dataType.simpleString()}".replace("bigint", "long") for f in df.schema.fields][:-1] == [x if "map" not in x else "headers map<string,string>" for x in recorder.EVENT.replace("map<string,string>", "map").split(", ")]
    rows = df.collect()
    assert [r.kind for r in rows if r._bad is None and r.seq is not None] == ["requestWillBeSent", "redirect", "requestWillBeSentExtraInfo", "responseReceived", "responseReceivedExtraInfo", "dataReceived", "loadingFinished"]
    assert sorted(r._bad for r in rows if r._bad is not None)[:2] == ["", ""] and {"no json", "[1]"} <= {r._bad for r in rows}
    got = recorder.settle(df.filter("_bad is null and seq is not null")).orderBy("opened_at").collect()
    assert [(r.url, r.outcome, r.status, r.request_headers, r.response_headers, r.body and bytes(r.body).decode(), r.ip) for r in got] == [
        ("http://h/a", "redirected", 301, {"A": "1"}, None, None, None), ("http://h/b", "recorded", 200, {"A": "2"}, {"B": "2"}, "hé", "10.0.0.1"),
    ]


def test_from_files_to_settled_exchanges(spark, tmp_path):
    """Source, parser and keyed state together, the files coming one after another."""
    (tmp_path / "in").mkdir()
    for part in (0, 1):
        for k, t in list(enumerate(lines()))[part * 4 : part * 4 + 4 if part == 0 else 7]:
            with (tmp_path / "in" / f"f{part}").open("a") as f:
                f.write(t + "\n")
        stream = recorder.settle_stream(source.network_events(source.stream_lines(spark, str(tmp_path / "in"), 100)).filter("_bad is null"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("opened_at").collect()
    assert [(r.url, r.outcome, r.body_bytes) for r in got] == [("http://h/a", "redirected", None), ("http://h/b", "recorded", 3)]
