"""Stores, probes, manifests, signatures, source regions and the bucketed lookup."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from captureq.operators import replay
from captureq.sources import sinks


def test_store_and_probe(spark, tmp_path):
    store = sinks.HadoopStore(spark, f"file://{tmp_path}/box")
    waits = []

    def appear(seconds):
        waits.append(seconds)
        if len(waits) == 2:
            (tmp_path / "box").mkdir()

    store.probe(sleep=appear)
    assert waits == [1.0, 1.0] and store.put("a.bin", b"\x00\xff") == f"file://{tmp_path}/box/a.bin"
    assert (tmp_path / "box" / "a.bin").read_bytes() == b"\x00\xff"
    with pytest.raises(FileNotFoundError):
        sinks.HadoopStore(spark, f"file://{tmp_path}/none").probe(tries=2, sleep=waits.append)


def test_uris(spark):
    uri = lambda p: sinks.object_uri(F.lit("b"), F.lit(p).cast("string"), F.lit("n"))
    assert list(spark.range(1).select(uri("/x/y/"), uri(""), uri(None)).first()) == ["s3://b/x/y/n", "s3://b/n", "s3://b/n"]


def test_manifests(spark, tmp_path):
    df = spark.createDataFrame([("7_c", '{"status":"success"}'), ("8", '{"status":"failed"}'), ("a: é%", None)], "filename string, report string")
    folder = tmp_path / "m"
    sink = sinks.ManifestSink(str(folder))
    assert sink.record(df) is None and sink.record(df.filter("filename = '8'").withColumn("report", F.lit("new"))) is None
    assert {p.name: p.read_text() for p in folder.iterdir() if p.name != "_SUCCESS"} == {"7_c.result.json": '{"status":"success"}', "8.result.json": "new", "a: é%.result.json": ""}
    (tmp_path / "file").write_text("x")
    assert sinks.ManifestSink(str(tmp_path / "file" / "x")).record(df)
    # A name that leaves the folder is refused, and nothing of it is written.
    assert "../x" in sink.record(spark.createDataFrame([("../x", "r")], "filename string, report string"))
    assert not (tmp_path / "x.result.json").exists()


def test_manifests_of_a_stream(spark, tmp_path):
    """A batch that is written again, as after a lost driver, leaves what it left before."""
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(f"t{k}", f"report {k}") for k in range(40)], "filename string, report string").repartition(4).write.json(str(src))
    sink = sinks.ManifestSink(str(out))
    run = lambda check: spark.readStream.schema("filename string, report string").option("maxFilesPerTrigger", 1).json(str(src)).writeStream.foreachBatch(sink.batch).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
    run("c1")
    first = {p.name: (p.read_text(), p.stat().st_mtime_ns) for p in out.glob("*.result.json")}
    assert {n: t for n, (t, _) in first.items()} == {f"t{k}.result.json": f"report {k}" for k in range(40)}
    run("c2")  # a new checkpoint: every batch comes again, and the ledger knows it
    assert {p.name: (p.read_text(), p.stat().st_mtime_ns) for p in out.glob("*.result.json")} == first
    sink.batch(spark.createDataFrame([("t1", "late")], "filename string, report string"), 99)
    assert (out / "t1.result.json").read_text() == "late" and len(list(out.glob("*.result.json"))) == 40


def test_store_of_many(spark, tmp_path):
    df = spark.range(30).select(F.format_string("d%d/f%d.bin", F.col("id") % 3, "id").alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary").alias("data"), F.lit(1).alias("part"))
    sinks.HadoopStore(spark, str(tmp_path / "s")).put_all(df)
    assert {str(p.relative_to(tmp_path / "s")): len(p.read_bytes()) for p in (tmp_path / "s").glob("*/*.bin")} == {f"d{k % 3}/f{k}.bin": k for k in range(30)}
    assert not list((tmp_path / "s").glob("_temporary*"))


def test_signatures(spark):
    p = spark.createDataFrame([(1, True), (2, True), (3, False)], "page_id int, require_signature boolean")
    s = spark.createDataFrame([(1, b"s", None), (2, None, "timeout")], "page_id int, signature binary, error string")
    assert {r.page_id: (r.signature, r.error) for r in sinks.signed(p, s).collect()} == {1: (b"s", None), 2: (None, "signing: timeout"), 3: (None, None)}


def test_regions(spark):
    text = "a\n  // #region one\n  x\n    y\n  // #endregion\nb\n# #region two\n# #endregion\n"
    df = spark.createDataFrame([("p", text), ("q", None), ("r", "none")], "path string, text string")
    assert [tuple(r) for r in sinks.regions(df).collect()] == [("p", "one", "x\n  y"), ("p", "two", "")]
    names = spark.createDataFrame([("b",), ("\u00e4",), ("a",), ("B",)], "n string")
    assert [r.n for r in sinks.in_locale_order(names, "n").collect()] == ["a", "\u00e4", "b", "B"]


def test_nearest_by_buckets(spark):
    """Every bucket width finds what a look at all pairs finds, ties included."""
    rng = random.Random(3)
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda: t0 + datetime.timedelta(hours=rng.randint(0, 400))
    asked = [(k, rng.choice("abcd"), at()) for k in range(150)]
    index = [(rng.choice("abc"), at(), k) for k in range(60)]
    want = {}
    for i, key, t in asked:
        near = sorted((abs((t - u).total_seconds()) * 1000, u, r) for k, u, r in index if k == key)
        want[i] = (near[0][2], int(near[0][0])) if near else (None, None)
    a = spark.createDataFrame(asked, "id long, key string, at timestamp")
    b = spark.createDataFrame(index, "key string, at timestamp, ref long")
    for bucket in (3600, 86_400, 10**9):
        assert {r.id: (r.ref, r.gap_ms) for r in replay.nearest(a, b, bucket=bucket).collect()} == want
