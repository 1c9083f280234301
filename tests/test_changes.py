"""Changes in a stream equal those of the batch, in any split; failed refreshes keep what was known."""

import random

import pytest
from pyspark.sql import functions as F

from captureq.operators import events
from captureq.streaming import changes


def streamed(spark, tmp_path, df, per_file, make):
    n = df.count()
    for a in range(0, n, per_file):
        df.filter(F.col("seq").between(a, a + per_file - 1)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{a:06d}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    make(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


@pytest.mark.parametrize("per_file", [13, 400])
def test_stream_equals_batch_flips(spark, tmp_path, per_file):
    rng = random.Random(per_file)
    n = 400 if per_file == 400 else 90
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), k, rng.choice([1, 1, 2, None]), rng.choice([True, False, None, False])) for k in range(n)], "key string, seq long, value int, failed boolean").cache()
    got = streamed(spark, tmp_path, df, per_file, lambda s: changes.flips_stream(s, "key", "seq", "value", "failed"))
    good = df.filter(~F.coalesce("failed", F.lit(False)))
    want = events.flips(good, "key", "seq", "value").select("key", "seq", F.col("value").cast("string"))
    assert got == sorted((tuple(r) for r in want.collect()), key=repr) and len(got) > 10


def test_memberships(spark, tmp_path):
    rows = [("g", ["a", "b"], False), ("g", ["b", "a", "a"], False), ("g", [], True), ("g", None, False), ("g", [], False), ("h", ["a"], False), ("g", ["a"], None)]
    df = spark.createDataFrame([(g, k, m, f) for k, (g, m, f) in enumerate(rows)], "group string, seq long, members array<string>, failed boolean")
    got = streamed(spark, tmp_path, df, 2, lambda s: changes.membership_stream(s, "group", "seq", "members", "failed"))
    assert got == [("g", 0, "a,b"), ("g", 3, ""), ("g", 6, "a"), ("h", 5, "a")]
