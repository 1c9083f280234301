"""Large block-lists against SQL's LIKE, pattern by pattern."""

import random
import re

from pyspark.sql import functions as F

from captureq.operators import blocklist


def like(url, pattern):
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), url, re.S) is not None


def test_patterns_equal_regular_expressions(spark):
    rng = random.Random(4)
    bits = ["ads", "ad", "x", ".", "/", "*", "**", "example", "com", "-", "é", "%", "_", "\\", "Ads", "12", "?q="]
    urls = ["".join(rng.choice([b for b in bits if "*" not in b]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    patterns = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(400)] + urls[:20] + ["*", "", "a*a", "*a", "ab*ba"]
    df = spark.createDataFrame([(k, u, 7) for k, u in enumerate([*urls, "aba", "a", "abba", None])], "id long, url string, n_patterns int")
    table = spark.createDataFrame([(p, "x") for p in [*patterns, *patterns[:9], None]], "pattern string, url string")
    got = {r.id: (r.url, r.n_patterns) for r in blocklist.blocked_urls(df, table, short=7).collect()}
    assert len(got) == 304 and got[303] == (None, 0)
    assert {k: n for k, (u, n) in got.items() if u is not None} == {k: sum(like(u, p) for p in set(patterns)) for k, (u, _) in got.items() if u is not None}
    assert blocklist.blocked_urls(df.limit(0), table).count() == 0
    assert {r.n_patterns for r in blocklist.blocked_urls(df, table.limit(0)).collect()} == {0}


def test_hundred_thousand_patterns(spark):
    """No nested loop over patterns, hot parts in every url and every pattern."""
    table = spark.range(100_000).select(F.format_string("*://*.ads.example.com/track/%d/*", "id").alias("pattern"))
    urls = spark.range(3000).select("id", F.format_string("https://h%d.ads.example.com/track/%d/x.js", F.col("id") % 9, F.col("id") * 50).alias("url"))
    out = blocklist.blocked_urls(urls, table)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.groupBy("n_patterns").count().collect()} == {(0, 1000), (1, 2000)}


def test_parts_are_not_broadcast(spark):
    """Urls of few bytes have parts of many, which Spark takes for as small as the urls: their joins must not pass through
    the driver. A rare run files a pattern, however frequent its words are, and so do its start and its end."""
    urls = spark.range(2000).select("id", F.format_string("https://h%d.example.org/a/%d?s=x", F.col("id") % 9, F.col("id") + 1000).alias("url"))
    table = spark.range(500).select(F.format_string("http*.org/*/%d*", F.col("id") + 1000).alias("pattern")).unionByName(spark.createDataFrame([("*=x",), ("*?s*",), ("*z*",)], "pattern string"))
    out = blocklist.blocked_urls(urls, table)
    assert {tuple(r) for r in out.groupBy("n_patterns").count().collect()} == {(3, 500), (2, 1500)}
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    assert "BroadcastHashJoin [_key" not in out._jdf.queryExecution().executedPlan().toString()
    keys = spark.createDataFrame([("http*.org/*/1234*",), ("*js",), ("*js*",)], "p string").select(blocklist.pattern_keys(F.col("p")).alias("k")).collect()
    assert {"r/123", "r1234", "worg", "shttp"} <= set(keys[0].k) and keys[1].k == ["ejs"] and keys[2].k == []
