"""Adapters: the driver's tables as capture data (exchanges, tasks, network events, pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, seq, url, status, mime, date, body_bytes, declared_bytes: one row per recorded network exchange."""
    # Renamed before the window, so that what groups by task_id finds the rows already dealt by it.
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "task_id")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    seq = F.row_number().over(Window.partitionBy("task_id").orderBy(*order))
    digit = F.floor("l_quantity") % 10
    status = F.when(digit == 0, 304).when(digit == 1, 302).when(digit == 2, 204).when(digit == 3, 404).otherwise(200)
    url = F.concat(F.lit("https://h"), (F.col("task_id") % 97).cast("string"), F.lit(".example."), F.when(F.col("l_linestatus") == "F", "com").otherwise("net"), F.lit("/p/"), (F.col("l_partkey") % 5).cast("string"))
    mime = F.when(F.col("l_returnflag") == "A", "text/html").when(F.col("l_returnflag") == "N", "image/png").otherwise("video/mp4")
    empty = status.isin(204, 302, 304)
    price = F.col("l_extendedprice")
    return li.select(
        "task_id", seq.cast("long").alias("seq"), url.alias("url"), status.cast("int").alias("status"), mime.alias("mime"), F.col("l_shipdate").alias("date"),
        F.when(status == 204, None).when(empty, F.lit(0)).otherwise(F.floor(price)).cast("long").alias("body_bytes"), F.when(empty, F.lit(0)).otherwise(F.floor(price * (1 - F.col("l_discount")))).cast("long").alias("declared_bytes"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, url, enqueued_at, worker_index, retry_count, status, label, correlation_id, message."""
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "httpError").otherwise("timeout")
    k = key % 5
    # Classes decide before messages: one that reads like a time limit comes from a plain error too.
    error_class = F.when(k == 0, "TimeoutError").when((k == 2) & (key % 3 == 0), "SigningRequiredError").otherwise("Error")
    message = F.when(k == 0, "Navigation timeout of 30000 ms exceeded").when(k == 1, "Waiting failed: 100ms exceeded").when(k == 2, "Target closed").when(k == 3, "browser disconnected").otherwise("boom")
    return table(spark, sf_dir, "orders").select(
        key.alias("task_id"), F.concat(F.lit("https://h"), (key % 97).cast("string"), F.lit(".example.com/p/"), (F.col("o_custkey") % 50).cast("string")).alias("url"), F.col("o_orderdate").alias("enqueued_at"),
        (F.col("o_custkey") % 3).cast("int").alias("worker_index"), (key % 3).cast("int").alias("retry_count"), status.alias("status"), F.col("o_orderpriority").alias("label"),
        F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("correlation_id"), message.alias("message"), error_class.alias("error_class"),
    )


#: Fixed values of the adapter: event type to network event kind.
EVENT_KINDS = {"view": "requestWillBeSent", "click": "responseReceived", "purchase": "loadingFinished", "error": "loadingFailed", "signup": "redirect"}


def net_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, seq, ts, kind, encoded_length: the ordered network-event log (redirect: a request that redirects)."""
    kind = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.floor(F.col("value") * 1000).cast("long").alias("encoded_length"))


#: What rich_pages adds to every page, in the order in which it stands there. Links in comments and scripts are none.
RICH_TAIL = (
    "<a rel=nofollow href=../up/./x?a=1&amp;b=2>Up</a><a href=\"http://[bad\">Bad</a><a HREF='#f' rel=\"me noopener\"> Q </a>"
    "<!-- <a href=/no>no</a><div id=onetrust-banner-sdk><img src=no.png> --><script>var s = \"<a href='/no'>no</a><p class=klaro>\";</script>"
    "<a href=/un title=it's>Un&#x70;aired <!-- no -->&lt;b&gt;</a>"
    "<img src=a.png data-src=\"/b.png\" srcset=\"c.png 1x, d.png 2x\"><video src='v.mp4' poster=//cdn.example/p.png></video>"
)


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages whose html goes on with what the generated pages lack: unquoted, entity-coded, relative and unparseable link
    targets, rel, unpaired quotes, links that are none, responsive images, a video, a link with an attribute of 20 000
    characters (on one page in ten), by page_id one of four banners (or near misses of them), and on every third page a
    base, which holds for the whole page."""
    kind = F.pmod("page_id", F.lit(4))
    banner = F.when(kind == 0, "<div id=onetrust-banner-sdk>").when(kind == 1, '<div id="ONETRUST-banner-sdk" class="x cc-window">')
    banner = banner.when(kind == 2, "<div class='a klaro b'>").otherwise('<p id="sp_message_container_9">')
    long_link = F.concat(F.lit("<a data-x='"), F.repeat(F.lit('">'), F.when(F.col("page_id") % 10 == 0, 10_000).otherwise(3)), F.lit("' href=long>Long</a>"))
    base = F.when(F.col("page_id") % 3 == 1, '<base target=x><BASE HREF="/b/c">').otherwise("")
    return table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit(RICH_TAIL), long_link, banner, base))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled exchanges from the network-event log: outcomes as they are, the rest derived from ids and sizes. The number
    of tasks grows with that of requests, and so do the request ids."""
    from captureq.operators.events import paired_exchanges

    p = paired_exchanges(net_events(spark, sf_dir))
    rid, size = F.col("request_id"), F.col("encoded_length")
    odd = size % 7
    skip = F.when(odd == 0, "too-large").when(odd == 1, "content-type").when(odd == 2, "task-cap")
    recorded = F.col("outcome") == "recorded"
    sent = F.create_map(F.lit(":path"), F.lit("/"), F.lit("Accept"), F.lit("*/*"))
    got = F.create_map(F.lit(":status"), F.lit("200"), F.lit("Content-Length"), F.lit("9"), F.lit("Set-Cookie"), F.lit("a=1\nb=2"))
    return p.select(
        F.floor(rid / 16).alias("task_id"), "request_id", "round", "opened_at", "outcome", "encoded_length",
        F.concat(F.lit("https://H.example:8443/r?i="), rid.cast("string")).alias("url"), F.when(rid % 2 == 0, "GET").otherwise("POST").alias("method"), F.when(rid % 3 == 0, "Image").alias("resource_type"),
        F.when(F.col("responded") | (F.col("outcome") == "redirected"), F.when(F.col("outcome") == "redirected", 302).otherwise(200)).alias("status"), F.lit("").alias("status_text"), sent.alias("request_headers"), got.alias("response_headers"),
        F.when(recorded, skip).alias("skip_reason"), F.when(recorded & skip.isNull(), size).alias("body_bytes"), F.lit("net::ERR_FAILED").alias("error_text"), (rid % 2 == 0).alias("canceled"),
        F.when(rid % 5 == 0, "inspector").alias("blocked_reason"),
    )


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """settled with what a task's archive needs besides: times, bodies of up to 511 bytes, addresses, posted bodies."""
    rid, size = F.col("request_id"), F.col("encoded_length") % 512
    whole = F.col("body_bytes").isNotNull()
    letter = F.substring(F.lit("0123456789abcdef"), (rid % 16 + 1).cast("int"), F.lit(1))
    return settled(spark, sf_dir).withColumns(
        {
            "body": F.when(whole, F.repeat(letter, size.cast("int"))).cast("binary"), "body_bytes": F.when(whole, size), "captured_at": F.timestamp_seconds(F.lit(1704067200) + F.col("opened_at")),
            "mime": F.when(rid % 3 != 0, "text/html"), "ip": F.when(rid % 2 == 0, F.concat(F.lit("10.0.0."), (rid % 256).cast("string"))), "request_body": F.when(F.col("method") == "POST", F.concat(F.lit("q="), rid.cast("string"))).cast("binary"),
        }
    )


def page_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with their synthetic capture time."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    return table(spark, sf_dir, "pages").withColumn("captured_at", at)
