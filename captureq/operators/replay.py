"""Index lines and replay lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captureq.functions.digest import EMPTY_SHA256
from captureq.functions.url import fuzzy_key, surt


def cdxj_line(url: Column, timestamp: Column, mime: Column, status: Column, digest: Column, length: Column, offset: Column, filename: Column) -> Column:
    """`surt ts {json}` with fixed key order and every value a JSON string (values are quoted by to_json). A null digest
    is that of no bytes, since every line states one; other null values are empty strings."""
    digest = F.coalesce(digest, F.lit("sha256:" + EMPTY_SHA256))
    pairs = [("url", url), ("mime", mime), ("status", status), ("digest", digest), ("length", length), ("offset", offset), ("filename", filename)]
    quoted = [F.concat(F.lit(f'"{k}":'), F.regexp_extract(F.to_json(F.struct(F.coalesce(v.cast("string"), F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)) for k, v in pairs]
    return F.concat_ws(" ", surt(url), timestamp, F.concat(F.lit("{"), F.concat_ws(",", *quoted), F.lit("}")))


#: Seconds of a time bucket of the nearest-capture lookup.
BUCKET = 7 * 86_400


def nearest(asked: DataFrame, index: DataFrame, key: str = "key", bucket: int = BUCKET) -> DataFrame:
    """For each request (id, key, at) the capture of that key closest in time; of equally close ones the earlier, then
    the smaller ref; nulls where the key has none, and where the request's key or time is null. Captures without a key, a
    time or a ref are never found. Every request gives a row, repeated ones too; columns but those three are not read.

    An as-of join by sorting: requests and captures of a key and a bucket of time are merged in order and the neighbours
    before and after are carried along. Where a bucket has none on one side, the last or first capture of the next one
    that has is taken from a table of one row a bucket. So no request meets every capture of its key, and a key that
    very many rows name is as many partitions as it has buckets."""
    slot = F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / bucket).alias("slot")
    none = F.lit(None).cast("long")
    whole = F.col(key).isNotNull() & F.col("at").isNotNull()
    lost = asked.filter(~whole).select("id")
    asked, index = asked.filter(whole).withColumn("_asked", F.lit(True)), index.filter(whole)
    both = asked.select(key, slot, "at", "id", "_asked", none.alias("ref")).unionByName(index.select(key, slot, "at", none.alias("id"), F.lit(False).alias("_asked"), "ref"))
    seen = F.when(F.col("ref").isNotNull(), F.struct("at", "ref"))
    before = Window.partitionBy(key, "slot").orderBy("at", "_asked", F.desc("ref")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key, "slot").orderBy("at", F.col("ref").isNotNull(), "ref").rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("p", F.last(seen, ignorenulls=True).over(before)).withColumn("n", F.first(seen, ignorenulls=True).over(after)).filter("_asked")
    # One row a bucket: its first and last capture, then the nearest ones of the buckets before and after.
    late = F.max(F.when(F.col("ref").isNotNull(), F.struct("at", (-F.col("ref")).alias("ref"))))
    ends = both.groupBy(key, "slot").agg(F.min(seen).alias("first"), late.alias("last")).withColumn("last", F.when(F.col("last").isNotNull(), F.struct("last.at", (-F.col("last.ref")).alias("ref"))))
    order = Window.partitionBy(key).orderBy("slot")
    ends = ends.select(
        key,
        "slot",
        F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    near = near.join(ends, [key, "slot"]).withColumns({"p": F.coalesce("p", "earlier"), "n": F.coalesce("n", "later")})
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    gap_p, gap_n = ms(F.col("at")) - ms(F.col("p.at")), ms(F.col("n.at")) - ms(F.col("at"))
    use_p = F.col("n").isNull() | (F.col("p").isNotNull() & (gap_p <= gap_n))
    found = near.select("id", F.when(use_p, F.col("p.ref")).otherwise(F.col("n.ref")).alias("ref"), F.when(use_p, gap_p).otherwise(gap_n).alias("gap_ms"))
    return found.unionByName(lost.select("id", none.alias("ref"), none.alias("gap_ms")))


def fuzzy_groups(pages: DataFrame, params: Sequence[str]) -> DataFrame:
    """Pages that a fuzzy lookup treats as one."""
    return pages.select("page_id", fuzzy_key(F.col("url"), params).alias("fuzzy_url"))
