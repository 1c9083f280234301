"""Request schemas, defaults and problem documents as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wire form of a capture request.
REQUEST = (
    "url string, labels array<string>, correlationId string, captureFormats struct<png:boolean,webp:boolean,html:boolean,links:boolean,mhtml:boolean,wacz:boolean>, signing boolean, acceptLanguage string, "
    "viewport struct<width:int,height:int>, deviceScaleFactor double, operationDelayMs int, cache string, archiveMode string, extraSelectors array<string>, excludeFrameworks array<string>"
)

#: Bounds of the wire form.
BOUNDS = {"width": (1, 7680), "height": (1, 4320), "deviceScaleFactor": (1, 3), "operationDelayMs": (0, 10000)}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A folder of request lines; a line that is no JSON object is kept as text in _bad."""
    return spark.read.schema(REQUEST + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder that grows, bad lines included."""
    return spark.readStream.schema(REQUEST + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def is_uri(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S*$"), F.lit(False))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def is_date_time(c: Column) -> Column:
    return F.coalesce(c.rlike(DATE_TIME), F.lit(False))


def _outside(c: Column, bound: tuple[int, int]) -> Column:
    return c.isNotNull() & ~c.between(*bound)


def schema_errors(requests: DataFrame) -> Column:
    """All violations of a wire request, in field order, joined by `; `; empty where there is none."""
    r = lambda name: F.col(name)
    checks = [
        (~is_uri(F.trim("url")), "url must match format uri"), (r("acceptLanguage").isNotNull() & ~r("acceptLanguage").rlike(r"^[\x20-\x7e]{1,200}$"), "acceptLanguage must be 1 to 200 printable characters"),
        (_outside(r("viewport.width"), BOUNDS["width"]), "viewport.width must be 1 to 7680"), (_outside(r("viewport.height"), BOUNDS["height"]), "viewport.height must be 1 to 4320"),
        (_outside(r("deviceScaleFactor"), BOUNDS["deviceScaleFactor"]), "deviceScaleFactor must be 1 to 3"), (_outside(r("operationDelayMs"), BOUNDS["operationDelayMs"]), "operationDelayMs must be 0 to 10000"),
        (r("cache").isNotNull() & ~r("cache").isin("use", "bypass", "clear"), "cache must be one of the allowed values"), (r("archiveMode").isNotNull() & ~r("archiveMode").isin("single-pass", "multipass"), "archiveMode must be one of the allowed values"),
        (F.size("extraSelectors") > 50, "extraSelectors must have at most 50 items"), (F.size("excludeFrameworks") > 20, "excludeFrameworks must have at most 20 items"),
    ]
    return F.array_join(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks]), lambda x: x.isNotNull()), "; ")


#: Problem documents by status.
PROBLEMS = {400: "Validation failed", 404: "Unknown task", 409: "Duplicate URL", 503: "No operational workers available"}


def problem(status: Column, detail: Column) -> Column:
    title = F.element_at(F.create_map(*[F.lit(x) for p in PROBLEMS.items() for x in p]), status)
    return F.when(title.isNotNull(), F.struct(F.lit("about:blank").alias("type"), title.alias("title"), status.alias("status"), detail.alias("detail")))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Each named column, or its configured default where it is null or absent."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def device_ratios(mode: Column, single: Column) -> Column:
    """Pixel ratios of the capture passes."""
    return F.when(mode == "multipass", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(single.cast("double")))


def reset_state(given: Column, flag: Column, cookies: bool, page_context: bool) -> Column:
    """flag true or false is absolute; else each field of the spec struct, or its default."""
    both = lambda v: F.struct(v.alias("cookies"), v.alias("pageContext"))
    spec = F.struct(F.coalesce(given["cookies"], F.lit(cookies)).alias("cookies"), F.coalesce(given["pageContext"], F.lit(page_context)).alias("pageContext"))
    return F.when(flag.isNotNull(), both(flag)).otherwise(spec)


def behavior_options(config: Column, request: Column, enabled: Column) -> Column:
    """Options by behaviour id over the union of configured, requested and enabled ids; requested keys win. Both are
    map<string, map<string, string>>."""
    empty = F.create_map().cast("map<string,string>")
    ids = F.array_distinct(F.concat(F.coalesce(F.map_keys(config), F.array().cast("array<string>")), F.coalesce(F.map_keys(request), F.array().cast("array<string>")), enabled))

    def merged(i: Column) -> Column:
        a, b = F.coalesce(F.try_element_at(config, i), empty), F.coalesce(F.try_element_at(request, i), empty)
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False))), b)

    return F.map_from_entries(F.transform(ids, lambda i: F.struct(i, merged(i))))


def ws_url(url: Column, ip: Column, port: Column) -> Column:
    """A websocket url with its host replaced by an address (IPv6 in brackets) and its port where one is given."""
    address = F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip)
    kept = F.regexp_extract(url, r"^wss?://[^/?#]*?(:\d+)?(?:[/?#]|$)", 1)
    rest = F.regexp_extract(url, r"^wss?://[^/?#]*(.*)$", 1)
    return F.concat(F.regexp_extract(url, r"^(wss?://)", 1), address, F.when(port.isNotNull(), F.concat(F.lit(":"), port.cast("string"))).otherwise(kept), rest)


def submit_summary(replies: DataFrame) -> DataFrame:
    """total, accepted, rejected and the time that all submissions took (accepted boolean, ms long)."""
    return replies.agg(F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.max("ms").alias("duration_ms"))


def spec_coverage(items: DataFrame) -> DataFrame:
    """area, supported, total: for each area of a standard its items that are supported in full, and those that it has (all
    but those outside). items: area, state (full, partial, unused, outside); a null state is an item that is not supported,
    a null area an area of its own."""
    state = F.coalesce("state", F.lit("unused"))
    return items.groupBy("area").agg(F.count_if(state == "full").alias("supported"), F.count_if(state != "outside").alias("total"))


def duplicate_ids(items: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def set_difference(claimed: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    """Names on one side only, with that side."""
    a, b = claimed.select(key).distinct().withColumn("a", F.lit(True)), emitted.select(key).distinct().withColumn("b", F.lit(True))
    return a.join(b, key, "full").filter("a is null or b is null").select(key, F.when(F.col("a"), "claimed").otherwise("emitted").alias("side"))


def missing_references(text: DataFrame, pattern: str, facts: DataFrame, key: str) -> DataFrame:
    """(id, key) for every match of pattern in a text that no fact row has."""
    found = text.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias(key))
    return found.join(facts.select(key).distinct(), key, "left_anti").select("id", key)


def listed(names: Sequence[str]) -> Column:
    """An ordered list without repeats."""
    return F.array_distinct(F.array(*[F.lit(n) for n in names]))
