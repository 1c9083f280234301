"""Queries of the operators whose inputs the generated tables lack: adapters derive them from order keys, page ids and
table columns. Where the cases are few, the equivalents state the expected values rather than the operators' rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captureq.functions import digest, text, url
from captureq.operators import behaviors, links, requests, workers
from captureq.plans import sqltext as S
from captureq.plans.catalog import query
from captureq.sources import sinks, tables

def _k() -> Column:
    return F.col("k")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


def _pick(values: list) -> Column:
    """The value whose place in the list is the key modulo its length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_k() % len(values)).cast("int") + 1)


def _sql(values: list) -> str:
    """A DuckDB list of the values."""
    spelt = ["NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values]
    return f"[{', '.join(spelt)}]"


def _nth(values: list, key: str = "o_orderkey") -> str:
    return f"({_sql(values)})[1 + CAST({key} % {len(values)} AS INTEGER)]"


# Formats of single values

PROTOCOLS = {"h2": "HTTP/2.0", "http/2": "HTTP/2.0", "HTTP/2.0": "HTTP/2.0", "http/1.0": "HTTP/1.0", "h3": "HTTP/1.1", None: "HTTP/1.1", "h2c": "HTTP/1.1"}


@query(f"SELECT o_orderkey AS k, {_nth(list(PROTOCOLS))} AS protocol, {_nth(list(PROTOCOLS.values()))} AS version FROM orders")
def protocol_versions(spark, d):
    k = _keys(spark, d).select("k", _pick(list(PROTOCOLS)).alias("protocol"))
    return k.withColumn("version", text.http_version(F.col("protocol")))


FLAGS = {"true": True, "1": True, "false": False, "0": False, "": False, "yes": None, None: None}
LISTS = {"a, b,,c ": '["a","b","c"]', "": "[]", " , ": "[]", "one": '["one"]'}
URIS = {"s3://b/k/x": ("b", "k/x"), "s3://b/": ("", ""), "s3://b": ("", ""), "https://b/k": ("", "")}


@query(f"""SELECT o_orderkey AS k, {_nth(list(FLAGS.values()))} AS flag, {_nth(list(LISTS.values()))} AS items, {_nth([v[0] for v in URIS.values()])} AS bucket,
  {_nth([v[1] for v in URIS.values()])} AS object, CASE WHEN o_orderkey < 100000 THEN '***' ELSE 'key-***' || right('000' || o_orderkey, 4) END AS masked FROM orders""")
def setting_values(spark, d):
    bucket, key = url.s3_parts(_pick(list(URIS)))
    secret = F.when(_k() < 100000, F.concat(F.lit("key"), _k().cast("string"))).otherwise(F.concat(F.lit("key-"), _k().cast("string")))
    return _keys(spark, d).select(
        "k", text.env_bool(_pick(list(FLAGS))).alias("flag"), F.to_json(text.split_csv(_pick(list(LISTS)))).alias("items"), bucket.alias("bucket"), key.alias("object"), text.mask_key(secret).alias("masked")
    )


UUIDS = {"123e4567-e89b-12d3-a456-426614174000": True, "123E4567-E89B-12D3-A456-42661417400F": True, "123e4567e89b12d3a456426614174000": False, "g23e4567-e89b-12d3-a456-426614174000": False, None: False}
TIMES = {"2024-01-01T00:00:00Z": True, "2024-01-01T00:00:00.123+02:00": True, "2024-01-01 00:00:00Z": False, "2024-01-01T00:00:00": False, "": False, None: False}


@query(f"SELECT o_orderkey AS k, {_nth(list(UUIDS.values()))} AS uuid, {_nth(list(TIMES.values()))} AS date_time FROM orders")
def format_checks(spark, d):
    return _keys(spark, d).select("k", requests.is_uuid(_pick(list(UUIDS))).alias("uuid"), requests.is_date_time(_pick(list(TIMES))).alias("date_time"))


SOCKETS = [  # url, address, port, rewritten url
    ("ws://host:9222/devtools/x?a=1", "10.0.0.1", None, "ws://10.0.0.1:9222/devtools/x?a=1"), ("wss://host/devtools", "::1", None, "wss://[::1]/devtools"),
    ("ws://host:9222/x", "fe80::2", "80", "ws://[fe80::2]:80/x"), ("ws://host", "10.0.0.1", "9000", "ws://10.0.0.1:9000"),
]


@query(f"SELECT o_orderkey AS k, {_nth([s[3] for s in SOCKETS])} AS socket FROM orders")
def socket_urls(spark, d):
    given, ip, port = (_pick([s[i] for s in SOCKETS]) for i in range(3))
    return _keys(spark, d).select("k", requests.ws_url(given, ip, port.cast("int")).alias("socket"))


# Requests and settings

LANGUAGES, CACHES, MODES, TARGETS = ["en", "", None, "de-DE,de;q=0.9", "x" * 201], ["use", "bypass", "clear", "never", None], ["single-pass", "both", None], ["https://a.example/", "no uri", None, " https://b.example/ "]


@query(f"""WITH r AS (SELECT o_orderkey AS k, concat_ws('; ', CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'url must match format uri' END,
    CASE WHEN o_orderkey % 5 IN (1, 4) THEN 'acceptLanguage must be 1 to 200 printable characters' END,
    CASE WHEN o_orderkey % 9000 NOT BETWEEN 1 AND 7680 THEN 'viewport.width must be 1 to 7680' END, CASE WHEN o_orderkey % 5000 NOT BETWEEN 1 AND 4320 THEN 'viewport.height must be 1 to 4320' END,
    CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'deviceScaleFactor must be 1 to 3' END, CASE WHEN o_orderkey % 12000 NOT BETWEEN 1000 AND 11000 THEN 'operationDelayMs must be 0 to 10000' END,
    CASE WHEN o_orderkey % 5 = 3 THEN 'cache must be one of the allowed values' END, CASE WHEN o_orderkey % 3 = 1 THEN 'archiveMode must be one of the allowed values' END,
    CASE WHEN o_orderkey % 60 > 50 THEN 'extraSelectors must have at most 50 items' END, CASE WHEN o_orderkey % 25 > 20 THEN 'excludeFrameworks must have at most 20 items' END) AS errors FROM orders)
  SELECT k, errors, CASE WHEN errors <> '' THEN '{{"type":"about:blank","title":"Validation failed","status":400,"detail":"' || errors || '"}}' END AS problem FROM r""")
def request_errors(spark, d):
    n = lambda m: (_k() % m).cast("int")
    asked = _keys(spark, d).select(
        "k", _pick(TARGETS).alias("url"), _pick(LANGUAGES).alias("acceptLanguage"), F.struct(n(9000).alias("width"), n(5000).alias("height")).alias("viewport"), n(5).cast("double").alias("deviceScaleFactor"),
        (n(12000) - 1000).alias("operationDelayMs"), _pick(CACHES).alias("cache"), _pick(MODES).alias("archiveMode"), F.array_repeat(F.lit("x"), n(60)).alias("extraSelectors"), F.array_repeat(F.lit("x"), n(25)).alias("excludeFrameworks"),
    )
    told = asked.select("k", requests.schema_errors(asked).alias("errors"))
    return told.withColumn("problem", F.to_json(F.when(F.col("errors") != "", requests.problem(F.lit(400), F.col("errors")))))


@query(f"""SELECT o_orderkey AS k, {_nth(["use", "clear"])} AS cache, 'default' AS mode, CASE WHEN o_orderkey % 3 = 0 THEN '[1.0,2.0]' ELSE '[' || (1 + o_orderkey % 3) || '.0]' END AS ratios,
  CASE o_orderkey % 3 WHEN 0 THEN '{{"cookies":true,"pageContext":true}}' WHEN 1 THEN '{{"cookies":false,"pageContext":false}}'
    ELSE '{{"cookies":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' WHEN o_orderkey % 4 = 1 THEN 'false' ELSE 'true' END || ',"pageContext":' || CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END || '}}' END AS reset FROM orders""")
def capture_settings(spark, d):
    k = _keys(spark, d).withColumn("cache", F.when(_k() % 2 == 1, "clear"))
    k = requests.with_defaults(k, {"cache": "use", "mode": "default"})
    given = F.struct(F.when(_k() % 2 == 0, True).when(_k() % 4 == 1, False).alias("cookies"), F.when(_k() % 5 == 0, True).alias("pageContext"))
    ratios = requests.device_ratios(F.when(_k() % 3 == 0, "multipass").otherwise("single-pass"), 1 + _k() % 3)
    reset = requests.reset_state(given, _pick([True, False, None]), True, False)
    return k.select("k", "cache", "mode", F.to_json(ratios).alias("ratios"), F.to_json(reset).alias("reset"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN '{"a":{"y":"2","x":"9"},"b":{"z":"4"},"c":{}}' WHEN o_orderkey % 2 = 0 THEN '{"a":{"x":"1","y":"2"},"c":{}}'
  WHEN o_orderkey % 3 = 0 THEN '{"a":{"x":"9"},"b":{"z":"4"},"c":{}}' ELSE '{"c":{}}' END AS options FROM orders""")
def behavior_option_union(spark, d):
    kind = "map<string,map<string,string>>"
    config = F.when(_k() % 2 == 0, F.from_json(F.lit('{"a":{"x":"1","y":"2"}}'), kind))
    asked = F.when(_k() % 3 == 0, F.from_json(F.lit('{"a":{"x":"9"},"b":{"z":"4"}}'), kind))
    return _keys(spark, d).select("k", F.to_json(requests.behavior_options(config, asked, F.array(F.lit("c")))).alias("options"))


@query("SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_ids(spark, d):
    return requests.duplicate_ids(_keys(spark, d), "c")


@query("""WITH f AS (SELECT 'n' || n_nationkey AS key FROM nation), t AS (SELECT o_orderkey AS id, unnest(list_distinct(['n' || (o_orderkey % 40), 'n' || (o_orderkey % 30)])) AS key FROM orders)
  SELECT id, key FROM t WHERE key NOT IN (SELECT key FROM f)""")
def missing_references(spark, d):
    n = lambda m: (_k() % m).cast("string")
    said = _keys(spark, d).select(_k().alias("id"), F.concat(F.lit("see [[n"), n(40), F.lit("]], [[n"), n(30), F.lit("]] and [n99]")).alias("text"))
    facts = tables.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"))
    return requests.missing_references(said, r"\[\[(\w+)\]\]", facts, "key")


# Workers, coordinators, certificates

EVENTS = ["initialize", "ready", "degrade", "members", "ready", "shutdown", "done", "recover"]


@query(f"""WITH e AS (SELECT CAST(floor(o_orderkey / 8) AS BIGINT) AS worker, list({_nth(EVENTS)} ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
  SELECT worker, list_reduce(list_prepend('created', l), lambda a, x: CASE a || '/' || x {" ".join(f"WHEN '{s}/{e}' THEN '{n}'" for s, e, n in workers.COORDINATOR)} ELSE a END) AS state FROM e""")
def coordinator_states(spark, d):
    e = _keys(spark, d).select(F.floor(_k() / 8).cast("long").alias("worker"), "k", _pick(EVENTS).alias("event"))
    return workers.follow(e, "worker", "k", "event")


@query("SELECT 'h' || o_orderkey AS host FROM orders WHERE o_orderkey % 3 <> 1")
def present_members(spark, d):
    profiles = _keys(spark, d).select(F.concat(F.lit("h"), _k().cast("string")).alias("host"), _pick([None, "NXDOMAIN", "SERVFAIL"]).alias("error"))
    return workers.present_members(profiles)


def _observed(spark: SparkSession, d: str) -> DataFrame:
    chain = F.array(F.concat(F.lit("leaf"), (_k() % 13).cast("string")), F.concat(F.lit("root"), (_k() % 2).cast("string")))
    return workers.certificate_times(_keys(spark, d).select("k", _k().cast("string").alias("host"), (1_700_000_000 + _k()).alias("valid_from"), (1_800_000_000 + 60 * _k()).alias("valid_to"), chain.alias("chain")))


_REF = "substr(sha256('leaf' || (o_orderkey % 13) || 'root' || (o_orderkey % 2)), 1, 16)"


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS host, strftime(make_timestamp((1700000000 + o_orderkey) * 1000000), '%Y-%m-%d %H:%M:%S') AS valid_from,
  strftime(make_timestamp((1800000000 + 60 * o_orderkey) * 1000000), '%Y-%m-%d %H:%M:%S') AS valid_to, {_REF} AS ref FROM orders""")
def certificate_times(spark, d):
    utc = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias(c)
    return _observed(spark, d).select("host", utc("valid_from"), utc("valid_to"), "ref")


@query(f"SELECT DISTINCT {_REF} AS ref, '[\"leaf' || (o_orderkey % 13) || '\",\"root' || (o_orderkey % 2) || '\"]' AS chain FROM orders")
def certificate_chains(spark, d):
    return workers.distinct_chains(_observed(spark, d)).select("ref", F.to_json("chain").alias("chain"))


@query("SELECT o_orderkey AS chain, CASE o_orderkey % 3 WHEN 2 THEN true WHEN 1 THEN o_orderkey % 4 <> 0 ELSE false END AS reaches FROM orders")
def trusted_chains(spark, d):
    """Three certificates a chain; of every fourth chain the second names another issuer than the third's subject."""
    kind = F.concat(F.lit("-"), (_k() % 3).cast("string"))
    certs = _keys(spark, d).select(_k().alias("chain"), "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    named = lambda p: F.concat(F.lit("s"), p.cast("string"), kind)
    issuer = F.when((_k() % 4 == 0) & (F.col("pos") == 1), "elsewhere").otherwise(named(F.col("pos") + 1))
    return behaviors.chain_reaches(certs.select("chain", "pos", named(F.col("pos")).alias("subject"), issuer.alias("issuer")), ["s3-1", "s1-2"])


@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS chain, l_linenumber AS pos, 's' || l_partkey % 11 AS subject, 's' || l_suppkey % 11 AS issuer FROM lineitem),
  walk AS (SELECT chain, arg_min(subject, (pos, subject, issuer)) AS who, 0 AS n FROM c GROUP BY chain UNION SELECT w.chain, c.issuer, n + 1 FROM walk w JOIN c ON c.chain = w.chain AND c.subject = w.who WHERE n < 10)
  SELECT chain, bool_or(who IN ('s0', 's5')) AS reaches FROM walk GROUP BY chain""")
def issuer_walks(spark, d):
    """The line items of an order as certificates: parts issue to one another in no order, crosswise and in loops."""
    li = tables.table(spark, d, "lineitem")
    named = lambda c: F.concat(F.lit("s"), (F.col(c) % 11).cast("string"))
    certs = li.select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("pos"), named("l_partkey").alias("subject"), named("l_suppkey").alias("issuer"))
    return behaviors.issuers_reach(certs, ["s0", "s5"])


@query("""WITH v AS (SELECT o_custkey % 40 AS cert, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS b FROM orders WHERE o_custkey % 40 <> 7 AND (o_custkey % 40 <> 9 OR o_orderkey % 500 = 1)),
  s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 40 AS cert, CASE WHEN l_linenumber <> 6 THEN l_shipdate END AS t FROM lineitem),
  r AS (SELECT id, cert, t, (SELECT max(b) FROM v WHERE v.cert = s.cert AND v.a <= s.t) AS latest FROM s)
  SELECT id, CASE WHEN t IS NULL THEN 'skipped' WHEN cert NOT IN (SELECT cert FROM v) THEN 'unknown' WHEN latest IS NULL THEN 'not-yet-valid' WHEN latest >= t THEN 'ok' ELSE 'expired' END AS state FROM r""")
def claimed_validity(spark, d):
    """Orders as periods of certificates, line items as signatures at the time of their shipment."""
    cert, key = F.col("o_custkey") % 40, F.col("o_orderkey")
    periods = tables.table(spark, d, "orders").filter((cert != 7) & ((cert != 9) | (key % 500 == 1)))
    periods = periods.select(cert.alias("cert"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((key % 9).cast("int"))).alias("valid_to"))
    item = F.col("l_linenumber")
    signed = tables.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + item).alias("id"), (F.col("l_suppkey") % 40).alias("cert"), F.when(item != 6, F.col("l_shipdate")).alias("claimed_at"))
    return behaviors.validity_at(signed, periods)


@query("""SELECT 'h' || (o_orderkey % 50) AS host, min_by('tls' || o_orderkey, o_orderkey) FILTER (o_orderkey % 50 <> 7 AND o_orderkey % 3 <> 0) AS details FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1""")
def tls_hosts(spark, d):
    scheme = F.when(_k() % 7 == 0, "http://h/").otherwise("https://h/")
    details = F.when((_k() % 50 != 7) & (_k() % 3 != 0), F.concat(F.lit("tls"), _k().cast("string")))
    return behaviors.tls_hosts(_keys(spark, d).select(_k().alias("seq"), F.concat(F.lit("h"), (_k() % 50).cast("string")).alias("host"), scheme.alias("url"), details.alias("details")))


_CHECKS = {"hash": 3, "signature": 4, "domain": 5, "timestamp": 7}


@query(f"""WITH c AS (SELECT o_orderkey AS id, {", ".join(f"CASE o_orderkey % {m} WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'ok' END AS {n}" for n, m in _CHECKS.items())} FROM orders)
  SELECT *, CASE 'failed' {" ".join(f"WHEN {n} THEN '{n}'" for n in _CHECKS)} END AS reason FROM c""")
def package_verdicts(spark, d):
    told = [F.when(_k() % m == 0, None).otherwise(_k() % m != 1).alias(n) for n, m in _CHECKS.items()]
    return behaviors.verdict(_keys(spark, d).select(_k().alias("id"), *told))


# Pages

RAN = [
    ('[{"id":"autoscroll","steps":5,"exhausted":true}]', '{"scroll_exhausted":true,"scroll_steps":5,"scrolled_px":4000}'), ('[{"id":"autofetch","steps":3,"exhausted":true}]', None),
    ('[{"id":"autoscroll","exhausted":true}]', None), ('[{"id":"x"},{"id":"autoscroll","steps":2,"exhausted":false},{"id":"autoscroll","steps":9,"exhausted":true}]', '{"scroll_exhausted":false,"scroll_steps":2,"scrolled_px":1600}'),
    ("[]", None),
]


@query(f"SELECT o_orderkey AS id, {_nth([r[1] for r in RAN])} AS coverage FROM orders")
def behavior_coverage(spark, d):
    ran = F.from_json(_pick([r[0] for r in RAN]), "array<struct<id string, steps long, exhausted boolean>>")
    return behaviors.coverage(_keys(spark, d).select(_k().alias("id"), ran.alias("ran")), 800).select("id", F.to_json("coverage").alias("coverage"))


@query("""WITH e AS (SELECT CAST(floor(o_orderkey / 8) AS BIGINT) AS page_id, CASE WHEN o_orderkey % 2 = 1 THEN 'r/' || (o_orderkey % 8 - 1) || '/c' ELSE 'r/' || (o_orderkey % 8) END AS path FROM orders
    WHERE o_orderkey % 3 <> 2 AND o_orderkey % 2000 >= 500 AND o_orderkey % 100 >= 30 AND o_orderkey % 7 <> 0)
  SELECT page_id, path FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.page_id = e.page_id AND starts_with(e.path, o.path || '/'))""")
def page_overlays(spark, d):
    path = F.when(_k() % 2 == 1, F.concat(F.lit("r/"), (_k() % 8 - 1).cast("string"), F.lit("/c"))).otherwise(F.concat(F.lit("r/"), (_k() % 8).cast("string")))
    e = _keys(spark, d).select(
        F.floor(_k() / 8).cast("long").alias("page_id"), path.alias("path"), _pick(["fixed", "sticky", "static"]).alias("position"), (_k() % 2000).alias("z"), (_k() % 100).alias("area"), F.lit(100).alias("viewport_area"), (_k() % 7 == 0).alias("landmark")
    )
    return links.overlays(e, 500, 0.3).select("page_id", "path")


@query("""SELECT page_id, 0 AS pos, '["https://s.example/d/v' || page_id || '.mp4","https://cdn.example/p.png","https://s.example/w.webm"]' AS urls FROM pages
  UNION ALL SELECT page_id, 1, '["https://s.example/d/a.ogg"]' FROM pages WHERE page_id % 2 = 0""")
def page_media(spark, d):
    video = F.format_string('<VIDEO src="v%d.mp4" poster=\'//cdn.example/p.png\'><source type="x" src="/w.webm"><source src="v%d.mp4"></VIDEO>', "page_id", "page_id")
    audio = F.when(F.col("page_id") % 2 == 0, '<audio controls src="a.ogg"></audio>').otherwise('<audio src="a.ogg"')
    p = tables.table(spark, d, "pages").select("page_id", F.lit("https://s.example/d/p").alias("url"), F.concat("html", video, audio).alias("html"))
    return links.media_urls(p).select("page_id", F.col("pos").cast("int").alias("pos"), F.to_json("urls").alias("urls"))


@query("""SELECT page_id, '["https://s.example/css/i' || page_id || '.png","https://s.example/b.png","https://cdn.example/c.png"]' AS urls FROM pages""")
def stylesheet_targets(spark, d):
    css = F.concat(F.lit("a{background:url(i"), F.col("page_id").cast("string"), F.lit(".png)}b{c:URL( '/b.png' ) url(\"//cdn.example/c.png\") url(data:image/png;base64,xx) url('') url(/b.png)}"))
    return tables.table(spark, d, "pages").select("page_id", F.to_json(links.stylesheet_urls(css, F.lit("https://s.example/css/main.css"))).alias("urls"))


@query("""SELECT o_orderkey AS k, '["https://cdn' || (o_orderkey % 3) || '.example/i' || o_orderkey || '.PNG"]' AS images, '["https://i.example/' || (2 + o_orderkey % 400) || 'x' || (2 + o_orderkey % 300) || '_c.jpg","https://i.example/'
  || 2 * (2 + o_orderkey % 400) || 'x' || 2 * (2 + o_orderkey % 300) || '_c.jpg","https://i.example/' || (3 + o_orderkey % 400) // 2 || 'x' || (3 + o_orderkey % 300) // 2 || '_c.jpg","https://i.example/plain.jpg"]' AS sizes FROM orders""")
def image_variants(spark, d):
    html = F.format_string('<img src="https://cdn%d.example/i%d.PNG"> https://other.org/x.jpg (https://cdn%d.example/i%d.PNG) https://x.example/y.txt', _k() % 3, _k(), _k() % 3, _k())
    sized = F.format_string("https://i.example/%dx%d_c.jpg", 2 + _k() % 400, 2 + _k() % 300)
    sizes = links.size_siblings(F.array(sized, F.lit("https://i.example/plain.jpg")))
    return _keys(spark, d).select("k", F.to_json(links.image_urls(html, "example")).alias("images"), F.to_json(sizes).alias("sizes"))


@query("""SELECT o_orderkey AS k, substr(sha256('-----BEGIN CERTIFICATE-----' || o_orderkey || '-----END CERTIFICATE----------BEGIN CERTIFICATE-----x-----END CERTIFICATE-----'), 1, 16) AS ref, 2 AS n FROM orders""")
def pem_chains(spark, d):
    pem = F.format_string("head -----BEGIN CERTIFICATE-----%d-----END CERTIFICATE-----\n-----BEGIN CERTIFICATE-----x-----END CERTIFICATE----- -----BEGIN CERTIFICATE-----cut", _k())
    blocks = links.pem_blocks(pem)
    return _keys(spark, d).select("k", digest.chain_ref(blocks).alias("ref"), F.size(blocks).alias("n"))


@query("""SELECT 'p' || o_orderkey AS path, 'one ' || o_orderkey AS name, 'x' || chr(10) || '  y' || o_orderkey AS body FROM orders
  UNION ALL SELECT 'p' || o_orderkey, 'two', 'z' FROM orders WHERE o_orderkey % 2 = 0""")
def source_regions(spark, d):
    first = F.format_string("a\n  // #region one %d\n    x\n      y%d\n  // #endregion\nb\n", _k(), _k())
    second = F.when(_k() % 2 == 0, "# #region two\nz\n# #endregion\n").otherwise("# #region two\nz\n")
    return sinks.regions(_keys(spark, d).select(F.concat(F.lit("p"), _k().cast("string")).alias("path"), F.concat(first, second).alias("text")))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'sig' || page_id END AS signature,
  CASE WHEN page_id % 3 = 0 AND page_id % 2 = 1 THEN CASE WHEN page_id % 5 = 0 THEN 'signing' ELSE 'signing: refused' END END AS error FROM pages""")
def signed_packages(spark, d):
    p = tables.table(spark, d, "pages").select("page_id", (F.col("page_id") % 3 == 0).alias("require_signature"))
    even = F.col("page_id") % 2 == 0
    told = p.filter("page_id % 5 <> 0 OR page_id % 2 = 0").select("page_id", F.when(even, F.concat(F.lit("sig"), F.col("page_id").cast("string"))).alias("signature"), F.when(~even, "refused").alias("error"))
    return sinks.signed(p, told).select("page_id", "signature", "error")


@query(f"""WITH {S.TASKS} SELECT task_id, task_id % 3 = 0 AS success, task_id % 4 = 1 AS again FROM tasks""")
def page_outcomes(spark, d):
    k = _keys(spark, d)
    status = _pick([200 + 99, 304, None])
    message = _pick([None, "Execution context was destroyed, most likely because of a navigation.", "Target closed", "navigation"])
    return k.select(_k().alias("task_id"), text.http_success(status).alias("success"), text.context_destroyed(message).alias("again"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'OneTrust' WHEN 1 THEN 'InsitesCookieConsent' WHEN 3 THEN 'Own' END AS framework,
  CASE page_id % 4 WHEN 0 THEN '["#onetrust-banner-sdk"]' WHEN 1 THEN '[".cc-window",".x"]' WHEN 2 THEN '[]' ELSE '["#sp_message_container_9"]' END AS removed FROM pages""")
def consent_custom(spark, d):
    """Two frameworks left out, two entries added."""
    added = [("Own", "#sp_message_container_9"), ("Own", ".x")]
    found = links.consent_banners(tables.rich_pages(spark, d), ["Klaro", "Sourcepoint"], added)
    return found.select("page_id", "framework", F.to_json("removed").alias("removed"))
