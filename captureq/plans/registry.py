"""All queries of the capture operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captureq.functions import digest, text, url
from captureq.operators import behaviors, events, links, recorder, replay, tasks
from captureq.plans import columns  # noqa: F401  registers its queries
from captureq.plans import sqltext as S
from captureq.plans.catalog import ORACLES, QUERIES, query  # noqa: F401
from captureq.sources import tables

#: Limits of the recorded exchanges in these queries.
MAX_RESPONSE, MAX_TASK, SKIP = 90_000, 150_000, ["video/"]


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return recorder.body_budget(tables.exchanges(spark, d), MAX_RESPONSE, MAX_TASK, SKIP)


# Archive recording


def _as_json(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as JSON text, which both engines spell alike."""
    return df.withColumns({c: F.to_json(c) for c in arrays})


@query(f"WITH RECURSIVE {S.COMPLETE} SELECT * REPLACE (CAST(to_json(bodyless_urls) AS VARCHAR) AS bodyless_urls, CAST(to_json(truncated_urls) AS VARCHAR) AS truncated_urls) FROM complete")
def archive_completeness(spark, d):
    return _as_json(recorder.completeness(_folded(spark, d)), "bodyless_urls", "truncated_urls")


@query(f"WITH RECURSIVE {S.FOLDED} SELECT task_id, seq, url, body_bytes, skip_reason FROM folded")
def body_budget(spark, d):
    return _folded(spark, d).select("task_id", "seq", "url", "body_bytes", "skip_reason")


@query(f"WITH RECURSIVE {S.FOLDED}, {S.STATS} SELECT * FROM stats")
def recorder_stats(spark, d):
    return recorder.recorder_stats(_folded(spark, d))


@query(f"""WITH RECURSIVE {S.FOLDED} SELECT task_id, reason, pos, url FROM (SELECT task_id, skip_reason AS reason, url, row_number() OVER (PARTITION BY task_id, skip_reason ORDER BY seq) AS pos
  FROM folded WHERE skip_reason IS NOT NULL) WHERE pos <= 5""")
def recorder_samples_top5(spark, d):
    return recorder.first_samples(_folded(spark, d))


@query(f"""WITH {S.EXCHANGES} SELECT task_id, seq, coalesce(body_bytes, 0) + 300 AS length, CAST(sum(coalesce(body_bytes, 0) + 300) OVER (PARTITION BY task_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - coalesce(body_bytes, 0) - 300 AS BIGINT) AS "offset" FROM exchanges""")
def warc_offsets(spark, d):
    return recorder.record_offsets(tables.exchanges(spark, d), F.coalesce("body_bytes", F.lit(0)) + 300)


_KINDS = "".join(
    f""" || CASE WHEN {name} > 0 THEN chr(10) || '  {reason} ' || {name} || '{tail}' || coalesce(chr(10) || array_to_string(list_transform(list_slice({name}_urls, 1, 5), lambda u: '    ' || u), chr(10)), '') ELSE '' END"""
    for name, reason, tail in (
        ("skipped_content_type", "content-type", ""),
        ("truncated_too_large", "too-large", " — raise --wacz-max-response-bytes"),
        ("truncated_task_cap", "task-cap", " — raise --wacz-max-task-bytes"),
    )
)
_SAMPLED = ", ".join(f"list(url ORDER BY seq) FILTER (skip_reason = '{r}') AS {n}_urls" for n, r in (("skipped_content_type", "content-type"), ("truncated_too_large", "too-large"), ("truncated_task_cap", "task-cap")))


@query(f"""WITH RECURSIVE {S.COMPLETE}, {S.STATS}, sampled AS (SELECT task_id, {_SAMPLED} FROM folded GROUP BY task_id)
  SELECT s.task_id, 'in archive ' || in_archive || ' (with body ' || total_recorded || ' / without body ' || (in_archive - total_recorded) || ')' ||
  CASE WHEN in_archive > total_recorded THEN chr(10) || 'body omitted ' || (in_archive - total_recorded) || ' — in the archive, not replayable' {_KINDS} ELSE '' END ||
  CASE WHEN NOT complete THEN chr(10) || 'bodyless ' || bodyless_n || ' — seen only as 304, replay cannot recover' || CASE WHEN bodyless_n > 0 THEN chr(10) || array_to_string(list_transform(list_slice(bodyless_urls, 1, 5), lambda u: '  ' || u), chr(10)) ELSE '' END ELSE '' END ||
  chr(10) || 'failed 0  incomplete 0  body ' || CASE WHEN s.total_body_bytes >= 1048576 THEN printf('%.1fMB', s.total_body_bytes / 1048576.0) ELSE CAST(floor(s.total_body_bytes / 1024.0 + 0.5) AS BIGINT) || 'KB' END || chr(10) || 'complete = ' || complete AS report
  FROM stats s JOIN complete c ON s.task_id = c.task_id JOIN sampled m ON s.task_id = m.task_id""")
def archive_trace(spark, d):
    return recorder.trace_lines(recorder.task_report(_folded(spark, d)))


_SEEN = "CASE seq % 4 WHEN 0 THEN 'https://x.doubleclick.net/a' WHEN 1 THEN 'https://www.facebook.com/tra?b' ELSE url END"


@query(f"""WITH {S.EXCHANGES}, e AS (SELECT task_id, seq, {_SEEN} AS url FROM exchanges)
  SELECT task_id, seq, url, (url LIKE 'https://%.example.net/p/1' OR url LIKE '%://h1%.com/%' OR url LIKE '%://%.doubleclick.net/%' OR url LIKE '%://%.facebook.com/tr%') AS blocked FROM e""")
def block_list(spark, d):
    e = tables.exchanges(spark, d).withColumn("url", F.expr(_SEEN))
    globs = ["https://*.example.net/p/1", "*://h1*.com/*", *recorder.BLOCK_GLOBS]
    return e.select("task_id", "seq", "url", url.matches_any(F.col("url"), globs).alias("blocked"))


#: A block-list of its own pattern for every order: some name a page, some a host, a path or an ending, some nothing.
_GLOBS = """SELECT CASE o_orderkey % 6 WHEN 0 THEN '*/en/' || (o_orderkey % 5000) WHEN 1 THEN 'http*.org/*/' || (o_orderkey % 5000) || '*' WHEN 2 THEN '*://m.*/' || (o_orderkey % 700) WHEN 3 THEN '*example.' || (o_orderkey % 9) || '*'
  WHEN 4 THEN 'https://*.net/fr/*' || (o_orderkey % 1000) ELSE '*utm_source=' || o_orderkey END AS pattern FROM orders"""


@query(f"""WITH g AS (SELECT DISTINCT replace(replace(pattern, '_', '!_'), '*', '%') AS p FROM ({_GLOBS}) UNION SELECT '%s') SELECT page_id, url, (SELECT count(*) FROM g WHERE url LIKE p ESCAPE '!') AS n_patterns FROM pages""")
def block_table(spark, d):
    """How many patterns of a large list match each page's url, without looking at the list for each."""
    from captureq.operators import blocklist

    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    kinds = [
        F.concat(F.lit("*/en/"), text(k % 5000)), F.concat(F.lit("http*.org/*/"), text(k % 5000), F.lit("*")), F.concat(F.lit("*://m.*/"), text(k % 700)), F.concat(F.lit("*example."), text(k % 9), F.lit("*")),
        F.concat(F.lit("https://*.net/fr/*"), text(k % 1000)), F.concat(F.lit("*utm_source="), text(k)),
    ]
    pattern = F.get(F.array(*kinds), (k % 6).cast("int"))
    listed = tables.table(spark, d, "orders").select(pattern.alias("pattern")).unionByName(spark.createDataFrame([("*s",)], "pattern string"))
    return blocklist.blocked_urls(tables.table(spark, d, "pages").select("page_id", "url"), listed)


@query(f"WITH {S.EXCHANGES} SELECT task_id, seq, mime, (mime LIKE 'video/%' OR mime LIKE 'image/p%') AS skipped FROM exchanges")
def mime_skip(spark, d):
    e = tables.exchanges(spark, d)
    return e.select("task_id", "seq", "mime", recorder.mime_skipped(F.col("mime"), ["video/", "image/p"]).alias("skipped"))


_REASONS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in text.RECORDER_REASONS.items())
_ERRORS = " ".join(f"WHEN {k} THEN ': {v}'" for k, v in text.ERROR_REASONS.items())


@query(f"WITH {S.EXCHANGES} SELECT DISTINCT status, coalesce(CASE status {_REASONS} END, 'OK') AS recorded_reason, 'HTTP ' || status || coalesce(CASE status {_ERRORS} END, '') AS error_message FROM exchanges")
def status_text(spark, d):
    e = tables.exchanges(spark, d).select("status").distinct()
    return e.select("status", text.recorder_reason(F.col("status"), F.lit("")).alias("recorded_reason"), text.http_error_message(F.col("status"), F.lit("")).alias("error_message"))


@query(f"""WITH {S.EXCHANGES}, x AS (SELECT * FROM exchanges WHERE status IN (200, 304)), r AS (SELECT task_id AS id, url AS key, date AS at FROM exchanges WHERE seq = 1),
  n AS (SELECT r.id, x.task_id * 100 + x.seq AS ref, abs(epoch_ms(x.date) - epoch_ms(r.at)) AS gap_ms, row_number() OVER (PARTITION BY r.id ORDER BY abs(epoch_ms(x.date) - epoch_ms(r.at)), x.date, x.task_id * 100 + x.seq) AS k FROM r JOIN x ON x.url = r.key)
  SELECT id, ref, gap_ms FROM n WHERE k = 1
  UNION ALL SELECT id, NULL, NULL FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.url = r.key)""")
def replay_nearest(spark, d):
    e = tables.exchanges(spark, d)
    asked = e.filter("seq = 1").select(F.col("task_id").alias("id"), F.col("url").alias("key"), F.col("date").alias("at"))
    index = e.filter(F.col("status").isin(200, 304)).select(F.col("url").alias("key"), F.col("date").alias("at"), (F.col("task_id") * 100 + F.col("seq")).alias("ref"))
    return replay.nearest(asked, index)


# Pages


@query(f"SELECT page_id, {S.SURT.format('url')} AS surt FROM pages")
def surt_keys(spark, d):
    return tables.table(spark, d, "pages").select("page_id", url.surt(F.col("url")).alias("surt"))


@query(f"SELECT page_id, {S.HOST.format('url')} AS host, CASE WHEN {S.REST.format('url')} LIKE '/%' THEN {S.REST.format('url')} ELSE '/' || {S.REST.format('url')} END AS target, list_extract(string_split(url, '/'), -1) AS basename, regexp_matches(url, '^https?://') AS web FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return tables.table(spark, d, "pages").select("page_id", url.host(u).alias("host"), url.request_target(u).alias("target"), url.basename(u).alias("basename"), url.is_web(u).alias("web"))


@query("SELECT page_id, 'sha256:' || sha256(html) AS digest FROM pages")
def payload_digest_hex(spark, d):
    return tables.table(spark, d, "pages").select("page_id", digest.sha256_hex(F.col("html")).alias("digest"))


@query(f"SELECT page_id, 'sha256:' || {S.BASE32.format('h')} AS digest FROM (SELECT page_id, sha256(html) AS h FROM pages)")
def payload_digest_b32(spark, d):
    return tables.table(spark, d, "pages").select("page_id", digest.sha256_base32(F.col("html")).alias("digest"))


@query(f"""SELECT page_id, {S.SURT.format('url')} || ' ' || strftime(make_timestamp((1704067200 + page_id * 60) * 1000000), '%Y%m%d%H%M%S') || ' {{"url":"' || url || '","mime":"text/html","status":"200","digest":"sha256:' || CASE WHEN page_id % 4 = 0 THEN '{digest.EMPTY_SHA256}' ELSE {S.BASE32.format('h')} END ||
  '","length":"' || strlen(html) || '","offset":"' || (page_id * 1000) || '","filename":"data.warc.gz"}}' AS line FROM (SELECT *, sha256(html) AS h FROM pages)""")
def cdxj_lines(spark, d):
    p = tables.page_times(spark, d)
    ts = url.cdx_timestamp(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    line = replay.cdxj_line(F.col("url"), ts, F.lit("text/html"), F.lit(200), F.when(F.col("page_id") % 4 != 0, digest.sha256_base32(F.col("html"))), F.octet_length("html"), F.col("page_id") * 1000, F.lit("data.warc.gz"))
    return p.select("page_id", line.alias("line"))


_TAGS = """tags AS (SELECT page_id, url, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>') AS t FROM pages)),
raw AS (SELECT page_id, pos, url, regexp_extract(tag, '(?is)^<a\\s[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS h, regexp_replace(regexp_extract(tag, '(?is)^<a\\s[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g') AS x FROM tags),
anchors AS (SELECT page_id, pos, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN h ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || h END AS href, substr(trim(x), 1, 200) AS text FROM raw)"""


_PATH = r"regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
_SITE = r"regexp_extract(url, '^([^:]+://[^/?#]*)', 1)"
#: What tables.rich_pages resolves relative targets against: a base of its own on every third page.
_BASE_PATH = f"CASE WHEN page_id % 3 = 1 THEN '/b/c' ELSE {_PATH} END"
_FOLDER = f"{_SITE} || regexp_replace({_BASE_PATH}, '/[^/]*$', '') || '/'"
#: The links that tables.rich_pages adds behind a page's own.
_LINKS = f"""{_TAGS}, links AS (SELECT page_id, pos, href, text, CAST(NULL AS VARCHAR) AS rel FROM anchors
  UNION ALL SELECT p.page_id, i + (SELECT count(*) FROM tags t WHERE t.page_id = p.page_id), CASE i WHEN 0 THEN {_SITE} || regexp_replace({_BASE_PATH}, '/[^/]*/[^/]*$', '') || '/up/x?a=1&b=2'
    WHEN 1 THEN 'http://[bad' WHEN 2 THEN CASE WHEN page_id % 3 = 1 THEN {_SITE} || '/b/c' ELSE regexp_replace(url, '#.*$', '') END || '#f' WHEN 3 THEN {_SITE} || '/un' ELSE {_FOLDER} || 'long' END, text, rel
    FROM pages p, (VALUES (0, 'Up', 'nofollow'), (1, 'Bad', NULL), (2, 'Q', 'me noopener'), (3, 'Unpaired <b>', NULL), (4, 'Long', NULL)) v(i, text, rel))"""


@query(f"WITH {_LINKS} SELECT * FROM links")
def link_extract(spark, d):
    return links.anchors(tables.rich_pages(spark, d))


@query(f"WITH {_LINKS} SELECT page_id, pos, href, text, rel FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS n FROM links WHERE regexp_matches(href, '^https?://[^\\[]')) WHERE n = 1")
def link_dedup_first(spark, d):
    return links.outbound_links(tables.rich_pages(spark, d))


@query(f"""SELECT page_id, CAST(to_json([{_FOLDER} || 'a.png', {_SITE} || '/b.png', {_FOLDER} || 'c.png', {_FOLDER} || 'd.png', {_FOLDER} || 'v.mp4', regexp_extract(url, '^([^:]+:)', 1) || '//cdn.example/p.png']) AS VARCHAR) AS candidates FROM pages""")
def responsive_candidates(spark, d):
    return _as_json(links.responsive_candidates(tables.rich_pages(spark, d)), "candidates")


@query("SELECT page_id, coalesce(nullif(trim(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')), ''), url) AS title FROM pages")
def page_titles(spark, d):
    return links.titles(tables.table(spark, d, "pages"))


@query("""SELECT page_id, CASE WHEN len(kept) > 0 THEN stem || '?' || array_to_string(kept, '&') ELSE stem END AS fuzzy_url FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS stem,
  list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('utm_source', 'ref')) AS kept FROM pages)""")
def replay_fuzzy(spark, d):
    return replay.fuzzy_groups(tables.table(spark, d, "pages"), ["utm_source", "ref"])


_REGISTRY = [("example.com", 1, "scroll"), ("example.com", 2, "play"), ("example.net", 1, "fetch"), ("www.example.com", 1, "own")]


@query(f"""WITH reg(host, ord, behavior) AS (VALUES {", ".join(str(r) for r in _REGISTRY)}), k AS (SELECT page_id, {S.HOST.format('url')} AS h FROM pages),
  keys AS (SELECT page_id, 0 AS rank, h AS host FROM k UNION ALL SELECT page_id, 1, s FROM (SELECT page_id, h, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS s FROM k) WHERE s <> h)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY rank, ord) AS pos, behavior FROM keys JOIN reg USING (host)""")
def host_behaviors(spark, d):
    registry = spark.createDataFrame(_REGISTRY, "host string, ord int, behavior string")
    return behaviors.host_behaviors(tables.table(spark, d, "pages"), F.broadcast(registry))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'OneTrust' WHEN 1 THEN 'InsitesCookieConsent' WHEN 2 THEN 'Klaro' ELSE 'Sourcepoint' END AS framework,
  CASE page_id % 4 WHEN 0 THEN '["#onetrust-banner-sdk"]' WHEN 1 THEN '[".cc-window"]' WHEN 2 THEN '[".klaro"]' ELSE '["[id^=\\"sp_message_container\\"]"]' END AS removed FROM pages""")
def consent_banners(spark, d):
    return _as_json(links.consent_banners(tables.rich_pages(spark, d)), "removed")


# Tasks


@query(f"""WITH {S.TASKS}, t AS (SELECT task_id, {S.NAME_ERROR.format("trim(label)")} AS label_error, CASE WHEN correlation_id <> '' THEN {S.NAME_ERROR.format("correlation_id")} END AS correlation_error FROM tasks)
  SELECT *, label_error IS NULL AND correlation_error IS NULL AS valid FROM t""")
def task_validation(spark, d):
    return tasks.validated(tables.tasks(spark, d))


@query(f"""WITH {S.TASKS} SELECT task_id, CASE WHEN url = '' THEN 'url is required' WHEN retry_count = 2 THEN 'signing requires captureFormats.wacz' ELSE {S.NAME_ERROR.format("trim(label)")} END AS error, retry_count = 2 AS require_signature FROM tasks""")
def request_resolution(spark, d):
    t = tables.tasks(spark, d).withColumns({"labels": F.array("label"), "formats": F.struct(F.lit(True).alias("png"), (F.col("retry_count") == 1).alias("wacz")), "signing": F.col("retry_count") == 2})
    return tasks.resolve_request(t).select("task_id", "error", "require_signature")


@query(f"WITH {S.TASKS} SELECT task_id, task_id || CASE WHEN correlation_id <> '' THEN '_' || correlation_id ELSE '' END || CASE WHEN label <> '' THEN '_' || label ELSE '' END || '.png' AS filename FROM tasks")
def artifact_filename(spark, d):
    return tasks.artifact_names(tables.tasks(spark, d), "png")


@query(f"WITH {S.TASKS} SELECT task_id, CASE WHEN status = 'success' THEN 'succeeded' WHEN retry_count < 2 THEN 'requeued' ELSE 'failed' END AS outcome, CASE WHEN status <> 'success' AND retry_count < 2 THEN retry_count + 1 ELSE retry_count END AS next_retry FROM tasks")
def retry_outcome(spark, d):
    return tasks.retry_outcome(tables.tasks(spark, d))


@query(f"WITH {S.TASKS}, c AS (SELECT task_id, {S.ERROR_TYPE} AS error_type, CASE WHEN {S.ERROR_TYPE} = 'timeout' THEN CAST(nullif(regexp_extract(message, '(\\d+)\\s*ms\\s+exceeded', 1), '') AS INTEGER) END AS timeout_ms FROM tasks) SELECT *, CASE WHEN error_type = 'timeout' THEN 'timeout' ELSE 'failed' END AS status FROM c")
def error_classify(spark, d):
    return tasks.classified_errors(tables.tasks(spark, d))


@query(f"WITH {S.TASKS} SELECT task_id, url, row_number() OVER (PARTITION BY url ORDER BY enqueued_at, task_id) > 1 AS rejected FROM tasks")
def duplicate_url_reject(spark, d):
    return tasks.duplicate_urls(tables.tasks(spark, d))


_ADMISSION = f"""WITH {S.TASKS}, t AS (SELECT *, {S.NAME_ERROR.format("trim(label)")} IS NOT NULL OR correlation_id <> '' AND {S.NAME_ERROR.format("correlation_id")} IS NOT NULL AS bad FROM tasks),
  h AS (SELECT url, min({{'a': enqueued_at, 'b': task_id}}) AS first FROM t WHERE NOT bad AND status <> 'success' GROUP BY url)
  SELECT task_id, CASE WHEN bad THEN 400 WHEN {{closed}} THEN 503 WHEN first < {{'a': enqueued_at, 'b': task_id}} THEN 409 ELSE 202 END AS http_status FROM t LEFT JOIN h USING (url)"""


@query(_ADMISSION.replace("{closed}", "false"))
def admission(spark, d):
    return tasks.admission(tables.tasks(spark, d), 3, F.col("status") == "success")


@query(_ADMISSION.replace("{closed}", "true"))
def admission_closed(spark, d):
    return tasks.admission(tables.tasks(spark, d), 0, F.col("status") == "success")


@query(f"WITH {S.TASKS} SELECT count(*) FILTER (status <> 'success' AND retry_count < 2) AS pending, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status <> 'success' AND retry_count >= 2) AS failed, count(*) AS total FROM tasks")
def queue_status(spark, d):
    return tasks.queue_counts(tables.tasks(spark, d))


@query(f"WITH {S.TASKS} SELECT task_id, url FROM tasks WHERE status <> 'success' ORDER BY enqueued_at, task_id LIMIT 50")
def pending_peek(spark, d):
    return tasks.pending_head(tables.tasks(spark, d))


@query(f"WITH {S.TASKS}, t AS (SELECT *, status = 'success' AS ok, retry_count >= 2 AS final, {S.ERROR_TYPE} = 'connection' AS lost FROM tasks) SELECT worker_index, count(*) FILTER (ok OR final) AS processed, count(*) FILTER (NOT ok AND (final OR lost)) AS errors FROM t GROUP BY worker_index")
def worker_counters(spark, d):
    return tasks.worker_counters(tables.tasks(spark, d))


@query(f"WITH {S.TASKS} SELECT worker_index, pos, task_id, message FROM (SELECT *, row_number() OVER (PARTITION BY worker_index ORDER BY enqueued_at DESC, task_id DESC) AS pos FROM tasks WHERE status <> 'success') WHERE pos <= 10")
def worker_error_history(spark, d):
    return tasks.error_history(tables.tasks(spark, d))


@query(f"WITH {S.TASKS} SELECT url, min(task_id) AS first_seq, arg_max(status, task_id) AS status FROM tasks GROUP BY url ORDER BY first_seq DESC, url LIMIT 1000")
def result_cache(spark, d):
    return tasks.result_cache(tables.tasks(spark, d), "url", "task_id", "status", 1000)


@query("WITH q AS (SELECT DISTINCT l_orderkey AS task_id FROM lineitem) SELECT task_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = task_id AND o_orderstatus = 'F') THEN 200 WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = task_id) THEN 202 ELSE 404 END AS http_status FROM q")
def capture_lookup(spark, d):
    t = tables.tasks(spark, d)
    asked = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id")).distinct()
    return tasks.lookups(asked, t.filter("status = 'success'"), t)


@query(f"WITH {S.TASKS} SELECT task_id, greatest(0, epoch_ms(TIMESTAMP '1996-01-01 00:00:00') - epoch_ms(enqueued_at)) AS age_ms FROM tasks")
def task_ages(spark, d):
    return tasks.ages(tables.tasks(spark, d), "1996-01-01 00:00:00")


#: The event log as a log of attempts: purchases succeed, views and clicks may be tried again, the rest fails for good.
_LOG = "SELECT user_id AS task_id, event_id AS seq, ts AS tick, event_type = 'purchase' AS succeeded, event_type IN ('view', 'click') AS retryable FROM events"
_ATTEMPTS = f"""log AS ({_LOG}), told AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS k FROM log),
  fold AS (SELECT task_id, k, seq, 0 AS attempt, tick AS enqueued_at, succeeded, retryable FROM told WHERE k = 1
    UNION ALL SELECT t.task_id, t.k, t.seq, CASE WHEN again THEN f.attempt + 1 ELSE 0 END, CASE WHEN again THEN f.enqueued_at ELSE t.tick END, t.succeeded, t.retryable
      FROM (SELECT *, NOT succeeded AND retryable AND attempt < 2 AS again FROM fold) f JOIN told t ON t.task_id = f.task_id AND t.k = f.k + 1),
  branched AS (SELECT *, CASE WHEN succeeded THEN 'success' WHEN NOT retryable THEN 'failed' WHEN attempt < 2 THEN 'retry' ELSE 'exhausted' END AS branch FROM fold)"""


def _attempts(spark, d):
    e = tables.table(spark, d, "events")
    kind = F.col("event_type")
    log = e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (kind == "purchase").alias("succeeded"), kind.isin("view", "click").alias("retryable"))
    return tasks.attempts(log)


@query(f"""WITH RECURSIVE {_ATTEMPTS} SELECT task_id, seq, CAST(attempt AS BIGINT) AS attempt, epoch_us(enqueued_at) // 1000 AS enqueued_ms, branch, CAST(count(*) FILTER (branch = 'retry') OVER w AS BIGINT) AS retry_n, CAST(count(*) FILTER (branch = 'exhausted') OVER w AS BIGINT) AS exhausted_n,
  CAST(count(*) FILTER (branch = 'failed') OVER w AS BIGINT) AS failed_n FROM branched WINDOW w AS (PARTITION BY task_id ORDER BY seq)""")
def task_attempts(spark, d):
    """Attempts by windows; the SQL walks each task's log row by row."""
    return _attempts(spark, d).withColumn("enqueued_ms", F.unix_millis(F.col("enqueued_at").cast("timestamp"))).drop("enqueued_at")


@query(f"""WITH RECURSIVE {_ATTEMPTS} SELECT task_id, seq, CAST(attempt AS BIGINT) AS attempt, CASE attempt WHEN 0 THEN 700 WHEN 1 THEN 1400 ELSE 2500 END AS delay_ms FROM branched WHERE branch IN ('retry', 'exhausted')""")
def backoff_schedule(spark, d):
    """How long each attempt that did not go well is waited for: doubled from 700 ms, at most 2500."""
    waits = _attempts(spark, d).filter(F.col("branch").isin("retry", "exhausted"))
    return tasks.backoff(waits, F.col("attempt"), 700, 2500, carry=["task_id", "seq"])


@query(f"""WITH {S.TASKS} SELECT task_id, '{{"taskId":"' || task_id || '"' || CASE WHEN correlation_id <> '' THEN ',"correlationId":"' || correlation_id || '"' ELSE '' END || ',"labels":["' || label || '"],"url":"' || url || '","status":"' || status || '"}}' AS report FROM tasks""")
def report_json(spark, d):
    return tasks.report_json(tables.tasks(spark, d))


# Events


@query(f"WITH {S.PAIRED} SELECT * FROM paired")
def exchange_pairing(spark, d):
    return events.paired_exchanges(tables.net_events(spark, d))


@query(f"WITH {S.PAIRED} SELECT outcome, count(*) AS n, CAST(sum(encoded_length) AS BIGINT) AS encoded FROM paired GROUP BY outcome")
def exchange_outcomes(spark, d):
    return events.paired_exchanges(tables.net_events(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("encoded_length").alias("encoded"))


@query(f"WITH {S.EVENTS} SELECT request_id, seq, hop FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS hop FROM ev WHERE kind IN ('requestWillBeSent', 'redirect')) WHERE kind = 'redirect'")
def redirect_chain(spark, d):
    from pyspark.sql import Window

    hops = tables.net_events(spark, d).filter(F.col("kind").isin(*events.OPENING)).withColumn("hop", F.row_number().over(Window.partitionBy("request_id").orderBy("seq")).cast("long"))
    return hops.filter("kind = 'redirect'").select("request_id", "seq", "hop")


@query(f"WITH {S.EVENTS}, h AS (SELECT *, kind <> 'loadingFailed' AS healthy FROM ev) SELECT request_id, seq, healthy FROM (SELECT *, lag(healthy) OVER w AS prev, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY request_id ORDER BY seq)) WHERE n = 1 OR healthy IS DISTINCT FROM prev")
def health_flips(spark, d):
    return events.flips(tables.net_events(spark, d).withColumn("healthy", F.col("kind") != "loadingFailed"), "request_id", "seq", "healthy")


@query("""WITH a AS (SELECT user_id AS member, bool_or(event_type = 'purchase') AS busy FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT DISTINCT user_id AS member FROM events WHERE event_id % 3 = 0)
  SELECT coalesce(a.member, b.member) AS member, CASE WHEN a.member IS NOT NULL AND b.member IS NOT NULL THEN 'survives' WHEN b.member IS NOT NULL THEN 'added' WHEN busy THEN 'draining' ELSE 'retired' END AS fate FROM a FULL JOIN b ON a.member = b.member""")
def membership_diff(spark, d):
    e = tables.table(spark, d, "events").withColumnRenamed("user_id", "member")
    now = e.filter("event_id % 2 = 0").groupBy("member").agg(F.max(F.col("event_type") == "purchase").alias("busy"))
    return events.membership(now, e.filter("event_id % 3 = 0"), "member", "busy")


@query(f"WITH {S.EVENTS}, r AS (SELECT request_id AS run, seq, encoded_length AS ms, CAST(coalesce(sum(encoded_length) OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM ev) SELECT *, spent_before < 300000 AS ran FROM r")
def behavior_cutoff(spark, d):
    e = tables.net_events(spark, d).select(F.col("request_id").alias("run"), "seq", F.col("encoded_length").alias("ms"))
    return behaviors.deadline_cut(e, 300_000)


@query("SELECT p_type AS area, count(*) FILTER (p_size <= 25) AS supported, count(*) FILTER (p_size < 50) AS total FROM part GROUP BY p_type")
def spec_coverage(spark, d):
    """Parts as the items of a standard, by type: small ones are supported, the largest are outside of it."""
    size = F.col("p_size")
    state = F.when(size <= 25, "full").when(size < 40, "partial").when(size < 50, "unused").otherwise("outside")
    return requests.spec_coverage(tables.table(spark, d, "part").select(F.col("p_type").alias("area"), state.alias("state")))


# Archives


@query("SELECT page_id, url, sha256(html) AS payload_sha256 FROM pages")
def warc_roundtrip(spark, d):
    from captureq.sources import archive

    out = archive.read_warcs(archive.page_packages(tables.page_times(spark, d), packages=False))
    return out.select("page_id", "url", F.sha2("payload", 256).alias("payload_sha256"))


@query("SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(200 AS INTEGER) AS status, sha256(html) AS payload_sha256 FROM pages")
def wacz_roundtrip(spark, d):
    from captureq.sources import archive

    out = archive.read_packages(archive.page_packages(tables.page_times(spark, d)))
    return out.select("page_id", "url", "title", "status", F.sha2("payload", 256).alias("payload_sha256"))


#: Limits of the folded exchanges: bytes of a response as the network counts them, stored bytes of a task.
_RESPONSE_CAP, _TASK_CAP = 60_000, 3_000
_WHY_OMITTED = f"""CASE WHEN request_id % 3 = 0 THEN 'content-type' WHEN {{0}} >= {_TASK_CAP} THEN 'task-cap' WHEN encoded_length > {_RESPONSE_CAP} THEN 'too-large' WHEN {{0}} + body > {_TASK_CAP} THEN 'task-cap' END"""
_ENDED = S.PAIRED.replace("arg_min(kind, seq) AS opened_by,", "arg_min(kind, seq) AS opened_by, min(CASE WHEN kind IN ('loadingFinished', 'loadingFailed') THEN seq END) AS end_seq,").replace("AS outcome, encoded_length\n", "AS outcome, encoded_length, end_seq\n")


@query(f"""WITH RECURSIVE {_ENDED}, x AS (SELECT *, request_id // 16 AS task_id, request_id % 7 = 3 AS blocked, encoded_length % 997 AS body FROM paired),
  d AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY end_seq) AS k FROM x WHERE outcome = 'recorded' AND NOT blocked),
  fold AS (SELECT task_id, k, request_id, round, reason, CASE WHEN reason IS NULL THEN body ELSE 0 END AS total FROM (SELECT *, {_WHY_OMITTED.format("0")} AS reason FROM d WHERE k = 1)
    UNION ALL SELECT task_id, k, request_id, round, reason, prior + CASE WHEN reason IS NULL THEN body ELSE 0 END FROM (SELECT d.*, f.total AS prior, {_WHY_OMITTED.format("f.total").replace("request_id", "d.request_id")} AS reason FROM fold f JOIN d ON d.task_id = f.task_id AND d.k = f.k + 1))
  SELECT x.task_id, CAST(x.request_id AS VARCHAR) AS request_id, x.round, opened_at, CASE WHEN blocked THEN 'blocked' ELSE outcome END AS outcome, CASE WHEN blocked THEN NULL WHEN outcome = 'redirected' THEN 302 WHEN responded THEN 200 END AS status,
    CASE WHEN outcome = 'recorded' AND NOT blocked AND reason IS NULL THEN body END AS body_bytes, CASE WHEN outcome IN ('recorded') AND NOT blocked THEN reason WHEN outcome = 'redirected' AND NOT blocked AND responded AND x.request_id % 3 = 0 THEN 'content-type' END AS skip_reason
  FROM x LEFT JOIN fold ON fold.request_id = x.request_id AND fold.round = x.round""")
def exchange_fold(spark, d):
    """Every exchange of the event log, through the keyed state machine: blocks, skips, byte budgets of each task."""
    from captureq.streaming import recorder
    from captureq.streaming.exchanges import Options

    rid, size = F.col("request_id"), F.col("encoded_length")
    finished = F.col("kind") == "loadingFinished"
    responded = F.col("kind") == "responseReceived"
    none = F.lit(None).cast("string")
    e = tables.net_events(spark, d).select(
        F.floor(rid / 16).cast("long").alias("task_id"), "seq", F.col("ts").cast("timestamp").alias("captured_at"), "kind", rid.cast("string").alias("request_id"), F.concat(F.lit("https://h"), (rid % 7).cast("string"), F.lit(".example/"), rid.cast("string")).alias("url"),
        F.lit("GET").alias("method"), none.alias("resource_type"), F.lit(None).cast("map<string,string>").alias("headers"), F.when(responded, 200).alias("status"), none.alias("status_text"),
        F.when(rid % 3 == 0, "video/mp4").otherwise("text/html").alias("mime"), none.alias("ip"), size.alias("encoded_length"), F.when(finished, F.repeat(F.lit("x"), (size % 997).cast("int"))).cast("binary").alias("body"), none.cast("binary").alias("request_body"),
        none.alias("error_text"), F.lit(None).cast("boolean").alias("canceled"), none.alias("blocked_reason"),
    )
    limits = Options(block=["https://h3.*"], skip_mime=["video/"], max_response=_RESPONSE_CAP, max_task=_TASK_CAP)
    return recorder.settle(e, limits).select("task_id", "request_id", "round", "opened_at", "outcome", "status", "body_bytes", "skip_reason")


# Records of settled exchanges

_RECORD_ID = """'<urn:uuid:' || (SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', h[17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(task_id || '/' || request_id || '/' || round || '/{0}')) AS h)) || '>'"""
_SETTLED = f"""{S.PAIRED}, settled AS (SELECT request_id // 16 AS task_id, request_id, round, opened_at, outcome, encoded_length, 'https://H.example:8443/r?i=' || request_id AS url, CASE WHEN request_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN request_id % 3 = 0 THEN 'Image' END AS kind, CASE WHEN outcome = 'redirected' THEN 302 WHEN responded THEN 200 END AS status,
  CASE WHEN outcome = 'recorded' THEN CASE encoded_length % 7 WHEN 0 THEN 'too-large' WHEN 1 THEN 'content-type' WHEN 2 THEN 'task-cap' END END AS skip FROM paired)"""
_PAIR = "outcome IN ('recorded', 'redirected')"
_MISSING = "CASE outcome WHEN 'no-response' THEN 'loadingFinished-without-response' WHEN 'failed' THEN 'loadingFailed' WHEN 'incomplete' THEN 'stop-while-pending' END"
_WHY = f"""'incomplete=true;reason=' || {_MISSING} || CASE WHEN outcome <> 'failed' THEN ';requestId=' || request_id ELSE ';errorText=net::ERR_FAILED;canceled=' || (request_id % 2 = 0) END || CASE WHEN outcome <> 'no-response' THEN ';method=' || method ELSE '' END
  || coalesce(';resourceType=' || kind, '') || CASE WHEN outcome = 'failed' THEN CASE WHEN request_id % 5 = 0 THEN ';blockedReason=inspector' ELSE '' END || coalesce(';status=' || status, '') ELSE '' END"""
_CRLF = "chr(13) || chr(10)"
_OWN = "CASE WHEN outcome = 'recorded' THEN 'Set-Cookie: a=1' || {0} || 'Set-Cookie: b=2' || {0} || 'Content-Length: ' || CASE WHEN skip IS NULL THEN encoded_length ELSE 0 END ELSE 'Content-Length: 9' || {0} || 'Set-Cookie: a=1' || {0} || 'Set-Cookie: b=2' END".format(_CRLF)


@query(f"""WITH {_SETTLED} SELECT task_id, request_id, round, 0 AS pos, 'response' AS kind, {_RECORD_ID.format("response")} AS record_id, {_RECORD_ID.format("request")} AS concurrent_to, CAST(NULL AS VARCHAR) AS refers_to,
    CASE WHEN skip IN ('too-large', 'task-cap') THEN 'length' END AS truncated, 'HTTP/1.1 ' || status || CASE status WHEN 302 THEN ' Found' ELSE ' OK' END || {_CRLF} || {_OWN} || {_CRLF} || {_CRLF} AS head, CAST(NULL AS VARCHAR) AS fields FROM settled WHERE {_PAIR}
  UNION ALL SELECT task_id, request_id, round, 1, 'request', {_RECORD_ID.format("request")}, {_RECORD_ID.format("response")}, NULL, NULL, method || ' /r?i=' || request_id || ' HTTP/1.1' || {_CRLF} || 'Accept: */*' || {_CRLF} || 'Host: h.example:8443' || {_CRLF} || {_CRLF}, NULL FROM settled WHERE {_PAIR}
  UNION ALL SELECT task_id, request_id, round, 2, 'metadata', {_RECORD_ID.format("metadata")}, NULL, {_RECORD_ID.format("response")}, NULL, NULL, 'truncated=' || skip || coalesce(';encodedDataLength=' || encoded_length, '') FROM settled WHERE {_PAIR} AND skip IS NOT NULL
  UNION ALL SELECT task_id, request_id, round, 0, 'metadata', {_RECORD_ID.format("metadata")}, NULL, NULL, NULL, NULL, {_WHY} FROM settled WHERE {_MISSING} IS NOT NULL""")
def exchange_records(spark, d):
    from captureq.operators import records

    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return records.exchange_records(tables.settled(spark, d)).withColumn("fields", fields)


_STAMP = "make_timestamp((1704067200 + opened_at) * 1000000)"
_DAY = f"strftime({_STAMP}, '%Y-%m-%dT%H:%M:%SZ')"


def _line(name: str, value: str) -> str:
    return f"coalesce('{name}: ' || {value} || {_CRLF}, '')"


_WARC = f"""'WARC/1.1' || {_CRLF} || {_line("WARC-Type", "kind")} || {_line("WARC-Record-ID", "record_id")} || {_line("WARC-Date", "day")} || {_line("WARC-Target-URI", "CASE WHEN kind IN ('response', 'request') THEN url END")}
  || {_line("WARC-Filename", "CASE WHEN kind = 'warcinfo' THEN 'data.warc.gz' END")} || {_line("Content-Type", "CASE WHEN kind IN ('response', 'request') THEN 'application/http;msgtype=' || kind ELSE 'application/warc-fields' END")} || {_line("Content-Length", "strlen(block)")}
  || {_line("WARC-Block-Digest", "'sha256:' || " + S.BASE32.format("sha256(block)"))} || {_line("WARC-Concurrent-To", "concurrent_to")} || {_line("WARC-IP-Address", "CASE WHEN kind = 'response' THEN ip END")}
  || {_line("WARC-Payload-Digest", "payload_digest")} || {_line("WARC-Truncated", "truncated")} || {_line("WARC-Target-URI", "CASE WHEN kind = 'metadata' THEN url END")} || {_line("WARC-Refers-To", "refers_to")} || {_CRLF} || block || {_CRLF} || {_CRLF}"""
#: Every record of every task's archive as text, with its place; all of it is ASCII.
_ARCHIVED = ORACLES["exchange_records"].replace("THEN encoded_length ELSE 0", "THEN encoded_length % 512 ELSE 0").replace("SELECT task_id, request_id, round, 0 AS pos", ", r AS (SELECT task_id, request_id, round, 0 AS pos", 1) + f"""),
a AS (SELECT r.*, opened_at, {_DAY} AS day, url, status, CASE WHEN request_id % 3 <> 0 THEN 'text/html' ELSE '' END AS mime, CASE WHEN request_id % 2 = 0 THEN '10.0.0.' || request_id % 256 END AS ip,
  CASE r.kind WHEN 'response' THEN CASE WHEN outcome = 'recorded' AND skip IS NULL THEN repeat(substr('0123456789abcdef', 1 + request_id % 16, 1), encoded_length % 512) ELSE '' END WHEN 'request' THEN CASE WHEN method = 'POST' THEN 'q=' || request_id END END AS payload
  FROM r JOIN (SELECT * EXCLUDE (kind) FROM settled) USING (task_id, request_id, round)),
b AS (SELECT *, CASE WHEN payload IS NOT NULL THEN 'sha256:' || {S.BASE32.format("sha256(payload)")} END AS payload_digest, CASE WHEN kind = 'metadata' THEN array_to_string(list_transform(string_split(fields, ';'), lambda f: replace(f, '=', ': ') || {_CRLF}), '') ELSE head || coalesce(payload, '') END AS block FROM a
  UNION ALL BY NAME SELECT task_id, -1 AS pos, 'warcinfo' AS kind, min(opened_at) AS opened_at, strftime(make_timestamp((1704067200 + min(opened_at)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS day, 'software: captureq' || {_CRLF} || 'format: WARC File Format 1.1' || {_CRLF} AS block,
  {_RECORD_ID.format("").replace("task_id || '/' || request_id || '/' || round || '/'", "task_id || '/info'")} AS record_id FROM settled GROUP BY task_id),
w AS (SELECT *, {_WARC} AS record FROM b),
places AS (SELECT *, strlen(record) AS length, row_number() OVER t AS seq, coalesce(CAST(sum(strlen(record)) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset" FROM w WINDOW t AS (PARTITION BY task_id ORDER BY pos >= 0, opened_at, request_id, round, pos)),
lines AS (SELECT task_id, seq, 'example,h)/r?i=' || request_id || ' ' || strftime({_STAMP}, '%Y%m%d%H%M%S') || ' {{"url":"' || url || '","mime":"' || mime || '","status":"' || status || '","digest":"' || payload_digest || '","length":"' || length || '","offset":"' || "offset" || '","filename":"data.warc.gz"}}' AS line
  FROM places WHERE kind = 'response')"""


@query(f"""{_ARCHIVED} SELECT task_id, seq, kind, "offset", length, sha256(record) AS record_sha256 FROM places""")
def task_archives(spark, d):
    """Archives of whole tasks, written as files and read back record by record."""
    from captureq.operators import archives
    from captureq.sources import files

    places = files.written(archives.placed(archives.warc_records(tables.archived(spark, d)), compress=False), "places")
    path = files.shared_folder(spark, "archives")
    files.write_files(archives.archive_files(places), path)
    asked = places.select(F.concat(F.col("task_id").cast("string"), F.lit("/" + archives.ARCHIVE)).alias("name"), "offset", "length", "task_id", "seq", "kind")
    return files.read_ranges(asked, path).select("task_id", "seq", "kind", "offset", "length", F.sha2("data", 256).alias("record_sha256"))


@query(f"{_ARCHIVED} SELECT task_id, line, row_number() OVER (ORDER BY line, task_id) AS n FROM lines")
def archive_index(spark, d):
    """All index lines, sorted over range partitions; their number is their place in the files, read back in order."""
    from captureq.operators import archives
    from captureq.sources import files

    lines = archives.sorted_index(archives.placed(archives.warc_records(tables.archived(spark, d)), compress=False))
    # Within a partition lines follow one another; a partition's first place is the number of lines in those before it.
    kept = files.written(lines.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "task_id", "line"), "index")
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("at").bitwiseAND((1 << 33) - 1)
    return kept.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("task_id", "line", (F.col("before") + inside + 1).alias("n"))


_COUNTS = ", ".join(f"count(*) FILTER (skip = '{r}') AS {n}" for n, r in (("skipped_content_type", "content-type"), ("truncated_too_large", "too-large"), ("truncated_task_cap", "task-cap")))
_FIRST = ", ".join(f"CAST(to_json(coalesce(list_slice(list(url ORDER BY opened_at, url) FILTER (skip = '{r}'), 1, 5), [])) AS VARCHAR) AS {n}_urls" for n, r in (("skipped_content_type", "content-type"), ("truncated_too_large", "too-large"), ("truncated_task_cap", "task-cap")))


@query(f"""WITH {_SETTLED}, s AS (SELECT * REPLACE (CASE WHEN request_id % 11 = 0 THEN 'blocked' ELSE outcome END AS outcome, CASE WHEN request_id % 11 <> 0 THEN skip END AS skip) FROM settled)
  SELECT task_id, count(*) FILTER ({_PAIR} AND skip IS NULL) AS total_recorded, count(*) FILTER (outcome = 'blocked') AS blocked, {_COUNTS}, count(*) FILTER (outcome IN ('failed', 'no-response')) AS failed, count(*) FILTER (outcome = 'incomplete') AS incomplete,
    CAST(coalesce(sum(CASE WHEN outcome = 'recorded' AND skip IS NULL THEN encoded_length END), 0) AS BIGINT) AS total_body_bytes, CAST(to_json(coalesce(list_slice(list(url ORDER BY opened_at, url) FILTER (outcome = 'blocked'), 1, 5), [])) AS VARCHAR) AS blocked_urls, {_FIRST} FROM s GROUP BY task_id""")
def recorder_counters(spark, d):
    from captureq.operators import records

    blocked = F.col("request_id") % 11 == 0
    s = tables.settled(spark, d).withColumns({"outcome": F.when(blocked, "blocked").otherwise(F.col("outcome")), "skip_reason": F.when(~blocked, F.col("skip_reason"))})
    return _as_json(records.recorder_counters(s), *[f"{k}_urls" for k in records.REJECTIONS])


_HEADED = """h AS (SELECT request_id, round, arg_max(seq, seq) FILTER (kind IN ('requestWillBeSent', 'redirect')) AS q0, max(seq) FILTER (kind = 'responseReceived' AND seq % 3 <> 0) AS r0, max(seq) FILTER (kind = 'responseReceived' AND seq % 3 = 0) AS r1 FROM live GROUP BY request_id, round)"""


@query(f"""WITH {S.PAIRED}, {_HEADED} SELECT request_id, round, 'seq=' || q0 AS request_headers, 'seq=' || coalesce(r1, r0) AS response_headers FROM h""")
def exchange_headers(spark, d):
    from captureq.operators import records

    e = tables.net_events(spark, d)
    # Every third response event is taken for the extra one, whichever comes first.
    extra = (F.col("kind") == "responseReceived") & (F.col("seq") % 3 == 0)
    e = e.withColumns({"kind": F.when(extra, records.EXTRA_RESPONSE).otherwise(F.col("kind")), "headers": F.create_map(F.lit("seq"), F.col("seq").cast("string"))})
    spelt = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return records.exchange_headers(e).withColumns({c: spelt(c) for c in ("request_headers", "response_headers")})


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 2 OR o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 AS active, CASE WHEN o_orderkey % 3 = 2 THEN '[\"Didomi\"]' ELSE '[]' END AS excluded, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 5000 ELSE 1000 END AS min_z, o_orderkey % 3 <> 2 OR o_orderkey % 2 = 0 AS use_defaults FROM orders")
def dismiss_specs(spark, d):
    k = F.col("o_orderkey")
    given = F.concat(F.lit('{"excludeFrameworks":["Didomi"],"useDefaults":'), (k % 2 == 0).cast("string"), F.lit(',"heuristic":{"minZIndex":'), (k % 5000).cast("string"), F.lit("}}"))
    spec = F.when(k % 3 == 2, given).when(k % 3 == 1, (k % 2 == 0).cast("string"))
    out = links.dismiss_options(tables.table(spark, d, "orders").select(k.alias("id"), F.parse_json(spec).alias("spec")))
    return _as_json(out.select("id", "active", "excluded", F.col("heuristic.min_z").alias("min_z"), "use_defaults"), "excluded")


@query(f"WITH {S.TASKS} SELECT task_id, 1 + task_id % 3 AS attempts, task_id % 3 = 2 AND task_id % 5 = 4 AS given_up FROM tasks")
def navigation_retries(spark, d):
    k = F.col("task_id")
    tries = tables.tasks(spark, d).select(k, F.explode(F.sequence(F.lit(0).cast("long"), k % 3)).alias("seq"))
    lost = (F.col("seq") < k % 3) | (k % 5 == 4)
    message = F.when(lost, "Protocol error: EXECUTION context was destroyed, most likely because of a navigation.")
    return events.navigation_retries(tries.withColumn("message", message), "task_id")


@query(f"WITH {S.TASKS} SELECT worker_index, string_agg(label, ',' ORDER BY label) AS key FROM (SELECT DISTINCT worker_index, label FROM tasks) GROUP BY worker_index")
def membership_keys(spark, d):
    return events.membership_key(tables.tasks(spark, d), "worker_index", "label")


# Workers and requests

from captureq.operators import requests, workers  # noqa: E402


@query(f"""WITH {S.EVENTS}, s AS (SELECT request_id, seq, CASE kind WHEN 'requestWillBeSent' THEN 'processing' WHEN 'responseReceived' THEN 'idle' WHEN 'loadingFailed' THEN 'error' WHEN 'redirect' THEN 'connecting' ELSE 'disconnected' END AS state FROM ev),
  l AS (SELECT request_id, arg_max(state, seq) AS state, count(*) AS events FROM s GROUP BY request_id)
  SELECT request_id, state, events, CASE state WHEN 'processing' THEN 'busy' WHEN 'idle' THEN 'ready' WHEN 'error' THEN 'error' WHEN 'connecting' THEN 'error' ELSE 'disconnected' END AS health, state IN ('processing', 'idle', 'error') AS settled FROM l""")
def worker_health(spark, d):
    kind = F.col("kind")
    state = F.when(kind == "requestWillBeSent", "processing").when(kind == "responseReceived", "idle").when(kind == "loadingFailed", "error").when(kind == "redirect", "connecting").otherwise("disconnected")
    last = workers.last_states(tables.net_events(spark, d).withColumn("state", state), "request_id", "seq", "state")
    return last.withColumns({"health": workers.health(F.col("state")), "settled": workers.settled(F.col("state"))})


@query(f"""WITH {S.EVENTS}, w AS (SELECT request_id, seq * 10 AS start_ms, seq * 10 + encoded_length % 5000 AS end_ms FROM ev),
  r AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY request_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms) AS reach FROM w)
  SELECT request_id, CAST(sum(greatest(0, end_ms - greatest(reach, start_ms))) AS BIGINT) AS paced_ms FROM r GROUP BY request_id""")
def paced_time(spark, d):
    w = tables.net_events(spark, d).select("request_id", (F.col("seq") * 10).alias("start_ms"), (F.col("seq") * 10 + F.col("encoded_length") % 5000).alias("end_ms"))
    return workers.paced_ms(w, "request_id")


@query(f"""WITH {S.TASKS}, o AS (SELECT task_id, worker_index AS op, task_id % 20000 AS elapsed_ms, task_id % 7000 AS injected_ms FROM tasks)
  SELECT task_id, op, elapsed_ms - injected_ms > 10000 AS op_timeout, sum(elapsed_ms) OVER (PARTITION BY task_id) > 15000 AS task_timeout FROM o""")
def deadlines(spark, d):
    o = tables.tasks(spark, d).select("task_id", F.col("worker_index").alias("op"), (F.col("task_id") % 20000).alias("elapsed_ms"), (F.col("task_id") % 7000).alias("injected_ms"))
    return workers.over_deadline(o, 10_000, 15_000)


@query(f"WITH {S.EVENTS}, p AS (SELECT request_id AS run, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS step, encoded_length % 3 AS y FROM ev), s AS (SELECT *, y = lag(y) OVER (PARTITION BY run ORDER BY step) AS same FROM p WHERE step <= 20) SELECT run, min(CASE WHEN same THEN step END) IS NOT NULL AS reached_bottom, coalesce(min(CASE WHEN same THEN step END), 20) AS steps FROM s GROUP BY run")
def scroll_coverage(spark, d):
    from pyspark.sql import Window

    e = tables.net_events(spark, d)
    step = F.row_number().over(Window.partitionBy("request_id").orderBy("seq")).cast("long")
    return workers.scroll_steps(e.select(F.col("request_id").alias("run"), step.alias("step"), (F.col("encoded_length") % 3).alias("y")), "run", 20)


@query(f"WITH RECURSIVE {S.COMPLETE} SELECT task_id, CASE WHEN complete THEN 'info' ELSE 'warn' END AS level, CASE WHEN NOT complete THEN bodyless_n END AS bodyless, CASE WHEN NOT complete THEN CAST(to_json(list_slice(bodyless_urls, 1, 5)) AS VARCHAR) END AS sample FROM complete")
def completeness_log(spark, d):
    return _as_json(workers.completeness_log(recorder.completeness(_folded(spark, d))), "sample")


@query(f"WITH {S.TASKS} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS accepted, count(*) FILTER (status <> 'success') AS rejected, max(task_id % 977) AS duration_ms FROM tasks")
def submit_summary(spark, d):
    return requests.submit_summary(tables.tasks(spark, d).select((F.col("status") == "success").alias("accepted"), (F.col("task_id") % 977).alias("ms")))


@query(f"WITH {S.TASKS}, b AS (SELECT worker_index AS index, arg_max(CASE WHEN status = 'success' THEN 'idle' ELSE 'error' END, task_id) AS state FROM tasks GROUP BY worker_index) SELECT (SELECT count(*) FROM tasks WHERE status <> 'success') AS queued, (SELECT max(greatest(0, epoch_ms(TIMESTAMP '1999-01-01 00:00:00') - epoch_ms(enqueued_at))) FROM tasks WHERE status <> 'success') AS oldest_ms, count(*) FILTER (state = 'idle') AS operational, bool_and(state = 'idle') AS all_healthy FROM b")
def status_snapshot(spark, d):
    t = tables.tasks(spark, d)
    state = F.when(F.col("status") == "success", "idle").otherwise("error")
    w = t.withColumn("state", state).groupBy(F.col("worker_index").alias("index")).agg(F.max_by("state", "task_id").alias("state"), F.max_by("message", "task_id").alias("last_error"))
    return workers.status_snapshot(t, w, "1999-01-01 00:00:00")


@query(f"""WITH {_TAGS}, c AS (SELECT page_id, href FROM anchors), seen AS (SELECT page_id, href FROM c WHERE strlen(href) % 3 = 0)
  SELECT page_id, count(DISTINCT href) AS candidates, count(DISTINCT href) FILTER (strlen(href) % 3 <> 0) AS never_requested FROM c GROUP BY page_id""")
def autofetch_candidates(spark, d):
    a = links.anchors(tables.table(spark, d, "pages"))
    c = a.groupBy("page_id").agg(F.collect_set("href").alias("candidates"))
    out = links.never_requested(c, a.filter(F.octet_length("href") % 3 == 0).select("page_id", F.col("href").alias("url")))
    return out.select("page_id", F.col("candidates").cast("long").alias("candidates"), F.col("never_requested").cast("long").alias("never_requested"))


@query(f"WITH {S.TASKS}, a AS (SELECT DISTINCT url FROM tasks WHERE task_id % 2 = 0), b AS (SELECT DISTINCT url FROM tasks WHERE task_id % 3 = 0) SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NOT NULL THEN 'claimed' ELSE 'emitted' END AS side FROM a FULL JOIN b ON a.url = b.url WHERE a.url IS NULL OR b.url IS NULL")
def set_differences(spark, d):
    t = tables.tasks(spark, d)
    return requests.set_difference(t.filter("task_id % 2 = 0"), t.filter("task_id % 3 = 0"), "url")


@query("""WITH RECURSIVE e AS (SELECT user_id AS page_id, event_id AS seq, event_type AS t, CAST(floor(value * 20) AS BIGINT) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  w AS (SELECT page_id, 0 AS k, 0 AS steps, CAST(0 AS BIGINT) AS y, CAST(NULL AS BIGINT) AS height FROM e GROUP BY page_id UNION ALL
    SELECT w.page_id, e.k, CASE WHEN go THEN steps + 1 ELSE steps END, CASE WHEN go THEN y + a ELSE y END, CASE WHEN t = 'purchase' THEN 8 * a ELSE height END
    FROM (SELECT *, steps < 12 AND NOT coalesce(y + 800 >= height, false) AS free FROM w) w JOIN e ON e.page_id = w.page_id AND e.k = w.k + 1, LATERAL (SELECT free AND t = 'view' AS go)),
  last AS (SELECT *, coalesce(y + 800 >= height, false) AS bottom FROM w WHERE (page_id, k) IN (SELECT (page_id, max(k)) FROM w GROUP BY page_id))
  SELECT page_id, CAST(k AS INTEGER) AS events, '{"coveredPx": ' || y || ', "exhausted": ' || (steps >= 12 AND NOT bottom) || ', "reachedBottom": ' || bottom || ', "steps": ' || steps || '}' AS decisions FROM last""")
def page_behaviors(spark, d):
    """The event log as what happens on pages: views scroll, purchases resize; each page is followed in order."""
    from captureq.streaming import page_events

    page_events.register(spark)
    e = tables.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "scroll").when(F.col("event_type") == "purchase", "resize").otherwise(F.col("event_type"))
    amount = F.floor(F.col("value") * 20).cast("long")
    rows = e.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "resize", 8 * amount).otherwise(amount).alias("amount"), F.lit(None).cast("string").alias("target"))
    rows.createOrReplaceTempView("_captureq_page_events")
    return spark.sql("""SELECT page_id, events, decisions FROM follow_pages(TABLE(_captureq_page_events), 'scroll', '{"scroll": {"maxSteps": 12}}')""")


@query(r"""WITH t AS (SELECT page_id, coalesce(html, '') AS h FROM pages), n AS (SELECT *, CAST((length(h) - length(replace(h, '<p', ''))) / 2 + (length(h) - length(replace(h, '<div', ''))) / 4 AS INTEGER) AS height,
    len(list_distinct(regexp_extract_all(h, '(?i)\ssrc\s*=\s*["'']([^"'']+)["'']', 1))) AS sources FROM t)
  SELECT page_id, 'autoscroll' AS behavior, least(3, height) AS steps, CAST(NULL AS VARCHAR) AS error, '{"reachedBottom": ' || (height <= 3) || ', "scrollSteps": ' || least(3, height) || '}' AS decisions FROM n
  UNION ALL SELECT page_id, 'autofetch', CAST(least(2000, sources) AS INTEGER), NULL, '{"candidates": ' || least(2000, sources) || '}' FROM n WHERE contains(h, 'src')""")
def behavior_runs(spark, d):
    from captureq.streaming import behaviors as run

    run.register(spark)
    tables.table(spark, d, "pages").createOrReplaceTempView("_captureq_pages")
    return spark.sql("SELECT p.page_id, r.* FROM _captureq_pages p, LATERAL run_behaviors(p.html, 'autoscroll,autofetch,none', '{\"autoscroll\": {\"maxSteps\": 3}}') r")
