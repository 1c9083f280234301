"""DuckDB text shared by the equivalents of several queries."""

EXCHANGES = """exchanges AS (
  SELECT l_orderkey AS task_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
    'https://h' || (l_orderkey % 97) || '.example.' || CASE WHEN l_linestatus = 'F' THEN 'com' ELSE 'net' END || '/p/' || (l_partkey % 5) AS url,
    CASE CAST(floor(l_quantity) AS BIGINT) % 10 WHEN 0 THEN 304 WHEN 1 THEN 302 WHEN 2 THEN 204 WHEN 3 THEN 404 ELSE 200 END AS status,
    CASE l_returnflag WHEN 'A' THEN 'text/html' WHEN 'N' THEN 'image/png' ELSE 'video/mp4' END AS mime, l_shipdate AS date,
    CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 10 = 2 THEN NULL WHEN CAST(floor(l_quantity) AS BIGINT) % 10 IN (0, 1) THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS body_bytes,
    CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 10 IN (0, 1, 2) THEN 0 ELSE CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) END AS declared_bytes
  FROM lineitem)"""

_REASON = """CASE WHEN {total} >= 150000 THEN 'task-cap' WHEN e.declared_bytes > 90000 THEN 'too-large' WHEN e.mime LIKE 'video/%' THEN 'content-type'
      WHEN e.body_bytes > 90000 THEN 'too-large' WHEN {total} + coalesce(e.body_bytes, 0) > 150000 THEN 'task-cap' END"""

FOLDED = f"""{EXCHANGES},
fold AS (
  SELECT task_id, seq, reason, CASE WHEN reason IS NULL THEN coalesce(body_bytes, 0) ELSE 0 END AS total FROM (SELECT e.*, {_REASON.format(total="0")} AS reason FROM exchanges e WHERE seq = 1)
  UNION ALL
  SELECT task_id, seq, reason, prior + CASE WHEN reason IS NULL THEN coalesce(body_bytes, 0) ELSE 0 END FROM (
    SELECT e.*, f.total AS prior, {_REASON.format(total="f.total")} AS reason FROM fold f JOIN exchanges e ON e.task_id = f.task_id AND e.seq = f.seq + 1)),
folded AS (SELECT e.*, f.reason AS skip_reason FROM exchanges e JOIN fold f USING (task_id, seq))"""

COMPLETE = f"""{FOLDED},
by_url AS (
  SELECT task_id, url, bool_or(status = 304) AND NOT bool_or(status = 200) AS bodyless, bool_or(coalesce(skip_reason IN ('too-large', 'task-cap'), false)) AS truncated,
    sum(CASE WHEN skip_reason IS NULL THEN coalesce(body_bytes, 0) ELSE 0 END) AS bytes FROM folded GROUP BY ALL),
complete AS (
  SELECT task_id, count(*) FILTER (bodyless) AS bodyless_n, count(*) FILTER (truncated) AS truncated_n,
    coalesce(list(url ORDER BY url) FILTER (bodyless), []) AS bodyless_urls, coalesce(list(url ORDER BY url) FILTER (truncated), []) AS truncated_urls,
    CAST(sum(bytes) AS BIGINT) AS total_body_bytes, NOT bool_or(bodyless) AND NOT bool_or(truncated) AS complete FROM by_url GROUP BY task_id)"""

STATS = """stats AS (
  SELECT task_id, count(*) FILTER (skip_reason IS NULL) AS total_recorded, count(*) FILTER (skip_reason = 'content-type') AS skipped_content_type,
    count(*) FILTER (skip_reason = 'too-large') AS truncated_too_large, count(*) FILTER (skip_reason = 'task-cap') AS truncated_task_cap,
    CAST(sum(CASE WHEN skip_reason IS NULL THEN coalesce(body_bytes, 0) ELSE 0 END) AS BIGINT) AS total_body_bytes, count(*) AS in_archive FROM folded GROUP BY task_id)"""

TASKS = """tasks AS (
  SELECT o_orderkey AS task_id, 'https://h' || (o_orderkey % 97) || '.example.com/p/' || (o_custkey % 50) AS url, o_orderdate AS enqueued_at, CAST(o_custkey % 3 AS INTEGER) AS worker_index,
    CAST(o_orderkey % 3 AS INTEGER) AS retry_count, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'httpError' ELSE 'timeout' END AS status, o_orderpriority AS label,
    CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'c' || o_custkey END AS correlation_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'Navigation timeout of 30000 ms exceeded' WHEN 1 THEN 'Waiting failed: 100ms exceeded' WHEN 2 THEN 'Target closed' WHEN 3 THEN 'browser disconnected' ELSE 'boom' END AS message,
    CASE WHEN o_orderkey % 5 = 0 THEN 'TimeoutError' WHEN o_orderkey % 5 = 2 AND o_orderkey % 3 = 0 THEN 'SigningRequiredError' ELSE 'Error' END AS error_class
  FROM orders)"""

NAME_ERROR = """CASE WHEN length({0}) = 0 THEN 'Invalid filename "' || {0} || '": filename cannot be empty' WHEN length({0}) > 100 THEN 'Invalid filename "' || {0} || '": filename exceeds 100 characters'
    WHEN regexp_matches({0}, '[<>:"/\\\\|?*_]') THEN 'Invalid filename "' || {0} || '": contains invalid characters: < > : " / \\ | ? * _' WHEN regexp_matches({0}, '\\s') THEN 'Invalid filename "' || {0} || '": contains whitespace characters' END"""

ERROR_TYPE = """CASE error_class WHEN 'SigningRequiredError' THEN 'signing' WHEN 'TimeoutError' THEN 'timeout' ELSE CASE WHEN contains(message, 'disconnect') OR contains(message, 'closed') THEN 'connection' ELSE 'internal' END END"""

EVENTS = """ev AS (
  SELECT user_id AS request_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'requestWillBeSent' WHEN 'click' THEN 'responseReceived' WHEN 'purchase' THEN 'loadingFinished' WHEN 'error' THEN 'loadingFailed' WHEN 'signup' THEN 'redirect' END AS kind,
    CAST(floor(value * 1000) AS BIGINT) AS encoded_length FROM events)"""

HOST = "lower(regexp_replace(regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', ''), ':\\d*$', ''))"
REST = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1)"
SURT = f"array_to_string(list_reverse(string_split({HOST}, '.')), ',') || ')' || CASE WHEN {REST} LIKE '/%' THEN {REST} ELSE '/' || {REST} END"

#: Base32 of a hexadecimal text of 256 bits: nibbles to bits, five bits to a character.
BASE32 = """array_to_string(list_transform(range(0, 52), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda b:
    CASE WHEN 5 * i + b < 256 THEN ((strpos('0123456789abcdef', substr({0}, 1 + (5 * i + b) // 4, 1)) - 1) >> (3 - (5 * i + b) % 4)) & 1 ELSE 0 END << (4 - b))) AS BIGINT), 1)), '')"""

PAIRED = f"""{EVENTS},
rounds AS (SELECT *, CAST(sum(CASE WHEN kind IN ('requestWillBeSent', 'redirect') THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY seq) AS BIGINT) AS round FROM ev),
live AS (SELECT * FROM (SELECT *, coalesce(bool_or(kind IN ('loadingFinished', 'loadingFailed')) OVER (PARTITION BY request_id, round ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM rounds) WHERE round > 0 AND NOT ended),
rolled AS (SELECT request_id, round, min(seq) AS opened_at, bool_or(kind = 'responseReceived') AS responded, arg_min(kind, seq) AS opened_by,
  min(CASE WHEN kind IN ('loadingFinished', 'loadingFailed') THEN kind END) AS end_kind, min(CASE WHEN kind = 'loadingFinished' THEN encoded_length END) AS encoded_length FROM live GROUP BY request_id, round),
paired AS (SELECT request_id, round, opened_at, responded, CASE WHEN end_kind = 'loadingFailed' THEN 'failed' WHEN end_kind IS NOT NULL AND responded THEN 'recorded' WHEN end_kind IS NOT NULL THEN 'no-response'
  WHEN nxt = 'redirect' THEN 'redirected' WHEN nxt IS NOT NULL THEN 'replaced' ELSE 'incomplete' END AS outcome, encoded_length
  FROM (SELECT *, lead(opened_by) OVER (PARTITION BY request_id ORDER BY round) AS nxt FROM rolled))"""
