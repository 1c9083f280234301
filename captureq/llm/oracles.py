"""DuckDB equivalents of the queries that SQL can express on whole tables."""

_VECTORS = """v AS (SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false) AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS fit FROM embeddings),
l AS (SELECT a.k AS a, b.k AS b, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND a.fit AND b.fit AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT k AS n, k AS m FROM v UNION SELECT r.n, l.b FROM reach r JOIN l ON r.m = l.a)"""

OP1 = f"""WITH RECURSIVE {_VECTORS}, c AS (SELECT n, min(vec_id) AS component_id FROM reach JOIN v ON v.k = m GROUP BY n)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.k) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v JOIN c ON c.n = v.k"""

_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda b:
    ((strpos('0123456789abcdef', substr(h, 1 + (5 * i + b) // 4, 1)) - 1) >> (3 - (5 * i + b) % 4)) & 1 << (4 - b))) AS BIGINT), 1)), '')"""

OP4 = f"""SELECT page_id, strlen(p) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, p, sha1(p) AS h, max(page_id) OVER (PARTITION BY p) AS top FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_RULE = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p in (("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/"))) + " END"
_PARTS = """translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path"""
_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest"
#: Pages without comments and raw text, their link, meta and base tags, and a tag's attributes without quotes.
_CLEAN = r"""regexp_replace(html, '(?is)<!--.*?-->|<(?:script|style|noscript|textarea|title)\b.*?</(?:script|style|noscript|textarea|title)\s*>', '', 'g')"""
_TAGS = rf"""regexp_extract_all({_CLEAN}, '(?is)<(?:link|meta|base)\b(?:"[^"]*"|''[^'']*''|[^>"''])*>')"""


def _attribute(name: str) -> str:
    return rf"""trim(regexp_extract(tag, '(?is)\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), '"' || chr(39))"""


_TARGET = rf"""CASE WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(string_split_regex(lower(trim({_attribute("rel")})), '\s+'), 'canonical') THEN {_attribute("href")}
  WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim({_attribute("http-equiv")})) = 'refresh' THEN trim(regexp_extract({_attribute("content")}, '(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?(.*)$', 1), '"' || chr(39)) END"""


def _decoded(sql: str) -> str:
    for reference, char in (("&#x2F;", "/"), ("&#47;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        sql = f"replace({sql}, '{reference}', '{char}')"
    return sql


def _resolved(t: str, a: str) -> str:
    return f"""CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {t} WHEN starts_with({t}, '//') THEN regexp_extract({a}, '^([^:/?#]+:)//', 1) || {t}
  WHEN starts_with({t}, '/') THEN regexp_extract({a}, '^([^:/?#]+://[^/?#]*)', 1) || {t} WHEN starts_with({t}, '?') THEN regexp_extract({a}, '^([^?#]*)', 1) || {t}
  ELSE rtrim(regexp_extract({a}, '^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || {t} END"""


#: Of column u: the site, the path without dot segments, and the query.
_NODE = r"""CASE WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(u, '#.*$', '')
  ELSE regexp_replace(regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || p || CASE WHEN p = '' OR regexp_matches(q, '(^|/)\.\.?$') THEN '/' ELSE '' END
    || regexp_extract(regexp_replace(u, '#.*$', ''), '(\?.*)$', 1) END"""
_STEPS = r"""list_reduce(string_split(q, '/'), lambda done, x: CASE WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN x = '.' THEN done ELSE done || '/' || x END)"""
_SPLIT = r"""regexp_extract(regexp_replace(u, '#.*$', ''), '^[^?]*?://[^/?]*([^?]*)', 1) AS q"""


def _nodes(source: str) -> str:
    """Every row of a source with a column u, and its node."""
    return f"(SELECT *, {_NODE} AS node FROM (SELECT *, {_STEPS} AS p FROM (SELECT *, {_SPLIT} FROM {source})))"


OP6 = f"""WITH RECURSIVE
j AS (SELECT page_id, u, node, {_PARTS} FROM (SELECT page_id, u, node, {_REST.replace("url", "u")} FROM {_nodes("(SELECT page_id, url AS u FROM pages)")})),
own AS (SELECT *, {_RULE} AS rule FROM j),
tagged AS (SELECT regexp_replace(url, '#.*$', '') AS a, {_TAGS} AS tags FROM pages WHERE url IS NOT NULL),
based AS (SELECT a, tags, list_filter(list_transform(tags, lambda tag: CASE WHEN regexp_matches(tag, '(?i)^<base') THEN nullif({_decoded(_attribute("href"))}, '') END), lambda x: x IS NOT NULL)[1] AS b FROM tagged),
raw AS (SELECT a, CASE WHEN b IS NULL THEN a ELSE {_resolved("b", "a")} END AS base, unnest(list_transform(tags, lambda tag: {_TARGET})) AS t FROM based),
cut AS (SELECT a, base, regexp_replace({_decoded("t")}, '#.*$', '') AS t FROM raw WHERE t <> ''),
e AS (SELECT a, {_resolved("t", "base")} AS b FROM cut WHERE t <> ''),
k AS (SELECT x.node AS a, y.node AS b FROM {_nodes("(SELECT a AS u, b FROM e)")} x JOIN {_nodes("(SELECT DISTINCT b AS u FROM e)")} y ON x.b = y.u),
s AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach AS (SELECT a AS n, a AS m FROM s UNION SELECT r.n, s.b FROM reach r JOIN s ON r.m = s.a),
told AS (SELECT n, {_RULE} AS rule FROM (SELECT n, {_PARTS} FROM (SELECT n, m AS url, {_REST.replace("url", "m")} FROM reach))),
alias AS (SELECT n, CASE WHEN bool_or(rule IN ('com/', 'www.example.com/en/')) THEN 'allow' WHEN bool_or(rule IS NOT NULL) THEN 'block' END AS v FROM told GROUP BY n)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE coalesce(v, 'allow') END AS verdict
FROM own LEFT JOIN alias ON n = node"""

OP8 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
part AS (SELECT r, n, 500 * c AS z, substr(h, 1000 * c + 1, 1800) AS s FROM (SELECT r, n, h, unnest(range(0, (n - 400) // 500 + 1)) AS c FROM d WHERE n >= 400)),
w AS (SELECT r, z + i AS i, md5(substr(s, 2 * i + 1, 800)) AS k FROM (SELECT r, z, s, unnest(range(0, least(500, n - 399 - z))) AS i FROM part)),
rep AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
isle AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM rep)),
span AS (SELECT r, g, min(i) AS a, max(i) + 400 AS b FROM isle GROUP BY r, g),
kept AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z, lead(a) OVER (PARTITION BY r ORDER BY a) AS nxt FROM span),
text_left AS (SELECT r, string_agg(substr(h, 2 * z + 1, 2 * (a - z)) || CASE WHEN nxt IS NULL THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS t, sum(b - a) AS gone, count(*) AS runs FROM kept JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256,
  CASE WHEN t IS NULL THEN body ELSE decode(unhex(array_to_string(list_filter(regexp_extract_all(t, '[0-7].|[CD].[89AB].|E.(?:[89AB].){2}|F.(?:[89AB].){3}|..'), lambda x: length(x) > 2 OR x < '8'), ''))) END AS text FROM d LEFT JOIN text_left USING (r)"""

#: CRC-32 of the text in column s, byte by byte and bit by bit (s is ASCII).
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda r, bit: xor(r >> 1, 3988292384 * (r & 1)))))"""

OP11 = f"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM o)),
turns AS (SELECT c.conv_id, pos, role, body FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND pos < h UNION ALL SELECT conv_id, pos, role, body FROM c JOIN o USING (conv_id) WHERE pos >= h),
seq AS (SELECT c.conv_id, coalesce(list(sha256(strlen(role) || ':' || role || body) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS t, coalesce(list(len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS w
  FROM c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id),
member AS (SELECT conv_id, d, sha256(array_to_string(t[:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(t[:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, len(t) = d AS ends, list_transform(range(0, d + 1), lambda j: sha256(array_to_string(t[:j], ','))) AS above
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM seq)),
node AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words, any_value(above) AS above, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT a AS k, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT unnest(above) AS a, n_convs, words, n FROM node LEFT JOIN kids USING (k)) GROUP BY a)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM node x LEFT JOIN node p ON x.up = p.k LEFT JOIN kids ON kids.k = x.k JOIN below ON below.k = x.k"""

_WORD = "[^\\x20\\x09-\\x0D]+"

OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 7], ' ')) AS k, CASE WHEN i + 64 <= len(w) THEN md5(array_to_string(w[i:i + 64], ' ')) END AS far FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
hit AS (SELECT DISTINCT r, i + j AS i FROM rep CROSS JOIN (SELECT unnest(range(0, 8)) AS j)),
told AS (SELECT r, count(*) AS n, sum(length(w[i])) AS chars FROM hit JOIN d USING (r) GROUP BY r),
long_one AS (SELECT DISTINCT r FROM win WHERE far IS NOT NULL GROUP BY r, far HAVING count(*) > 1),
m AS (SELECT d.r, doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS full_lines, coalesce(n, 0) AS n_repeat_words, coalesce(chars, 0) AS chars, long_one.r IS NOT NULL AS long_repeat
  FROM d LEFT JOIN told USING (r) LEFT JOIN long_one USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * chars <= 30 * word_chars AND NOT long_repeat AS kept FROM b"""

_TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_SHARE = "1 + CAST(1000000000 AS HUGEINT) * ({0} + 2) // ({1} + 2 * {2})"
_GAP = "({0} - {1}) * ({0} - {1}) // ({0} + {1})"

OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(body, '{_TERM}')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN c USING (lang, source) GROUP BY ALL),
gp AS (SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE.format("coalesce(n, 0)", "total", "v")} AS p FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
lq AS (SELECT lang, term, {_SHARE.format("n", "total", "v")} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total FROM gn GROUP BY lang) USING (lang) JOIN v USING (lang)),
far AS (SELECT x.lang, x.source, y.source AS other, sum({_GAP.format("x.p", "y.p")}) AS f FROM gp x JOIN gp y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
part AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN far ON far.lang = x.lang AND far.source = x.source AND far.other = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST({_GAP.format("p", "q")} AS BIGINT) FROM gp JOIN lq USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM part) WHERE part = 'pair' OR rank <= 10"""

ORACLES = {"op1_embedding_neardup": OP1, "op4_warc": OP4, "op6_url_filter": OP6, "op8_repeats": OP8, "op11_conversation_trie": OP11, "op12_quality_rules": OP12, "op13_divergence": OP13}
