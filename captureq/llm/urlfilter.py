"""URL rules, and block decisions that travel along redirects and canonical links.

Pages and the targets of their canonical links and refresh redirects are nodes; distributed connected components join
the aliases of one page. A page that no rule fits takes the decision of its component: allow where any member is
explicitly allowed, else block where any is blocked, else allow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captureq.functions import html
from captureq.functions.text import bound
from captureq.functions.url import absolute
from captureq.operators.links import page_base

from .common import frequent_join, written
from .components import connected_components

Rule = tuple[str, str, str]  # verdict, host, path

#: What a refresh's content says after its time: a target in quotes or without, `url=` before it or not.
_REFRESH = r"""(?is)^[^;,]*+[;,]\s*+(?:url\s*+=\s*+)?+(?:"([^"]*+)|'([^']*+)|(.*))"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; path: from there up to `?` or `#`.
    Both are empty for null and for a url without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".replace("{0}", "_url"))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(the longest rule that fits as host + path, its verdict); nulls where none fits. Of equally long ones allow."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def node(url: Column) -> Column:
    """The name under which a url is a node: no fragment, scheme and authority in lower case, no port that its scheme has
    anyway, no dot segments, `/` for an empty path. A url without `://` only loses its fragment."""
    plain = F.regexp_replace(url, r"#.*$", "")
    site = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_extract(plain, r"^[^?]*?://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(plain, r"(\?.*)$", 1)
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    clean = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)
    clean = F.concat(clean, F.when((clean == "") | F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(site == "", plain).otherwise(F.concat(_without_port(F.lower(site)), clean, query))


def _without_port(site: Column) -> Column:
    for own in (r"^(http://.*):80$", r"^(https://.*):443$", r"^(.*[^:/]):$"):
        site = F.regexp_replace(site, own, "$1")
    return site


def alias_targets(page: Column, base: Column) -> Column:
    """The absolute targets of a page's canonical links (rel is a list of words) and refreshes. Tags in comments, scripts
    and other raw text are none; the base element holds."""
    tags = F.filter(html.start_tags(page), lambda t: t.rlike(r"(?i)^<(?:link|meta)[\s/]"))
    read = F.transform(tags, lambda t: F.struct(t.rlike("(?i)^<link").alias("link"), html.attributes(t).alias("a")))

    def target(x: Column) -> Column:
        words = F.split(F.trim(F.lower(html.value(x["a"], "rel"))), r"\s+")
        canonical = x["link"] & F.coalesce(F.array_contains(words, "canonical"), F.lit(False))
        refresh = ~x["link"] & F.coalesce(F.trim(F.lower(html.value(x["a"], "http-equiv"))) == "refresh", F.lit(False))
        told = bound(html.value(x["a"], "content"), lambda c: F.concat(*[F.regexp_extract(c, _REFRESH, k) for k in (1, 2, 3)]))
        return F.trim(F.when(canonical, html.value(x["a"], "href")).when(refresh, told))

    named = F.transform(F.transform(read, target), lambda t: F.regexp_replace(t, "#.*$", ""))
    return F.transform(F.filter(named, lambda t: F.coalesce(t != "", F.lit(False))), lambda t: absolute(t, base))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): the nodes of the page's url and of each target of `alias_targets`; a link to a place in the page itself
    (`#x`) is none. Rows with a null url or null html have none."""
    some = pages.select(F.col(url_col).alias("a"), F.col(html_col).alias("h")).filter(F.col("a").isNotNull() & F.col("h").rlike("(?i)canonical|refresh"))
    edge = some.select("a", F.explode(alias_targets(F.col("h"), page_base(F.col("h"), F.regexp_replace("a", "#.*$", "")))).alias("t"))
    return edge.select(node(F.col("a")).alias("a"), node(F.col("t")).alias("b"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule (null where none fits), verdict, for every row.

    The longest fitting rule decides; explicit allow is never overruled by an alias. A null url has empty host and path
    and no aliases, so it is allowed; null html has no edges; repeated rows stay; an empty table gives no rows. Urls that
    differ in the case of scheme and host, in the scheme's own port, in dot segments or in character references of a link
    are one node."""
    base = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    host, path = host_path(F.col("_url"))
    base = base.select(id_col, node(F.col("_url")).alias("node"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("_own"))
    member = connected_components(alias_edges(pages, url_col, html_col))
    h, p = host_path(F.col("_url"))
    _, own = rule_for(F.col("h"), F.col("p"), rules)
    told = member.withColumn("_url", F.col("node")).select("node", "component", h.alias("h"), p.alias("p")).withColumn("v", own)
    decided = told.groupBy("component").agg(F.max(F.col("v") == "allow").alias("some_allow"), F.max(F.col("v") == "block").alias("some_block"))
    alias = member.join(decided, "component").select("node", F.when(F.col("some_allow"), "allow").when(F.col("some_block"), "block").alias("_alias"))
    alias = written(alias, "aliases")
    weight = base.join(alias.select("node"), "node").groupBy("node").agg(F.count(F.lit(1)).alias("w"))
    out = frequent_join(base, written(alias.join(weight, "node"), "weights"), ["node"], "w")
    return out.select(id_col, "host", "path", "rule", F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"))
