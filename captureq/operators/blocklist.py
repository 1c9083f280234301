"""Block-lists of any size as a table: an index of each pattern's rarest part, joined by equality, verified by the pattern.

A pattern matches a whole url; only `*` is wild. Whatever stands between two stars must stand in the url as it is, so a
url that matches holds every word and every run of four characters of it, and begins and ends as it does. Each pattern is
filed under the one of these parts that the fewest urls hold; a url meets only the patterns that are filed under its own
parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a run under which a pattern is filed, and at most of its start and its end.
RUN = 4


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^0-9A-Za-z]+"), lambda w: w != "")


def _runs(text: Column) -> Column:
    return F.when(F.length(text) >= RUN, F.transform(F.sequence(F.lit(1), F.length(text) - (RUN - 1)), lambda i: F.substr(text, i, F.lit(RUN)))).otherwise(F.array().cast("array<string>"))


def _keyed(prefix: str, found: Column) -> Column:
    return F.transform(found, lambda w: F.concat(F.lit(prefix), w))


def literals(pattern: Column) -> Column:
    """What stands between the stars of a pattern, empty parts included."""
    return F.split(pattern, r"\*")


def _edge(prefix: str, part: Column) -> Column:
    """The key of a part at the start ("s") or the end ("e") of a text, none for an empty part."""
    return F.when(part != "", F.array(F.concat(F.lit(prefix), part))).otherwise(F.array().cast("array<string>"))


def url_keys(url: Column) -> Column:
    """All parts of a url under which a pattern may be filed: words, runs, starts and ends."""
    ends = [_edge(p, cut(url, F.lit(k))) for p, cut in (("s", F.left), ("e", F.right)) for k in range(1, RUN + 1)]
    return F.array_distinct(F.concat(_keyed("w", _words(url)), _keyed("r", _runs(url)), *ends))


def pattern_keys(pattern: Column) -> Column:
    """Parts that every matching url holds: whole words (those that no star touches), runs of four characters, up to four
    characters before the first star and behind the last. None where the pattern says only less than that."""
    # A word at the edge of a star may go on in the url: a mark of letters there makes it part of no whole word.
    inner = F.regexp_replace(pattern, r"[0-9A-Za-z]*\*+[0-9A-Za-z]*", " ")
    words = _keyed("w", _words(inner))
    parts = literals(pattern)
    runs = _keyed("r", F.flatten(F.transform(parts, _runs)))
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    return F.array_distinct(F.concat(words, runs, _edge("s", F.left(first, F.lit(RUN))), _edge("e", F.right(last, F.lit(RUN)))))


def matches(url: Column, pattern: Column) -> Column:
    """Whether a url matches a pattern column: the first part at its start, the last at its end, the others in between
    from left to right, each as early as it can stand."""
    parts = literals(pattern)
    n = F.size(parts)
    first, last = F.get(parts, F.lit(0)), F.get(parts, n - 1)

    def after(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, url, at)
        return F.when((at < 1) | (found < 1), F.lit(0)).otherwise(found + F.length(part))

    # An empty part stands anywhere; `locate` would find it at the start.
    middle = F.filter(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), lambda p: p != "")
    reached = F.aggregate(middle, F.length(first) + 1, after)
    wild = url.startswith(first) & url.endswith(last) & (reached >= 1) & (reached - 1 + F.length(last) <= F.length(url))
    return F.coalesce(F.when(n == 1, url == pattern).otherwise(wild), F.lit(False))


def blocked_urls(urls: DataFrame, patterns: DataFrame, url_col: str = "url", pattern_col: str = "pattern", short: int = 1000) -> DataFrame:
    """urls (every row, all its columns) with n_patterns: how many distinct patterns match its url.

    Null and repeated patterns count once or not at all; the empty pattern matches the empty url. A null url matches
    nothing. Patterns that say nothing of a word, four characters, a start or an end (such as `*` or `*js*`) are looked at
    by every url, some `short` of them at a time. A column n_patterns is replaced. Work grows with the parts of the
    distinct urls and with the pairs that share a pattern's rarest part."""
    own = urls.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("_url")).distinct()
    listed = patterns.select(F.col(pattern_col).alias("_pattern")).dropna().distinct().withColumn("_keys", pattern_keys(F.col("_pattern")))
    held = own.select("_url", F.explode(url_keys(F.col("_url"))).alias("_key"))
    wanted = listed.select("_pattern", F.explode("_keys").alias("_key"))
    # Joins by parts are merged: Spark takes exploded parts for as small as the urls that they come from, and would gather
    # them on the driver to broadcast them.
    # How many urls hold each part that a pattern names; a part that none holds rules its pattern out.
    often = held.join(wanted.select("_key").distinct().hint("merge"), "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    filed = wanted.join(often.hint("merge"), "_key", "left").groupBy("_pattern").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_key")).alias("k")).filter("k.n > 0").select("_pattern", F.col("k._key").alias("_key"))
    met = held.join(filed.hint("merge"), "_key").filter(matches(F.col("_url"), F.col("_pattern"))).groupBy("_url").agg(F.count(F.lit(1)).alias("_n"))
    rest = listed.filter(F.size("_keys") == 0).select("_pattern")
    if n_rest := rest.count():
        some = rest.groupBy(F.pmod(F.xxhash64("_pattern"), F.lit(-(-n_rest // short)))).agg(F.collect_list("_pattern").alias("_all")).select("_all")
        near = own.crossJoin(some).select("_url", F.size(F.filter("_all", lambda p: matches(F.col("_url"), p))).cast("long").alias("_n")).filter("_n > 0")
        met = met.unionByName(near)
    told = met.groupBy(F.col("_url").alias(url_col)).agg(F.sum("_n").alias("n_patterns"))
    names = [c for c in urls.columns if c != "n_patterns"]
    return urls.select(*[F.col(f"`{c}`") for c in names]).join(told, url_col, "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("n_patterns", F.lit(0)).cast("long").alias("n_patterns"))
