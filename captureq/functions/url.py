"""URL columns: sort keys, parts, globs, fuzzy keys, absolute targets. Nothing here calls Python per row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from captureq.functions.text import bound

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_HOSTLESS = r"^[A-Za-z][A-Za-z0-9+.\-]*:(.*)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user information and port; empty where there is none."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def host_port(url: Column) -> Column:
    """Lower-case host and port as a Host header names them, without user information."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", ""))


def parseable(url: Column) -> Column:
    """Whether the authority holds a host, whole brackets and only digits as a port, so that a browser would take it."""
    fine = r"^(?:[^@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^\s\[\]<>^|%\\@:]+)(?::\d*)?$"
    return F.coalesce(F.regexp_extract(url, _AUTHORITY, 1).rlike(fine), F.lit(False))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def request_target(url: Column) -> Column:
    """Path and query, `/` for an empty path; a url without an authority stays as it is."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(host(url) == "", url).when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def surt(url: Column) -> Column:
    """Sort-friendly key: reversed host labels, `)`, path and query; port, user and fragment are dropped."""
    labels = F.array_join(F.reverse(F.split(host(url), r"\.")), ",")
    hostless = F.concat(F.lit(")"), F.regexp_replace(F.regexp_extract(url, _HOSTLESS, 1), r"#.*$", ""))
    return F.when(host(url) != "", F.concat(labels, F.lit(")"), request_target(url))).when(url.rlike(_HOSTLESS), hostless).otherwise(url)


def cdx_timestamp(iso: Column) -> Column:
    """First 14 digits of an ISO-8601 text."""
    return F.substring(F.regexp_replace(iso, r"[-:T]", ""), 1, 14)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(pattern: str) -> str:
    """A pattern in which only `*` is wild, as an anchored Java regular expression."""
    return "^" + ".*".join(re.sub(r"([\\^$.|?+()\[\]{}])", r"\\\1", part) for part in pattern.split("*")) + "$"


def matches_any(url: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | url.rlike(glob_regex(g))
    return out


def fuzzy_key(url: Column, params: Sequence[str]) -> Column:
    """The url without its fragment and without query parameters of these names."""
    base = F.regexp_replace(url, r"#.*$", "")
    query = F.regexp_extract(base, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin(*params))
    stem = F.regexp_extract(base, r"^([^?]*)", 1)
    return F.when(F.size(kept) > 0, F.concat(stem, F.lit("?"), F.array_join(kept, "&"))).otherwise(stem)


def dotless(url: Column) -> Column:
    """The url with `.` and `..` segments of its path resolved; one without an authority stays as it is."""
    site = origin(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    clean = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)
    clean = F.concat(clean, F.when((clean == "") | F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return F.when((site != "") & path.contains("/."), F.concat(site, clean, rest)).otherwise(url)


def absolute(href: Column, base: Column) -> Column:
    """href resolved against a base url: absolute, `//`, `/`, `?`, `#` and relative forms, dot segments resolved."""

    def resolved(h: Column) -> Column:
        folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin(base), h))
            .when((h == "") | h.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), h))
            .when(h.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), h))
            .otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), h))
        )

    return bound(bound(href, resolved), dotless)


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "") & parseable(url)


def s3_parts(uri: Column) -> tuple[Column, Column]:
    """(bucket, key) of an s3 uri; empty where it is none."""
    p = r"^s3://([^/]+)/(.+)$"
    return F.regexp_extract(uri, p, 1), F.regexp_extract(uri, p, 2)
