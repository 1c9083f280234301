"""Text, time and validation columns."""

from __future__ import annotations

from collections.abc import Mapping

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reason phrases that a recorder supplies (unknown: OK).
RECORDER_REASONS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 410: "Gone", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
#: Reason phrases of error reports (unknown: none).
ERROR_REASONS = {
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
#: Characters that a file name must not hold, and its greatest length.
BAD_NAME_CHARS, MAX_NAME = ["<", ">", ":", '"', "/", "\\", "|", "?", "*", "_"], 100


def lookup(table: Mapping[int, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key.cast("int"))


def recorder_reason(status: Column, given: Column) -> Column:
    return F.when(F.length(given) > 0, given).otherwise(F.coalesce(lookup(RECORDER_REASONS, status), F.lit("OK")))


def http_error_message(status: Column, given: Column) -> Column:
    reason = F.when(F.length(given) > 0, given).otherwise(lookup(ERROR_REASONS, status))
    return F.concat(F.lit("HTTP "), status.cast("string"), F.coalesce(F.concat(F.lit(": "), reason), F.lit("")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(text: Column) -> Column:
    """Trim every kind of Unicode white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def name_error(name: Column) -> Column:
    """The first reason why a text is no file name, null where it is one."""
    start = F.concat(F.lit('Invalid filename "'), name, F.lit('": '))
    bad = "[" + "".join("\\\\" if c == "\\" else c for c in BAD_NAME_CHARS) + "]"
    return (
        F.when(F.length(name) == 0, F.concat(start, F.lit("filename cannot be empty"))).when(F.length(name) > MAX_NAME, F.concat(start, F.lit(f"filename exceeds {MAX_NAME} characters")))
        .when(name.rlike(bad), F.concat(start, F.lit("contains invalid characters: " + " ".join(BAD_NAME_CHARS)))).when(name.rlike(r"(?U)\s"), F.concat(start, F.lit("contains whitespace characters")))
    )


def labels_error(labels: Column) -> Column:
    """The first error among trimmed labels, null for valid and for no labels."""
    return F.get(F.filter(F.transform(labels, lambda x: name_error(trim_all(x))), lambda e: e.isNotNull()), F.lit(0))


def artifact_name(task_id: Column, correlation_id: Column, labels: Column, extension: str) -> Column:
    parts = F.concat_ws("_", task_id.cast("string"), F.nullif(correlation_id, F.lit("")), F.nullif(F.array_join(labels, "-"), F.lit("")))
    return F.concat(parts, F.lit("." + extension))


def human_bytes(n: Column) -> Column:
    mib = F.format_string("%.1fMB", n / F.lit(1048576.0))
    return F.when(n >= 1048576, mib).otherwise(F.concat(F.floor(n / 1024.0 + 0.5).cast("string"), F.lit("KB")))


def timeout_ms(message: Column) -> Column:
    return F.regexp_extract(message, r"(\d+)\s*ms\s+exceeded", 1).try_cast("int")


#: Names of error classes that decide before any message does.
SIGNING_ERROR, TIMEOUT_ERROR = "SigningRequiredError", "TimeoutError"


def error_type(error_class: Column, message: Column) -> Column:
    """Class first: a failed signature, a time limit (the engine's own or the browser library's); then the message: a
    lost connection, else an internal error. Null class and message give an internal error."""
    lost = F.coalesce(message.contains("disconnect") | message.contains("closed"), F.lit(False))
    by_class = F.when(error_class == SIGNING_ERROR, "signing").when(error_class == TIMEOUT_ERROR, "timeout")
    return by_class.when(lost, "connection").otherwise("internal")


def context_destroyed(message: Column) -> Column:
    """Whether an error only says that the page navigated while it was looked at: such an operation is run again."""
    return F.coalesce(F.lower(message).contains("execution context was destroyed"), F.lit(False))


def http_success(status: Column) -> Column:
    """The statuses of a successful page: 200 to 299; a null status is none."""
    return F.coalesce(status.between(200, 299), F.lit(False))


def mask_key(key: Column) -> Column:
    return F.when(F.length(key) <= 8, "***").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("***"), F.right(key, F.lit(4))))


def split_csv(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def env_bool(text: Column) -> Column:
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0", ""), False)


def http_version(protocol: Column) -> Column:
    p = F.lower(F.coalesce(protocol, F.lit("")))
    return F.when(p.isin("h2", "http/2", "http/2.0"), "HTTP/2.0").when(p == "http/1.0", "HTTP/1.0").otherwise("HTTP/1.1")


def scale_dims(url: Column, factor: float) -> Column:
    """A url ending in /WxHsuffix with both sizes scaled and rounded; null where it has no such ending."""
    p = r"^(.*/)(\d+)x(\d+)([^/]*)$"
    side = lambda k: F.floor(F.regexp_extract(url, p, k).try_cast("double") * factor + 0.5).cast("long").cast("string")
    return F.when(url.rlike(p), F.concat(F.regexp_extract(url, p, 1), side(2), F.lit("x"), side(3), F.regexp_extract(url, p, 4)))
