"""The recorder's ordered fold over a task's exchanges, and what is counted from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Url globs that a recorder never archives, unless told otherwise.
BLOCK_GLOBS = [
    "*://*.google-analytics.com/*", "*://*.googletagmanager.com/*", "*://*.doubleclick.net/*", "*://*.facebook.com/tr*", "*://*.scorecardresearch.com/*",
    "*://*.hotjar.com/*", "*://*.segment.io/*", "*://*.amplitude.com/*", "*://*.mixpanel.com/*", "*://*.adsystem.com/*",
]


def mime_skipped(mime: Column, prefixes: Sequence[str]) -> Column:
    """True where a non-empty media type starts with any prefix."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | mime.startswith(p)
    return (F.coalesce(mime, F.lit("")) != "") & F.coalesce(hit, F.lit(False))


def body_budget(exchanges: DataFrame, max_response: int, max_task: int, skip: Sequence[str] = ()) -> DataFrame:
    """exchanges with skip_reason (null where the body is stored).

    A task's exchanges are folded in seq order: a body that does not fit is dropped without using the budget, so later
    smaller ones may fit; at a full budget everything drops. Cap reasons overwrite a content-type reason; a null body
    stores nothing and uses nothing. The fold is sequential by nature, so one task's exchanges meet in one place."""
    rest = [c for c in exchanges.columns if c not in ("task_id", "seq")]
    skipped = mime_skipped(F.col("mime"), skip)
    items = F.array_sort(F.collect_list(F.struct("seq", *rest, skipped.alias("_pre"))))
    # What is told of an exchange is one letter of a text: an array would be copied at every step.
    letters = {"c": "content-type", "l": "too-large", "t": "task-cap"}
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        total, body = acc["total"], F.coalesce(x["body_bytes"], F.lit(0))
        before = F.when(total >= max_task, "t").when(x["declared_bytes"] > max_response, "l").when(x["_pre"], "c").otherwise("-")
        after = F.when(before != "-", before).when(body > max_response, "l").when(total + body > max_task, "t").otherwise("-")
        stored = F.when(after == "-", body).otherwise(F.lit(0).cast("long"))
        return F.struct((total + stored).alias("total"), F.concat(acc["out"], after).alias("out"))

    # The rows travel with the fold, so nothing is joined back, and what follows by task needs no further shuffle.
    told = exchanges.groupBy("task_id").agg(items.alias("x")).select("task_id", "x", F.aggregate("x", start, step)["out"].alias("r"))
    each = told.select("task_id", "r", F.posexplode("x").alias("at", "x"))
    letter = F.substring(F.col("r"), F.col("at") + 1, F.lit(1))
    reason = F.create_map(*[F.lit(v) for pair in letters.items() for v in pair])[letter]
    return each.select("task_id", "x.seq", *[f"x.{c}" for c in rest], reason.alias("skip_reason"))


_COUNTED = {"total_recorded": None, "skipped_content_type": "content-type", "truncated_too_large": "too-large", "truncated_task_cap": "task-cap"}


def _counters() -> list[Column]:
    r = F.col("skip_reason")
    counts = [F.count_if(r.isNull() if kind is None else F.coalesce(r == kind, F.lit(False))).alias(name) for name, kind in _COUNTED.items()]
    return [*counts, F.sum(F.when(r.isNull(), F.coalesce("body_bytes", F.lit(0))).otherwise(0)).alias("total_body_bytes"), F.count(F.lit(1)).alias("in_archive")]


def recorder_stats(folded: DataFrame) -> DataFrame:
    """Counts by outcome, stored bytes, and what is in the archive."""
    return folded.groupBy("task_id").agg(*_counters())


def first_samples(folded: DataFrame, most: int = 5) -> DataFrame:
    """The first urls of each rejection kind, in arrival order."""
    pos = F.row_number().over(Window.partitionBy("task_id", "skip_reason").orderBy("seq"))
    return folded.filter(F.col("skip_reason").isNotNull()).withColumn("pos", pos).filter(F.col("pos") <= most).select("task_id", F.col("skip_reason").alias("reason"), F.col("pos").cast("long").alias("pos"), "url")


def record_offsets(records: DataFrame, length: Column) -> DataFrame:
    """Byte offset of each record in its task's archive: the exclusive running sum of lengths in write order."""
    upto = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return records.select("task_id", "seq", length.cast("long").alias("length")).withColumn("offset", F.sum("length").over(upto) - F.col("length"))


def task_report(folded: DataFrame, samples: int = 5) -> DataFrame:
    """recorder_stats and completeness of each task in one pass, aggregated by url, then by task, with the first urls of
    each rejection (arrays, by seq; with samples 0 none)."""
    cap = F.col("skip_reason").isin("too-large", "task-cap")
    reasons = {k: v for k, v in _COUNTED.items() if v is not None and samples}
    seen = {k: F.collect_list(F.when(F.col("skip_reason") == v, F.struct("seq", "url"))) for k, v in reasons.items()}
    by_url = folded.groupBy("task_id", "url").agg(
        (F.max((F.col("status") == 304).cast("int")) > F.max((F.col("status") == 200).cast("int"))).alias("bodyless"),
        (F.max(F.coalesce(cap, F.lit(False)).cast("int")) == 1).alias("truncated"),
        *[c.alias(f"{k}_urls") for k, c in seen.items()],
        *_counters(),
    )
    urls = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("url"))))
    sums = [F.sum(c).alias(c) for c in (*_COUNTED, "total_body_bytes", "in_archive")]
    first = lambda c: F.transform(F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, samples), lambda x: x["url"])
    out = by_url.groupBy("task_id").agg(
        F.count_if("bodyless").alias("bodyless_n"),
        F.count_if("truncated").alias("truncated_n"),
        urls("bodyless").alias("bodyless_urls"),
        urls("truncated").alias("truncated_urls"),
        *[first(f"{k}_urls").alias(f"{k}_urls") for k in reasons],
        *sums,
    )
    return out.withColumn("complete", (F.col("bodyless_n") == 0) & (F.col("truncated_n") == 0))


def completeness(folded: DataFrame) -> DataFrame:
    """Per task: urls seen only as 304, urls cut by a cap (sorted arrays), whether neither exists, and stored bytes."""
    return task_report(folded, 0).select("task_id", "bodyless_n", "truncated_n", "bodyless_urls", "truncated_urls", "total_body_bytes", "complete")


#: What the report says of each kind of omitted body.
_OMITTED = {
    "skipped_content_type": ("content-type ", ""),
    "truncated_too_large": ("too-large ", " — raise --wacz-max-response-bytes"),
    "truncated_task_cap": ("task-cap ", " — raise --wacz-max-task-bytes"),
}


def trace_lines(report: DataFrame) -> DataFrame:
    """The lines of each task's archive report (rows of task_report; blocked, failed and incomplete with their samples
    where the report has them, else none). What belongs to a line follows it, indented."""
    from captureq.functions.text import human_bytes

    s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    count = lambda c: F.col(c) if c in report.columns else F.lit(0).cast("long")
    none = F.array().cast("array<string>")
    blocked, omitted = count("blocked"), F.expr("skipped_content_type + truncated_too_large + truncated_task_cap")
    indented = lambda urls, by: F.transform(urls, lambda u: F.concat(F.lit(by), u))

    def group(when: Column, *lines: Column) -> Column:
        return F.when(when, F.concat(*lines)).otherwise(none)

    samples = F.col("blocked_urls") if "blocked_urls" in report.columns else none
    more = blocked - F.size(samples)
    kinds = [
        group(F.col(c) > 0, F.array(F.concat(F.lit("  " + head), s(c), F.lit(tail))), indented(F.col(f"{c}_urls"), "    "))
        for c, (head, tail) in _OMITTED.items()
    ]
    lines = F.concat(
        F.array(F.concat(F.lit("in archive "), s("in_archive"), F.lit(" (with body "), s("total_recorded"), F.lit(" / without body "), s(omitted), F.lit(")"))),
        group(blocked > 0, F.array(F.concat(F.lit("never archived "), s(blocked), F.lit(" — blocked by pattern"))), indented(samples, "  ")),
        group(more > 0, F.array(F.concat(F.lit("  … "), s(more), F.lit(" more")))),
        group(omitted > 0, F.array(F.concat(F.lit("body omitted "), s(omitted), F.lit(" — in the archive, not replayable"))), *kinds),
        group(
            ~F.col("complete"),
            F.array(F.concat(F.lit("bodyless "), s("bodyless_n"), F.lit(" — seen only as 304, replay cannot recover"))),
            indented(F.slice("bodyless_urls", 1, 5), "  "),
        ),
        F.array(F.concat(F.lit("failed "), s(count("failed")), F.lit("  incomplete "), s(count("incomplete")), F.lit("  body "), human_bytes(F.col("total_body_bytes")))),
        F.array(F.concat(F.lit("complete = "), s("complete"))),
    )
    return report.select("task_id", F.array_join(lines, "\n").alias("report"))
