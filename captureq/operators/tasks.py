"""Task admission, naming, retries, errors, queue and worker state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captureq.functions.text import artifact_name, error_type, labels_error, name_error, timeout_ms, trim_all


def resolve_request(requests: DataFrame, signing_policy: str = "allowed") -> DataFrame:
    """requests with error (the first that applies, else null), trimmed url and labels, require_signature.

    Order: url, formats, signing without an archive, signing against policy, labels, correlation id. Needs url, labels,
    correlation_id, formats (struct of booleans with wacz) and signing (nullable boolean)."""
    url = trim_all(F.col("url"))
    labels = F.filter(F.transform(F.coalesce("labels", F.array().cast("array<string>")), trim_all), lambda x: x != "")
    fields = requests.schema["formats"].dataType.names
    some = F.lit(False)
    for f in fields:
        some = some | F.coalesce(F.col(f"formats.{f}"), F.lit(False))
    signing, wacz = F.col("signing"), F.coalesce(F.col("formats.wacz"), F.lit(False))
    correlation = F.col("correlation_id")
    error = (
        F.when(F.coalesce(url, F.lit("")) == "", "url is required").when(~some, "At least one capture format must be specified").when((signing == True) & ~wacz, "signing requires captureFormats.wacz")  # noqa: E712
        .when(F.lit(signing_policy == "forbidden") & (signing == True), "this server does not sign captures (signingPolicy=forbidden)")  # noqa: E712
        .when(F.lit(signing_policy == "required") & (signing == False), "this server signs every capture (signingPolicy=required)")  # noqa: E712
        .otherwise(F.coalesce(labels_error(labels), F.when(F.coalesce(correlation, F.lit("")) != "", name_error(correlation))))
    )
    sign = F.lit(signing_policy == "required") | F.coalesce(signing, F.lit(False))
    return requests.withColumns({"error": error, "url": url, "labels": labels, "require_signature": sign})


def _name_errors() -> list[Column]:
    return [labels_error(F.array("label")).alias("label_error"), F.when(F.col("correlation_id") != "", name_error(F.col("correlation_id"))).alias("correlation_error")]


def validated(tasks: DataFrame) -> DataFrame:
    """task_id, label_error, correlation_error, valid."""
    return tasks.select("task_id", *_name_errors()).withColumn("valid", F.col("label_error").isNull() & F.col("correlation_error").isNull())


def artifact_names(tasks: DataFrame, extension: str) -> DataFrame:
    return tasks.select("task_id", artifact_name(F.col("task_id"), F.col("correlation_id"), F.array("label"), extension).alias("filename"))


def retry_outcome(tasks: DataFrame, max_retry: int = 2) -> DataFrame:
    """Success, requeued (with the next retry count) or failed (budget spent)."""
    ok = F.col("status") == "success"
    left = F.col("retry_count") < max_retry
    return tasks.select("task_id", F.when(ok, "succeeded").when(left, "requeued").otherwise("failed").alias("outcome"), F.when(~ok & left, F.col("retry_count") + 1).otherwise(F.col("retry_count")).cast("int").alias("next_retry"))


def classified_errors(tasks: DataFrame) -> DataFrame:
    """Kind of each error (error_class, message), the time limit that a message names, and the resulting status."""
    kind = error_type(F.col("error_class"), F.col("message"))
    limit = F.when(kind == "timeout", timeout_ms(F.col("message")))
    out = tasks.select("task_id", kind.alias("error_type"), limit.alias("timeout_ms"))
    return out.withColumn("status", F.when(F.col("error_type") == "timeout", "timeout").otherwise("failed"))


def _held(tasks: DataFrame, holds: Column) -> DataFrame:
    """tasks with held: whether an earlier task (in queue order) holds the same url. The first holder of a url is a
    partial minimum, so a url that very many tasks name is no crowded window."""
    order = F.struct("enqueued_at", "task_id")
    first = tasks.filter(holds).groupBy("url").agg(F.min(order).alias("_first"))
    return tasks.join(first, "url", "left").withColumn("held", F.coalesce(F.col("_first") < order, F.lit(False))).drop("_first")


def duplicate_urls(tasks: DataFrame, holds: Column | None = None) -> DataFrame:
    """Tasks whose exact url an earlier one already holds: any earlier one, or only those of which `holds` is true (a
    finished task holds nothing). Null urls are never duplicates."""
    return _held(tasks, F.lit(True) if holds is None else holds).select("task_id", "url", F.col("held").alias("rejected"))


def admission(tasks: DataFrame, operational_workers: int, finished: Column | None = None) -> DataFrame:
    """HTTP status of each submission: 400 invalid, 503 no workers, 409 duplicate, 202 accepted, in that order. Only a
    submission that was taken and has not finished holds its url: an invalid one never does."""
    told = tasks.withColumns({c: e for c, e in zip(("label_error", "correlation_error"), _name_errors(), strict=True)})
    bad = F.col("label_error").isNotNull() | F.col("correlation_error").isNotNull()
    done = F.lit(False) if finished is None else F.coalesce(finished, F.lit(False))
    told = _held(told.withColumn("_bad", bad), ~F.col("_bad") & ~done)
    return told.select("task_id", F.when(F.col("_bad"), 400).when(F.lit(operational_workers == 0), 503).when(F.col("held"), 409).otherwise(202).alias("http_status"))


def queue_counts(tasks: DataFrame, max_retry: int = 2) -> DataFrame:
    """Pending, succeeded and failed tasks."""
    o = retry_outcome(tasks, max_retry)
    return o.agg(F.count_if(F.col("outcome") == "requeued").alias("pending"), F.count_if(F.col("outcome") == "succeeded").alias("succeeded"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))


def pending_head(tasks: DataFrame, most: int = 50) -> DataFrame:
    """The head of the queue in first-in order; none for most <= 0."""
    return tasks.filter(F.col("status") != "success").orderBy("enqueued_at", "task_id").limit(max(most, 0)).select("task_id", "url")


def worker_counters(tasks: DataFrame, max_retry: int = 2) -> DataFrame:
    """processed and errors of each worker: a retried failure touches neither, except a lost connection, which counts as
    an error on both branches and as processed only when final."""
    ok, final = F.col("status") == "success", F.col("retry_count") >= max_retry
    lost = error_type(F.col("error_class"), F.col("message")) == "connection"
    return tasks.groupBy("worker_index").agg(F.count_if(ok | final).alias("processed"), F.count_if(~ok & (final | lost)).alias("errors"))


def error_history(tasks: DataFrame, most: int = 10) -> DataFrame:
    """Each worker's latest errors, newest first."""
    order = Window.partitionBy("worker_index").orderBy(F.desc("enqueued_at"), F.desc("task_id"))
    return tasks.filter(F.col("status") != "success").withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).select("worker_index", F.col("pos").cast("long").alias("pos"), "task_id", "message")


def result_cache(results: DataFrame, key: str, seq: str, value: str, capacity: int) -> DataFrame:
    """The newest keys by first insertion, each with its last value; a key recorded again keeps its place."""
    last = results.groupBy(key).agg(F.min(seq).alias("first_seq"), F.max_by(value, seq).alias(value))
    return last.orderBy(F.desc("first_seq"), key).limit(max(capacity, 0))


def lookups(asked: DataFrame, results: DataFrame, queued: DataFrame) -> DataFrame:
    """200 with a cached result, else 202 while tracked, else 404."""
    r = results.select("task_id").distinct().withColumn("r", F.lit(True))
    q = queued.select("task_id").distinct().withColumn("q", F.lit(True))
    out = asked.join(r, "task_id", "left").join(q, "task_id", "left")
    return out.select("task_id", F.when(F.col("r"), 200).when(F.col("q"), 202).otherwise(404).alias("http_status"))


def ages(tasks: DataFrame, now: str) -> DataFrame:
    """Milliseconds since each task was queued, by one clock reading."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return tasks.select("task_id", F.greatest(F.lit(0), ms(F.lit(now)) - ms(F.col("enqueued_at"))).cast("long").alias("age_ms"))


def backoff(waits: DataFrame, n: Column, base_ms: int, cap_ms: int, carry: Sequence[str] = ()) -> DataFrame:
    """attempt and delay_ms of each row: base_ms doubled n times, at most cap_ms; a null n gives a null delay."""
    return waits.select(*carry, n.cast("long").alias("attempt"), F.when(n.isNotNull(), F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), n))).cast("long").alias("delay_ms"))


def attempts(log: DataFrame, max_retries: int = 2) -> DataFrame:
    """The attempts of each task from its log (task_id, seq, at, succeeded, retryable), one row for each row of the log.

    attempt (from 0), enqueued_at (that of the first attempt, which a retry keeps), branch: `success`, `retry` (goes to
    the end of the queue as the next attempt), `exhausted` (would be retried, but max_retries were made) or `failed`; and
    how often the task took each of the last three branches so far. Anything but a retry ends a task's run; its next row
    is a new one. Null flags count as false; a null time stays null; rows of a null task_id are one task; ties in seq
    have no fixed order.

    Windows over one shuffle by task: an ending row closes a segment, and within a segment every max_retries + 1 rows are
    a run."""
    ok, again = F.coalesce("succeeded", F.lit(False)), F.coalesce("retryable", F.lit(False))
    of_task = Window.partitionBy("task_id").orderBy("seq")
    ended = F.sum((F.col("_ok") | ~F.col("_again")).cast("long")).over(of_task.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.select("task_id", "seq", "at", ok.alias("_ok"), again.alias("_again")).withColumn("_segment", F.coalesce(ended, F.lit(0)))
    place = F.row_number().over(Window.partitionBy("task_id", "_segment").orderBy("seq")) - 1
    rows = rows.withColumn("_place", place).withColumns({"attempt": (F.col("_place") % (max_retries + 1)).cast("long"), "_run": F.floor(F.col("_place") / (max_retries + 1))})
    first = F.first("at").over(Window.partitionBy("task_id", "_segment", "_run").orderBy("seq"))
    branch = F.when(F.col("_ok"), "success").when(~F.col("_again"), "failed").when(F.col("attempt") < max_retries, "retry").otherwise("exhausted")
    rows = rows.withColumns({"enqueued_at": first, "branch": branch})
    upto = of_task.rowsBetween(Window.unboundedPreceding, 0)
    counts = {f"{b}_n": F.sum((F.col("branch") == b).cast("long")).over(upto) for b in ("retry", "exhausted", "failed")}
    return rows.withColumns(counts).select("task_id", "seq", "attempt", "enqueued_at", "branch", *counts)


def report_json(tasks: DataFrame) -> DataFrame:
    """The wire report of each task; absent keys are left out."""
    body = F.to_json(F.struct(F.col("task_id").cast("string").alias("taskId"), F.nullif("correlation_id", F.lit("")).alias("correlationId"), F.array("label").alias("labels"), "url", "status"))
    return tasks.select("task_id", body.alias("report"))
