"""Worker and task lifecycles, health, members, deadlines and paced time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coordinator transitions (state, event, next state).
COORDINATOR = [
    ("created", "initialize", "initializing"), ("initializing", "ready", "running"), ("initializing", "failed", "terminated"), ("running", "degrade", "degraded"), ("degraded", "recover", "running"), ("running", "members", "reconciling"),
    ("degraded", "members", "reconciling"), ("reconciling", "ready", "running"), ("running", "shutdown", "shuttingDown"), ("degraded", "shutdown", "shuttingDown"), ("reconciling", "shutdown", "shuttingDown"), ("shuttingDown", "done", "terminated"),
]


def health(state: Column) -> Column:
    """Four-valued health of a worker state."""
    return F.when(state == "processing", "busy").when(state == "idle", "ready").when(state.isin("connecting", "error"), "error").otherwise("disconnected")


def settled(state: Column) -> Column:
    return state.isin("processing", "idle", "error")


def last_states(log: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """Each key's last state and the number of its changes: an event-sourced fold with partial aggregation."""
    return log.groupBy(key).agg(F.max_by(state, seq).alias(state), F.count(F.lit(1)).alias("events"))


def operational(workers: DataFrame) -> DataFrame:
    """operational, all_healthy and the failed workers with their last errors (index, state, last_error)."""
    h = health(F.col("state"))
    failed = F.array_sort(F.collect_list(F.when(h == "error", F.struct("index", "last_error"))))
    return workers.agg(F.count_if(h.isin("busy", "ready")).alias("operational"), F.coalesce(F.min(h.isin("busy", "ready")), F.lit(True)).alias("all_healthy"), failed.alias("failed"))


def follow(events: DataFrame, key: str, seq: str, event: str, start: str = "created") -> DataFrame:
    """The state that each key's ordered events lead to by the transition table; an event without a transition changes
    nothing."""
    table = F.create_map(*[F.lit(x) for s, e, n in COORDINATOR for x in (f"{s}/{e}", n)])
    ordered = F.array_sort(F.collect_list(F.struct(seq, event)))
    step = lambda acc, x: F.coalesce(F.try_element_at(table, F.concat(acc, F.lit("/"), x[event])), acc)
    return events.groupBy(key).agg(F.aggregate(ordered, F.lit(start), step).alias("state"))


def present_members(profiles: DataFrame) -> DataFrame:
    """Members whose lookup did not say that the name does not exist; other errors keep them (host, error)."""
    return profiles.filter(F.coalesce(F.col("error"), F.lit("")) != "NXDOMAIN").select("host")


def over_deadline(ops: DataFrame, operation_ms: int, task_ms: int) -> DataFrame:
    """Operation deadlines are extended by injected pacing, the wall-clock deadline of a task is not
    (task_id, op, elapsed_ms, injected_ms)."""
    total = Window.partitionBy("task_id")
    return ops.select("task_id", "op", (F.col("elapsed_ms") - F.col("injected_ms") > operation_ms).alias("op_timeout"), (F.sum("elapsed_ms").over(total) > task_ms).alias("task_timeout"))


def paced_ms(waits: DataFrame, key: str) -> DataFrame:
    """Time covered by possibly overlapping waits (start_ms, end_ms), each moment once: islands by a running maximum."""
    before = Window.partitionBy(key).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end_ms").over(before), F.col("start_ms"))
    part = waits.withColumn("own", F.greatest(F.lit(0), F.col("end_ms") - F.greatest(reach, F.col("start_ms"))))
    return part.groupBy(key).agg(F.sum("own").alias("paced_ms"))


def scroll_steps(positions: DataFrame, key: str, most: int) -> DataFrame:
    """reached_bottom and steps of each run: the first step whose position repeats, else all that were allowed
    (key, step from 1, y)."""
    prev = F.lag("y").over(Window.partitionBy(key).orderBy("step"))
    hit = positions.filter(F.col("step") <= most).withColumn("same", F.col("y") == prev)
    first = F.min(F.when(F.col("same"), F.col("step")))
    return hit.groupBy(key).agg(first.isNotNull().alias("reached_bottom"), F.coalesce(first, F.lit(most)).cast("long").alias("steps"))


def completeness_log(complete: DataFrame, most: int = 5) -> DataFrame:
    """warn with the number and first urls that have no body, for tasks that are not complete; else info."""
    return complete.select("task_id", F.when(F.col("complete"), "info").otherwise("warn").alias("level"), F.when(~F.col("complete"), F.col("bodyless_n")).alias("bodyless"), F.when(~F.col("complete"), F.slice("bodyless_urls", 1, most)).alias("sample"))


def certificate_times(observed: DataFrame) -> DataFrame:
    """Validity bounds as times, and distinct chains by their reference (host, valid_from, valid_to epoch seconds, chain)."""
    from captureq.functions.digest import chain_ref

    return observed.select("host", F.timestamp_seconds("valid_from").alias("valid_from"), F.timestamp_seconds("valid_to").alias("valid_to"), chain_ref(F.col("chain")).alias("ref"), "chain")


def distinct_chains(observed: DataFrame) -> DataFrame:
    return observed.select("ref", "chain").dropDuplicates(["ref"])


def status_snapshot(tasks: DataFrame, workers: DataFrame, now: str) -> DataFrame:
    """One row: queue counts, operational workers and the oldest queued age, all by one clock reading."""
    waiting = F.col("status") != "success"
    age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("enqueued_at").cast("timestamp"))
    q = tasks.agg(F.count_if(waiting).alias("queued"), F.max(F.when(waiting, F.greatest(F.lit(0), age))).cast("long").alias("oldest_ms")).withColumn("k", F.lit(0))
    w = operational(workers).select(F.lit(0).alias("k"), "operational", "all_healthy")
    return q.join(w, "k").drop("k")
