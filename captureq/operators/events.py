"""Batch forms of the exchange state machine over the network-event log, and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captureq.functions.text import context_destroyed

#: Events that open a request, and those that end one.
OPENING, ENDING = ("requestWillBeSent", "redirect"), ("loadingFinished", "loadingFailed")


def exchange_rounds(events: DataFrame) -> DataFrame:
    """Every event with its round: the number of openings of its request id so far, and whether an event that ends the
    round stands before it. Events of round 0, and events after the end, have no state and are dropped by callers."""
    upto = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rounds = events.withColumn("round", F.sum(F.col("kind").isin(*OPENING).cast("long")).over(upto))
    before = Window.partitionBy("request_id", "round").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rounds.withColumn("ended", F.coalesce(F.max(F.col("kind").isin(*ENDING)).over(before), F.lit(False)))


def paired_exchanges(events: DataFrame) -> DataFrame:
    """request_id, round, opened_at, responded, outcome, encoded_length.

    Outcomes: recorded (finished after a response), no-response (finished without one), failed, redirected (a redirect
    opens the next round while this one is open), replaced (another plain request of the id takes the slot) and
    incomplete (still open at the end)."""
    live = exchange_rounds(events).filter("round > 0 and not ended")
    end = F.when(F.col("kind").isin(*ENDING), F.struct("seq", "kind", "encoded_length"))
    folded = live.groupBy("request_id", "round").agg(F.min("seq").alias("opened_at"), F.max((F.col("kind") == "responseReceived")).alias("responded"), F.min(end).alias("end"), F.min_by("kind", "seq").alias("opened_by"))
    following = F.lead("opened_by").over(Window.partitionBy("request_id").orderBy("round"))
    told = folded.withColumn("next", following)
    outcome = (
        F.when(F.col("end.kind") == "loadingFailed", "failed").when(F.col("end.kind").isNotNull() & F.col("responded"), "recorded").when(F.col("end.kind").isNotNull(), "no-response")
        .when(F.col("next") == "redirect", "redirected").when(F.col("next").isNotNull(), "replaced").otherwise("incomplete")
    )
    return told.select("request_id", "round", "opened_at", "responded", outcome.alias("outcome"), F.when(F.col("end.kind") == "loadingFinished", F.col("end.encoded_length")).alias("encoded_length"))


def navigation_retries(attempts: DataFrame, key: str, most: int = 2) -> DataFrame:
    """key, attempts, given_up: how often an operation ran, at first and again after errors that only say that the page
    navigated (message; null: it went well), and whether it ended in such an error after `most` repetitions."""
    again = context_destroyed(F.col("message"))
    out = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(again).alias("_lost"), F.max_by(again, F.col("seq")).alias("_last"))
    return out.select(key, "attempts", (F.col("_last") & (F.col("_lost") > most)).alias("given_up"))


def membership_key(members: DataFrame, group: str, member: str) -> DataFrame:
    """group, key: the group's distinct members in order, joined by commas; equal keys are equal memberships."""
    return members.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(member)), ",").alias("key"))


def flips(events: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before it under the key (the first row counts)."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(seq))
    first = F.row_number().over(Window.partitionBy(key).orderBy(seq)) == 1
    return events.withColumn("prev", prev).withColumn("first", first).filter(F.col("first") | ~F.col(value).eqNullSafe(F.col("prev"))).select(key, seq, value)


def membership(now: DataFrame, wanted: DataFrame, key: str, busy: str) -> DataFrame:
    """Each member's fate: survives (wanted), draining (unwanted but busy), retired (unwanted and idle), added."""
    a = now.select(key, busy, F.lit(True).alias("_now"))
    b = wanted.select(key).distinct().withColumn("_want", F.lit(True))
    fate = F.when(F.col("_now") & F.col("_want"), "survives").when(F.col("_want"), "added").when(F.col(busy), "draining").otherwise("retired")
    return a.join(b, key, "full").select(key, fate.alias("fate"))
