"""Behaviours over a page's events: order, options, failures, nulls, and a table that lacks a column."""

import json

import pytest
from pyspark.errors import AnalysisException

from captureq.streaming import page_events

SCHEMA = "page_id long, seq long, kind string, amount long, target string, extra int"


def follow(spark, rows, ids, options="{}"):
    page_events.register(spark)
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3).createOrReplaceTempView("page_events_in")
    out = spark.sql("SELECT * FROM follow_pages(TABLE(page_events_in), :ids, :options)", {"ids": ids, "options": options}).collect()
    return {(r.page_id, r.behavior): (r.events, r.error, r.decisions and json.loads(r.decisions)) for r in out}


def test_events_are_followed_in_order(spark):
    rows = [(1, 5, "scroll", 700, None), (1, 1, "resize", 2000, None), (1, 3, "scroll", 700, None), (1, 4, "candidate", None, "b"), (1, 2, "candidate", None, "a"), (1, 6, "scroll", 700, None), (1, 7, "request", None, "a"), (1, 8, "candidate", None, "b"), (2, 1, "media", None, "v"), (2, 2, "playing", None, "v"), (2, 3, "playing", None, "w"), (2, 4, None, None, None)]
    got = follow(spark, rows, "fetch, scroll,none,scroll,play")
    assert got[1, "scroll"] == (8, None, {"coveredPx": 1400, "exhausted": False, "reachedBottom": True, "steps": 2})
    assert got[1, "fetch"] == (8, None, {"candidates": 2, "fetch": ["b"], "neverRequested": 1})
    assert got[2, "play"] == (4, None, {"media": 1, "playing": 1}) and got[2, "scroll"][2]["steps"] == 0 and len(got) == 6
    got = follow(spark, rows, "scroll", '{"scroll": {"maxSteps": 1}}')
    assert got[1, "scroll"][2] == {"coveredPx": 700, "exhausted": True, "reachedBottom": False, "steps": 1}
    assert follow(spark, rows[:0], "scroll") == {} and follow(spark, rows, "") == {}


def test_one_that_fails_is_reported(spark):
    got = follow(spark, [(1, 1, "scroll", 3, None), (None, 1, "scroll", 4, None)], "scroll,fetch", '{"fetch": {"most": "x"}}')
    assert got[1, "fetch"][1].startswith("ValueError") and got[1, "fetch"][2] is None and got[1, "scroll"][1] is None and got[None, "scroll"][2]["coveredPx"] == 4


def test_a_table_without_a_column_is_refused(spark):
    page_events.register(spark)
    spark.range(3).createOrReplaceTempView("page_events_bad")
    with pytest.raises(AnalysisException, match="lacks page_id, seq"):
        spark.sql("SELECT * FROM follow_pages(TABLE(page_events_bad), 'scroll', '{}')").collect()
