"""Behaviours that follow a page's events in order, as a table function over partitions.

    SELECT * FROM follow_pages(TABLE(events), 'scroll,fetch', '{"scroll": {"maxSteps": 5}}')

The function asks Spark for one partition a page and for its events in order (analyze), feeds them to the behaviours one
by one (eval), and tells what each decided when the page's last event is through (terminate). A behaviour keeps what it
needs of the events, not the events. One that fails is reported; the others go on."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

#: Columns that the table has; others are not read.
NEEDED = ("page_id", "seq", "kind", "amount", "target")


class Scroll:
    """Follows scroll steps (kind scroll, amount: pixels moved) down a page whose height the last resize told (kind resize),
    until its bottom is reached or maxSteps are made; later steps are not followed."""

    id = "scroll"

    def __init__(self, options: dict):
        self.most, self.view = int(options.get("maxSteps", 40)), int(options.get("viewport", 800))
        self.steps, self.at, self.height = 0, 0, None

    def follow(self, kind: str, amount: int | None, target: str | None) -> None:
        if kind == "resize" and amount is not None:
            self.height = amount
        elif kind == "scroll" and self.steps < self.most and not self._bottom():
            self.steps += 1
            self.at += amount or 0

    def _bottom(self) -> bool:
        return self.height is not None and self.at + self.view >= self.height

    def decide(self) -> dict:
        return {"coveredPx": self.at, "exhausted": self.steps >= self.most and not self._bottom(), "reachedBottom": self._bottom(), "steps": self.steps}


class Fetch:
    """Candidates (kind candidate, target: a url) that no request (kind request) names, before or after; the first `most`
    of them in the order in which they were found."""

    id = "fetch"

    def __init__(self, options: dict):
        self.most, self.found, self.asked = int(options.get("most", 2000)), {}, set()

    def follow(self, kind: str, amount: int | None, target: str | None) -> None:
        if target is None:
            return
        if kind == "candidate":
            self.found.setdefault(target, None)
        elif kind == "request":
            self.asked.add(target)

    def decide(self) -> dict:
        left = [t for t in self.found if t not in self.asked]
        return {"candidates": len(self.found), "fetch": left[: self.most], "neverRequested": len(left)}


class Play:
    """How many media elements (kind media) there are, and how many of them play (kind playing, one for each target)."""

    id = "play"

    def __init__(self, options: dict):
        self.media, self.playing = set(), set()

    def follow(self, kind: str, amount: int | None, target: str | None) -> None:
        if kind in ("media", "playing") and target is not None:
            (self.media if kind == "media" else self.playing).add(target)

    def decide(self) -> dict:
        return {"media": len(self.media), "playing": len(self.media & self.playing)}


#: Behaviours by id; a deployment adds its own classes here, requests name them.
REGISTRY: dict[str, type] = {c.id: c for c in (Scroll, Fetch, Play)}


class FollowPages:
    """page_id, behavior, events, error, decisions (JSON): a row for each page and registered behaviour named, in the order
    in which they are named. Ids that are unknown or repeated are left out; null events of a page count as of kind ''."""

    @staticmethod
    def analyze(events: AnalyzeArgument, ids: AnalyzeArgument, options: AnalyzeArgument | None = None) -> AnalyzeResult:
        have = {f.name for f in events.dataType.fields} if events.isTable else set()
        if missing := [c for c in NEEDED if c not in have]:
            raise ValueError(f"the table of events lacks {', '.join(missing)}")
        out = StructType().add("page_id", LongType()).add("behavior", StringType()).add("events", IntegerType()).add("error", StringType()).add("decisions", StringType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("page_id")], orderBy=[OrderingColumn("seq")])

    def __init__(self):
        self.page, self.running, self.seen, self.errors = None, None, 0, {}

    def _begin(self, ids: str | None, options: str | None) -> None:
        given = json.loads(options or "{}")
        self.running = {}
        for i in dict.fromkeys(x.strip() for x in (ids or "").split(",")):
            if i in REGISTRY:
                try:
                    self.running[i] = REGISTRY[i](given.get(i, {}))
                except Exception as e:  # noqa: BLE001  reported, the others go on
                    self.running[i], self.errors[i] = None, f"{type(e).__name__}: {e}"

    def eval(self, events, ids: str, options: str = "{}"):
        if self.running is None:
            self._begin(ids, options)
        self.page, self.seen = events["page_id"], self.seen + 1
        for i, behaviour in self.running.items():
            if i not in self.errors:
                try:
                    behaviour.follow(events["kind"] or "", events["amount"], events["target"])
                except Exception as e:  # noqa: BLE001
                    self.errors[i] = f"{type(e).__name__}: {e}"

    def terminate(self):
        for i, behaviour in (self.running or {}).items():
            decided = None
            if i not in self.errors:
                try:
                    decided = json.dumps(behaviour.decide(), sort_keys=True)
                except Exception as e:  # noqa: BLE001
                    self.errors[i] = f"{type(e).__name__}: {e}"
            yield self.page, i, self.seen, self.errors.get(i), decided


def register(spark: SparkSession) -> None:
    """Make follow_pages(TABLE(events), ids, options) known to SQL."""
    spark.udtf.register("follow_pages", udtf(FollowPages))
