"""The recorder's state machine over ordered network events, as a batch and as a stream.

Budget and eviction span the requests of a task, so state is kept by task. Events must arrive in seq order within a
task; the only rule for late events is that one without state is dropped."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "task_id long, seq long, kind string, request_id string, url string, status int, mime string, encoded_length long, body_bytes long"
OUTCOME = "task_id long, seq long, request_id string, url string, outcome string, status int, body_bytes long, skip_reason string"


@dataclass
class Options:
    block: list[str] = field(default_factory=list)
    skip_mime: list[str] = field(default_factory=list)
    max_response: int = 20 << 20
    max_task: int = 200 << 20
    max_pending: int = 5000

    def blocked(self, url: str) -> bool:
        return any(re.fullmatch(".*".join(map(re.escape, g.split("*"))), url, re.S) for g in self.block)


def step(state: dict, e: dict, o: Options) -> Iterator[dict]:
    """Apply one event to a task's state ({pending, total}) and yield the outcomes that it settles."""
    pending, rid = state["pending"], str(e["request_id"])

    def told(entry: dict, outcome: str, body: int | None = None, reason: str | None = None) -> dict:
        return {"task_id": e["task_id"], "seq": e["seq"], "request_id": rid, "url": entry["url"], "outcome": outcome, "status": entry.get("status"), "body_bytes": body, "skip_reason": reason}

    kind = e["kind"]
    if kind in ("requestWillBeSent", "redirect"):
        if o.blocked(e["url"]):
            entry = {"url": e["url"], "blocked": True}
            yield told(entry, "blocked")
            pending[rid] = entry  # a known id keeps its place in the order
            return
        prev = pending.get(rid)
        if kind == "redirect" and prev is not None and not prev.get("blocked"):
            prev["status"] = e["status"]
            yield told(prev, "recorded", None, prev.get("skip"))
        if len(pending) >= o.max_pending:
            del pending[next(iter(pending))]
        pending[rid] = {"url": e["url"]}
        return
    entry = pending.get(rid)
    if entry is None:
        return
    if kind == "responseReceived":
        if not entry.get("blocked"):
            entry["status"] = e["status"]
            entry["responded"] = True
            if e["mime"] and any(e["mime"].startswith(p) for p in o.skip_mime):
                entry["skip"] = "content-type"
        return
    if kind not in ("loadingFinished", "loadingFailed"):
        return
    del pending[rid]
    if entry.get("blocked"):
        return
    if kind == "loadingFailed":
        yield told(entry, "failed")
        return
    if not entry.get("responded"):
        yield told(entry, "no-response")
        return
    reason, declared, body = entry.get("skip"), e["encoded_length"] or 0, e["body_bytes"]
    if state["total"] >= o.max_task:
        reason = "task-cap"
    elif declared > o.max_response:
        reason = "too-large"
    stored = None
    if reason is None and body is not None:
        if body > o.max_response:
            reason = "too-large"
        elif state["total"] + body > o.max_task:
            reason = "task-cap"
        else:
            stored = body
            state["total"] += body
    yield told(entry, "recorded" if reason is None else "omitted", stored, reason)


def drain(task_id: int, state: dict) -> list[dict]:
    """What is still pending when recording stops, blocked slots included."""
    out = [{"task_id": task_id, "seq": None, "request_id": r, "url": x["url"], "outcome": "incomplete", "status": x.get("status"), "body_bytes": None, "skip_reason": None} for r, x in state["pending"].items()]
    state["pending"] = {}
    return out


def _rows(part: pd.DataFrame) -> Iterable[dict]:
    part = part.astype(object).where(part.notna(), None)
    return part.sort_values("seq", kind="stable").to_dict("records")


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"task_id": "Int64", "seq": "Int64", "status": "Int32", "body_bytes": "Int64"})


def assemble(events: DataFrame, options: Options | None = None) -> DataFrame:
    """Batch form: every outcome of every task, what stays pending at the end included."""
    o = options or Options()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state: dict = {"pending": {}, "total": 0}
        rows = [x for e in _rows(part) for x in step(state, e, o)]
        return _frame(rows + drain(int(part["task_id"].iloc[0]), state))

    return events.groupBy("task_id").applyInPandas(run, OUTCOME)


def assemble_stream(events: DataFrame, options: Options | None = None, drain_after: str | None = None) -> DataFrame:
    """Streaming form. With drain_after (a duration in ms as text) a task that is silent for so long is drained."""
    o = options or Options()

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else {"pending": {}, "total": 0}
        if group.hasTimedOut:
            group.remove()
            yield _frame(drain(key[0], state))
            return
        # One micro-batch may come in several chunks: they are put in order together.
        rows = [x for e in _rows(pd.concat(list(parts))) for x in step(state, e, o)]
        group.update((json.dumps(state),))
        if drain_after:
            group.setTimeoutDuration(int(drain_after))
        yield _frame(rows)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if drain_after else GroupStateTimeout.NoTimeout
    return events.groupBy("task_id").applyInPandasWithState(run, OUTCOME, "state string", "append", timeout)
