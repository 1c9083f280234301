"""The recorder as a keyed stream: network events in, settled exchanges out, ready for records and archives.

State is kept by task in maps of the state store: one entry for each pending request, one for its place in the order, one
for each request id's rounds, and a few counters. A batch of events reads and writes the entries that it names and no
others, however many are pending. The same transitions run over a plain dictionary for a batch."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from captureq.operators.records import EXTRA_REQUEST, EXTRA_RESPONSE
from captureq.streaming.exchanges import Options

#: Events of a task, in the order of seq.
EVENT = (
    "task_id long, seq long, captured_at timestamp, kind string, request_id string, url string, method string, resource_type string, headers map<string,string>, status int, status_text string, mime string, ip string, "
    "encoded_length long, body binary, request_body binary, error_text string, canceled boolean, blocked_reason string"
)
#: Settled exchanges: what exchange_records and warc_records read, and the event that settled them.
SETTLED = (
    "task_id long, request_id string, round long, opened_at long, settled_at long, captured_at timestamp, url string, method string, resource_type string, outcome string, status int, status_text string, request_headers string, response_headers string, "
    "mime string, ip string, body binary, request_body binary, body_bytes long, skip_reason string, encoded_length long, error_text string, canceled boolean, blocked_reason string"
)
_NAMES = [c.split()[0] for c in SETTLED.split(", ")]
_OPEN = ("requestWillBeSent", "redirect")


class Store:
    """What the transitions need of a state: pending entries by request, their order, rounds and counters."""

    def get(self, kind: str, key: object) -> object: ...

    def put(self, kind: str, key: object, value: object) -> None: ...

    def drop(self, kind: str, key: object) -> None: ...

    def every(self, kind: str) -> list[tuple]: ...


class Memory(Store):
    def __init__(self):
        self.maps: dict[str, dict] = {}

    def get(self, kind, key):
        return self.maps.get(kind, {}).get(key)

    def put(self, kind, key, value):
        self.maps.setdefault(kind, {})[key] = value

    def drop(self, kind, key):
        self.maps.get(kind, {}).pop(key, None)

    def every(self, kind):
        return list(self.maps.get(kind, {}).items())


class Recorder:
    """The transitions over one task's state."""

    def __init__(self, task: object, store: Store, options: Options):
        self.task, self.store, self.o = task, store, options
        self.blocks = [re.compile(".*".join(map(re.escape, g.split("*"))), re.S) for g in options.block]

    def _count(self, name: str, add: int = 0) -> int:
        n = (self.store.get("count", name) or 0) + add
        if add:
            self.store.put("count", name, n)
        return n

    def _remember(self, rid: str, entry: dict) -> None:
        self.store.put("pending", rid, json.dumps(entry))

    def _entry(self, rid: str) -> dict | None:
        text = self.store.get("pending", rid)
        return None if text is None else json.loads(text)

    def _leave(self, rid: str, place: int) -> None:
        self.store.drop("pending", rid)
        self.store.drop("order", place)
        self._count("open", -1)

    def _told(self, rid: str, entry: dict, outcome: str, event: dict | None, **more: object) -> dict:
        seq = None if event is None else event["seq"]
        head = {k: None if v is None else json.dumps(v) for k, v in (("request_headers", entry.get("q1", entry.get("q0"))), ("response_headers", entry.get("r1", entry.get("r0"))))}
        kept = {k: entry.get(k) for k in ("url", "method", "resource_type", "status", "status_text", "mime", "ip", "round", "opened_at")}
        posted = entry.get("posted")
        return {"task_id": self.task, "request_id": rid, "settled_at": seq, "captured_at": entry["at"], "outcome": outcome, "request_body": None if posted is None else bytes.fromhex(posted), **kept, **head, **more}

    def _opens(self, rid: str, e: dict) -> Iterator[dict]:
        blocked = any(p.fullmatch(e["url"] or "") for p in self.blocks)
        rounds = (self.store.get("rounds", rid) or 0) + 1
        self.store.put("rounds", rid, rounds)
        entry = {"url": e["url"], "method": e["method"], "resource_type": e["resource_type"], "q0": e["headers"], "round": rounds, "opened_at": e["seq"], "at": e["captured_at"], "posted": None if e["request_body"] is None else bytes(e["request_body"]).hex()}
        prev = self._entry(rid)
        if blocked:
            # The blocked request takes the slot; a known id keeps its place in the order.
            place = prev["place"] if prev is not None else self._place(rid)
            yield self._told(rid, entry, "blocked", e)
            self._remember(rid, {**entry, "blocked": True, "place": place})
            return
        if prev is not None and not prev.get("blocked"):
            if e["kind"] == "redirect":
                told = {**prev, "status": e["status"] if e["status"] is not None else 302, "status_text": e["status_text"]}
                yield self._told(rid, told, "redirected", e, skip_reason=prev.get("skip"))
            else:
                yield self._told(rid, prev, "replaced", e)
        if prev is not None:
            self._leave(rid, prev["place"])
        if self._count("open") >= self.o.max_pending:
            self._evict()
        self._remember(rid, {**entry, "place": self._place(rid)})

    def _place(self, rid: str) -> int:
        place = self._count("next", 1)
        self.store.put("order", place, rid)
        self._count("open", 1)
        return place

    def _evict(self) -> None:
        """Forget the oldest pending request. Places that were left are passed once, and never again."""
        first = self._count("first") or 1
        while (rid := self.store.get("order", first)) is None:
            first += 1
        self.store.put("count", "first", first + 1)
        self._leave(rid, first)

    def step(self, e: dict) -> Iterator[dict]:
        """Apply one event; yields the exchanges that it settles. Events without a pending request, of unknown kinds and
        without a request id change nothing."""
        rid, kind = e["request_id"], e["kind"]
        if rid is None:
            return
        if kind in _OPEN:
            yield from self._opens(rid, e)
            return
        entry = self._entry(rid)
        if entry is None:
            return
        if kind in (EXTRA_REQUEST, EXTRA_RESPONSE):
            self._remember(rid, {**entry, "q1" if kind == EXTRA_REQUEST else "r1": e["headers"]})
        elif kind == "responseReceived" and not entry.get("blocked"):
            skip = "content-type" if e["mime"] and any(e["mime"].startswith(p) for p in self.o.skip_mime) else entry.get("skip")
            self._remember(rid, {**entry, "status": e["status"], "status_text": e["status_text"], "mime": e["mime"], "ip": e["ip"], "r0": e["headers"], "responded": True, "skip": skip})
        elif kind in ("loadingFinished", "loadingFailed"):
            self._leave(rid, entry["place"])
            if entry.get("blocked"):
                return
            if kind == "loadingFailed":
                yield self._told(rid, entry, "failed", e, error_text=e["error_text"], canceled=e["canceled"], blocked_reason=e["blocked_reason"])
            elif not entry.get("responded"):
                yield self._told(rid, entry, "no-response", e, encoded_length=e["encoded_length"])
            else:
                yield self._finished(rid, entry, e)

    def _finished(self, rid: str, entry: dict, e: dict) -> dict:
        reason, total, body = entry.get("skip"), self._count("total"), e["body"]
        size = None if body is None else len(body)
        if reason is None and total >= self.o.max_task:
            reason = "task-cap"
        if reason is None and ((e["encoded_length"] or 0) > self.o.max_response or (size or 0) > self.o.max_response):
            reason = "too-large"
        if reason is None and total + (size or 0) > self.o.max_task:
            reason = "task-cap"
        stored = size is not None and reason is None
        if stored:
            self._count("total", size)
        return self._told(rid, entry, "recorded", e, encoded_length=e["encoded_length"], skip_reason=reason, body=bytes(body) if stored else None, body_bytes=size if stored else None)

    def drain(self) -> Iterator[dict]:
        """What is pending when recording stops, in the order of its places; blocked slots are no exchanges."""
        pending = sorted((json.loads(text)["place"], rid) for rid, text in self.store.every("pending"))
        for place, rid in pending:
            entry = self._entry(rid)
            self._leave(rid, place)
            if not entry.get("blocked"):
                yield self._told(rid, entry, "incomplete", None)


def _events(parts: Iterable[pd.DataFrame]) -> Iterator[dict]:
    """Events in order; times as text, headers as dictionaries."""
    for part in parts:
        part = part.astype(object).where(part.notna(), None)
        for e in part.to_dict("records"):
            yield {**e, "headers": None if e["headers"] is None else json.loads(e["headers"])}


def _frame(rows: Iterable[dict]) -> pd.DataFrame:
    out = pd.DataFrame([{k: r.get(k) for k in _NAMES} for r in rows], columns=_NAMES).astype(object)
    whole = {"task_id", "round", "opened_at", "settled_at", "body_bytes", "encoded_length"}
    kinds = {c: "Int64" for c in whole} | {"status": "Int32", "canceled": "boolean"}
    out = out.astype({c: kinds[c] for c in kinds})
    out["captured_at"] = pd.to_datetime(out["captured_at"], unit="us")
    return out


def _plain(events: DataFrame) -> DataFrame:
    """Events as pandas takes them: headers as JSON text, times as microseconds."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    return events.select(names).withColumns({"headers": F.to_json("headers"), "captured_at": F.unix_micros("captured_at")})


def _typed(settled: DataFrame) -> DataFrame:
    return settled.withColumns({c: F.from_json(c, "map<string,string>") for c in ("request_headers", "response_headers")})


def settle(events: DataFrame, options: Options | None = None) -> DataFrame:
    """Batch form: SETTLED rows (headers as maps) of all tasks, what is pending at the end included.

    events: EVENT. Events of a task meet in one task, in the order of seq; a null seq comes first. Rows of a null task_id
    are a task of their own. Any other column may be null; extra columns are not read; no events give no rows."""
    o = options or Options()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        r = Recorder(key[0], Memory(), o)
        rows = [x for e in _events([part.sort_values("seq", kind="stable", na_position="first")]) for x in r.step(e)]
        return _frame([*rows, *r.drain()])

    return _typed(_plain(events).groupBy("task_id").applyInPandas(run, SETTLED))


class _Maps(Store):
    """The maps of a task in Spark's state store. Keys and values are texts or numbers."""

    FORMS = {"pending": ("request_id string", "entry string"), "order": ("place long", "request_id string"), "rounds": ("request_id string", "n long"), "count": ("name string", "n long")}

    def __init__(self, handle: StatefulProcessorHandle):
        self.maps = {k: handle.getMapState(k, *forms) for k, forms in self.FORMS.items()}

    def get(self, kind, key):
        # One read, where containsKey and getValue would be two.
        got = self.maps[kind].getValue((key,))
        return None if got is None else got[0]

    def put(self, kind, key, value):
        self.maps[kind].updateValue((key,), (value,))

    def drop(self, kind, key):
        self.maps[kind].removeKey((key,))

    def every(self, kind):
        return [(k[0], v[0]) for k, v in self.maps[kind].iterator()]

    def clear(self) -> None:
        for m in self.maps.values():
            m.clear()


class _Processor(StatefulProcessor):
    def __init__(self, options: Options, drain_after: int | None):
        self.o, self.after = options, drain_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.maps = handle, _Maps(handle)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        r = Recorder(key[0], self.maps, self.o)
        # A batch of one task may come in several chunks: they are put in order together.
        part = pd.concat(list(rows)).sort_values("seq", kind="stable", na_position="first")
        yield _frame([x for e in _events([part]) for x in r.step(e)])
        if self.after:
            due = self.due.get()
            if due is not None:
                self.handle.deleteTimer(due[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.after
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(Recorder(key[0], self.maps, self.o).drain())
        self.maps.clear()
        self.due.clear()

    def close(self) -> None:
        pass


def settle_stream(events: DataFrame, options: Options | None = None, drain_after: int | None = None) -> DataFrame:
    """Streaming form of `settle`. Within a micro-batch a task's events are put in order; over batches they must come in
    order. With drain_after (milliseconds) a task that is silent for so long is drained and forgotten; a later event
    begins it anew. Needs the RocksDB state store."""
    timed = "ProcessingTime" if drain_after else "None"
    out = _plain(events).groupBy("task_id").transformWithStateInPandas(_Processor(options or Options(), drain_after), SETTLED, "Append", timed)
    return _typed(out)
