"""Network-event logs as a stream: files of lines, in the order of their names, each event read once.

An offset is a file and the bytes of it that are done; all files before it in name order are done whole. Only the last
file may still grow, by whole lines. A partition is a range of bytes of one file: it gives the lines that begin in it, so
that large files are read side by side. The driver lists names and sizes and looks at the end of the last file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from captureq.operators.records import EXTRA_REQUEST, EXTRA_RESPONSE
from captureq.sources.files import opened

FORMAT = "captureq_events"
SCHEMA = "value string, file string, offset long"
#: Bytes of a partition, of a read, of a batch of lines.
RANGE_BYTES, BLOCK, BATCH = 32 << 20, 1 << 20, 4 << 20


class _Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        super().__init__((file, start, stop))


def lines_between(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at start or later and before stop, without line ends. A line begins at 0 and
    behind every line end; one that is not ended is none."""
    at = start
    if start:
        # Unless a line ends right before it, start lies within one, which is not ours.
        file.seek(start - 1)
        held = file.read(BLOCK)
        while held and b"\n" not in held:
            at += len(held)
            held = file.read(BLOCK)
        cut = held.find(b"\n") + 1
        if not cut:
            return
        at += cut - 1
    file.seek(at)
    rest = b""
    while at < stop:
        more = file.read(BLOCK)
        if not more:
            return
        rest += more
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if at >= stop:
                return
            yield at, line
            at += len(line) + 1


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path.rstrip("/"), range_bytes

    def _files(self) -> list[tuple[str, int]]:
        """Names below the path and sizes, in name order; names that begin with `_` or `.` are not looked at."""
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")

    def _whole(self, name: str, size: int) -> int:
        """Bytes of a file up to its last line end."""
        store, root = opened(self.path)
        with store.open_input_file(f"{root}/{name}") as file:
            stop = size
            while stop:
                start = max(0, stop - BLOCK)
                file.seek(start)
                at = file.read(stop - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                stop = start
        return 0

    def initialOffset(self) -> dict:
        return {"file": "", "bytes": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        if not files:
            return self.initialOffset()
        name, size = files[-1]
        return {"file": name, "bytes": self._whole(name, size)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, size in self._files():
            if start["file"] <= name <= end["file"]:
                a = start["bytes"] if name == start["file"] else 0
                b = end["bytes"] if name == end["file"] else size
                out += [_Range(name, k, min(k + self.range_bytes, b)) for k in range(a, b, self.range_bytes)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, start, stop = partition.value
        store, root = opened(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            texts = pa.array([t.decode("utf-8", "replace") for _, t in rows], pa.string())
            return pa.RecordBatch.from_arrays([texts, pa.array([name] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.int64())], names=["value", "file", "offset"])

        with store.open_input_file(f"{root}/{name}") as file:
            for row in lines_between(file, start, stop):
                rows.append(row)
                size += len(row[1])
                if size >= BATCH:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class EventSource(DataSource):
    """Options: path, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def stream_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value, file, offset of every line of the event files in a folder, and of those that come."""
    spark.dataSource.register(EventSource)
    return spark.readStream.format(FORMAT).option("path", path).option("rangeBytes", str(range_bytes)).load()


#: Wire form of a line: a task's envelope around an event of the public DevTools protocol (its `Network` domain).
_RESPONSE = "struct<status: int, statusText: string, mimeType: string, headers: map<string,string>, remoteIPAddress: string>"
LINE = (
    "taskId long, seq long, at string, method string, body string, base64Encoded boolean, params struct<requestId: string, type: string, request: struct<url: string, method: string, headers: map<string,string>, postData: string>, "
    f"redirectResponse: {_RESPONSE}, response: {_RESPONSE}, headers: map<string,string>, encodedDataLength: double, errorText: string, canceled: boolean, blockedReason: string>, _bad string"
)
#: The six kinds of events that are followed.
KINDS = ("requestWillBeSent", EXTRA_REQUEST, "responseReceived", EXTRA_RESPONSE, "loadingFinished", "loadingFailed")


def network_events(lines: DataFrame) -> DataFrame:
    """Events as `recorder.EVENT`, then _bad: the line itself where it is no JSON object (all else is null then).

    A request that carries the response of a redirect is of kind redirect, with that response's status. A body counts on
    loadingFinished, as base64 where the line says so (text that is none gives a null body). Lines of other events keep
    their kind and bring nothing else; null and empty lines are bad ones. Batch and streaming tables alike."""
    e = lines.select(F.from_json("value", LINE, {"columnNameOfCorruptRecord": "_bad"}).alias("e"), "value").select("e.*", "value")
    p = lambda name: F.col(f"params.{name}")
    kind = F.regexp_replace("method", r"^Network\.", "")
    opening, answer = kind == "requestWillBeSent", F.coalesce(p("response"), p("redirectResponse"))
    body = F.when(kind == "loadingFinished", F.when(F.coalesce("base64Encoded", F.lit(False)), F.try_to_binary("body", F.lit("base64"))).otherwise(F.col("body").cast("binary")))
    bad = F.when(F.col("_bad").isNotNull() | F.col("value").isNull() | (F.trim("value") == ""), F.coalesce("value", F.lit("")))
    headers = F.when(opening, p("request.headers")).when(kind == "responseReceived", p("response.headers")).otherwise(p("headers"))
    told: dict[str, Column] = {
        "task_id": F.col("taskId"), "seq": F.col("seq"), "captured_at": F.try_to_timestamp("at"), "kind": F.when(opening & p("redirectResponse").isNotNull(), "redirect").otherwise(kind), "request_id": p("requestId"), "url": p("request.url"), "method": p("request.method"),
        "resource_type": p("type"), "headers": headers, "status": answer["status"], "status_text": answer["statusText"], "mime": answer["mimeType"], "ip": answer["remoteIPAddress"], "encoded_length": p("encodedDataLength").cast("long"), "body": body,
        "request_body": p("request.postData").cast("binary"), "error_text": p("errorText"), "canceled": p("canceled"), "blocked_reason": p("blockedReason"), "_bad": bad,
    }
    return e.select(*[c.alias(n) for n, c in told.items()])
