"""Python steps in bounded memory: the rows that Spark hands to a step at once, those that it hands on, freed memory."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that Spark hands to a Python step at once, where the session has no setting of its own: both sides hold
#: a batch. One longer row is a batch by itself.
BATCH_ROWS, _BATCH_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, _BYTES_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch from Spark's default of 10000, and its bytes, which whole texts make too large."""
    if int(spark.conf.get(_BATCH_KEY)) == 10_000:
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)
    # Without this setting Spark bounds a batch by rows alone, and so does a session that has raised it to its limit.
    given = spark.conf.get(_BYTES_KEY, None)
    if given is None or given in ("-1", str(2**31 - 1), f"{2**31 - 1}b"):
        spark.conf.set(_BYTES_KEY, str(BATCH_BYTES))


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A Python step after whose task freed memory goes back to the system: the worker lives on, idle or for the next
    task, beside others and the JVM."""

    @functools.wraps(run)
    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts)
        trim()

    return step


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as tuples, one after the other."""
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)


def batches_of(rows: Iterable[Sequence], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches that are handed on as soon as their texts and bytes are BATCH_BYTES or their number BATCH_ROWS."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, str | bytes))
        if size >= BATCH_BYTES or len(out) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
