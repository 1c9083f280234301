"""Shared helpers: the shared folder, written intermediate tables, byte-bounded Arrow slices."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captureq.sources.batches import BATCH_BYTES, BATCH_ROWS, bounded_batches, released, trim  # noqa: F401  read by the operators

#: Most bytes of text that one Python step holds at once (one longer text still passes whole).
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is configured, a temporary one is set in local mode (tests); on a
    cluster that is an error, since executors would each write to a disk of their own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="captureq-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/captureq-{uuid.uuid4().hex}-{name}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again: all that was made of them is itself written."""
    for t in tables:
        _delete(t.sparkSession, t.scratch)


def byte_slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, at least one row each."""
    ends = np.cumsum(lengths, dtype=np.int64)
    at, n = 0, len(ends)
    while at < n:
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, stop
        at = stop


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(start, stop, that part of a string or binary column without nulls)."""
    col = batch.column(column)
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    for a, b in byte_slices(pc.binary_length(col).to_numpy(zero_copy_only=False), most):
        yield a, b, col.slice(a, b - a)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a null-free string or binary array, and its row offsets into them."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - (off[0] if len(off) else 0)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3 (1 is held out); a null id is in no fold and is never learnt from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def held_out(id_col: Column) -> Column:
    return F.coalesce(fold(id_col) == 1, F.lit(False))


#: Keys of a join that count as frequent: so many rows of one side at most are broadcast.
FREQUENT = 1000


def frequent_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """Join (left or inner) of a side whose rows may crowd under a few keys with one that has at most one row a key and
    knows in `weight` how many rows the left has there. The right's FREQUENT heaviest rows are broadcast, whatever the
    input's size; no other key can hold more than a thousandth of the left's rows, and those meet by a shuffle, without
    copies. Both sides are read twice: they should be written tables or plain scans."""
    top = right.orderBy(F.desc(weight), *keys).limit(FREQUENT)
    near = left.join(F.broadcast(top.drop(weight)), keys, "inner")
    far = left.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(right.drop(weight), keys, how)
    return near.unionByName(far)
