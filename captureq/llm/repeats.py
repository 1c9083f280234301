"""Removal of byte strings that stand more than once in a corpus, by column-wise collection transforms.

A string of `length` bytes is found under its content anchor. Only anchors whose core stands twice matter. Of equal
segments (all strings of one place that share an anchor) two go on, of others the one; those that share a core meet in a
shard, whose Burrows-Wheeler transform and common prefixes are built column by column and show which starts are
repeated. No start is told repeated by a count of hashes: every verdict is a common prefix of two suffixes in a
transform. Nothing but bounded bitmaps reaches the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import text_segments
from .bwt import repeated_starts
from .common import FREQUENT, discard, frequent_join, raw_bytes, released, text_slices, trim, written

#: Bytes of an anchor's core; segments in one transform; segments of a core from which on it is cut by distance.
CORE, TOGETHER, HOT = 160, 400, 4096
#: Intervals of distance to the anchor into which the segments of a crowded core are cut.
INTERVALS = 8
#: Bytes of text that are hashed at once (some hundred bytes of memory each).
PIECE = 1 << 19
#: Bits of the maps that spare rows a shuffle: of texts (128 KB) and of cores (8 MB, broadcast).
#: A full map spares nothing and stays right.
MAP_BITS, CORE_BITS = 1 << 20, 1 << 26


def _bitmap(ids: DataFrame, column: str, bits: int) -> bytes:
    """One bit for each id of the column, at its remainder: a map of fixed size."""
    slot = F.pmod(F.col(column), F.lit(bits)) + 1
    got = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = bytearray(bits // 8)
    for r in got.toLocalIterator():
        at = (r["n"] - 1) * 4096
        out[at : at + len(r["m"])] = r["m"]
    return bytes(out)


def _may_hold(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that is true for every id in the column and for few others. The map is a table of one row that plans refer to:
    as a constant its text would stand in every description of a plan that the driver keeps."""
    whole = ids.sparkSession.createDataFrame(pa.table({"m": pa.array([_bitmap(ids, column, MAP_BITS)], pa.binary())})).scalar()

    def test(col: Column) -> Column:
        p = F.pmod(col, F.lit(MAP_BITS))
        byte = F.conv(F.hex(F.substring(whole, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, p.bitwiseAND(7).cast("int")) == 1

    return test


def _core_counts(rows: DataFrame, length: int, core: int) -> DataFrame:
    """(key, n): cores that are anchors more than once, and how often."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for _, _, col in text_slices(batch, 0, PIECE):
                got = text_segments(*raw_bytes(col), length, core, PIECE, named=False)
                key, at = np.unique(got["key"], return_inverse=True)
                n = np.bincount(at, got["count"], len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def _segments(rows: DataFrame, length: int, core: int, cores: Broadcast) -> DataFrame:
    """(r1, r2, key, seg, at, count) of the segments whose core the map holds; at packs start, span and lead."""
    names = ["r1", "r2", "key", "seg", "at", "count"]

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(cores.value, np.uint8)
        for batch in parts:
            r1, r2 = (batch.column(k).to_numpy() for k in (0, 1))
            for a, _, col in text_slices(batch, 2, PIECE):
                got = text_segments(*raw_bytes(col), length, core, PIECE)
                slot = got["key"] % CORE_BITS
                hit = np.flatnonzero(known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                row = got["row"][hit] + a
                at = ((got["start"] << 32) | (got["span"] << 16) | got["lead"])[hit]
                cols = (r1[row], r2[row], got["key"][hit], got["seg"][hit], at, got["count"][hit])
                for k in range(0, len(row), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in cols], names=names)

    return rows.select("r1", "r2", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _pieces(text: bytes, key: int, span: int, lead: int, length: int, core: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(shard, first start, bytes, span, lead) of a segment cut by distance to its anchor. All strings of an interval of
    distances share the bytes from the interval's nearest start to its farthest end: their hash names the shard."""
    step = -(-(length - core + 1) // INTERVALS)
    for near in range(0, length - core + 1, step):
        far = min(near + step - 1, length - core)
        lo, hi = max(near, lead - span), min(far, lead)
        if lo <= hi:
            common = text[lead - near : lead - far + length]
            a = lead - hi
            yield xxhash.xxh64_intdigest(common, (key + near) % (1 << 64)) - (1 << 63), a, text[a : lead - lo + length], hi - lo, hi


def _cut_texts(wanted: DataFrame, rows: DataFrame, length: int, core: int) -> DataFrame:
    """The bytes of the wanted segments: (shard, key, seg, first, span, lead, bytes), by one join on the row identity.
    Segments of crowded cores come cut by distance, the others whole in the shard of their core."""
    some = rows.filter(_may_hold(wanted, "r1")(F.col("r1"))).select("r1", "r2", "text").dropDuplicates(["r1", "r2"])
    # A text's segments are at most one for each of its bytes.
    lists = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("key", "seg", "crowded", "at")).alias("w"))
    names = ["shard", "key", "seg", "first", "span", "lead", "bytes"]

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b, col in text_slices(batch, 1, 4 << 20):
                texts, out = col.to_pylist(), []
                want = batch.column(0).slice(a, b - a)
                flat = want.flatten()
                row = np.repeat(np.arange(b - a), want.value_lengths().to_numpy()).tolist()
                for r, key, seg, crowded, at in zip(row, *(flat.field(k).to_pylist() for k in ("key", "seg", "crowded", "at")), strict=True):
                    start, span, lead = at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF
                    text = texts[r][start : start + span + length]
                    if crowded:
                        out += [(shard, key, seg, first, n, d, t) for shard, first, t, n, d in _pieces(text, key, span, lead, length, core)]
                    else:
                        out.append((key, key, seg, 0, span, lead, text))
                for k in range(0, len(out), 20_000):
                    cols = list(zip(*out[k : k + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "bytes" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)

    return lists.join(some, ["r1", "r2"]).select("w", "text").mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'bytes' else 'long'}" for n in names))


def _solve(rows: list[pa.RecordBatch], length: int, width: int, together: int) -> Iterator[pa.RecordBatch]:
    """(key, seg, part) of whole shards: each maximal run of repeated starts of a segment, as first << 16 | last."""
    t = pa.Table.from_batches(rows).combine_chunks()
    # Segments that are equal byte for byte are one string of the transform, with their number.
    strings: dict[tuple, list] = {}
    cols = (t.column(k).to_pylist() for k in ("bytes", "lead", "span", "key", "seg", "first"))
    for text, lead, span, key, seg, first in zip(*cols, strict=True):
        strings.setdefault((text, lead, span), [0, key, seg, first])[0] += 1
    texts, leads, spans = zip(*strings, strict=True)
    number, key, seg, first = zip(*strings.values(), strict=True)
    # Of very many segments one class of distances after the other is looked at.
    rounds = [range(c, c + 1) for c in range(width)] if len(texts) > 4 * together else [None]
    out: list[tuple[int, int, int]] = []
    for classes in rounds:
        for k, flags in enumerate(repeated_starts(texts, leads, spans, length, width, classes, number)):
            if flags.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))) + first[k]
                out += [(key[k], seg[k], x << 16 | y) for x, y in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "seg", "part"])


def _repeated_parts(cut: DataFrame, length: int, width: int) -> DataFrame:
    """(key, seg, part) from the transforms of all shards; several small shards share one."""
    together = TOGETHER

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for batch in parts:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if count >= together and shard[a] != last:
                    yield from _solve(held, length, width, together)
                    held, count = [], 0
                held.append(batch.slice(a, b - a))
                count, last = count + b - a, shard[a]
        if held:
            yield from _solve(held, length, width, together)

    # Work a byte is high here, so partitions are many and not merged by size.
    tasks = 2 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, "key long, seg long, part long")


def _ranges(marks: list[dict], length: int) -> np.ndarray:
    """The packed (from << 32 | to) byte ranges of a text's repeated strings: for each of its segments, and each of the
    equal ones that follow, the runs of repeated starts."""
    out = []
    for m in marks:
        start, span = m["at"] >> 32, (m["at"] >> 16) & 0xFFFF
        for p in m["parts"]:
            x, y = p >> 16, p & 0xFFFF
            if y - x == span:
                out.append((start << 32) | (start + m["count"] * (span + 1) - 1 + length))
            else:
                at = start + (span + 1) * np.arange(m["count"])
                out += (((at + x) << 32) | (at + y + length)).tolist()
    return np.array(out, np.int64)


def _merge(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal runs of packed (from << 32 | to) byte ranges."""
    marks = np.sort(marks)
    a, b = marks >> 32, marks & 0xFFFFFFFF
    reach = np.maximum.accumulate(b)
    fresh = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(a) - 1)]


def _whole_words(text: bytes, a: int, b: int) -> int:
    """The words of text[a:b] that it does not cut."""
    n = len(text[a:b].split())
    n -= a > 0 and not text[a - 1 : a].isspace() and not text[a : a + 1].isspace()
    return n - (b < len(text) and not text[b - 1 : b].isspace() and not text[b : b + 1].isspace())


def _long_runs(text: bytes, marks: np.ndarray, length: int, words: int, enough: int) -> np.ndarray:
    """The packed byte ranges of unbroken runs of repeated starts that hold over `words` words, or `enough` bytes.
    Passages that only touch or overlap have starts between them that are not repeated, and are judged one by one."""
    lo, hi = _merge(marks - (length - 1))
    hi = hi + length - 1
    big = np.array([y - x >= enough or _whole_words(text, x, y) > words for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
    return (lo[big] << 32) | hi[big]


def valid_text(kept: Column) -> Column:
    """The bytes left as text, without characters that a cut has left incomplete."""
    left = kept.cast("string")
    return F.when(F.is_valid_utf8(left), left).otherwise(F.replace(F.make_valid_utf8(left), F.lit("\ufffd"), F.lit("")))


def _repeated_segments(rows: DataFrame, length: int, core: int, width: int) -> DataFrame:
    """(r1, r2, marks): for every text with repeated strings its segments that hold some (at, count) and where (parts)."""
    spark = rows.sparkSession
    long = rows.filter(F.octet_length("text") >= length)
    twice = written(_core_counts(long, length, core), "twice")
    cores = spark.sparkContext.broadcast(_bitmap(twice, "key", CORE_BITS))
    every = _segments(long, length, core, cores)
    # The most frequent cores, a list of fixed length, are found without a shuffle: one may hold a third of all rows.
    frequent = F.broadcast(twice.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", F.lit(True).alias("often")))
    every = written(every.join(frequent, "key", "left"), "segments")
    cores.destroy()
    trim()
    rest = every.filter("often is null").join(twice.select("key"), "key", "left_semi")
    met = written(every.filter("often").unionByName(rest).drop("often"), "met")
    discard(every, twice)
    last = F.col("at") + F.shiftleft((F.col("count") - 1) * (F.shiftright("at", 16).bitwiseAND(0xFFFF) + 1), 32)
    each = written(met.groupBy("key", "seg").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("w"), F.min(F.struct("r1", "r2", "at")).alias("one"), F.max(F.struct("r1", "r2", last.alias("at"))).alias("other")), "each")
    crowd = each.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > HOT).select("key", F.lit(True).alias("crowded"))
    two = F.when(F.col("n") > 1, F.array("one", "other")).otherwise(F.array("one"))
    wanted = each.join(crowd, "key", "left").select("key", "seg", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.explode(two).alias("x"))
    wanted = written(wanted.select("key", "seg", "crowded", "x.r1", "x.r2", "x.at"), "wanted")
    parts = _repeated_parts(_cut_texts(wanted, rows, length, core), length, width).groupBy("key", "seg").agg(F.collect_set("part").alias("parts"))
    verdict = written(parts.join(each.select("key", "seg", "w"), ["key", "seg"]), "verdict")
    discard(wanted, each)
    marks = frequent_join(met, verdict, ["key", "seg"], "w").filter("parts is not null")
    out = written(marks.groupBy("r1", "r2").agg(F.collect_list(F.struct("at", "count", "parts")).alias("marks")), "marks")
    discard(met, verdict)
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, core: int = CORE, width: int = 50, words: int = 0, enough: int = 0) -> DataFrame:
    """Every column of df and kept binary (the bytes left) and spans array<struct<start,stop>> (the removed runs).

    A byte goes if a string of `length` bytes covers it that also starts anywhere else in any row, its own included;
    strings are judged on the input and never cross rows. Null text counts as empty; shorter texts keep everything; rows
    repeated with id and text repeat each other and lose the same bytes; a null id is a value like others; an empty
    table gives no rows. Columns named kept or spans are replaced. Texts are under 2^31 bytes. With `words`,
    of the strings only unbroken runs of more than that many words, or of `enough` bytes, go."""
    carry = [c for c in df.columns if c not in ("kept", "spans")]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = [f"c{i}" for i in range(len(carry))]
    identity = [F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(text, F.col(id_col)).alias("r2")]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], text.alias("text"), *identity)
    lists = _repeated_segments(rows, length, core, width)
    may = _may_hold(lists, "r1")(F.col("r1"))
    spans = "array<struct<start:long,stop:long>>"
    clean = rows.filter(~may).select(*names, F.col("text").alias("kept"), F.array().cast(spans).alias("spans"))
    touched = rows.filter(may).join(lists, ["r1", "r2"], "left").select(*names, "marks", "text")
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))

    def cut_one(t: bytes, marks: list[dict] | None) -> tuple[bytes, list[dict]]:
        found = _ranges(marks, length) if marks else np.zeros(0, np.int64)
        if words and len(found):
            found = _long_runs(t, found, length, words, enough)
        if not len(found):
            return t, []
        at, out, runs = 0, [], []
        for x, y in zip(*(v.tolist() for v in _merge(found)), strict=True):
            out.append(t[at:x])
            runs.append({"start": x, "stop": y})
            at = y
        return b"".join([*out, t[at:]]), runs

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        for batch in parts:
            for a, b, col in text_slices(batch, k + 1):
                marks = batch.column(k).slice(a, b - a).to_pylist()
                kept, runs = zip(*map(cut_one, col.to_pylist(), marks), strict=True)
                same = [batch.column(j).slice(a, b - a) for j in range(k)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pair))], names=[*names, "kept", "spans"])

    cut = touched.mapInArrow(run, f"{kinds}, kept binary, spans {spans}")
    return clean.unionByName(cut).select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "kept", "spans")
