"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Two fingerprints that differ in at most two bits agree on two of four 16-bit quarters at least, so each distinct
fingerprint goes to the six shards named by its pairs of quarters. A shard's tree holds at most TREE nodes; larger
shards are cut into blocks and every pair of blocks meets once, one block as the tree and the other as the queries. A
tree's children are keyed by their integer Hamming distance to the parent, and a search follows only the edges within
the radius. Trees travel to the task that holds their queries: broadcasting all of them would grow with the data."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent_join, released, text_slices, written
from .components import connected_components

TREE = 4096


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the word shingles; zero without words."""
    found = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[: -words]])
    n, ones = len(starts), np.zeros(64, np.int64)
    cuts = map(slice, starts.tolist(), (ends[words - 1 :] - 1).tolist())
    hashes = map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(seed))
    while len(part := np.fromiter(itertools.islice(hashes, 255 * 256), np.uint64)):
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for a in range(0, len(bits), 255):
            ones += bits[a : a + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp long (the 64 bits, signed) for every row; null and wordless texts have fingerprint zero."""
    kind = df.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, col in text_slices(batch, 1):
                fp = np.array([fingerprint(t, words) for t in col.to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp)], names=[id_col, "fp"])

    return df.select(id_col, F.col(text_col).cast("binary").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class BkTree:
    """Nodes are [value, {distance: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (value ^ node[0]).bit_count():
            below = node[1].get(d)
            if below is None:
                node[1][d] = [value, {}]
                return
            node = below

    def near(self, value: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = (value ^ node[0]).bit_count()
            if d <= radius:
                yield node[0]
            for edge, child in node[1].items():
                if -radius <= edge - d <= radius:
                    todo.append(child)


def tree_links(tree: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Spanning links among tree values (queries None), or between query and tree values."""
    bk, root = BkTree(), {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    out = []

    def link(x: int, y: int) -> None:
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
            out.append((x, y))

    for value in tree:
        if queries is None:
            for other in bk.near(value, radius):
                link(value, other)
        bk.add(value)
    for value in queries or ():
        for other in bk.near(value, radius):
            link(value, other)
    return out


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (is in the tree, fp) rows of each run of equal shards, over batch borders."""
    held: list[np.ndarray] = []
    for batch in parts:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if held:
            rows = np.vstack([*held, rows])
        cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield rows[a:b, 4], rows[a:b, 5]
        held = [rows[edges[-1] :]]
    if held and len(held[0]):
        yield held[0][:, 4], held[0][:, 5]


def fingerprint_links(fps: DataFrame, radius: int = 2, tree: int = TREE) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) within the radius (2 at most), enough to connect all that are
    linked. No pair within the radius lies in different components of them."""
    if not 0 <= radius <= 2:
        raise ValueError("four quarters prove links up to two bits")
    quarter = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    shards = [F.struct(F.lit(n).alias("band"), (F.shiftleft(quarter[i], 16) + quarter[j]).alias("key")) for n, (i, j) in enumerate(itertools.combinations(range(4), 2))]
    spread = fps.select("fp", F.explode(F.array(*shards)).alias("s")).select("s.band", "s.key", "fp")
    count = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = spread.join(count, ["band", "key"])
    blocks = F.ceil(F.col("n") / tree).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).cast("int").alias("in_tree"), "fp")

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for own, fp in _runs(parts):
            if len(fp) < 2:
                continue
            value = fp.view(np.uint64)
            inside, asks = value[own == 1].tolist(), value[own == 0].tolist()
            out += tree_links(inside, asks or None, radius)
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(pairs, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    order = ["band", "key", "lo", "hi"]
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """id, fp, component_id (smallest id that links reach, itself included), one row per input row.

    Rows of equal fingerprints collapse to one node before any link is looked for. Null and wordless texts have
    fingerprint zero and link like any other; a null id gets the smallest non-null id of its component; repeated rows
    stay repeated; an empty table gives no rows; other columns are ignored."""
    rows = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_n"))
    member = connected_components(fingerprint_links(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    known = fps.join(member, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "_least", "_n")
    known = written(known, "classes")
    least = known.groupBy("component").agg(F.min("_least").alias("component_id"))
    named = written(known.join(least, "component").select("fp", "component_id", "_n"), "named")
    return frequent_join(rows, named, ["fp"], "_n")
