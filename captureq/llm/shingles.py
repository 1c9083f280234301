"""Near duplicates by the word shingles themselves: documents whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more, and all that such links connect.

At that similarity two 64-bit SimHash fingerprints differ in about ten bits, and no set of blocks of 64 bits proves such
a radius in shards of use. So two things propose groups: SimHash links within two bits, and equal bands of min-hashes
(25 of five: a pair at 0.8 is missed with a probability of 5e-5, a closer one less). A proposed group's shingle sets meet
in one task (large groups: every two of its blocks do), where every link is decided by the sets. No proposal links by
itself."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frequent_join, released, text_slices, written
from .components import connected_components
from .simhash import fingerprint_links

WORDS, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 25, 5
#: Shingles of one block of a group; two blocks meet in a task (some hundred bytes of memory a shingle).
BLOCK_SHINGLES = 1_000_000
_FACTORS = np.random.default_rng(21).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every run of `words` words, in order; of the whole of a shorter text; none without words."""
    found = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-words]])
    cuts = map(slice, starts.tolist(), (ends[words - 1 :] - 1).tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(42)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of shingle hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[a : a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of min-hashes; none for the empty set."""
    if not len(shingles):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        least = np.minimum(least, np.multiply.outer(shingles[a : a + 2048], _FACTORS).min(axis=0))
    bands = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(bands[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def similar_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning links among sets (sorted, unique) that connect exactly what pairs of at least this Jaccard similarity
    connect. A set leaves the index once it is reached, so a group of copies costs one search, not one for every pair."""
    out: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets], np.int64)
    free = np.ones(len(sets), bool)
    indexed = np.zeros(0, np.int64)
    names = first = owner = np.zeros(0, np.int64)
    todo: list[int] = []
    seed = 0
    while True:
        if todo:
            at = todo.pop()
        else:
            while seed < len(sets) and not free[seed]:
                seed += 1
            if seed == len(sets):
                return out
            at = seed
            free[at] = False
        left = np.count_nonzero(free)
        if not left:
            return out
        if not len(indexed) or 2 * left < len(indexed):
            indexed = np.flatnonzero(free)
            every, who = np.concatenate([sets[k] for k in indexed]), np.repeat(indexed, size[indexed])
            order = np.argsort(every, kind="stable")
            owner = who[order]
            names, first = np.unique(every[order], return_index=True)
            first = np.append(first, len(owner))
        if not len(names):
            return out
        mine = sets[at]
        spot = np.minimum(np.searchsorted(names, mine), len(names) - 1)
        spot = spot[names[spot] == mine]
        if not len(spot):
            continue
        shared = np.concatenate([owner[a:b] for a, b in zip(first[spot].tolist(), first[spot + 1].tolist(), strict=True)])
        others, both = np.unique(shared, return_counts=True)
        near = others[free[others] & (both >= similarity * (size[at] + size[others] - both) - 1e-9)]
        free[near] = False
        out += [(at, k) for k in near.tolist()]
        todo += near.tolist()


def _marks(df: DataFrame, id_col: str) -> DataFrame:
    """id, t1, t2 (hash of the text), node (digest of its shingle set), n (shingles), fp, bands for every row."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "t1", "t2", "node", "n", "fp", "bands"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, col in text_slices(batch, 3):
                node, n, fp, bands = [], [], [], []
                for t in col.to_pylist():
                    h = shingle_hashes(t)
                    s = np.unique(h)
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    n.append(len(s))
                    fp.append(majority(h))
                    bands.append(band_keys(s))
                cols = [batch.column(k).slice(a, b - a) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=names)

    return df.select(id_col, "t1", "t2", "_t").mapInArrow(run, f"`{id_col}` {kind}, t1 long, t2 long, node binary, n long, fp long, bands array<long>")


def _stars(keyed: DataFrame) -> DataFrame:
    """(a, b): every node of a key that holds several, and the key's least."""
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most"), F.count(F.lit(1)).alias("w")).filter("b <> most").select("key", "b", "w")
    return frequent_join(keyed, least, ["key"], "w", "inner").select(F.col("node").alias("a"), "b").filter("a <> b")


def _decided(members: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """(a, b): links between nodes of one proposed group that the shingle sets bear out. members: grp, node, n, t1, t2;
    texts: t1, t2, text. Rows stay slim until blocks are dealt."""
    blocks = F.greatest(F.ceil(F.sum("n") / block).cast("int"), F.lit(1))
    size = written(members.groupBy("grp").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("w")), "sizes")
    met = frequent_join(members, size, ["grp"], "w", "inner")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "t1", "t2")
    met = met.join(texts, ["t1", "t2"]).select("grp", "lo", "hi", "node", "text")

    def solve(nodes: list[bytes], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        links = similar_links(sets) if len(sets) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        for batch in parts:
            for a, b, col in text_slices(batch, 4):
                keys = zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in range(4)), strict=True)
                for (grp, lo, hi, node), t in zip(keys, col.to_pylist(), strict=True):
                    if (grp, lo, hi) != now:
                        yield from solve(nodes, sets)
                        now, nodes, sets = (grp, lo, hi), [], []
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes(t)))
        yield from solve(nodes, sets)

    order = ["grp", "lo", "hi"]
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a binary, b binary")


def text_hashes(text_col: str = "text") -> tuple[Column, Column]:
    """t1, t2: 128 bits of hash of a text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return F.xxhash64(text, F.lit(1)).alias("t1"), F.xxhash64(text, F.lit(2)).alias("t2")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_SHINGLES) -> DataFrame:
    """id, t1, t2 (hash of the text), component (a digest, equal for what links connect), one row per input row.

    Texts of equal shingle sets are one node, null and wordless texts too: they have the empty set. Null ids and repeated
    rows stay; an empty table gives no rows; other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = df.select(id_col, *text_hashes(text_col), text.alias("_t"))
    rows = written(_marks(docs, id_col), "shingles")
    nodes = rows.groupBy("node").agg(F.min(F.struct("t1", "t2", "n", "fp", "bands")).alias("x"), F.count(F.lit(1)).alias("w"))
    nodes = written(nodes.select("node", "x.*", "w"), "nodes")
    prints = fingerprint_links(nodes.filter("n > 0").select("fp").distinct())
    merged = connected_components(prints).select(F.col("node").alias("fp"), "component")
    by_print = nodes.filter("n > 0").select("node", "fp").join(merged, "fp", "left").select(F.coalesce("component", "fp").alias("key"), "node")
    by_band = nodes.select(F.explode("bands").alias("key"), "node")
    proposed = _stars(by_band).unionByName(_stars(written(by_print, "prints")))
    group = connected_components(proposed).select("node", F.col("component").alias("grp"))
    members = written(nodes.join(group, "node").select("t1", "t2", "node", "n", "grp"), "members")
    texts = docs.select("t1", "t2", F.col("_t").alias("text")).dropDuplicates(["t1", "t2"])
    member = connected_components(_decided(members, texts, block))
    named = written(member.join(nodes.select("node", "w"), "node"), "members")
    return frequent_join(rows.select(id_col, "t1", "t2", "node"), named, ["node"], "w").select(id_col, "t1", "t2", F.coalesce("component", "node").alias("component"))
