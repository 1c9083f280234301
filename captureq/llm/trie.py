"""Prefix trie of conversations, by an external mergesort whose runs carry common prefixes.

A conversation is the row of its turns' 128-bit digests. Spark deals conversations into ranges of that row (then of the
id, so that copies may lie in several ranges); each task sorts its range in bounded runs, spooled to files of its own,
merges them by a loser tree that knows how many turns each head shares with the row last put out, and keeps the nodes
of the open path on a stack. A node is finished once a row leaves it. Nodes on the path of a range's first or last row
may go on in a neighbour: they are put out as partial sums under a digest of their path, and added up afterwards."""

from __future__ import annotations

import hashlib
import itertools
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frequent_join, released, written

#: Bytes of a turn's digest.
WIDTH = 16
#: Bytes of digests in a sorted run, bytes of a spooled block, characters of a piece of a joined id list.
RUN_BYTES, BLOCK_BYTES, PIECE_CHARS = 8 << 20, 1 << 18, 1 << 16
#: What a task puts out: finished nodes, partial nodes, pieces of their id lists, and its outer paths (words: those of the
#: turns down to a node; side 0 is the first row's path, 1 the last one's).
DONE, PART, ENDS, EDGE = 0, 1, 2, 3
SCHEMA = "kind int, part int, side int, path binary, parent_path binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, piece long, ends string"
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])

Item = tuple[bytes, int, list[int]]  # digests of the turns, conversation, words of each turn


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rebuilt(convs: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, turns binary, words array<long>: every conversation after its rebuilding.

    The first h own turns of conversation c - c % group take the place of c's first h, h = crc32(decimal c) % shared.
    Turns go by turn (null first), then role, then the text's SHA-256, so ties and repeated rows have a fixed order. A
    null role or text is empty. Rows without a conv_id belong to no conversation and are left out. The digests of one
    conversation's turns (24 bytes each) meet in one row."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("\0", F.octet_length(role).cast("string"), role, text), 256), 1, 2 * WIDTH))
    rows = convs.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("order"), digest.alias("digest"), words_of(text).alias("words"))
    # Structs sort field by field, null first: one shuffle by conversation, without a window.
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "order", "digest", "words"))).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("t"))
    first = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    made = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    nothing = F.slice("t", 1, 0)
    turns = F.concat(F.coalesce(F.slice("head", 1, h), nothing), F.slice("t", h + 1, F.greatest(F.size("t") - h, F.lit(0))))
    return made.select("conv_id", turns.alias("t")).select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("turns"), F.col("t.words").alias("words"))


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two rows share, the first `at` being known to be equal."""
    most = min(len(a), len(b)) // WIDTH
    if a[at * WIDTH : most * WIDTH] == b[at * WIDTH : most * WIDTH]:
        return most
    while a[at * WIDTH : at * WIDTH + WIDTH] == b[at * WIDTH : at * WIDTH + WIDTH]:
        at += 1
    return at


def with_lcp(items: Iterable[Item]) -> Iterator[tuple[int, Item]]:
    before = None
    for x in items:
        yield (0 if before is None else shared_turns(before, x[0])), x
        before = x[0]


class Runs:
    """Sorted runs of a task, each a file of pickled blocks of (shared turns with the row before, item)."""

    def __init__(self, run_bytes: int):
        self.run_bytes, self.folder, self.paths, self.held, self.size = run_bytes, None, [], [], 0

    def add(self, item: Item) -> None:
        self.held.append(item)
        self.size += len(item[0]) + 8 * len(item[2]) + 64
        if self.size >= self.run_bytes:
            self._spool()

    def _sorted(self) -> list[Item]:
        rows, self.held, self.size = self.held, [], 0
        rows.sort(key=lambda x: x[:2])
        return rows

    def _spool(self) -> None:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="runs-")
        path = os.path.join(self.folder, str(len(self.paths)))
        with open(path, "wb") as f:
            block, size = [], 0
            for x in with_lcp(self._sorted()):
                block.append(x)
                size += len(x[1][0]) + 64
                if size >= BLOCK_BYTES:
                    pickle.dump(block, f, -1)
                    block, size = [], 0
            pickle.dump(block, f, -1)
        self.paths.append(path)

    @staticmethod
    def _read(path: str) -> Iterator[tuple[int, Item]]:
        with open(path, "rb") as f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def merged(self) -> Iterator[tuple[int, Item]]:
        return merge([*(self._read(p) for p in self.paths), with_lcp(self._sorted())])

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def merge(runs: list[Iterator[tuple[int, Item]]]) -> Iterator[tuple[int, Item]]:
    """One sorted stream of all runs, each row with the turns it shares with the row before (0 for the first).

    A loser tree over the heads. Every head knows how many turns it shares with the row last put out: of two heads the
    one that shares more is the smaller, unseen; if they share equally many, turns are compared from there on, and the
    loser remembers what it shares with the winner, which is the next row put out that it can meet."""
    n = len(runs)
    heads = [next(r, None) for r in runs]
    lcp = [0] * n

    def beats(a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser's count becomes what it shares with the winner."""
        if heads[b] is None:
            return True
        if heads[a] is None:
            return False
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        x, y = heads[a][1], heads[b][1]
        at = shared_turns(x[0], y[0], lcp[a])
        first = x[:2] < y[:2] if at * WIDTH in (len(x[0]), len(y[0])) else x[0][at * WIDTH :] < y[0][at * WIDTH :]
        lcp[b if first else a] = at
        return first

    if not n:
        return
    # Leaves are n..2n-1; inner node k holds the loser of its two subtrees.
    losers, winners = [0] * n, [0] * n + list(range(n))
    for k in range(n - 1, 0, -1):
        a, b = winners[2 * k], winners[2 * k + 1]
        w = a if beats(a, b) else b
        winners[k], losers[k] = w, a + b - w
    top = winners[1]
    while heads[top] is not None:
        yield lcp[top], heads[top][1]
        heads[top] = next(runs[top], None)
        if heads[top] is not None:
            lcp[top] = heads[top][0]  # its own run's count: the row before it is the one just put out
        k = (top + n) // 2
        while k:
            if not beats(top, losers[k]):
                top, losers[k] = losers[k], top
            k //= 2


class _Node:
    __slots__ = ("chars", "ids", "kids", "least", "leaves", "n", "pieces", "shared", "sum")

    def __init__(self):
        self.least, self.n, self.kids, self.leaves = None, 0, 0, 0
        # Rows that share this node with the row before them: how many, and their words down to where they part.
        self.shared, self.sum = 0, 0
        # Conversations that end here, as far as they are not put out in pieces.
        self.ids, self.chars, self.pieces = [], 0, 0

    def joins(self, up: _Node) -> None:
        up.n, up.leaves, up.shared, up.sum = up.n + self.n, up.leaves + self.leaves, up.shared + self.shared, up.sum + self.sum
        up.least = self.least if up.least is None else min(up.least, self.least)


class _Spool:
    """Finished nodes in the order they finish, read back from the last: parents before their children."""

    def __init__(self, rows: int = 20_000):
        self.rows, self.folder, self.blocks, self.held = rows, None, 0, []

    def add(self, row: dict) -> None:
        self.held.append(row)
        if len(self.held) == self.rows:
            if self.folder is None:
                self.folder = tempfile.mkdtemp(prefix="nodes-")
            with open(os.path.join(self.folder, str(self.blocks)), "wb") as f:
                pickle.dump(self.held, f, -1)
            self.blocks, self.held = self.blocks + 1, []

    def backwards(self) -> Iterator[dict]:
        yield from reversed(self.held)
        for k in range(self.blocks - 1, -1, -1):
            with open(os.path.join(self.folder, str(k)), "rb") as f:
                yield from reversed(pickle.load(f))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def path_digest(turns: bytes, depth: int) -> bytes:
    return hashlib.sha256(turns[: depth * WIDTH]).digest()[:WIDTH]


def _path(turns: bytes) -> list[bytes]:
    """The digest of every prefix, the empty one first."""
    sha, out = hashlib.sha256(), []
    for k in range(0, len(turns) + 1, WIDTH):
        out.append(sha.copy().digest()[:WIDTH])
        sha.update(turns[k : k + WIDTH])
    return out


def range_nodes(part: int, stream: Iterable[tuple[int, Item]], piece_chars: int = PIECE_CHARS) -> Iterator[dict]:
    """Rows of SCHEMA for the sorted rows of one range, as if there were no other range.

    Every sum over a subtree is one over rows, given what each shares with the rows beside it: the nodes below that are
    new, the words down to it are saved; a row's last node is a leaf if the next row does not extend it."""
    spool, stack, item, sums, first = _Spool(), [], None, [0], None
    on_first = 0  # the open nodes down to this depth are on the first row's path

    def finish(depth: int, last: bool) -> Iterator[dict]:
        """Close the open nodes from `depth` on."""
        while len(stack) > depth:
            node, d = stack.pop(), len(stack)
            if stack:
                node.joins(stack[-1])
            outer, path = last or d <= on_first, None
            if outer or node.pieces:
                path = path_digest(item[0], d)
                if node.ids:
                    yield {"kind": ENDS, "part": part, "path": path, "piece": node.pieces, "ends": ",".join(node.ids)}
            spool.add({
                "kind": DONE if path is None else PART, "part": part, "path": path, "outer": outer, "conv_id": node.least, "depth": d, "n_convs": node.n, "n_children": node.kids, "n_leaves": node.leaves,
                "saved_tokens": node.sum - node.shared * sums[max(d - 1, 0)], "ends": hashlib.sha256(",".join(node.ids).encode()).hexdigest() if path is None else None,
            })

    try:
        for lcp, now in stream:
            if item is not None:
                stack[-1].leaves += len(item[0]) > lcp * WIDTH
                yield from finish(lcp + 1, False)
                on_first = min(on_first, lcp)
                stack[lcp].shared += 1
                stack[lcp].sum += sums[lcp]
            item = now
            turns, conv, words = item
            sums = list(itertools.accumulate(words, initial=0))
            if first is None:
                first, on_first, edges = item, len(words), sums
            for d in range(len(stack), len(words) + 1):
                if d:
                    stack[-1].kids += 1
                stack.append(_Node())
            node = stack[-1]
            node.n += 1
            node.least = conv if node.least is None else min(node.least, conv)
            node.ids.append(str(conv))
            node.chars += len(node.ids[-1]) + 1
            if node.chars >= piece_chars:
                yield {"kind": ENDS, "part": part, "path": path_digest(turns, len(words)), "piece": node.pieces, "ends": ",".join(node.ids)}
                node.ids, node.chars, node.pieces = [], 0, node.pieces + 1
        if item is None:
            return
        stack[-1].leaves += 1
        yield from finish(0, True)
        for side, turns, so_far in ((0, first[0], edges), (1, item[0], sums)):
            for d, path in enumerate(_path(turns)):
                yield {"kind": EDGE, "part": part, "side": side, "path": path, "depth": d, "words": so_far[d]}
        above: list[dict] = []
        for row in spool.backwards():
            del above[row["depth"] :]
            if above:
                up = above[-1]
                row["parent_path" if up["outer"] else "parent_conv_id"] = up["path" if up["outer"] else "conv_id"]
            above.append(row)
            yield row
    finally:
        spool.close()


def _batches(rows: Iterator[dict], size: int = 4000) -> Iterator[pa.RecordBatch]:
    while block := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in block], f.type) for f in _ARROW], schema=_ARROW)


def _ranges(run_bytes: int):
    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(run_bytes)
        try:
            for batch in parts:
                for item in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    runs.add(item)
            yield from _batches(range_nodes(TaskContext.get().partitionId(), runs.merged()))
        finally:
            runs.close()

    return run


@released
def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, digest of its joined pieces) of rows that come path by path, piece by piece."""
    path, sha = None, None
    for batch in parts:
        out = []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != path:
                if path is not None:
                    out.append((path, sha.hexdigest()))
                path, sha = key, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["path", "ends_sha256"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([sha.hexdigest()])], names=["path", "ends_sha256"])


def _corrections(edges: DataFrame) -> DataFrame:
    """What two neighbouring ranges have counted apart along the path they share: the lower nodes of it as new in the
    second, its words as not saved, the first range's last row as a leaf. One row for each node of the path."""
    spark = edges.sparkSession
    # The numbers of the ranges that have rows: as many as there are tasks.
    have = sorted(r.part for r in edges.select("part").distinct().collect())
    nexts = spark.createDataFrame(list(itertools.pairwise(have)), "part int, next int")
    last = edges.filter("side = 1").join(F.broadcast(nexts), "part").select("next", "depth", "path")
    ends = edges.filter("side = 1").groupBy("part").agg(F.max("depth").alias("length")).join(F.broadcast(nexts), "part").select("next", "length")
    begin = edges.filter("side = 0").withColumnRenamed("part", "next")
    met = begin.join(last, ["next", "depth", "path"])
    most = met.groupBy("next").agg(F.max(F.struct("depth", "words")).alias("m")).join(ends, "next").select("next", F.col("m.depth").alias("shared"), F.col("m.words").alias("all_words"), "length")
    before = begin.select("next", (F.col("depth") + 1).alias("depth"), F.col("words").alias("above"))
    out = met.join(before, ["next", "depth"], "left").join(most, "next")
    return out.select(
        "path", F.lit(None).cast("binary").alias("parent_path"), F.lit(None).cast("long").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(0).cast("long").alias("n_convs"),
        (-(F.col("depth") < F.col("shared")).cast("long")).alias("n_children"), (-(F.col("length") == F.col("shared")).cast("long")).alias("n_leaves"), (F.col("all_words") - F.coalesce("above", F.lit(0))).alias("saved_tokens"),
    )


def conversation_trie(convs: DataFrame, group: int = 20, shared: int = 4, run_bytes: int = RUN_BYTES, ranges: int | None = None) -> DataFrame:
    """One row per node of the prefix trie of all rebuilt conversations (see `rebuilt`): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are equal if role and text are (128 bits of SHA-256). The root is a node wherever there is a conversation; an
    empty table gives no rows. Extra columns are not read. `ranges` is the number of tasks, Spark's shuffle partitions
    unless given. A run holds `run_bytes`; one conversation is in memory whole, as are the open nodes of its path."""
    spark = convs.sparkSession
    items = written(rebuilt(convs, group, shared).select("turns", "conv_id", "words"), "conversations")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = written(items.repartitionByRange(ranges, "turns", "conv_id").mapInArrow(_ranges(run_bytes), SCHEMA), "trie")
    discard(items)
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    named = ["path", "parent_path", "conv_id", "depth", "parent_conv_id", *sums]
    part = out.filter(F.col("kind") == PART).select(named).unionByName(_corrections(out.filter(F.col("kind") == EDGE)))
    part = part.groupBy("path").agg(*(F.max(c).alias(c) for c in ("parent_path", "depth", "parent_conv_id")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
    pieces = out.filter(F.col("kind") == ENDS).select("path", "ends", "part", "piece").repartition("path").sortWithinPartitions("path", "part", "piece").select("path", "ends")
    part = written(part.join(pieces.mapInArrow(_hashed, "path binary, ends_sha256 string"), "path", "left"), "partial-nodes")
    # A parent that only the sums know: few such nodes, but the root has a child in nearly every range.
    up = part.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("up"), "n_children")
    done = out.filter(F.col("kind") == DONE).select(*named, F.col("ends").alias("ends_sha256"))
    known = done.filter("parent_path is null").withColumn("up", F.lit(None).cast("long"))
    joined = frequent_join(done.filter("parent_path is not null").withColumnRenamed("n_children", "kids"), up, ["parent_path"], "n_children").withColumnRenamed("kids", "n_children")
    rest = part.join(up.drop("n_children"), "parent_path", "left")
    every = known.unionByName(joined).unionByName(rest)
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), *sums, F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
