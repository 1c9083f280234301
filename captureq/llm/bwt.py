"""Column-wise construction of the Burrows-Wheeler transform of many strings, with common prefixes.

All strings are read from their ends at the same pace: round j inserts every string's suffix of j symbols at once. What
is kept for each suffix, in sorted order, is the symbol before it (the transform), the common prefix with the suffix
above it, the place of its own tail, and whose suffix it is. A round finds the places of the new suffixes by ranks in
the old order, merges old and new rows in one sequential pass, and writes the merged columns to a second set of files;
the two sets take turns. Memory holds one column at a time beside the files."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Sequence

import numpy as np

from .anchors import Rolling

#: Columns of a sorted suffix: first symbol, place of its tail, symbol before it, common prefix with the row above,
#: string, and symbols in it.
COLUMNS = {"first": np.int32, "tail": np.int32, "before": np.int32, "lcp": np.int16, "string": np.int32, "size": np.int16}


class _Files:
    """Two sets of column files of fixed capacity; only the first rows in use are read or written."""

    def __init__(self, rows: int):
        self.folder = tempfile.mkdtemp(prefix="bwt-")
        self.sets = [{k: np.memmap(os.path.join(self.folder, f"{k}{s}"), t, "w+", shape=(max(rows, 1),)) for k, t in COLUMNS.items()} for s in (0, 1)]

    def close(self) -> None:
        self.sets = []
        shutil.rmtree(self.folder, ignore_errors=True)


def _range_min(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Least lcp in lo..hi-1 (hi > lo). zeros counts the rows with common prefix 0 up to each place."""
    out = np.zeros(len(lo), np.int16)
    open_ = np.flatnonzero(zeros[hi] == zeros[lo])
    if len(open_):
        open_ = open_[np.argsort(lo[open_])]  # in order, so that what lies between two ranges is read once at most
        at = np.stack([lo[open_], hi[open_]], axis=1).ravel()
        grown = np.append(lcp, np.int16(0))
        out[open_] = np.minimum.reduceat(grown, at)[::2]
    return out


def collection_bwt(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, size, lcp) of every suffix of every string, in sorted order; symbols are ranks of 0 and up, string k is
    symbols[ends[k-1]:ends[k]]. A suffix sorts before its extensions; lcp counts symbols shared with the row above."""
    starts = np.concatenate([[0], ends[:-1]])
    m = len(ends)
    files = _Files(len(symbols) + m)
    try:
        n = m
        now = files.sets[0]
        length = ends - starts
        now["first"][:n], now["tail"][:n], now["lcp"][:n], now["size"][:n] = -1, -1, 0, 0
        now["string"][:n] = np.arange(m)
        last = np.full(m, -1, np.int32)
        last[length > 0] = symbols[ends[length > 0] - 1]
        now["before"][:n] = last
        newest = np.arange(m)  # places of the newest suffixes
        step = 0
        while True:
            lcp, first, tail = now["lcp"][:n], now["first"][:n], now["tail"][:n]
            symbol = now["before"][newest].astype(np.int64)
            newest, symbol = newest[symbol >= 0], symbol[symbol >= 0]
            if not len(newest):
                break
            step += 1
            order = np.lexsort((newest, symbol))
            newest, symbol = newest[order], symbol[order]
            k = len(newest)
            wide = np.int64(n + 1)
            keys = first.astype(np.int64) * wide + tail
            at = np.searchsorted(keys, symbol * wide + newest)
            del keys
            shift = np.cumsum(np.bincount(at, minlength=n + 1))[:n]
            old_place = np.arange(n) + shift
            place = at + np.arange(k)
            # Common prefixes: one more than the least among the rows between the two tails.
            zeros = np.concatenate([[0], np.cumsum(lcp == 0)])
            above_new = np.concatenate([[False], (at[1:] == at[:-1]) & (symbol[1:] == symbol[:-1])])
            old_above = np.maximum(at - 1, 0)
            same_above = above_new | ((at > 0) & (first[old_above] == symbol))
            above_tail = np.where(above_new, np.concatenate([[0], newest[:-1]]), tail[old_above])
            new_lcp = np.zeros(k, np.int16)
            i = np.flatnonzero(same_above)
            new_lcp[i] = 1 + _range_min(lcp, above_tail[i] + 1, newest[i] + 1, zeros)
            below = np.minimum(at, n - 1)
            last_of = np.concatenate([at[1:] != at[:-1], [True]])
            i = np.flatnonzero(last_of & (at < n) & (first[below] == symbol))
            below_lcp = (below[i], 1 + _range_min(lcp, newest[i] + 1, tail[below[i]] + 1, zeros))
            del zeros
            # One pass over the old columns into the other set of files.
            out = files.sets[step % 2]
            string = now["string"][newest]
            left = length[string] - step
            before = np.where(left > 0, symbols[np.maximum(starts[string] + left - 1, 0)], -1)
            fresh = {"first": symbol, "tail": old_place[newest], "before": before, "lcp": new_lcp, "string": string, "size": step}
            total = n + k
            for c in COLUMNS:
                row = out[c][:total]
                if c == "tail":
                    moved = np.where(tail >= 0, old_place[np.maximum(tail, 0)], -1)
                    row[old_place] = moved
                else:
                    row[old_place] = now[c][:n]
                row[place] = fresh[c]
            out["lcp"][old_place[below_lcp[0]]] = below_lcp[1]
            now, n, newest = out, total, place
        return np.array(now["string"][:n]), np.array(now["size"][:n]), np.array(now["lcp"][:n])
    finally:
        files.close()


def block_ranks(texts: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A rank for the block of `width` bytes at every place of the joined texts (equal blocks, equal ranks; other blocks,
    other ranks), and where each text begins. Blocks are told apart by a hash, and every one is compared with the first
    of its rank, so ranks are exact."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0, *(len(t) for t in texts)])
    if len(data) < width:
        return np.zeros(0, np.int64), base
    # Eight bytes from every place on; blocks are compared eight at a time, the last ones overlapping.
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data.tobytes(), strides=(1,)) if width >= 8 else data
    steps = [*range(0, width - 7, 8), width - 8] if width >= 8 else range(width)
    for which in (0, 1):
        _, first, rank = np.unique(Rolling(data, which).windows(width), return_index=True, return_inverse=True)
        same = first[rank]
        n = len(rank)
        if all(np.array_equal(eight[k : k + n], eight[same + k]) for k in steps):
            return rank.astype(np.int64), base
    raise ValueError("two hashes fail to tell blocks apart")


def repeated_starts(texts: Sequence[bytes], leads: Sequence[int], spans: Sequence[int], length: int, width: int = 50, classes: range | None = None, number: Sequence[int] | None = None) -> list[np.ndarray]:
    """For each text the starts (0..span) whose `length` bytes also stand at another start of these texts.

    A symbol is a block of `width` bytes; width divides length. A text gives one string for each distance to its anchor
    modulo width, cut so that a suffix at each of its starts has all length/width symbols; a start is repeated if its
    suffix shares that many with the row above or below it, or if its row stands for several equal ones: `number` says
    how many texts are equal to each. Equal stretches have equal distances to their anchors, so the classes of distances
    may be handled apart: `classes` names those that are looked at."""
    if length % width:
        raise ValueError("the width does not divide the length")
    need = length // width
    rank, base = block_ranks(texts, width)
    span = np.array(spans)
    wanted = np.arange(width) if classes is None else np.array(classes)
    # One string for each text and class: starts at distances c, c + width, ... before the anchor.
    phase = (np.array(leads)[:, None] - wanted) % width
    text_of, at = np.nonzero(phase <= span[:, None])
    phase = phase[text_of, at]
    every = np.zeros(int((span + 1).sum()), bool)
    flat = np.cumsum([0, *(span + 1)])
    if len(text_of):
        lengths = (span[text_of] - phase) // width + need
        ends = np.cumsum(lengths)
        within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        string, size, lcp = collection_bwt(rank[np.repeat(base[text_of] + phase, lengths) + width * within], ends)
        best = lcp.copy()
        best[:-1] = np.maximum(best[:-1], lcp[1:])
        if number is not None:
            best = np.where(np.array(number)[text_of[string]] > 1, size, best)
        hit = np.flatnonzero(best >= need)
        every[flat[text_of[string[hit]]] + phase[string[hit]] + width * (lengths[string[hit]] - size[hit])] = True
    return [every[a:b] for a, b in zip(flat[:-1], flat[1:], strict=True)]
