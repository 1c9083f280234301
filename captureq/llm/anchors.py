"""Content anchors: every byte string of a given length has one, chosen from its bytes alone.

A string's anchor is its core (a run of `core` bytes) of least hash, the leftmost of equals. Starts that share an
anchor form a segment: the bytes from the first start to the end of the last start's string. Equal strings have equal
anchors at equal distances, so they can only meet under one core hash."""

from __future__ import annotations

import numpy as np


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_BYTES = (_table(11), _table(12))
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


#: Powers of a base, as far as any buffer of this process has needed them.
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 12), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[int(base)] = known
    return known[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of any byte ranges of one buffer, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, which: int):
        base = _BASES[which]
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * _powers(base, len(data)) if len(data) else np.zeros(0, np.uint64), out=self.prefix[1:])
        self.back = _powers(_inverse(base), len(data) + 1)

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.back[a])

    def windows(self, k: int) -> np.ndarray:
        return mix((self.prefix[k:] - self.prefix[:-k]) * self.back[: len(self.back) - k])


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that all its bits depend on all bits of the sum."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w values: minima from block borders forwards and backwards."""
    n = len(values)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, core: int, named: bool = True) -> dict[str, np.ndarray]:
    """Segments of all texts in a buffer: row (text), start, span (starts less one), lead (anchor less start), key (core
    hash), seg (hash of the segment's bytes), count. Equal segments that follow each other, as in a text that repeats a
    few words over and over, are one entry with their count; the next one starts span + 1 later. The buffer holds less
    than 2^24 bytes a piece; longer ones are pieced."""
    none = {k: np.zeros(0, np.int64) for k in ("row", "start", "span", "lead", "key", "seg", "count")}
    w = length - core + 1
    if len(data) < length:
        return none
    one = Rolling(data, 0)
    h = one.windows(core)
    place = np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_least((h & ~np.uint64(0xFFFFFF)) | (place & np.uint64(0xFFFFFF)), w) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    if len(offsets) > 2:
        inside = starts + length <= np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
        starts, anchor, row = starts[inside], anchor[inside], row[inside]
    if not len(starts):
        return none
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(starts)]]) - 1
    a, z, p, r = starts[first], starts[last], anchor[first], row[first]
    key, span, lead = h[p], z - a, p - a
    if not named:
        entry = {"row": r, "start": a - offsets[:-1][r], "span": span, "lead": lead, "key": key.view(np.int64)}
        return entry | {"count": np.ones(len(key), np.int64)}
    seg = one.ranges(a, z + length) ^ Rolling(data, 1).ranges(a, z + length)
    again = (seg[1:] == seg[:-1]) & (key[1:] == key[:-1]) & (span[1:] == span[:-1]) & (lead[1:] == lead[:-1]) & (r[1:] == r[:-1])
    head = np.concatenate([[0], np.flatnonzero(~again) + 1])
    out = {"row": r, "start": a - offsets[:-1][r], "span": span, "lead": lead, "key": key.view(np.int64), "seg": seg.view(np.int64)}
    return {k: v[head] for k, v in out.items()} | {"count": np.diff(np.append(head, len(seg)))}


def text_segments(data: np.ndarray, offsets: np.ndarray, length: int, core: int, piece: int = 1 << 22, named: bool = True) -> dict[str, np.ndarray]:
    """segments() over pieces of bounded size. A longer text is read in overlapping pieces, each giving the segments of
    its own starts; a segment that a piece border cuts comes as two, whose starts are still each under its anchor."""
    parts = []
    rows = len(offsets) - 1
    at = 0
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, side="right")) - 1)
        a, b = int(offsets[at]), int(offsets[stop])
        if b - a <= piece or stop > at + 1:
            got = segments(data[a:b], offsets[at : stop + 1] - a, length, core, named)
            got["row"] = got["row"] + at
            parts.append(got)
        else:
            for s in range(a, b, piece):
                e = min(b, s + piece + length - 1)
                got = segments(data[s:e], np.array([0, e - s]), length, core, named)
                got["row"], got["start"] = got["row"] + at, got["start"] + (s - a)
                parts.append(got)
        at = stop
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else segments(data[:0], np.zeros(1, np.int64), length, core, named)
