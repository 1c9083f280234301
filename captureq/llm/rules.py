"""Quality rules of a text: counts, and repetition by a suffix array over its words.

The suffixes of every text of a slice are sorted together, a text's own in one block, by doubling ranks: a round orders
only suffixes that are not yet told apart, by the rank of what follows them. The ranks of each round are kept where
suffixes share that many words, and give the common prefix of neighbours in the finished array. Intervals of common
prefixes are the repeated strings; those that no word before them extends are the maximal ones, and the union of their
spans is what of a text is repeated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, released, text_slices

#: Words of a repeat that counts.
MIN_WORDS = 8
#: Limits: least words, repeated words of a hundred (these two are the base rules); repeated characters of a hundred,
#: words of the longest repeat.
LEAST_WORDS, MOST_REPEATED, MOST_COVERED, MOST_LONG = 20, 30, 30, 64
#: Bytes of text sorted at once (one longer text still passes whole, at some 40 bytes of memory for each of its own).
SLICE = 4 << 20

_SPACE, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Level:
    """Ranks of the suffixes that share `size` words with another of their text: equal words, equal rank."""

    size: int
    at: np.ndarray | None  # places, ascending; None: rank has every place
    rank: np.ndarray

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words from places i on equal those from j on; places must lie in the array."""
        if self.at is None:
            return self.rank[i] == self.rank[j]
        if not len(self.at):
            return np.zeros(len(i), bool)
        a, b = (np.minimum(np.searchsorted(self.at, x), len(self.at) - 1) for x in (i, j))
        return (self.at[a] == i) & (self.at[b] == j) & (self.rank[a] == self.rank[b])


def suffix_array(codes: np.ndarray, row: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """(places of all suffixes, text by text and sorted within each; the levels). codes: a number for each word, row:
    its text, ends: for each word the end of its text. A suffix sorts before its extensions."""
    n = len(codes)
    key = row.astype(np.int64) * (int(codes.max()) + 1 if n else 1) + codes
    sa = np.argsort(key, kind="stable")
    slots, held = np.arange(n), sa
    key = key[sa]
    rank = np.zeros(n, np.int64)
    levels, size = [], 1
    while len(held):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = slots[np.maximum.accumulate(np.where(new, np.arange(len(held)), 0))]
        rank[held] = begin
        many = ~(new & np.append(new[1:], True))
        slots, held, begin = slots[many], held[many], begin[many]
        if not len(held):
            break
        if len(held) * 8 > n:
            levels.append(Level(size, None, rank.astype(np.int32) if n < 2**31 else rank.copy()))
        else:
            order = np.argsort(held)
            levels.append(Level(size, held[order], begin[order]))
        after = held + size
        follow = np.where(after < ends[held], rank[np.minimum(after, n - 1)] + 1, 0)
        key = begin * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        held, key = held[order], key[order]
        sa[slots] = held
        size *= 2
    return sa, levels


def common_prefixes(sa: np.ndarray, levels: list[Level], ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, lcp): every slot whose suffix shares `least` words or more with the one in the slot before it."""
    k = least.bit_length() - 1
    if k >= len(levels) or len(sa) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slots = 1 + np.flatnonzero(levels[k].equal(sa[:-1], sa[1:]))
    a, b = sa[slots - 1], sa[slots]
    shared, last = np.zeros(len(slots), np.int64), len(sa) - 1
    for level in reversed(levels):
        i, j = a + shared, b + shared
        shared += level.size * ((i < ends[a]) & (j < ends[b]) & level.equal(np.minimum(i, last), np.minimum(j, last)))
    keep = shared >= least
    return slots[keep], shared[keep]


def maximal_repeats(sa: np.ndarray, slots: np.ndarray, lcp: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first slot, slots, words) of each interval of common prefixes whose string is a maximal repeat: its occurrences
    are followed by different words (or an end), as in any interval, and preceded by different ones. before: for each
    place the word before it, a negative number of its own where there is none."""
    mixed = object()

    def close(bound: int, stack: list[list]) -> Iterator[tuple[int, int, int]]:
        while stack and stack[-1][0] > bound:
            words, begin, left = stack.pop()
            if left is mixed:
                yield begin, end - begin, words
            if stack and stack[-1][0] >= bound:
                top = stack[-1]
                top[2] = left if top[2] == left else mixed
            elif bound:
                stack.append([bound, begin, left])

    stack: list[list] = []
    end = -1
    for slot, words, was, now in zip(slots.tolist(), lcp.tolist(), before[sa[slots - 1]].tolist(), before[sa[slots]].tolist(), strict=True):
        if slot != end:
            yield from close(0, stack)
            end = slot
        yield from close(words, stack)
        if not stack or stack[-1][0] < words:
            stack.append([words, slot - 1, was])
        top = stack[-1]
        top[2] = now if top[2] == now else mixed
        end = slot + 1
    yield from close(0, stack)


def measures(data: np.ndarray, off: np.ndarray, min_words: int = MIN_WORDS) -> dict[str, np.ndarray | list]:
    """The counts of each text of a slice: data is the bytes of all, text k is data[off[k]:off[k + 1]]."""
    m = len(off) - 1
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word that runs over the start of a text is two.
    cuts = off[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[word[cuts] & word[cuts - 1]]
    begin, stop = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([stop, cuts]))
    first = np.searchsorted(begin, off)
    chars = np.concatenate([[0], np.cumsum(word & ((data & 0xC0) != 0x80))])
    symbols = np.searchsorted(np.flatnonzero(_SYMBOL[data]), off)
    out = {"n_words": np.diff(first), "word_chars": chars[off[1:]] - chars[off[:-1]], "n_symbols": np.diff(symbols), "n_dup_lines": _repeated_lines(data, off, begin)}
    n = len(begin)
    row = np.repeat(np.arange(m), out["n_words"])
    codes = _codes(data[word], stop - begin)
    ends = first[1:][row]
    sa, levels = suffix_array(codes, row, ends)
    slots, lcp = common_prefixes(sa, levels, ends, min_words)
    # The deepest interval around a suffix gives its longest repeat; shorter ones and later starts lie in its span.
    best = np.zeros(n + 1, np.int64)
    for at in (slots, slots - 1):
        np.maximum.at(best, sa[at], lcp)
    hit = np.flatnonzero(best)
    covered = np.cumsum(np.bincount(hit, minlength=n + 1) - np.bincount(hit + best[hit], minlength=n + 1))[:n] > 0
    longest, repeats = np.zeros(m, np.int64), np.zeros(m, np.int64)
    np.maximum.at(longest, row[hit], best[hit])
    before = np.where(np.arange(n) > first[:-1][row], np.concatenate([[0], codes[:-1]]) if n else codes, -1 - np.arange(n))
    for slot, _, _ in maximal_repeats(sa, slots, lcp, before):
        repeats[row[sa[slot]]] += 1
    per_word = chars[stop] - chars[begin]
    opens = covered & (~np.concatenate([[False], covered[:-1]]) | (np.arange(n) == first[:-1][row]))
    shuts = covered & (~np.append(covered[1:], False) | (np.arange(n) == ends - 1))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for a, b in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(shuts).tolist(), strict=True):
        spans[row[a]].append((a - int(first[row[a]]), b + 1 - int(first[row[a]])))
    total = lambda x: np.bincount(row, weights=x, minlength=m).astype(np.int64)
    return out | {"n_repeat_words": total(covered), "repeat_chars": total(covered * per_word), "longest_repeat": longest, "n_repeats": repeats, "spans": spans}


def _codes(joined: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each string of the joined bytes, equal for equal strings."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(joined))])
    return col.dictionary_encode().indices.to_numpy().astype(np.int64)


def _repeated_lines(data: np.ndarray, off: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each text its lines with a word that equal an earlier one."""
    m, newline = len(off) - 1, data == 10
    starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(newline) + 1, off[-1:]]))
    stops = np.append(starts[1:], off[-1]) if len(starts) else starts
    full = np.searchsorted(begin, stops) > np.searchsorted(begin, starts)
    lengths = stops - starts
    lengths[full] -= newline[stops[full] - 1]
    at = starts[full]
    row = np.searchsorted(off, at, "right") - 1
    size = len(data) + 1
    inside = np.cumsum(np.bincount(at, minlength=size) - np.bincount(at + lengths[full], minlength=size))[:-1] > 0
    code = _codes(data[inside], lengths[full])
    _, once = np.unique(row * (len(code) + 1) + code, return_index=True)
    return np.bincount(row, minlength=m) - np.bincount(row[once], minlength=m)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat", "n_repeats"]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, the counts (long) and spans, array<struct<start, end>> of word places: one row for each row of docs.

    Words are runs of other than the six ASCII white space characters, over whole texts. A null or empty text has no
    words and zeros. n_repeat_words: words in a repeat of min_words words or more of the same text, the first occurrence
    included; repeat_chars: their code points; longest_repeat: words of the longest; n_repeats: maximal repeats. Ties and
    repeated rows are measured alike and apart; an empty table gives no rows; columns but those two are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc", *COUNTS, "spans"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b, col in text_slices(batch, 1, SLICE):
                got = measures(*raw_bytes(col), min_words)
                spans = pa.array([[{"start": x, "end": y} for x, y in s] for s in got["spans"]], span)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(got[c], pa.int64()) for c in COUNTS), spans], names=names)

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, {', '.join(f'{c} long' for c in COUNTS)}, spans array<struct<start: long, end: long>>").withColumnRenamed("doc", id_col)


def base_failed(least: int = LEAST_WORDS, repeated: int = MOST_REPEATED) -> Column:
    return (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > repeated * F.col("n_words"))


def within_limits(covered: int = MOST_COVERED, longest: int = MOST_LONG) -> Column:
    """The method's own verdict: repeats hold at most so many of a hundred characters of the words, the longest at most so
    many words."""
    return (100 * F.col("repeat_chars") <= covered * F.col("word_chars")) & (F.col("longest_repeat") <= longest)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """What `measured` returns, with base_failed and kept. limits: covered and longest of `within_limits`."""
    out = measured(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & within_limits(**limits))
