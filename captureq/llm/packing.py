"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: a fixed number of sequences is open at a time; a bitset with one bit per amount of free
space finds the tightest one that still fits; when one too many is open, the fullest closes. Each task packs its own
rows, so nothing is shuffled and memory does not grow with the input."""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import released, text_slices
from .pieces import CACHE_ENTRIES, UnitCache


class OpenBins:
    """Open sequences keyed by free space."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.open, self.next = size, limit, 0, 0
        self.mask, self.at = 0, [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        seq = self.at[free].pop()
        if not self.at[free]:
            self.mask ^= 1 << free
        self.open -= 1
        return seq

    def place(self, need: int) -> tuple[int, int]:
        """(sequence, offset in it) for a piece of `need` ids."""
        fits = self.mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            seq, free = self.next, self.size
            self.next += 1
        left = free - need
        if left:
            self.at[left].append(seq)
            self.mask |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return seq, self.size - free


def cut_lengths(n: int, size: int) -> list[int]:
    """Piece lengths of a document of n ids: itself, or full pieces after a first one that may be shorter."""
    if n <= size:
        return [n]
    first = n % size
    return ([first] if first else []) + [size] * (n // size)


class Encoder:
    """Encoding by the tokeniser's own model, pre-token by pre-token: its batch interface also tracks offsets and
    alignments, which cost three times the merges themselves. Texts that hold one of its added tokens, which it cuts out
    before anything else, go through the whole tokeniser."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.find = self.whole.model, regex.compile(PATTERN).findall
        self.spell = dict(enumerate(byte_alphabet()))
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def units(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of units, each given once. Most are a space and a word, with or without a comma or full stop behind
        it: such a word is its own pre-token, spelt as it stands but for the space."""
        out, known, model = [], {}, self.model.tokenize

        def ids(spelt: str) -> bytes:
            return array("I", [x.id for x in model(spelt)]).tobytes()

        def other(p: str) -> bytes:
            found = known.get(p)
            if found is None:
                found = known[p] = ids(p.encode().decode("latin-1").translate(self.spell))
            return found

        for t in texts:
            if t[:1] == " " and t.isascii():
                word = t[1:]
                if word.isalpha():
                    out.append(ids("\u0120" + word))
                    continue
                if t[-1] in ",." and word[:-1].isalpha():
                    out.append(ids("\u0120" + word[:-1]) + other(t[-1]))
                    continue
            out.append(b"".join(map(other, self.find(t))))
        return out

    def texts(self, texts: Sequence[str], cache: UnitCache) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes, as the library gives them without special tokens."""
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not odd:
            return cache.texts(texts)
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        out = cache.texts(plain)
        for i in odd:
            out[i] = array("I", self.whole.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pack_documents(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, open_bins: int = 1024, cache_entries: int = CACHE_ENTRIES
) -> DataFrame:
    """One row per piece: id, piece, start, length, tokens (little-endian uint32), sequence_id, offset.

    A document is its ids followed by end_id; only one longer than `size` is cut, its first piece may be shorter.
    Ids are the library's own with add_special_tokens=False: an added token that stands in a text is one id.
    Null text counts as empty (one piece holding only end_id); a null id passes through; repeated rows are packed each
    by itself; an empty table gives no rows; other columns are ignored. sequence_id is the task number times 2^40 plus
    a counter, so tasks never share a sequence. Within one slice of a batch longer pieces are placed first."""
    end = np.array([end_id], "<u4").tobytes()
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, tokens binary, sequence_id long, offset long"
    names = [id_col, "piece", "start", "length", "tokens", "sequence_id", "offset"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        bins, units = OpenBins(size, open_bins), UnitCache(encoder.units, cache_entries)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for a, _, col in text_slices(batch, 1, 4 << 20):
                rows = []
                for i, blob in enumerate(encoder.texts(col.to_pylist(), units)):
                    start = 0
                    blob += end
                    for k, n in enumerate(cut_lengths(len(blob) // 4, size)):
                        rows.append((n, a + i, k, start, blob[4 * start : 4 * (start + n)]))
                        start += n
                rows.sort(key=lambda r: -r[0])
                put = [bins.place(r[0]) for r in rows]
                n, row, k, start, blob = zip(*rows, strict=True)
                seq, off = zip(*put, strict=True)
                sequence = [base + s for s in seq]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip((k, start, n, blob, sequence, off), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *cols], names=names)

    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)
