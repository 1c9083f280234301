"""Byte-level BPE through a sentencepiece model that is serialised here from the rank file.

Every byte is spelt as one printable character; the pieces are the vocabulary in that spelling, scored by negative
rank, so sentencepiece merges pairs in rank order. Normalisation is the identity. Pre-tokens are the matches of the
public pattern, encoded one by one; ids decode through the inverse byte mapping."""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_slices
from .pieces import UnitCache, splitter


def byte_alphabet() -> list[str]:
    """A character for each byte: itself where it is printable Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: Sequence[bytes]) -> bytes:
    """A sentencepiece ModelProto; piece 0 is unknown, piece r + 1 is the token of rank r."""
    spell = byte_alphabet()
    out = bytearray(_field(1, _field(1, b"<unk>") + _field(3, 2)))
    for rank, token in enumerate(tokens):
        text = "".join(map(spell.__getitem__, token)).encode()
        out += _field(1, _field(1, text) + b"\x15" + struct.pack("<f", -rank) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in found] != list(range(len(found))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [t for _, t in found]


class ByteBpe:
    """encode texts to little-endian uint32 ids, decode ids to bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise_model(tokens))
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.split = splitter(regex.compile(pattern).findall)
        alphabet = byte_alphabet()
        self.spell = dict(enumerate(alphabet))
        # Decoding: the model's pieces, each spelt back to bytes through the inverse of the alphabet.
        back = {ord(c): b for b, c in enumerate(alphabet)}
        spelt = self.model.id_to_piece(list(range(1, len(tokens) + 1)))
        self.pieces = [bytes(map(back.__getitem__, map(ord, p))) for p in spelt]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        found = [[p.encode() for p in self.split(t)] for t in texts]
        # A pre-token that is itself in the vocabulary is one id, and is not given to the model.
        ids = {p: self.whole[p] for f in found for p in f if p in self.whole}
        rest = list({p for f in found for p in f if p not in ids})
        spelt = [p.decode("latin-1").translate(self.spell) for p in rest]
        for p, i in zip(rest, self.model.encode(spelt, out_type=int, num_threads=1) if spelt else [], strict=True):
            ids[p] = (np.array(i, "<u4") - 1).astype("<u4").tobytes()
        return [b"".join(map(ids.__getitem__, f)) for f in found]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded binary (the ids decoded again), one row per input row.

    Null and empty texts give an empty array and empty bytes; special-token strings are ordinary text; null ids and
    repeated rows pass through; an empty table gives no rows; other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        units = UnitCache(bpe.encode)
        for batch in batches:
            for a, b, col in text_slices(batch, 1, 2 << 20):
                blobs = units.texts(col.to_pylist())
                flat = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in blobs)]).astype(np.int32)
                ids, at = flat.tolist(), ends.tolist()
                back = [bpe.decode(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(back, pa.binary())], names=[id_col, "ids", "decoded"])

    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
