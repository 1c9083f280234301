"""Texts as PNG images in binary columns, and low-frequency hashes of what is read back."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: bytes, width: int = 64, level: int = 1) -> bytes:
    """8-bit grey PNG of whole rows. All rows have one filter: of none, left and above that with the least sum of signed
    sizes, the usual rule for a filter that may compress best."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    left, above = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    above[1:] -= rows[:-1]
    choices = (rows, left, above)
    kind = int(np.argmin([np.abs(c.view(np.int8).astype(np.int16)).sum(dtype=np.int64) for c in choices]))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, choices[kind]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def _diagonals(out: np.ndarray, kinds: np.ndarray) -> None:
    """Undo Average and Paeth rows in place, with whatever rows stand between them, along anti-diagonals: a sample needs
    its left, upper and upper left neighbours, so all samples of one diagonal are free at once."""
    height, width = out.shape
    grid = np.zeros((height + 1, width + 1), np.int16)  # a border of zeros above and to the left
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        a, b, c = grid[y + 1, x], grid[y, x + 1], grid[y, x]
        p = a + b - c
        pa_, pb, pc_ = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))
        guess = np.choose(kinds[y], [np.zeros_like(a), a, b, (a + b) >> 1, paeth])
        grid[y + 1, x + 1] = (out[y, x] + guess) & 255
    out[:] = grid[1:, 1:]


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the five row filters of a one-byte-per-pixel image; lines are (height, 1 + width)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    # Runs of rows of one kind: sums along or across them; kinds 3 and 4 go by diagonals, with the row above them.
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        kind = kinds[a] if b > a else 0
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            top = max(a - 1, 0)
            out[top:b] = np.cumsum(out[top:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            top = max(a - 1, 0)
            part, own = out[top:b], kinds[top:b].astype(np.intp)
            if top < a:
                own[0] = 0  # already undone
            _diagonals(part, own)
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, non-interlaced PNG, every chunk's checksum tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body = 8, None, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(part) != n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return unfilter(lines)


@functools.lru_cache(maxsize=4)
def _basis(size: int, keep: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(size) + 1) * np.arange(keep)[:, None] / (2 * size))


def _shrink(a: np.ndarray, size: int) -> np.ndarray:
    """Rows resampled to `size`: means of equal shares, or repeated rows where there are fewer."""
    n = len(a)
    at = np.arange(size) * n // size
    if n < size:
        return a[at]
    return np.add.reduceat(a, at, axis=0) / np.diff(np.append(at, n))[:, None]


def dct_hash(image: np.ndarray, size: int = 32, keep: int = 8) -> str:
    """Signs of the keep x keep lowest cosine coefficients against their median, as hexadecimal digits."""
    small = _shrink(_shrink(image.astype(np.float64), size).T, size).T
    d = _basis(size, keep)
    low = np.round(d @ small @ d.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _mapped(df: DataFrame, binary_col: str, extra: dict[str, str], run) -> DataFrame:
    """mapInArrow over df with `binary_col` last in the input, the other columns carried along."""
    carry = [c for c in df.columns if c != binary_col and c not in extra]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry] + [f"{c} {t}" for c, t in extra.items()])
    names = [*carry, *extra]

    @released
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b, col in text_slices(batch, len(carry), 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(len(carry))] + run(col.to_pylist()), names=names)

    return df.select(*[F.col(f"`{c}`") for c in carry], F.col(binary_col)).mapInArrow(batches, schema)


def to_media(df: DataFrame, payload_col: str = "payload", width: int = 64, level: int = 1) -> DataFrame:
    """The other columns and media binary: each payload (a positive multiple of `width` bytes) as a PNG.

    A null payload counts as empty and fails like any payload that is no positive multiple of the width: text_payload
    makes neither. A column already named media is replaced; an empty table gives no rows."""
    return _mapped(df, payload_col, {"media": "binary"}, lambda xs: [pa.array([write_png(x, width, level) for x in xs], pa.binary())])


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns, and media, payload binary (read back) and feature string (low-frequency hash).

    Null media give null results; a damaged image fails the task. Columns of those names are replaced."""

    def run(xs: list[bytes]) -> list[pa.Array]:
        images = [read_png(x) if x else None for x in xs]
        return [pa.array(xs, pa.binary()), pa.array([None if x is None else x.tobytes() for x in images], pa.binary()), pa.array([None if x is None else dct_hash(x) for x in images], pa.string())]

    return _mapped(df, media_col, {"media": "binary", "payload": "binary", "feature": "string"}, run)


def text_payload(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """id, n_bytes, payload: the text's UTF-8 bytes (null: empty), zero-filled to a positive multiple of `unit`."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.when(n == 0, unit).otherwise((unit - n % unit) % unit)
    return df.select(id_col, n.cast("long").alias("n_bytes"), F.concat(raw, F.repeat(F.lit("\0"), fill).cast("binary")).alias("payload"))
