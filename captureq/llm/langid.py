"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are runs of two to four bytes of the lower-cased letters, word ends included. The mean embedding is linear, so
prediction sums one row of a (buckets x languages) table for each subword of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, raw_bytes, released, text_slices, trim
from .quality import excerpt

BUCKETS, DIM, ORDERS = 1 << 13, 8, (2, 3, 4)
#: Bounds of the training sample: texts of each language, and bytes of an example.
ROWS_PER_LANG, EXAMPLE_BYTES = 250, 32_768
PIECE = 1 << 19


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    table[128:] = np.arange(128, 256)
    for b in range(97, 123):
        table[b] = table[b - 32] = b
    return table


_LETTER = _letters()


def _subwords(sym: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each order the buckets of the subwords that start at the first n symbols; BUCKETS where there is none."""
    none = (sym[:n] == 0) & (sym[1 : n + 1] == 0)
    h = sym[:n] * np.uint32(0x9E3779B1) + sym[1 : n + 1] * np.uint32(0x85EBCA77)
    for k in ORDERS:
        if k > 2:
            h = h * np.uint32(0x27D4EB2F) + sym[k - 1 : n + k - 1] * np.uint32(0xC2B2AE3D)
        mixed = h ^ (h >> np.uint32(15))
        at = (mixed * np.uint32(0x2C1B3C6D + 2 * k)) >> np.uint32(32 - 13)
        at[none] = BUCKETS
        yield at


def _spelt(data: np.ndarray) -> np.ndarray:
    """A text's letters between word ends."""
    out = np.zeros(len(data) + 8, np.uint32)
    out[1 : len(data) + 1] = _LETTER[data]
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages); the last row is zero
    bias: np.ndarray
    temperature: float
    reject_below: float  # calibrated confidence under which a text is not given a language
    familiar: np.ndarray  # (BUCKETS + 1,) log shares of the buckets in the languages learnt; the last is zero
    floor: float  # mean log share under which a long text is in none of them
    spread: float  # of one subword's log share: what a short text may lie under the floor

    def foreign(self, familiarity: np.ndarray, subwords: np.ndarray) -> np.ndarray:
        """Whether texts consist of subwords that no learnt language uses; one without subwords does not tell."""
        return familiarity < self.floor - 2 * self.spread / np.sqrt(np.maximum(subwords, 1))


def bag(text: bytes) -> np.ndarray:
    """Shares of the buckets among a text's subwords."""
    sym = _spelt(np.frombuffer(text, np.uint8))
    out = np.zeros(BUCKETS + 1)
    for at in _subwords(sym, len(text) + 1):
        out += np.bincount(at, minlength=BUCKETS + 1)
    out = out[:BUCKETS]
    return (out / max(out.sum(), 1)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[bytes], langs: list[str], epochs: int = 15, batch: int = 16, rate: float = 8.0, seed: int = 7, keep: float = 0.998) -> Model:
    """SGD over four fifths of the examples; the rest sets the temperature (least log loss) and the rejection bounds.

    The bound of confidence is four fifths of what `keep` of those texts pass, and at most 0.15 over a guess: short
    texts are unsure. A softmax is sure of foreign texts too, so the second bound is on the mean log share of a text's
    subwords among those of the languages (each weighs alike): what `keep` of the held-back texts of every language pass,
    less half the spread of one subword. Without examples the model knows no language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(BUCKETS + 1, np.float32), 0.0, 0.0)
    y = np.array([names.index(x) for x in langs])
    c = np.stack([bag(t) for t in texts])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    test, own = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 10 else (order, order)
    share = np.mean([c[own[y[own] == k]].mean(axis=0) for k in np.unique(y[own])], axis=0)
    familiar = np.log(0.9 * share + 0.1 / BUCKETS)
    e = (rng.standard_normal((BUCKETS, DIM)) / DIM**0.5).astype(np.float32)
    w = (rng.standard_normal((DIM, len(names))) / DIM**0.5).astype(np.float32)
    b = np.zeros(len(names), np.float32)
    one = np.eye(len(names), dtype=np.float32)
    for r in range(epochs):
        lr = rate * (1 - r / epochs)
        for a in range(0, len(own), batch):
            take = own[a : a + batch]
            x = c[take] @ e
            g = (_softmax(x @ w + b) - one[y[take]]) / len(take)
            back = g @ w.T
            w -= 0.1 * lr * (x.T @ g)
            b -= 0.05 * lr * g.sum(0)
            e -= lr * 8 * (c[take].T @ back)
        own = rng.permutation(own)
    z = (c[test] @ e) @ w + b
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = _softmax(z / temperature).max(axis=1)
    bound = min(float(np.quantile(sure, 1 - keep)) * 0.8, 1 / len(names) + 0.15)
    known = c[test] @ familiar
    spread = float(np.sqrt(np.maximum(c[test] @ familiar**2 - known**2, 0)).mean())
    floor = min(float(np.quantile(known[y[test] == k], 1 - keep)) for k in np.unique(y[test])) - spread / 2
    table = np.vstack([e @ w, np.zeros((1, len(names)))]).astype(np.float32)
    return Model(names, table, b.astype(np.float64), temperature, bound, np.append(familiar, 0).astype(np.float32), floor, spread)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG, example_bytes: int = EXAMPLE_BYTES) -> Model:
    """Fit on a bounded sample: of each non-null language the rows_per_lang ids of smallest hash in the training folds
    whose texts hold a letter. Of a text longer than example_bytes an excerpt from anywhere in it is learnt from."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l"), F.col(text_col).alias("_t"))
    own = own.filter((fold(F.col("_id")) != 1) & F.col("_l").isNotNull() & F.col("_t").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id"))
    pick = own.select("_id", "_l").withColumn("_r", rank).filter(F.col("_r") <= rows_per_lang).select("_id", "_l").distinct()
    part = excerpt(F.col("_t").cast("binary"), F.col("_id"), example_bytes)
    some = own.join(F.broadcast(pick), ["_id", "_l"]).select("_id", "_l", part.alias("_t"))
    rows = some.withColumn("_r", rank).filter(F.col("_r") <= rows_per_lang).collect()
    rows.sort(key=lambda r: (r["_id"], r["_l"], bytes(r["_t"])))
    model = fit([bytes(r["_t"]) for r in rows], [r["_l"] for r in rows])
    trim()
    return model


def subword_means(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean table row over the subwords of every text, and their number; a text is read in pieces of fixed places, so its
    sum depends on it alone."""
    out, number = np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        sym = _spelt(data[a:b])
        total, n = np.zeros(table.shape[1]), 0
        for p in range(0, b - a + 1, PIECE):
            m = min(PIECE, b - a + 1 - p)
            for at in _subwords(sym[p : p + m + 8], m):
                count = np.bincount(at, minlength=BUCKETS + 1) if m > 4 * BUCKETS else None
                if count is None:
                    total += table.take(at, axis=0).sum(axis=0, dtype=np.float64)
                    n += m - int(np.count_nonzero(at == BUCKETS))
                else:
                    total += count @ table.astype(np.float64)
                    n += int(count[:BUCKETS].sum())
        out[i], number[i] = total / max(n, 1), n
    return out, number


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Calibrated logits of every text."""
    return (subword_means(model.table, data, offsets)[0] + model.bias) / model.temperature


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id (or, with carry, every column), lang_pred, score (calibrated confidence) and rejected.

    lang_pred is `und` with score 0 for a null text, one without a letter, or a model that knows no language; rejected
    marks these, texts whose confidence is under the model's bound, and texts of subwords that no learnt language uses. Null ids and repeated rows pass through, texts
    of any length are read whole, an empty table gives no rows. With carry, columns of those names are replaced."""
    told = ["lang_pred", "score", "rejected"]
    keep = [c for c in docs.columns if c not in told] if carry else [id_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, rejected boolean"
    names = np.array([*model.langs, "und"], object)
    at = keep.index(text_col) if carry else len(keep) + 1
    wide = np.column_stack([model.table, model.familiar])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = np.array(batch.column(len(keep)).to_pylist(), bool)
            for a, b, col in text_slices(batch, at):
                has = letter[a:b] & bool(model.langs)
                if model.langs:
                    data, offsets = raw_bytes(col)
                    means, number = subword_means(wide, data, offsets)
                    p = _softmax((means[:, :-1] + model.bias) / model.temperature)
                    foreign = model.foreign(means[:, -1], number)
                    best, sure = np.where(has, p.argmax(axis=1), len(model.langs)), np.where(has, np.round(p.max(axis=1), 6), 0.0)
                else:
                    best, sure, foreign = np.zeros(b - a, int), np.zeros(b - a), np.ones(b - a, bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(a, b - a) for k in range(len(keep))] + [pa.array(names[best].tolist(), pa.string()), pa.array(sure), pa.array(~has | foreign | (sure < model.reject_below))],
                    names=[*keep, *told],
                )

    text = F.col(text_col)
    extra = [] if carry else [text.cast("binary").alias("_t")]
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_captureq_letter")
    return docs.select(*[F.col(f"`{c}`") for c in keep], letter, *extra).mapInArrow(run, schema)
