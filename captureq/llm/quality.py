"""Document quality from bytes: a small convolutional network in numpy.

A text's bytes are embedded, learned filters slide over them, and each filter's largest response is taken in
overlapping chunks (two neighbouring blocks each) that together cover the whole document; a hidden layer reads each
chunk, and the chunks' mean gives one probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, raw_bytes, released, text_slices, trim

#: Bytes in a block (a chunk is two), embedding size, filters, hidden units; a filter spans three steps of two bytes.
BLOCK, DIM, FILTERS, HIDDEN, PAD = 256, 8, 40, 24, 256
#: Bounds of the training sample: labelled rows of each class, and bytes of an example.
ROWS_PER_CLASS, EXAMPLE_BYTES = 700, 8_192

Model = dict[str, np.ndarray]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each filled with PAD to whole blocks (six PADs at least), and each text's first block."""
    lengths = np.diff(offsets)
    blocks = (lengths + 6 + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.full(first[-1] * BLOCK + 6, PAD, np.uint16)
    for a, n, b in zip(offsets.tolist(), lengths.tolist(), (first * BLOCK).tolist(), strict=False):
        out[b : b + n] = data[a : a + n]
    return out, first


def _steps(model: Model, part: np.ndarray) -> np.ndarray:
    return model["embed"][part].reshape(-1, 2 * DIM)


def _convolve(model: Model, x: np.ndarray) -> np.ndarray:
    """Responses at each step of two bytes; x has three more steps than are returned."""
    w = model["filters"]
    z = x[:-3] @ w[0]
    z += x[1:-2] @ w[1]
    z += x[2:-1] @ w[2]
    return z


def block_maxima(model: Model, sym: np.ndarray, piece: int = 1024, first: np.ndarray | None = None) -> np.ndarray:
    """Each filter's largest response in each block, a bounded piece of blocks at a time. With `first`, windows that
    begin in the PADs at a text's end and reach into the next text do not count, so that a text stands for itself."""
    n = (len(sym) - 6) // BLOCK
    out = np.empty((n, FILTERS), np.float32)
    for a in range(0, n, piece):
        b = min(n, a + piece)
        z = _convolve(model, _steps(model, sym[a * BLOCK : b * BLOCK + 6]))
        z = z.reshape(b - a, BLOCK // 2, FILTERS)
        if first is not None:
            ends = first[1:][(first[1:] > a) & (first[1:] <= b)] - 1 - a
            z[ends, -2:] = -np.inf
        out[a:b] = z.max(axis=1)
    return out + model["bias"]


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right block of every chunk, and each text's first chunk. A text of one block is one chunk."""
    blocks = np.diff(first)
    count = np.maximum(blocks - 1, 1)
    start = np.concatenate([[0], np.cumsum(count)])
    left = np.arange(start[-1]) - np.repeat(start[:-1] - first[:-1], count)
    return left, np.where(np.repeat(blocks, count) > 1, left + 1, left), start


def _head(model: Model, m: np.ndarray, first: np.ndarray):
    left, right, start = _chunks(first)
    c = np.maximum(np.maximum(m[left], m[right]), 0)
    h = np.maximum(c @ model["hidden"] + model["hidden_bias"], 0)
    doc = np.add.reduceat(h, start[:-1], axis=0) / np.diff(start)[:, None]
    return left, right, start, c, h, doc, doc @ model["out"] + model["out_bias"]


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of quality 1 for every text."""
    if "prior" in model:
        return np.full(len(offsets) - 1, float(model["prior"]))
    sym, first = symbols(data, offsets)
    logit = _head(model, block_maxima(model, sym, first=first), first)[-1].astype(np.float64) + float(model["shift"])
    return np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6)


def _gradients(model: Model, texts: list[bytes], y: np.ndarray) -> Model:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sym, first = symbols(data, offsets)
    x = _steps(model, sym)
    n = first[-1]
    z = _convolve(model, x).reshape(n, BLOCK // 2, FILTERS)
    arg = z.argmax(axis=1)
    m = np.take_along_axis(z, arg[:, None], 1)[:, 0] + model["bias"]
    left, right, start, c, h, doc, logit = _head(model, m, first)
    g = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
    out: Model = {"out": doc.T @ g, "out_bias": g.sum()}
    gh = np.repeat((g[:, None] * model["out"]) / np.diff(start)[:, None], np.diff(start), axis=0) * (h > 0)
    out |= {"hidden": c.T @ gh, "hidden_bias": gh.sum(0)}
    gc = (gh @ model["hidden"].T) * (c > 0)
    gm = np.zeros_like(m)
    from_left = m[left] >= m[right]
    np.add.at(gm, left, gc * from_left)
    np.add.at(gm, right, gc * ~from_left)
    out["bias"] = gm.sum(0)
    at = arg + np.arange(n)[:, None] * (BLOCK // 2)
    out["filters"] = np.stack([np.einsum("bfd,bf->df", x[at + k], gm) for k in range(3)])
    embed = np.zeros_like(model["embed"])
    for k in range(3):
        back = (gm[:, :, None] * model["filters"][k].T[None]).reshape(n, FILTERS, 2, DIM)
        for side in (0, 1):
            np.add.at(embed, sym[2 * (at + k) + side].ravel(), back[:, :, side].reshape(-1, DIM))
    return out | {"embed": embed}


def fit(texts: list[bytes], labels: list[int], prior: float | None = None, epochs: int = 8, batch: int = 24, rate: float = 8e-3, seed: int = 5) -> Model:
    """Adam on the logistic loss. With labels of one class or none, a constant (their value, or a half).

    Every longer example also lends a short excerpt under its label: maxima over few bytes are small, and without short
    examples a short text looks like one that repeats itself."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return {"prior": np.array(float(y[0]) if len(y) else 0.5)}
    rng = np.random.default_rng(seed)
    texts = list(texts)
    for t, label in list(zip(texts, labels, strict=True)):
        if len(t) > 160:
            a, n = rng.integers(0, len(t) - 160), rng.integers(4, 160)
            texts.append(t[a : a + n])
            y = np.append(y, np.float32(label))
    norm = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    model: Model = {
        "embed": norm(PAD + 1, DIM, scale=0.5), "filters": norm(3, 2 * DIM, FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32),
        "hidden": norm(FILTERS, HIDDEN, scale=0.2), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": norm(HIDDEN, scale=0.3), "out_bias": np.zeros((), np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    rounds = max(epochs, -(-200 * batch // len(y)))  # few examples: as many steps as a larger sample would make
    for r in range(rounds):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            take = order[a : a + batch]
            grads = _gradients(model, [texts[i] for i in take], y[take])
            step += 1
            lr = rate * (1 - 0.9 * r / rounds)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = (model[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    share = float(y.mean())
    aim = min(max(share if prior is None else prior, 1e-3), 1 - 1e-3)
    return model | {"shift": np.array(np.log(aim / (1 - aim)) - np.log(share / (1 - share)))}


def excerpt(text: Column, key: Column, most: int) -> Column:
    """A binary text of at most `most` bytes whole, of a longer one so many bytes from a place named by the key's hash."""
    room = F.greatest(F.octet_length(text) - most, F.lit(0)) + 1
    return text.substr((F.pmod(F.xxhash64(key), room) + 1).cast("int"), F.lit(most))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS, example_bytes: int = EXAMPLE_BYTES
) -> Model:
    """Fit on a bounded sample: of each class the rows_per_class labelled ids of smallest hash that are in a training
    fold and in docs. Of a text longer than example_bytes an excerpt from anywhere in it is learnt from. Rows with a
    null id, label or text are never learnt from, nor are ids that have both labels; of rows that share an id the text
    of least hash is."""
    label = F.col(label_col).cast("int")
    known = labels.select(F.col(id_col).alias("_id"), label.alias("_y")).filter((fold(F.col("_id")) != 1) & F.col("_y").isin(0, 1))
    sure = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z").drop("_z")
    counts = {r["_y"]: r["count"] for r in sure.groupBy("_y").count().collect()}
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t")).filter(F.col("_t").isNotNull())
    here = sure.join(text.select("_id"), "_id", "left_semi")
    pick = [here.filter(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_class) for k in (0, 1)]
    some = text.join(F.broadcast(pick[0].unionByName(pick[1])), "_id")
    part = excerpt(F.col("_t"), F.col("_id"), example_bytes)
    rows = some.select("_id", "_y", part.alias("_t")).groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), "_t")).alias("x")).collect()
    rows.sort(key=lambda r: (r["_id"], r["_y"]))
    total = sum(counts.values())
    model = fit([bytes(r["x"]["_t"]) for r in rows], [r["_y"] for r in rows], counts.get(1, 0) / total if total else None)
    trim()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id (or, with carry, every column) and score double in 0..1 for the whole text of every row.

    Null and empty texts get the score of an empty text; null ids and repeated rows pass through; a text of any length
    is read in bounded pieces; an empty table gives no rows. With carry, a column named score is replaced."""
    keep = [c for c in docs.columns if c != "score"] if carry else [id_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    text = keep.index(text_col) if carry else 1

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, col in text_slices(batch, text):
                data, offsets = raw_bytes(col)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(len(keep))] + [pa.array(scores(model, data, offsets))], names=[*keep, "score"])

    extra = [] if carry else [F.col(text_col).cast("binary").alias("_t")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], *extra).mapInArrow(run, schema)
