"""Embedding near-duplicates: cosine links among vectors of one label, by tiles in principal-axis order.

Vectors are scaled to length one and turned onto the principal axes of the whole table, largest first. Tiles of vectors
meet pairwise; a pair's products are summed over the leading axes first, what the rest can add is bounded by the norms
of the two suffixes, and pairs that cannot reach the threshold stop there. Survivors are decided on the given vectors
in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent_join, released, written
from .components import connected_components

#: Vectors in a block of the comparison, and in a tile inside a task.
BLOCK, TILE = 2048, 512


def _matrix(col: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, vec_col: str) -> dict[int, np.ndarray]:
    """For each vector length the orthonormal axes of the second moments, largest first.

    Tasks emit one moment matrix each, summed by entry on the executors: what reaches the driver is length squared."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            col = batch.column(0)
            size = col.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                x = _unit(_matrix(col.filter(pa.array(size == d))))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(m.ravel())], names=["d", "at", "v"])

    total = vectors.select(vec_col).mapInArrow(run, "d int, at int, v double").groupBy("d", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for d in {r["d"] for r in total}:
        m = np.zeros(d * d)
        for r in total:
            if r["d"] == d:
                m[r["at"]] = r["v"]
        m = m.reshape(d, d)
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def tile_links(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, threshold: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) with cosine >= threshold; b None: pairs i < j within a."""
    same = b is None
    b = a if same else b
    ua = _unit(a)
    ub = ua if same else _unit(b)
    ra, rb = ua @ axes, ub @ axes
    d = ra.shape[1]
    steps = [k for k in (8, 16, 32, 64, 128, 256, 512) if k < d] + [d]
    rest = lambda r: {k: np.sqrt((r[:, k:] ** 2).sum(axis=1)) for k in steps}
    sa, sb = rest(ra), rest(rb)
    least = threshold - 1e-9
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for p in range(0, len(a), tile):
        for q in range(p if same else 0, len(b), tile):
            k = steps[0]
            x, y = ra[p : p + tile], rb[q : q + tile]
            part = x[:, :k] @ y[:, :k].T
            i, j = np.nonzero(part + np.outer(sa[k][p : p + tile], sb[k][q : q + tile]) >= least)
            if same and p == q:
                i, j = i[i < j], j[i < j]
            dot = part[i, j]
            for lo, hi in zip(steps[:-1], steps[1:], strict=True):
                if not len(i):
                    break
                if len(i) > x.shape[0] * y.shape[0] // 8:
                    dot = dot + (x[:, lo:hi] @ y[:, lo:hi].T)[i, j]
                else:
                    dot = dot + np.einsum("ij,ij->i", x[i, lo:hi], y[j, lo:hi])
                keep = dot + sa[hi][p + i] * sb[hi][q + j] >= least
                i, j, dot = i[keep], j[keep], dot[keep]
            sure = np.empty(len(i), bool)
            for s in range(0, len(i), 65_536):
                t = slice(s, s + 65_536)
                sure[t] = np.einsum("ij,ij->i", ua[p + i[t]], ub[q + j[t]]) >= threshold
            if sure.any():
                found.append(((p + i[sure]).astype(np.int32), (q + j[sure]).astype(np.int32)))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    return root


def valid_vector(vec_col: str):
    """Condition: not null, not empty, only finite components, not all zero."""
    v = F.col(vec_col)
    # Comparisons place NaN above every number, so the bound excludes it too.
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id that links reach), kept (id = component_id).

    Vectors are compared only where labels are equal and not null and lengths are equal. Null, empty and zero vectors,
    and those with a null or non-finite component, link with nothing, nor do rows with a null label or id. Rows of one
    label with equal vectors collapse before the comparison and count each; an empty table gives no rows; columns other
    than the three are ignored."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    fit = valid_vector("vec") & F.col("label").isNotNull() & F.col("id").isNotNull()
    reps = written(rows.filter(fit).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")), "vectors")
    axes = principal_axes(reps, "vec")
    sizes = reps.groupBy("label", F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = frequent_join(reps.withColumn("d", F.size("vec")), sizes, ["label", "d"], "n", "inner")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "d", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "w", "vec")

    def meet(table: pa.Table) -> pa.Table:
        own, lo = table.column("own").to_numpy(), table.column("lo")[0].as_py()
        d, hi = table.column("d")[0].as_py(), table.column("hi")[0].as_py()
        table = table.take(pa.array(np.argsort(own, kind="stable")))
        own = np.sort(own, kind="stable")
        x, rep, w = _matrix(table.column("vec")), table.column("rep"), table.column("w").to_numpy()
        n = int((own == lo).sum())
        if lo == hi:
            i, j = tile_links(x, None, axes[d], threshold)
        else:
            i, j = tile_links(x[:n], x[n:], axes[d], threshold) if 0 < n < len(x) else (np.zeros(0, np.int32),) * 2
            j = j + n
        links = np.bincount(i, w[j], len(x)) + np.bincount(j, w[i], len(x))
        hit = np.flatnonzero(links)
        root = _roots(len(x), i, j)
        return pa.table({"a": rep.take(pa.array(hit)), "b": rep.take(pa.array(root[hit])), "n": pa.array(links[hit].astype(np.int64))})

    met = written(dealt.groupBy("label", "d", "lo", "hi").applyInArrow(meet, f"a {kind}, b {kind}, n long"), "links")
    member = connected_components(met.select("a", "b").filter("a <> b")).withColumnRenamed("node", "rep")
    links = met.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    # Rows find the vector they equal by 128 bits of hash, so that the vectors themselves are not dealt out again.
    keys = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.reverse("vec"), F.size("vec")).alias("h2")]
    told = reps.join(links, "rep", "left").join(member, "rep", "left").select("label", *keys, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("c"), "w")
    told = written(told.withColumn("fit", F.lit(True)), "told")
    slim = rows.select("id", "label", *keys, fit.alias("fit"))
    out = frequent_join(slim, told, ["label", "h1", "h2", "fit"], "w")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
