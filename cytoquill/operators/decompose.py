"""Truncated decomposition and its validation across splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a matrix that is summed up densely, at most: 4096 ** 2 doubles are 128 MB.
MOST_COLUMNS = 4096


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index(column))
    if not len(v):
        return np.empty((0, 0))
    x = np.nan_to_num(v.flatten().to_numpy(zero_copy_only=False).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
    return x.reshape(len(v), -1)


def cross_products(df: DataFrame, left: str, right: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, column sums of both array columns, and the matrix of products summed over rows.

    Each task sums its rows; the partial sums are added by entry in one aggregate.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            x, y = _matrix(b, left), _matrix(b, right)
            if len(x):
                n += len(x)
                one = np.concatenate([np.concatenate([x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0)]), (x.T @ y).reshape(-1), [x.shape[1]]])
                sums = one if sums is None else sums + np.append(one[:-1], 0)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["n", "sums"])

    parts = df.select(left, right).mapInArrow(run, "n long, sums array<double>")
    rows = parts.select("n", F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.max("v").alias("m")).orderBy("i").toPandas()
    if not len(rows):
        return 0, np.empty(0), np.empty(0), np.empty((0, 0))
    v, p = rows["v"].to_numpy(), int(rows["m"].iloc[-1])
    q = (len(v) - 1 - 2 * p) // (p + 2)
    return int(rows["n"].iloc[0]), v[: p + q], v[p + q : 2 * (p + q)], v[2 * (p + q) : -1].reshape(p, q)


def svd(vectors: DataFrame, components: int = 250) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores ``id, vec`` of the uncentred decomposition, singular values and right vectors; null and NaN components count as 0.

    The Gram matrix is summed over rows, its eigenvectors are found on the driver; it must have
    at most ``MOST_COLUMNS`` columns. Each right vector's largest entry is positive.
    """
    width = vectors.select(F.max(F.size("vec"))).first()[0] or 0
    if width > MOST_COLUMNS:
        raise ValueError(f"{width} columns are more than {MOST_COLUMNS}; select features first")
    _, _, _, gram = cross_products(vectors.select(F.col("vec").alias("a"), F.col("vec").alias("b")), "a", "b")
    values, right = np.linalg.eigh((gram + gram.T) / 2) if gram.size else (np.empty(0), np.empty((0, 0)))
    order = np.argsort(-values)[: min(components, len(values))]
    values, right = np.sqrt(np.maximum(values[order], 0)), right[:, order]
    right = right * np.where(right[np.abs(right).argmax(0), np.arange(right.shape[1])] < 0, -1, 1) if right.size else right
    sent = vectors.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((_matrix(b, "vec") @ sent.value).tolist(), pa.list_(pa.float64()))], names=["id", "vec"])

    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"id {kind}, vec array<double>"), values, right


def correlations(train: DataFrame, val: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and the correlation of each column of ``train`` with each of ``val`` (both id, vec), over shared ids; 0 for constant columns."""
    both = train.select("id", F.col("vec").alias("a")).join(val.select("id", F.col("vec").alias("b")), "id")
    n, sums, squares, products = cross_products(both, "a", "b")
    p = products.shape[0]
    if n < 3:
        return n, np.zeros(products.shape)
    var = np.maximum(squares / n - (sums / n) ** 2, 0)
    cov = products / n - np.outer(sums[:p], sums[p:]) / n**2
    scale = np.sqrt(np.outer(var[:p], var[p:]))
    return n, np.where(scale > 1e-300, cov / np.where(scale > 0, scale, 1), 0)


def reproducible(n: int, r: np.ndarray, alpha: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Columns of both sides with any correlation whose |z| exceeds the two-sided cut-off for all pairs together.

    Under random pairing of rows a correlation has mean 0 and variance 1 / (n - 1): what
    permutations would estimate is known, so none are drawn.
    """
    if not r.size or n < 3:
        return np.zeros(r.shape[0], bool), np.zeros(r.shape[1] if r.ndim > 1 else 0, bool)
    cutoff = NormalDist().inv_cdf(1 - alpha / r.size / 2)
    hit = np.abs(r) * np.sqrt(n - 1) > cutoff
    return hit.any(1), hit.any(0)


def find_components(train: DataFrame, val: DataFrame, most: int = 250, alpha: float = 0.01) -> tuple[DataFrame, DataFrame, dict]:
    """Scores of both splits restricted to reproducible components, and what was found."""
    (a, sa, _), (b, sb, _) = svd(train, most), svd(val, most)
    n, r = correlations(a, b)
    ka, kb = reproducible(n, r, alpha)
    keep = lambda df, k: df.select("id", F.filter("vec", lambda x, i: F.array_contains(F.array(*[F.lit(int(j)) for j in np.flatnonzero(k)]), i)).alias("vec")) if k.any() else df.select("id", F.array().cast("array<double>").alias("vec"))
    return keep(a, ka), keep(b, kb), {"n": n, "train": int(ka.sum()), "val": int(kb.sum()), "singular_train": sa, "singular_val": sb}
