"""Text quality by a generalised additive model with pairwise interactions.

Cyclic boosting: in turn, each feature gets a shallow tree over its bins, fitted to the gradient
of what the whole model still gets wrong; its leaves are added to the feature's lookup table.
Then the pairs of features whose joint bins explain most of the rest get tables of their own, in
the same way. A score is the sum of table entries, through the logistic function.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.common import arrow_map, map_batches, pieces

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "log_longest_word", "log_line_bytes", "upper", "digit", "symbol", "stop", "comma", "bang", "pipe",
    "space", "non_ascii", "distinct_words", "distinct_lines", "commonest_word", "repeated_neighbours", "compressed", "entropy",
)


def _bytes(chars: str) -> np.ndarray:
    return np.array([chr(b) in chars for b in range(256)], float)


_UPPER, _LOWER = (_bytes("".join(chr(a + i) for i in range(26))) for a in (65, 97))
_CLASSES = np.stack([
    _UPPER, _LOWER, _bytes("0123456789"), _bytes("#$%&*@^~<>{}[]=+\\/_"), _bytes("."), _bytes(",;:"), _bytes("!?"), _bytes("|"), _bytes(" \t\r\n\v\f"), (np.arange(256) >= 128).astype(float),
], 1)


def text_features(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` for each whole text; null and empty texts have zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    counts = np.zeros((len(texts), 256))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode()
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = raw.lower().split()
        lines = raw.split(b"\n")
        distinct = Counter(words)
        w = max(len(words), 1)
        out[i, :5] = math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, distinct)) / max(len(distinct), 1), math.log1p(max(map(len, words), default=0)), math.log1p(len(raw) / len(lines))
        out[i, 14:19] = len(distinct) / w, len(set(lines)) / len(lines), max(distinct.values(), default=0) / w, sum(map(bytes.__eq__, words, words[1:])) / w, len(zlib.compress(raw, 1)) / len(raw)
    total = np.maximum(counts.sum(1), 1)
    k = counts @ _CLASSES
    letters = np.maximum(k[:, 0] + k[:, 1], 1)
    words = np.maximum(np.expm1(out[:, 1]), 1)
    out[:, 5:14] = np.stack([k[:, 0] / letters, k[:, 2] / total, k[:, 3] / total, k[:, 4] / words, k[:, 5] / words, k[:, 6] / words, k[:, 7] / words, k[:, 8] / total, k[:, 9] / total], 1)
    p = counts / total[:, None]
    out[:, 19] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return out


class Gam(NamedTuple):
    """Bin edges and lookup tables; ``pair_edges`` are the coarser bins of the pair tables."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: bins of all rows at once, one addition for each table."""
        total = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, f], "right")]
        bins = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for f in {f for p in self.pairs for f in p}}
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1])) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, ridge: float) -> np.ndarray:
    """Newton steps for each bin, constant over at most ``leaves`` runs of bins, split greedily by gain."""
    cg, ch, cn = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    runs = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        m = np.arange(a + 1, b)
        lg, lh, rg, rh = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
        gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        gain[(cn[m] - cn[a] < least) | (cn[b] - cn[m] < least)] = 0
        i = int(gain.argmax())
        return float(gain[i]), int(m[i])

    while len(runs) < leaves:
        gains = [best(a, b) for a, b in runs]
        i = max(range(len(runs)), key=lambda j: gains[j][0])
        if gains[i][0] <= 1e-9:
            break
        a, b = runs[i]
        runs[i : i + 1] = [(a, gains[i][1]), (gains[i][1], b)]
    out = np.empty(len(g))
    for a, b in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a table of bins into four by one threshold on each axis: gain, and the step of each cell."""
    pad = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = pad(g), pad(h)
    r, c = g.shape
    if r < 2 or c < 2:
        return 0.0, np.zeros_like(g)
    parts = lambda s: (s[1:-1, 1:-1], s[1:-1, -1:] - s[1:-1, 1:-1], s[-1:, 1:-1] - s[1:-1, 1:-1], s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + s[1:-1, 1:-1])
    quarters = list(zip(parts(cg), parts(ch), strict=True))
    gain = sum(a**2 / (b + ridge) for a, b in quarters) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = [a[i, j] / (b[i, j] + ridge) for a, b in quarters]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 200, rate: float = 0.08, leaves: int = 4, pairs: int = 6, least: int = 5, ridge: float = 2.0) -> Gam:
    """Fit to 0/1 labels. Without rows of both labels all tables are zero and every score is (ones + 1) / (rows + 2)."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    intercept = math.log(share / (1 - share))
    edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    pair_edges = [_edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Gam(intercept, edges, tables, [], pair_edges, [])
    if not 0 < y.sum() < n:
        return model
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    in_bin = [np.bincount(b, minlength=len(t)) for b, t in zip(at, tables, strict=True)]
    total = np.full(n, intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for b, t, c in zip(at, tables, in_bin, strict=True):
            g, h = gradient()
            step = rate * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), c, leaves, least, ridge)
            t += step
            total += step[b]
    low = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(pair_edges)]
    shape = [len(e) + 1 for e in pair_edges]

    def joint(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = gradient()
        cell = low[a] * shape[b] + low[b]
        tab = lambda v: np.bincount(cell, v, shape[a] * shape[b]).reshape(shape[a], shape[b])
        return _cross(tab(g), tab(h), ridge)

    gains = sorted(((joint(a, b)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    for _, a, b in gains[:pairs]:
        model.pairs.append((a, b))
        model.pair_tables.append(np.zeros((shape[a], shape[b])))
    for _ in range(rounds // 4):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * joint(a, b)[1]
            t += step
            total += step[low[a], low[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Fit on at most ``rows`` labelled documents, those of the smallest xxhash64 of doc_id.

    Rows whose crc32 of the id as text leaves 2 modulo 4 are held out. Null labels don't count; of
    several labels of a document the largest counts, of several rows with its id any.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers are broadcast, and as many rows of features come to the driver.
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "quality": cols["quality"], "x": list(text_features(cols["text"]))}

    got = arrow_map(mine.select("doc_id", "quality", "text"), run, "doc_id long, quality int, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(rows).toPandas()
    if not len(got):
        return fit_gam(np.empty((0, len(FEATURES))), np.empty(0))
    return fit_gam(np.stack(got["x"].to_numpy()), got["quality"].to_numpy().astype(float))


def held_out(doc_id):
    """Column: the row must not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def score_documents(docs: DataFrame, model: Gam, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of each whole text; null and empty texts are scored as empty ones. Other columns are left out."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        s = model.scores(text_features(cols["text"]))
        return {"doc_id": cols["doc_id"], "score": s.tolist(), "predicted": (s >= least).astype(int).tolist()}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores ``least`` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                s = model.scores(text_features(part.column(part.schema.get_field_index(text_col)).to_pylist()))
                yield part.filter(pa.array(s >= least))

    return map_batches(docs, run, docs.schema)
