"""Exact top-k inner-product search: a ball tree for each shard, branch and bound in the order of each query's own bounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.llm.common import map_batches, materialize

#: Points of a leaf, at most (more if they all coincide).
LEAF = 128


class BallTree:
    """Balls around the means of ever smaller sets of integer vectors, split at the median along the widest line."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right
        centres, radii = [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[self.order[a:b]]
            c = own.mean(0)
            d = np.sqrt(((own - c) ** 2).sum(1))
            me = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            centres.append(c)
            radii.append(d.max(initial=0.0))
            if parent >= 0:
                n = self.nodes[parent]
                self.nodes[parent] = (n[0], n[1], me, n[3]) if side == 0 else (n[0], n[1], n[2], me)
            if b - a > leaf and radii[me] > 0:
                far = own[d.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                along = own @ (other - far)
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(along, half)]
                todo += [(a + half, b, me, 1), (a, a + half, me, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.ids, self.points = ids[self.order], points[self.order]

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and scores that can be among the k best of each query; ``floor``: scores that k candidates are known to reach.

        From the root on, a query goes on to a node's children only if the node's bound reaches its
        floor, so ties stay. Each query visits its leaves in the order of its own bounds, the highest first, until
        one lies under its floor, which is its k-th score as soon as that is higher.
        """
        best_id = [np.empty(0, np.int64)] * len(qids)
        best = [np.empty(0)] * len(qids)
        if not len(self.ids) or not len(qids):
            return best_id, best
        bounds, leaves = self._leaf_bounds(queries, floor)
        order = np.argsort(-bounds, axis=1, kind="stable")
        rows = np.arange(len(qids))
        for t in range(len(leaves)):
            at = order[rows, t]
            keep = bounds[rows, at] >= np.maximum(floor[rows], -1e300)
            rows, at = rows[keep], at[keep]
            if not len(rows):
                break
            by_leaf = np.argsort(at, kind="stable")
            for group in np.split(by_leaf, np.flatnonzero(np.diff(at[by_leaf])) + 1):
                a, b = self.nodes[leaves[at[group[0]]]][:2]
                self._visit(a, b, rows[group], qids, queries, k, floor, best_id, best)
        return best_id, best

    def _visit(self, a: int, b: int, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, best_id: list[np.ndarray], best: list[np.ndarray]) -> None:
        scores = queries[rows] @ self.points[a:b].T
        ids = self.ids[a:b]
        scores[ids[None, :] == qids[rows][:, None]] = -np.inf
        some = (scores >= np.maximum(floor[rows], -1e300)[:, None]).any(1)
        for r, s in zip(rows[some], scores[some], strict=True):
            ok = s >= max(floor[r], -1e300)
            i, v = np.concatenate([best_id[r], ids[ok]]), np.concatenate([best[r], s[ok]])
            top = np.lexsort((i, -v))[:k]
            best_id[r], best[r] = i[top], v[top]
            if len(top) == k:
                floor[r] = max(floor[r], v[top[-1]])

    def _bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products with a node's points, rounded up: they and the scores are sums of some dozens of products."""
        return (queries @ self.centres[node] + norms * self.radii[node]) * (1 + 1e-12) + 1

    def _leaf_bounds(self, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """A row for each query with its bounds of the leaves, minus infinity where a node above is left out."""
        norms = np.sqrt((queries**2).sum(1))
        rows: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.arange(len(queries)), self._bound(0, queries, norms))}
        leaves = [i for i, n in enumerate(self.nodes) if n[2] < 0]
        out = np.full((len(queries), len(leaves)), -np.inf)
        place = {n: i for i, n in enumerate(leaves)}
        todo = [0]
        while todo:
            node = todo.pop()
            own, high = rows.pop(node)
            keep = high >= floor[own]
            own, high = own[keep], high[keep]
            if not len(own):
                continue
            _, _, left, right = self.nodes[node]
            if left < 0:
                out[own, place[node]] = high
                continue
            for child in (left, right):
                rows[child] = own, np.minimum(high, self._bound(child, queries[own], norms[own]))
                todo.append(child)
        return out, leaves


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component. Vectors that are null, or hold null or non-finite components, take no part."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def _by_size(ids: np.ndarray, v: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix of the vectors of each length."""
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return {int(n): (ids[sizes == n], np.stack([flat[e - n : e] for e in ends[sizes == n]]) if n else np.empty((int((sizes == 0).sum()), 0))) for n in np.unique(sizes)}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = 65_536, block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query with all rows but its own.

    ``vectors`` and ``queries`` are of ``quantized`` form: integer components, as doubles; where scores
    could reach 2**53, which doubles don't hold exactly, OverflowError is raised. Ties go to the smaller vec_id; with fewer than k other rows, all of
    them. Only vectors of a query's length are its candidates. A repeated query row is one query; a repeated row of
    ``vectors`` is a candidate each time. Vectors are dealt out to shards of about ``shard`` rows, each of which is one
    ball tree, and queries to blocks of about ``block`` rows, each of which goes to every shard: two passes
    over the vectors, however many queries there are. In the first pass each query looks only at the leaf of its highest bound in
    each shard; the k-th score of all that is its floor in the second, for every shard alike.
    """
    stored = materialize(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("at")))
    asked = materialize(queries.dropDuplicates(["vec_id"]).select("vec_id", "v"))
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((stored, shard), (asked, block)))
    points = stored.select(F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("floor"), F.lit(0).alias("block"))

    def searched(asked: DataFrame, probe: bool) -> DataFrame:
        sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", "floor", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
        dealt = points.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "kind", "block")
        found = map_batches(dealt, _searcher(k, probe), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = searched(asked.withColumn("floor", F.lit(None).cast("double")), True)
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k)
    asked = materialize(asked.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left"))
    return searched(asked, False).select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, probe: bool):
    """Rows come sorted by shard: first its points, then the queries, block by block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        trees: dict[int, BallTree] = {}

        def answers(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for n, parts in held.items():
                trees[n] = BallTree(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            held.clear()
            floors = dict(zip(rows.column(2).to_pylist(), rows.column(4).to_pylist(), strict=True))
            for n, (qids, queries) in _by_size(rows.column(2).to_numpy(), rows.column(3)).items():
                if n not in trees:
                    continue
                tree = trees[n]
                floor = np.array([-np.inf if floors[q] is None else floors[q] for q in qids.tolist()])
                if np.sqrt((queries**2).sum(1)).max() * np.sqrt((tree.points**2).sum(1)).max(initial=0) >= 2**53:
                    raise OverflowError("scores may reach 2**53")
                got_id, got = (_probe if probe else BallTree.search)(tree, qids, queries, k, floor)
                sizes = [len(x) for x in got_id]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate(got_id)), pa.array(np.concatenate(got).astype(np.int64))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            marks = [batch.column(i).to_numpy() for i in (0, 1, 5)]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if marks[0][a] != now:
                    now = marks[0][a]
                    held.clear()
                    trees.clear()
                if marks[1][a]:
                    yield from answers(rows)
                else:
                    for n, part in _by_size(rows.column(2).to_numpy(), rows.column(3)).items():
                        held.setdefault(n, []).append(part)

    return run


def _probe(tree: BallTree, qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The k best of each query within the leaf of its highest bound: enough for a first floor."""
    leaves = [i for i, n in enumerate(tree.nodes) if n[2] < 0]
    bounds = queries @ tree.centres[leaves].T + np.sqrt((queries**2).sum(1))[:, None] * tree.radii[leaves]
    best_id, best = [], []
    for q, row, at in zip(qids, queries, bounds.argmax(1), strict=True):
        a, b = tree.nodes[leaves[at]][:2]
        ids, scores = tree.ids[a:b], tree.points[a:b] @ row
        other = ids != q
        ids, scores = ids[other], scores[other]
        top = np.lexsort((ids, -scores))[:k]
        best_id.append(ids[top])
        best.append(scores[top])
    return best_id, best
