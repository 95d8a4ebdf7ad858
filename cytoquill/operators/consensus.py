"""The consensus of two neighbour graphs over the same cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.operators import knn


def fill_missing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Kept neighbours of ``one``, and of sources that it lacks those of ``other``."""
    lacking = other.join(one.select("src").distinct(), "src", "left_anti")
    return one.unionByName(lacking)


def overlap(train: DataFrame, val: DataFrame) -> DataFrame:
    """``src, dst, d_train, d_val`` of kept neighbours of either; null where a split hasn't the edge."""
    t = train.select("src", "dst", F.col("dist").alias("d_train"))
    v = val.select("src", "dst", F.col("dist").alias("d_val"))
    return t.join(v, ["src", "dst"], "full_outer")


def merge(train: DataFrame, val: DataFrame, eps: float = 1e-3) -> DataFrame:
    """``src, rank, dst, dist, weight`` of two masked neighbour tables (src, dst, dist, keep).

    An edge of both has the mean distance; an edge of one split has the mean of its distance and
    the largest kept distance of that source in the other split. Edges are ranked anew by source.
    """
    t, v = (x.where("keep").select("src", "dst", "dist") for x in (train, val))
    t, v = fill_missing(t, v), fill_missing(v, t)
    per = Window.partitionBy("src")
    joined = overlap(t, v).withColumns({"m_train": F.max("d_train").over(per), "m_val": F.max("d_val").over(per)})
    dist = (F.coalesce("d_train", "m_train") + F.coalesce("d_val", "m_val")) / 2
    ranked = joined.select("src", "dst", dist.alias("dist")).withColumn("rank", F.row_number().over(per.orderBy("dist", F.col("src") != F.col("dst"), "dst")))
    return knn.weigh(ranked, eps)


def consensus_graph(train: DataFrame, val: DataFrame, k: int | None = None, metric: str = "cosine", cutoff: float = 3.0) -> DataFrame:
    """Edges of the consensus of two embeddings (id, vec) of the same cells."""
    k = knn.choose_k(train.count(), k)
    masked = [knn.gap_mask(knn.knn(x, k, metric), cutoff) for x in (train, val)]
    return knn.edges(merge(*masked))
