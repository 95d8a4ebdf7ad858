"""Splitting counts molecule by molecule, by hash: the order of rows and partitions plays no part."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.operators.checks import invalid_counts


class CountSplitError(ValueError):
    pass


def check_proportions(proportions: Sequence[float]) -> None:
    """Finite, not negative, summing to 1 within 1e-12."""
    if not proportions or any(not math.isfinite(p) or p < 0 for p in proportions) or abs(math.fsum(proportions) - 1) > 1e-12:
        raise CountSplitError("proportions must be finite, not negative and sum to 1")


def split_counts(counts: DataFrame, proportions: Sequence[float] = (0.325, 0.325, 0.35), seed: int = 0, names: Sequence[str] = ("train", "val", "test"), check: bool = True) -> DataFrame:
    """``cell_id, gene_id`` and a column of counts for each split; their sum is ``n``.

    Each molecule i of a cell and gene goes by md5(seed|cell|gene|i) as a number in [0, 1) to the
    split whose span of cumulative proportions holds it: a multinomial draw that anyone can repeat.
    """
    check_proportions(proportions)
    if check and (bad := invalid_counts(counts).first()) is not None:
        raise CountSplitError(f"counts must be finite, whole and not negative: {bad.asDict()}")
    names = list(names)[: len(proportions)]
    ends = [math.fsum(proportions[: i + 1]) for i in range(len(proportions))]
    ends[-1] = 2.0
    text = F.concat_ws("|", F.lit(str(seed)), "cell_id", "gene_id", F.col("i").cast("string"))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    one = counts.where("n > 0").select("cell_id", "gene_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).select("cell_id", "gene_id", u.alias("u"))
    lows = [0.0, *ends[:-1]]
    return one.groupBy("cell_id", "gene_id").agg(*[F.count_if((F.col("u") >= a) & (F.col("u") < b)).alias(f"n_{k}") for k, a, b in zip(names, lows, ends, strict=True)])


def long_splits(split: DataFrame) -> DataFrame:
    """``split, cell_id, gene_id, n``: the columns of ``split_counts`` as rows, zeros left out."""
    names = [c for c in split.columns if c.startswith("n_")]
    return split.unpivot(["cell_id", "gene_id"], names, "split", "n").where("n > 0").select(F.substring("split", 3, 99).alias("split"), "cell_id", "gene_id", "n")


def conservation(counts: DataFrame, split: DataFrame) -> DataFrame:
    """Cells and genes where the splits don't sum to the counts: ``cell_id, gene_id, delta``."""
    names = [c for c in split.columns if c.startswith("n_")]
    total = split.select("cell_id", "gene_id", sum(F.col(c) for c in names).alias("total"))
    joined = counts.select("cell_id", "gene_id", "n").join(total, ["cell_id", "gene_id"], "full_outer")
    delta = F.coalesce("total", F.lit(0)) - F.coalesce("n", F.lit(0))
    return joined.select("cell_id", "gene_id", delta.alias("delta")).where("delta <> 0")
