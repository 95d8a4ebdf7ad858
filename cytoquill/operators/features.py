"""Rank correlation of genes over sparse counts, and anti-correlation feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_correlation(counts: DataFrame, by: Sequence[str] = (), cells: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """``[by…,] gene_a, gene_b, rho`` with gene_a < gene_b: Spearman's correlation with average ranks, zeros included.

    The zeros of a gene share one rank. Measured from it, ranks are as sparse as counts, so sums of
    products come from joins of the counts with themselves by cell. Cells are those of ``cells``
    ([by…,] cell_id), else those with counts. Genes of constant rank have no rows.
    """
    by = list(by)
    counts = counts.where("n > 0")
    n = (counts.select(*by, "cell_id").distinct() if cells is None else cells).groupBy(*by).agg(F.count("*").cast("double").alias("cells"))
    # A gene's ranks follow from its histogram, which has a row for each different count, not for each cell.
    gene = Window.partitionBy(*by, "gene_id")
    up = gene.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.groupBy(*by, "gene_id", "n").agg(F.count("*").alias("ties"))
    ranks = ranks.select(*by, "gene_id", "n", "ties", (F.coalesce(F.sum("ties").over(up), F.lit(0)) + 1).alias("low"), F.sum("ties").over(gene).alias("nonzero"))
    own = counts.select(*by, "cell_id", "gene_id", "n").join(ranks, [*by, "gene_id", "n"])
    own = own.join(F.broadcast(n), by) if by else own.join(F.broadcast(n), how="cross")  # a row for each group
    zeros = F.col("cells") - F.col("nonzero")
    rank = zeros + F.col("low") + (F.col("ties") - 1) / 2
    # Over the rank of the zeros; without zeros, over 0.
    own = own.select(*by, "cell_id", "gene_id", "cells", (rank - F.when(zeros > 0, (zeros + 1) / 2).otherwise(0.0)).alias("r"))
    sums = own.groupBy(*by, "gene_id").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.first("cells").alias("cells"))
    sums = sums.select(*by, "gene_id", "s", "cells", (F.col("q") - F.col("s") * F.col("s") / F.col("cells")).alias("v")).where("v > 1e-9")
    a, b = (own.select(*by, "cell_id", F.col("gene_id").alias(g), F.col("r").alias(r)) for g, r in (("gene_a", "ra"), ("gene_b", "rb")))
    products = a.join(b, [*by, "cell_id"]).where("gene_a < gene_b").groupBy(*by, "gene_a", "gene_b").agg(F.sum(F.col("ra") * F.col("rb")).alias("p"))
    sa = sums.select(*by, F.col("gene_id").alias("gene_a"), F.col("s").alias("sa"), F.col("v").alias("va"), "cells")
    sb = sums.select(*by, F.col("gene_id").alias("gene_b"), F.col("s").alias("sb"), F.col("v").alias("vb"))
    pairs = sa.join(sb, by) if by else sa.join(sb, how="cross")  # the result has a row for each pair of genes
    pairs = pairs.where("gene_a < gene_b").join(products, [*by, "gene_a", "gene_b"], "left")
    rho = (F.coalesce("p", F.lit(0.0)) - F.col("sa") * F.col("sb") / F.col("cells")) / F.sqrt(F.col("va") * F.col("vb"))
    return pairs.select(*by, "gene_a", "gene_b", F.round(rho, digits).alias("rho"))


def cutoffs(n_cells: int, n_pairs: int, alpha: float = 0.05) -> tuple[float, float]:
    """Correlations beyond which a pair is taken as real: without correlation, rho has mean 0 and variance 1 / (n - 1)."""
    if n_cells < 3 or n_pairs < 1:
        return 1.0, -1.0
    z = NormalDist().inv_cdf(1 - alpha / (2 * n_pairs)) / (n_cells - 1) ** 0.5
    return min(z, 1.0), -min(z, 1.0)


def anticorrelated_genes(rho: DataFrame, genes: DataFrame, cneg: float, least: int = 1) -> DataFrame:
    """``gene_id, n_negative, selected``: genes with at least ``least`` partners at ``cneg`` or under."""
    low = rho.where(F.col("rho") <= cneg).select(F.explode(F.array("gene_a", "gene_b")).alias("gene_id")).groupBy("gene_id").agg(F.count("*").alias("n_negative"))
    n = F.coalesce("n_negative", F.lit(0))
    return genes.select("gene_id").join(low, "gene_id", "left").select("gene_id", n.alias("n_negative"), (n >= least).alias("selected"))


def manifest(selected: DataFrame) -> DataFrame:
    """One row: ordered ids of all features and of those kept, as JSON."""
    ids = F.array_sort(F.collect_list("gene_id"))
    kept = F.array_sort(F.collect_list(F.when(F.col("selected"), F.col("gene_id"))))
    return selected.agg(F.to_json(ids).alias("feature_ids"), F.to_json(kept).alias("feature_ids_kept"), F.count_if("selected").alias("n_kept"))
