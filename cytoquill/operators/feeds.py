"""Tables behind plots: volcano, s-curve, density difference, heatmap; no drawing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def volcano(df: DataFrame, effect: str, p: str, alpha: float = 0.05, label: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """``df`` with ``neglog10_p`` and ``significant``; with ``labels``, only these are marked in ``shown``."""
    out = df.withColumns({"neglog10_p": -F.log10(F.col(p) + 1e-300), "significant": F.coalesce(F.col(p) < alpha, F.lit(False))})
    return out if labels is None else out.withColumn("shown", F.col(label).isin(labels))


def mean_difference(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``baseMean, log2FoldChange, significant`` for an MA plot."""
    return results.select("baseMean", "log2FoldChange", F.coalesce(F.col("padj") < alpha, F.lit(False)).alias("significant"))


def s_curve(enrichment: DataFrame, value: str = "enrichment_t") -> DataFrame:
    """Pathways of each contrast ranked by value, the lowest first; nulls are left out."""
    order = Window.partitionBy("contrast").orderBy(value, "library", "pathway")
    return enrichment.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(order))


def reverse_contrast(df: DataFrame, contrast: str, reverse: str, columns: list[str]) -> DataFrame:
    """A contrast's rows under the name of its reverse, with directional columns negated."""
    return df.where(F.col("contrast") == contrast).withColumns({c: -F.col(c) for c in columns}).withColumn("contrast", F.lit(reverse))


def heatmap_z(enrichment: DataFrame, value: str = "enrichment_t") -> DataFrame:
    """``contrast, library, pathway, z``: each pathway's values over contrasts, centred and scaled by their population deviation; null if that is about 0."""
    per = Window.partitionBy("library", "pathway")
    sd = F.stddev_pop(value).over(per)
    z = F.when(sd > 1e-12, (F.col(value) - F.avg(value).over(per)) / sd)
    return enrichment.where(F.col(value).isNotNull()).select("contrast", "library", "pathway", z.alias("z"))


def heatmap_matrix(z: DataFrame, contrasts: list[str]) -> DataFrame:
    """A column of ``z`` for each contrast; rows without any value are dropped."""
    wide = z.groupBy("library", "pathway").pivot("contrast", contrasts).agg(F.first("z"))
    return wide.dropna("all", subset=contrasts)


def density_difference(stats: DataFrame, genes: DataFrame, points: int = 512) -> DataFrame:
    """``x, members, background, difference`` on a grid over all statistics (gene, stat): Gaussian densities of members (gene) and the others, scaled to the same area.

    The bandwidth is n ** -0.2 times the sample deviation of each side. Each row adds to each grid
    point in partial sums, so tasks send ``points`` rows at most.
    """
    rows = stats.where("stat is not null").join(genes.select("gene", F.lit(True).alias("m")).distinct(), "gene", "left").select("stat", F.coalesce("m", F.lit(False)).alias("m"))
    span = rows.agg(F.min("stat").alias("low"), F.max("stat").alias("high"))
    band = rows.groupBy("m").agg(F.count("*").alias("n"), (F.stddev_samp("stat") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"))
    grid = rows.join(F.broadcast(band), "m").join(F.broadcast(span), how="cross").select("stat", "m", "n", "h", "low", ((F.col("high") - F.col("low")) / (points - 1)).alias("dx"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))  # two rows and one row
    u = (F.col("low") + F.col("i") * F.col("dx") - F.col("stat")) / F.col("h")
    k = F.exp(-0.5 * u * u) / (F.col("h") * math.sqrt(2 * math.pi) * F.col("n"))
    sums = grid.groupBy("i").agg(F.first(F.col("low") + F.col("i") * F.col("dx")).alias("x"), F.first("dx").alias("dx"), F.sum(F.when(F.col("m"), k).otherwise(0.0)).alias("members"), F.sum(F.when(~F.col("m"), k).otherwise(0.0)).alias("background"))
    end = F.when(F.col("i").isin(0, points - 1), 0.5).otherwise(1.0)
    area = sums.agg(F.sum(end * F.col("members") * F.col("dx")).alias("am"), F.sum(end * F.col("background") * F.col("dx")).alias("ab"))
    out = sums.join(F.broadcast(area), how="cross").select("x", F.try_divide("members", "am").alias("members"), F.try_divide("background", "ab").alias("background"))  # one row
    return out.withColumn("difference", F.col("members") - F.col("background"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
