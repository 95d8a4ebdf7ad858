"""Quality control of cells: feature flags, metrics, thresholds, classes, filter, plot tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETS = ("mt", "ribo", "lncRNA")
METRICS = ("total_counts", "n_genes_by_counts", *(f"pct_counts_{s}" for s in SETS), "log1p_total_counts", *(f"log1p_total_counts_{s}" for s in SETS))


def flag_features(genes: DataFrame, mt_prefix: str = "MT-", ribo_prefixes: Sequence[str] = ("RPL", "RPS"), lnc_genes: Sequence[str] = ("MALAT1", "NEAT1", "XIST")) -> DataFrame:
    """``gene_id, symbol, mt, ribo, lncRNA`` of ``genes`` (gene_id, symbol); a null symbol is replaced by the id."""
    symbol = F.coalesce("symbol", "gene_id")
    ribo = F.lit(False)
    for p in ribo_prefixes:
        ribo = ribo | symbol.startswith(p)
    return genes.select("gene_id", symbol.alias("symbol"), symbol.startswith(mt_prefix).alias("mt"), ribo.alias("ribo"), symbol.isin(list(lnc_genes)).alias("lncRNA"))


def metrics(counts: DataFrame, flagged: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """A row for each cell: totals, genes with counts, share of each feature set in percent, log1p totals.

    One pass with partial sums by cell; the flags (a row for each gene) join by gene. Cells
    of ``cells`` without counts have zeros, and null percentages.
    """
    sums = [F.sum(F.when(F.col(s), F.col("n")).otherwise(0)).alias(f"total_counts_{s}") for s in SETS]
    out = counts.join(flagged.select("gene_id", *SETS), "gene_id", "left").groupBy("cell_id").agg(F.sum("n").alias("total_counts"), F.count_if(F.col("n") > 0).alias("n_genes_by_counts"), *sums)
    if cells is not None:
        out = cells.select("cell_id").join(out, "cell_id", "left").fillna(0)
    total = F.col("total_counts")
    return out.select(
        "cell_id", "total_counts", "n_genes_by_counts",
        *[F.col(f"total_counts_{s}") for s in SETS],
        *[F.try_divide(100.0 * F.col(f"total_counts_{s}"), total).alias(f"pct_counts_{s}") for s in SETS],
        F.log1p(total).alias("log1p_total_counts"),
        *[F.log1p(f"total_counts_{s}").alias(f"log1p_total_counts_{s}") for s in SETS],
    )


def thresholds(
    cell_metrics: DataFrame, doublet_total_counts_quantile: float = 0.98, doublet_n_genes_quantile: float = 0.98, doublet_max_pct_mito: float = 20.0,
    fragment_lncRNA_high_pct: float = 6.0, fragment_lncRNA_low_pct: float = 1.0, fragment_mito_high_pct: float = 25.0, fragment_max_total_counts: float | None = None,
    fragment_max_n_genes: float | None = None, min_total_counts: float = 2000.0, min_n_genes: int = 500, max_pct_mito: float = 30.0,
) -> DataFrame:
    """One row of cut-offs; quantiles are exact, with linear interpolation."""
    total, genes = F.col("total_counts"), F.col("n_genes_by_counts")
    given = lambda v, c: F.percentile(c, 0.75) if v is None else F.first(F.lit(float(v)))
    return cell_metrics.agg(
        F.percentile(total, doublet_total_counts_quantile).alias("doublet_total_counts"),
        F.percentile(genes, doublet_n_genes_quantile).alias("doublet_n_genes"),
        given(fragment_max_total_counts, total).alias("fragment_max_total_counts"),
        given(fragment_max_n_genes, genes).alias("fragment_max_n_genes"),
    ).select(
        "*",
        *[
            F.lit(float(v)).alias(k)
            for k, v in dict(
                doublet_max_pct_mito=doublet_max_pct_mito, fragment_lncRNA_high_pct=fragment_lncRNA_high_pct, fragment_lncRNA_low_pct=fragment_lncRNA_low_pct,
                fragment_mito_high_pct=fragment_mito_high_pct, min_total_counts=min_total_counts, min_n_genes=min_n_genes, max_pct_mito=max_pct_mito,
            ).items()
        ],
    )


def classify(cell_metrics: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Metrics with ``qc_category`` and ``qc_keep``; ``cutoffs`` is the one row of ``thresholds``.

    The first class that fits counts: doublet candidate, nuclear fragment, anucleated fragment, low
    quality, pass. Comparisons with null percentages are false.
    """
    total, genes, mt, lnc = (F.col(c) for c in ("total_counts", "n_genes_by_counts", "pct_counts_mt", "pct_counts_lncRNA"))
    small = total <= F.col("fragment_max_total_counts")
    category = (
        F.when((total >= F.col("doublet_total_counts")) & (genes >= F.col("doublet_n_genes")) & (mt <= F.col("doublet_max_pct_mito")), "doublet_candidate")
        .when((lnc >= F.col("fragment_lncRNA_high_pct")) & (mt <= F.col("fragment_mito_high_pct")) & small & (genes <= F.col("fragment_max_n_genes")), "fragment_nuclear_lncRNA_enriched")
        .when((lnc <= F.col("fragment_lncRNA_low_pct")) & (mt >= F.col("fragment_mito_high_pct")) & small, "fragment_anucleated")
        .when((total < F.col("min_total_counts")) | (genes < F.col("min_n_genes")) | (mt > F.col("max_pct_mito")), "low_quality")
        .otherwise("pass_qc")
    )
    joined = cell_metrics.join(F.broadcast(cutoffs), how="cross")  # one row
    return joined.select(*[cell_metrics[c] for c in cell_metrics.columns], category.alias("qc_category")).withColumn("qc_keep", F.col("qc_category") == "pass_qc")


def summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("qc_category").agg(F.count("*").alias("n_cells"))


def filter_counts(counts: DataFrame, classified: DataFrame) -> DataFrame:
    """Counts of the cells that are kept."""
    return counts.join(classified.where("qc_keep").select("cell_id"), "cell_id", "left_semi")


def quantify_and_filter(counts: DataFrame, genes: DataFrame, cells: DataFrame | None = None, features: Mapping | None = None, cutoffs: Mapping | None = None) -> dict[str, DataFrame]:
    """The whole quality control: ``metrics``, ``thresholds``, ``classified``, ``summary``, ``counts``."""
    m = metrics(counts, flag_features(genes, **(features or {})), cells)
    t = thresholds(m, **(cutoffs or {}))
    c = classify(m, t)
    return {"metrics": m, "thresholds": t, "classified": c, "summary": summary(c), "counts": filter_counts(counts, c)}


def metrics_frame(classified: DataFrame, prefix: str = "", columns: Sequence[str] = METRICS, extra: Sequence[str] = ()) -> DataFrame:
    """Chosen metric columns, renamed with a prefix."""
    return classified.select("cell_id", *[F.col(c).alias(prefix + c) for c in (*columns, *extra)])


def plot_long(cell_metrics: DataFrame, columns: Sequence[str] = METRICS) -> DataFrame:
    """``cell_id, metric, value`` for violin and box plots."""
    return cell_metrics.select("cell_id", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("cell_id", list(columns), "metric", "value")


def plot_sample(cell_metrics: DataFrame, fraction: float, max_cells: int, n_cells: int) -> DataFrame:
    """min(max_cells, int(n_cells * fraction)) cells, those of the smallest md5 of their id: a sampling operator."""
    return cell_metrics.orderBy(F.md5(F.col("cell_id").cast("binary")), "cell_id").limit(min(max_cells, int(n_cells * fraction)))
