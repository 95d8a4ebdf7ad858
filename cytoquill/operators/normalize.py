"""Depth normalisation of long counts. A cell's depth is the sum of its counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depths(counts: DataFrame, cells: DataFrame | None = None, value: str = "n") -> DataFrame:
    """``cell_id, depth``; cells of ``cells`` without counts have depth 0."""
    d = counts.groupBy("cell_id").agg(F.sum(value).alias("depth"))
    return d if cells is None else cells.select("cell_id").join(d, "cell_id", "left").fillna(0, ["depth"])


def proportional(values: DataFrame, cells: DataFrame | None = None, value: str = "n", target: float | None = None) -> DataFrame:
    """``value`` scaled to a common depth: the mean depth of all cells unless given."""
    d = depths(values, cells, value)
    mean = d.agg(F.avg("depth").alias("mean")) if target is None else None
    out = values.join(d, "cell_id")
    out = out.join(F.broadcast(mean), how="cross") if mean is not None else out.withColumn("mean", F.lit(float(target)))  # one row
    return out.select("cell_id", "gene_id", F.try_divide(F.col(value) * F.col("mean"), F.col("depth")).alias("value"))


def _pointwise(f: Callable[[Column], Column]) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    return lambda counts, cells=None: counts.select("cell_id", "gene_id", f(F.col("n").cast("double")).alias("value"))


def _log(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.log1p("value"))


def pf(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    return proportional(counts, cells)


def pf_log(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    return _log(proportional(counts, cells))


def pf_log_pf(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    return proportional(_log(proportional(counts, cells)), cells, "value")


def cpm_log(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    return _log(proportional(counts, cells, target=1e6))


def cp10k_log(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    return _log(proportional(counts, cells, target=1e4))


def depth_norm(counts: DataFrame, cells: DataFrame | None = None, target: float | None = None) -> DataFrame:
    """x / (depth / target), target: the mean depth unless given."""
    return proportional(counts, cells, target=target)


def tenk(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    return proportional(counts, cells, target=1e4)


def pearson_residuals(counts: DataFrame, cells: DataFrame, genes: DataFrame, theta: float = 100.0) -> DataFrame:
    """(x - mu) / sqrt(mu + mu**2 / theta) of every cell and gene, zeros too, clipped to the root of the number of cells.

    mu is depth * gene total / grand total. The output is dense by definition: a row for each cell and gene.
    A cell's counts go with it as a map, so the dense rows arise in a narrow step and are never shuffled.
    Cells and genes without counts give 0.
    """
    n_cells = cells.count()
    by_gene = genes.select("gene_id").join(counts.groupBy("gene_id").agg(F.sum("n").alias("g")), "gene_id", "left").fillna(0, ["g"])
    total = counts.agg(F.sum("n").alias("t"))
    held = counts.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_id", "n"))).alias("held"))
    rows = depths(counts, cells).join(held, "cell_id", "left").join(F.broadcast(total), how="cross")  # one row
    grid = rows.join(by_gene, how="cross").withColumn("n", F.try_element_at("held", F.col("gene_id")))
    mu = F.col("depth") * F.col("g") / F.col("t")
    z = F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)) - mu, F.sqrt(mu + mu * mu / theta)), F.lit(0.0))
    bound = float(n_cells) ** 0.5
    return grid.select("cell_id", "gene_id", F.greatest(F.least(z, F.lit(bound)), F.lit(-bound)).alias("value"))


#: Normalisers by name; each takes (counts, cells) and returns (cell_id, gene_id, value).
NORMALIZERS: dict[str, Callable[..., DataFrame]] = {
    "raw": _pointwise(lambda x: x),
    "pf": pf,
    "log": _pointwise(F.log1p),
    "pf_log": pf_log,
    "pf_log_pf": pf_log_pf,
    "cpm_log": cpm_log,
    "cp10k_log": cp10k_log,
    "sqrt": _pointwise(F.sqrt),
    "depth": depth_norm,
    "tenk": tenk,
}


def normalize(counts: DataFrame, name: str = "pf_log", cells: DataFrame | None = None) -> DataFrame:
    if name not in NORMALIZERS:
        raise KeyError(f"no normaliser {name!r}; there are {', '.join(sorted(NORMALIZERS))}")
    return NORMALIZERS[name](counts, cells)
