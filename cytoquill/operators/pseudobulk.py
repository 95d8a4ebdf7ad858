"""Pseudobulks: building them from a cell graph, aggregating counts and metadata, applying them to held-out counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.sources.tables import checkpointed

#: Labels that are looked up for columns, at most.
MOST_LABELS = 10_000


class PseudobulkError(ValueError):
    pass


def aggregate_counts(counts: DataFrame, membership: DataFrame) -> DataFrame:
    """``pb_id, gene_id, n``: counts of each pseudobulk's cells, summed."""
    return counts.join(membership, "cell_id").groupBy("pb_id", "gene_id").agg(F.sum("n").alias("n"))


def totals(pb_counts: DataFrame, membership: DataFrame) -> DataFrame:
    """``pb_id, n_cells, total, source_cells``: cells in order of their ids."""
    own = membership.groupBy("pb_id").agg(F.count("*").alias("n_cells"), F.array_sort(F.collect_list("cell_id")).alias("source_cells"))
    return own.join(pb_counts.groupBy("pb_id").agg(F.sum("n").alias("total")), "pb_id", "left").select("pb_id", "n_cells", F.coalesce("total", F.lit(0)).alias("total"), "source_cells")


def label_proportions(membership: DataFrame, cells: DataFrame, label: str, weights: DataFrame | None = None) -> DataFrame:
    """``pb_id, label, proportion`` of a label among a pseudobulk's cells; with ``weights`` (cell_id, weight) by weight, unless their sum isn't positive."""
    m = membership.join(cells.select("cell_id", F.col(label).alias("label")), "cell_id")
    m = m.withColumn("weight", F.lit(1.0)) if weights is None else m.join(weights, "cell_id", "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)))
    per = m.groupBy("pb_id", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("c"))
    whole = per.groupBy("pb_id").agg(F.sum("w").alias("tw"), F.sum("c").alias("tc"))
    return per.join(whole, "pb_id").select("pb_id", "label", F.when(F.col("tw") > 0, F.try_divide("w", "tw")).otherwise(F.col("c") / F.col("tc")).alias("proportion"))


def weighted_mean(membership: DataFrame, cells: DataFrame, column: str, weights: DataFrame) -> DataFrame:
    """``pb_id, value``: the mean of a numeric column by weight (cell_id, weight); 0 without weight. Nulls don't count."""
    m = membership.join(cells.select("cell_id", F.col(column).cast("double").alias("x")), "cell_id").join(weights, "cell_id").where("x is not null")
    return m.groupBy("pb_id").agg(F.coalesce(F.try_divide(F.sum(F.col("x") * F.col("weight")), F.sum("weight").cast("double")), F.lit(0.0)).alias("value"))


def coordinates(membership: DataFrame, cells: DataFrame, x: str, y: str, weights: DataFrame) -> DataFrame:
    """``pb_id, pb_coord_x, pb_coord_y``: weighted centres."""
    a = weighted_mean(membership, cells, x, weights).withColumnRenamed("value", "pb_coord_x")
    return a.join(weighted_mean(membership, cells, y, weights).withColumnRenamed("value", "pb_coord_y"), "pb_id")


def wide_proportions(proportions: DataFrame, prefix: str, labels: Sequence[str] | None = None) -> DataFrame:
    """A column ``prefix__label`` for each label, 0 where a pseudobulk hasn't it. Without ``labels`` they are looked up; more than 10,000 raise PseudobulkError."""
    if labels is None:
        labels = [r[0] for r in proportions.select("label").distinct().orderBy("label").limit(MOST_LABELS + 1).collect()]
        if len(labels) > MOST_LABELS:
            raise PseudobulkError(f"more than {MOST_LABELS} labels; name those wanted")
    out = proportions.groupBy("pb_id").pivot("label", list(labels)).agg(F.first("proportion")).fillna(0.0)
    return out.withColumnsRenamed({v: f"{prefix}__{v}" for v in labels})


def proportions_map(proportions: DataFrame) -> DataFrame:
    """``pb_id, proportions``: a map from label to share."""
    return proportions.groupBy("pb_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "proportion")))).alias("proportions"))


def build(graph: DataFrame, cells: DataFrame, mode: str = "within_cluster", partition_by: Sequence[str] = (), cells_per_pb: int = 10, sample: str = "sample", cluster: str = "cluster") -> DataFrame:
    """``pb_id, cell_id``: cells grouped along a graph (src, dst, weight by cell_id), each in one pseudobulk.

    ``within_cluster``: none crosses a sample or cluster; ``topology``: none crosses a level of
    ``partition_by``, jointly. Null levels raise PseudobulkError. Ids are ``key__pb_i``.
    """
    from cytoquill.operators.community import partition

    if mode not in ("within_cluster", "topology"):
        raise PseudobulkError(f"no mode {mode!r}")
    keys = list(partition_by) or ([sample, cluster] if mode == "within_cluster" else [])
    if keys and (bad := cells.where(" or ".join(f"`{k}` is null" for k in keys)).first()) is not None:
        raise PseudobulkError(f"null level of {', '.join(keys)} in {bad.asDict()}")
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    nodes = cells.select(key.alias("boundary"), F.col("cell_id").alias("id"))
    parts = partition(graph, nodes, cells_per_pb)
    return parts.select(F.concat("boundary", F.lit("__pb_"), F.col("part").cast("string")).alias("pb_id"), F.col("id").alias("cell_id"))


def membership_problems(membership: DataFrame, cells: DataFrame) -> DataFrame:
    """``problem, cell_id``: cells in several pseudobulks, in none, or unknown."""
    twice = membership.groupBy("cell_id").agg(F.count("*").alias("c")).where("c > 1").select(F.lit("repeated").alias("problem"), "cell_id")
    missing = cells.select("cell_id").join(membership, "cell_id", "left_anti").select(F.lit("missing").alias("problem"), "cell_id")
    unknown = membership.join(cells, "cell_id", "left_anti").select(F.lit("unknown").alias("problem"), "cell_id")
    return twice.unionByName(missing).unionByName(unknown)


def apply_membership(membership: DataFrame, held_out: DataFrame, cells: DataFrame) -> DataFrame:
    """Held-out counts summed by a membership learned elsewhere; the cells must be the same, each once."""
    if (bad := membership_problems(membership, cells).first()) is not None:
        raise PseudobulkError(f"cell {bad['cell_id']} is {bad['problem']}")
    return aggregate_counts(held_out, membership)


def workflow(graph: DataFrame, counts: DataFrame, cells: DataFrame, settings: Mapping | None = None) -> dict[str, DataFrame]:
    """``membership``, ``counts``, ``totals`` and proportions of sample and cluster, plain and by depth."""
    m = checkpointed(build(graph, cells, **(settings or {})))  # all tables read it
    pb = checkpointed(aggregate_counts(counts, m))
    depth = counts.groupBy("cell_id").agg(F.sum("n").alias("weight"))
    out = {"membership": m, "counts": pb, "totals": totals(pb, m)}
    for label in ("sample", "cluster"):
        out[f"{label}_proportions"] = label_proportions(m, cells, label)
        out[f"{label}_weights"] = label_proportions(m, cells, label, depth)
    return out
