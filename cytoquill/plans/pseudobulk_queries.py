"""Queries: pseudobulks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import knn, normalize, pseudobulk
from cytoquill.plans import domain
from cytoquill.plans.base import query
from cytoquill.plans.domain import more, sql

_W = "w AS (SELECT cells.cell_id, coalesce(sum(n), 0)::double AS weight FROM cells LEFT JOIN counts USING (cell_id) GROUP BY ALL)"
#: Pseudobulks by nation only, so that clusters mix.
_M = "m AS (SELECT sample AS pb_id, cell_id FROM cells)"


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.depths(domain.counts(spark, sf_dir), domain.cells(spark, sf_dir)).select("cell_id", F.col("depth").alias("weight"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.cells(spark, sf_dir).select(F.col("sample").alias("pb_id"), "cell_id")


@query("pb_counts", sql("pb_counts", "SELECT * FROM pb_counts"))
def pb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.pb_counts(spark, sf_dir)


@query("pb_totals", more("pb_counts", "t AS (SELECT pb_id, sum(n)::bigint AS total FROM pb_counts GROUP BY ALL)", "SELECT pb_id, count(*) AS n_cells, coalesce(any_value(total), 0) AS total, array_to_string(list(cell_id ORDER BY cell_id), ',') AS source_cells FROM membership LEFT JOIN t USING (pb_id) GROUP BY pb_id"))
def pb_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudobulk.totals(domain.pb_counts(spark, sf_dir), domain.membership(spark, sf_dir)).withColumn("source_cells", F.array_join("source_cells", ","))


@query("pb_label_proportions", more("cells", _M, "c AS (SELECT pb_id, cluster AS label, count(*) AS c FROM m JOIN cells USING (cell_id) GROUP BY ALL)", "SELECT pb_id, label, round(c / sum(c) OVER (PARTITION BY pb_id), 6) AS proportion FROM c"))
def pb_label_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudobulk.label_proportions(_mixed(spark, sf_dir), domain.cells(spark, sf_dir), "cluster").withColumn("proportion", F.round("proportion", 6))


_WP = "p AS (SELECT pb_id, cluster AS label, sum(weight) AS s FROM m JOIN cells USING (cell_id) JOIN w USING (cell_id) GROUP BY ALL)"


@query("pb_weighted_proportions", more("cells counts", _M, _W, _WP, "SELECT pb_id, label, round(s / sum(s) OVER (PARTITION BY pb_id), 6) AS proportion FROM p"))
def pb_weighted_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudobulk.label_proportions(_mixed(spark, sf_dir), domain.cells(spark, sf_dir), "cluster", _weights(spark, sf_dir)).withColumn("proportion", F.round("proportion", 6))


@query("pb_meta_weighted_mean", more("cells counts", _M, _W, "SELECT pb_id, round(coalesce(sum(balance * weight) / nullif(sum(weight), 0), 0), 4) AS value FROM m JOIN cells USING (cell_id) JOIN w USING (cell_id) WHERE balance IS NOT NULL GROUP BY ALL"))
def pb_meta_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudobulk.weighted_mean(_mixed(spark, sf_dir), domain.cells(spark, sf_dir), "balance", _weights(spark, sf_dir)).withColumn("value", F.round("value", 4))


_SEG = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("pb_meta_onehot", more("cells counts", _M, _W, _WP, "q AS (SELECT pb_id, label, s / sum(s) OVER (PARTITION BY pb_id) AS p FROM p)",
  "SELECT pb_id, " + ", ".join(f"round(coalesce(max(p) FILTER (label = '{s}'), 0), 6) AS cluster_weight__{s}" for s in _SEG) + " FROM q GROUP BY ALL"))
def pb_meta_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pseudobulk.label_proportions(_mixed(spark, sf_dir), domain.cells(spark, sf_dir), "cluster", _weights(spark, sf_dir)).withColumn("proportion", F.round("proportion", 6))
    return pseudobulk.wide_proportions(p, "cluster_weight", _SEG)


@query("pb_coords", more("cells counts", _M, _W, "SELECT pb_id, round(coalesce(sum(balance * weight) / nullif(sum(weight), 0), 0), 4) AS pb_coord_x, round(coalesce(sum(length(cluster) * weight) / nullif(sum(weight), 0), 0), 4) AS pb_coord_y FROM m JOIN cells USING (cell_id) JOIN w USING (cell_id) GROUP BY ALL"))
def pb_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.cells(spark, sf_dir).withColumn("y", F.length("cluster"))
    return pseudobulk.coordinates(_mixed(spark, sf_dir), c, "balance", "y", _weights(spark, sf_dir)).withColumns({x: F.round(x, 4) for x in ("pb_coord_x", "pb_coord_y")})


@query("pb_apply_heldout", """WITH h AS (SELECT o_custkey::varchar AS cell_id, p_brand AS gene_id, sum(l_quantity)::bigint AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderkey % 2 = 1 GROUP BY ALL)
  SELECT c_nationkey || '|' || c_mktsegment AS pb_id, gene_id, sum(n)::bigint AS n FROM h JOIN customer ON cell_id = c_custkey::varchar GROUP BY ALL""")
def pb_apply_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cytoquill.plans.module_queries import split_counts

    held = split_counts(spark, sf_dir).where("split = 'val'").select("cell_id", "gene_id", "n")
    return pseudobulk.apply_membership(domain.membership(spark, sf_dir), held, domain.cells(spark, sf_dir))


@query("pb_membership_problems", "SELECT 'missing' AS problem, c_custkey::varchar AS cell_id FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'unknown', 'x' || r_regionkey FROM region")
def pb_membership_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain.membership(spark, sf_dir).where("cast(cell_id as long) % 7 <> 0")
    strange = domain.read_table(spark, sf_dir, "region").select(F.lit("r").alias("pb_id"), F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("cell_id"))
    return pseudobulk.membership_problems(m.unionByName(strange), domain.cells(spark, sf_dir))


@query("pb_built")
def pb_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudobulks of ten vectors along their neighbour graph, within labels."""
    v = domain.vectors(spark, sf_dir)
    cells = v.select(F.col("id").alias("cell_id"), F.col("label").cast("string").alias("sample"), F.lit("all").alias("cluster"))
    return pseudobulk.build(knn.one_graph(v, 20), cells)
