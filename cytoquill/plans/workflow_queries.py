"""Queries: whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import knn, nb, nbfit
from cytoquill.operators.design import build_design
from cytoquill.plans import domain, workflows
from cytoquill.plans.base import query
from cytoquill.plans.domain import more


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.cells(spark, sf_dir).withColumn("id", F.col("cell_id").cast("long"))


@query("workflow_consensus")
def workflow_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the counts come with feature selection, and with all genes: they are random, so selection should keep few genes or none."""
    counts, cells = domain.counts(spark, sf_dir), _cells(spark, sf_dir)
    start = workflows.consensus_pipeline(counts, cells, 7, stop_after="normalize")  # what both runs share
    runs = [(select, workflows.consensus_pipeline(counts, cells, 7, select_features=select, components=10, start=start)) for select in (True, False)]
    return spark.createDataFrame([(select, r.status, str(sorted(r.diagnostics.items()))) for select, r in runs], "select_features boolean, status string, diagnostics string")


@query("workflow_de")
def workflow_de(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cells of clusters and samples, their rounded coordinates as counts."""
    v = domain.vectors(spark, sf_dir)
    cells = v.select(F.col("id").alias("cell_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("sample"), F.concat(F.lit("k"), F.col("label") % 3).alias("cluster"))
    counts = v.select(F.col("id").alias("cell_id"), F.posexplode("vec").alias("g", "x")).select("cell_id", F.concat(F.lit("g"), F.col("g")).alias("gene_id"), F.floor(F.abs(F.col("x")) * 100 + 1).cast("long").alias("n"))
    sets = spark.createDataFrame([("lib", "low", [f"g{i}" for i in range(10)]), ("lib", "high", [f"g{i}" for i in range(10, 20)])], "library string, pathway string, genes array<string>")
    return workflows.de_pipeline(knn.one_graph(v, 20), counts, cells, sets).tables["enrichment"]


@query("size_factors_iterative")
def size_factors_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbfit.iterative_size_factors(domain.pb_counts(spark, sf_dir), build_design(domain.pbs(spark, sf_dir), "~ 0 + condition"), 3)


@query("vst_fit")
def vst_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbfit.vst(domain.pb_counts(spark, sf_dir), domain.pbs(spark, sf_dir))[0]


@query("norm_reused", more("pb_counts pbs", "e AS (SELECT pb_id FROM pbs WHERE condition = 'even')", "m AS (SELECT gene_id, avg(ln(n)) AS m FROM pb_counts SEMI JOIN e USING (pb_id) WHERE n > 0 GROUP BY gene_id HAVING count(*) = (SELECT count(*) FROM e))",
  "s AS (SELECT pb_id, exp(median(ln(n) - m)) AS s FROM pb_counts JOIN m USING (gene_id) WHERE n > 0 GROUP BY pb_id)", "SELECT pb_id, gene_id, n, round(s, 6) AS size_factor, round(n / s, 6) AS q FROM pb_counts JOIN s USING (pb_id)"))
def norm_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of all pseudobulks by the log means of one condition's."""
    c, even = domain.pb_counts(spark, sf_dir), domain.pbs(spark, sf_dir).where("condition = 'even'")
    out = nb.norm_transform(c, nb.norm_fit(c.join(even, "pb_id", "left_semi"), even))
    return out.withColumns({x: F.round(x, 6) for x in ("size_factor", "q")})
