"""Queries: hashes, compatibility findings, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import compat
from cytoquill.plans import domain, provenance
from cytoquill.plans.base import query
from cytoquill.plans.domain import more, sql
from cytoquill.sources.tables import own_folder
from cytoquill.streaming import qc_stream

_PREFIX = provenance.prefix("cells").hex()


@query("membership_hash", sql("membership", f"SELECT pb_id, sha256(unhex('{_PREFIX}' || hex(to_json(list(DISTINCT cell_id ORDER BY cell_id))::varchar))) AS digest FROM membership GROUP BY pb_id"))
def membership_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.membership(spark, sf_dir).groupBy("pb_id").agg(provenance.membership_digest(F.col("cell_id"), "cells").alias("digest"))


@query("findings_table", more("counts cells genes", "c AS (SELECT * FROM cells WHERE cell_id::int % 10 <> 3)", "g AS (SELECT * FROM genes UNION ALL SELECT 'Brand#1', 'B1' UNION ALL SELECT 'Brand#99', 'B99')", """f AS (
  SELECT 'cell_ids_missing_from_axis' AS code, 'error' AS severity, 'cell' AS subject, count(*) AS n, min(cell_id) AS example FROM (SELECT DISTINCT cell_id FROM counts) x ANTI JOIN c USING (cell_id)
  UNION ALL SELECT 'cell_ids_without_counts', 'warning', 'cell', count(*), min(cell_id) FROM c ANTI JOIN counts USING (cell_id)
  UNION ALL SELECT 'gene_ids_not_unique', 'error', 'gene', count(*), min(gene_id) FROM (SELECT gene_id FROM g GROUP BY gene_id HAVING count(*) > 1)
  UNION ALL SELECT 'gene_ids_missing_from_axis', 'error', 'gene', count(*), min(gene_id) FROM (SELECT DISTINCT gene_id FROM counts) x ANTI JOIN g USING (gene_id)
  UNION ALL SELECT 'gene_ids_without_counts', 'warning', 'gene', count(*), min(gene_id) FROM (SELECT DISTINCT gene_id FROM g) y ANTI JOIN counts USING (gene_id))""", "SELECT * FROM f WHERE n > 0"))
def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = domain.cells(spark, sf_dir).where("cast(cell_id as int) % 10 <> 3")
    extra = spark.createDataFrame([("Brand#1", "B1"), ("Brand#99", "B99")], "gene_id string, symbol string")
    return compat.findings(domain.counts(spark, sf_dir), cells, domain.genes(spark, sf_dir).unionByName(extra))


@query("order_mismatch", "WITH l AS (SELECT p_partkey AS position, p_brand AS id FROM part), r AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 50 = 7 THEN p_type ELSE p_brand END AS id FROM part), j AS (SELECT position, l.id AS l, r.id AS r FROM l FULL JOIN r USING (position) WHERE l.id IS DISTINCT FROM r.id) SELECT count(*) AS n, min(position) AS position, arg_min(l, position) AS left, arg_min(r, position) AS right FROM j HAVING count(*) > 0".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def order_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.read_table(spark, sf_dir, "part")
    left = p.select(F.col("p_partkey").alias("position"), F.col("p_brand").alias("id"))
    right = p.select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 50 == 7, F.col("p_type")).otherwise(F.col("p_brand")).alias("id"))
    return compat.order_mismatch(left, right)


@query("graph_findings", "SELECT 'graph_nodes_unknown' AS code, 'error' AS severity, 'graph' AS subject, count(DISTINCT id) AS n, min(id) AS example FROM (SELECT o_custkey::varchar AS id FROM orders) WHERE id::int % 4 = 1 HAVING count(*) > 0 UNION ALL SELECT 'graph_weights_invalid', 'error', 'graph', count(*), min(o_custkey::varchar) FROM orders WHERE o_totalprice - 1000 < 0 HAVING count(*) > 0")
def graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.read_table(spark, sf_dir, "orders")
    edges = o.select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"), (F.col("o_totalprice") - 1000).alias("weight"))
    return compat._union(compat.graph_findings(edges, domain.cells(spark, sf_dir).where("cast(cell_id as int) % 4 <> 1")))


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _folder(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark)


@query("stream_totals", "SELECT user_id::varchar AS cell_id, count(*) AS total_counts FROM events GROUP BY ALL")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of all cells, from the events as a stream."""
    e = qc_stream.read_stream(spark, sf_dir, "events.parquet", _EVENTS)
    return qc_stream.drain(qc_stream.running_totals(e.select(F.col("user_id").cast("string").alias("cell_id"), F.lit(1).alias("n"))), _folder(spark), "complete")
