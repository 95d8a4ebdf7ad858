"""Queries: named results, numbers of neighbours, contracted graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import community, modules
from cytoquill.plans import reports
from cytoquill.plans.base import query
from cytoquill.sources.tables import read_table


@query("contrast_summary", """SELECT l_returnflag || l_linestatus AS contrast, count(*) AS n, count(*) FILTER (l_linenumber <> 5) AS n_tested, count(*) FILTER (l_linenumber <= 2 AND l_suppkey % 3 = 2) AS n_up,
    count(*) FILTER (l_linenumber <= 2 AND l_suppkey % 3 = 0) AS n_down FROM lineitem GROUP BY ALL""")
def contrast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag and status as contrasts; adjusted p from line numbers, some null, and effects from suppliers."""
    li = read_table(spark, sf_dir, "lineitem")
    p = F.when(F.col("l_linenumber") != 5, F.col("l_linenumber") / 10)
    tested = li.select(F.concat("l_returnflag", "l_linestatus").alias("contrast"), p.alias("padj"), (F.col("l_suppkey") % 3 - 1).alias("log2FoldChange"))
    return reports.Contrasts(tested).summary(0.2)


_PAIRS = "SELECT o_orderpriority AS sample, 'g' || o_custkey AS gene_a, 'g' || (o_custkey * 7 + o_orderkey) % 97 AS gene_b FROM orders"


@query("neighbours_by_sample", f"""WITH p AS ({_PAIRS}), g AS (SELECT sample, count(DISTINCT g) AS n FROM (SELECT sample, unnest([gene_a, gene_b]) AS g FROM p) GROUP BY sample)
    SELECT sample, least(greatest(10, round(ln(n))), 200, n - 1)::int AS k FROM g""")
def neighbours_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("g"), c.cast("string"))
    return modules.default_ks(o.select(F.col("o_orderpriority").alias("sample"), name(F.col("o_custkey")).alias("gene_a"), name((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 97).alias("gene_b")))


@query("graph_contracted", """WITH e AS (SELECT o_custkey AS src, o_orderkey % 500 AS dst, (o_orderkey % 7)::double AS weight FROM orders)
    SELECT least(src % 10, dst % 10) AS src, greatest(src % 10, dst % 10) AS dst, sum(weight) AS weight FROM e GROUP BY ALL""")
def graph_contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of numbers, contracted by their last digits."""
    o = read_table(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 500).alias("dst"), (F.col("o_orderkey") % 7).cast("double").alias("weight"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return community.contracted(e, nodes.select("id", (F.col("id") % 10).alias("label")))
