"""The driver's tables as cell-by-gene tables, in DataFrames and in SQL.

Cells are customers, genes are brands, a count is the quantity a customer ordered of a brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.sources.tables import read_table

SQL = {
    "counts": "SELECT o_custkey::varchar AS cell_id, p_brand AS gene_id, sum(l_quantity)::bigint AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "cells": "SELECT c_custkey::varchar AS cell_id, c_nationkey::varchar AS sample, c_mktsegment AS cluster, c_acctbal AS balance FROM customer",
    "genes": "SELECT DISTINCT p_brand AS gene_id, replace(p_brand, 'Brand#', 'B') AS symbol FROM part",
    "ecounts": "SELECT user_id::varchar AS cell_id, 'G' || json_extract_string(props, '$.k') AS gene_id, count(*) AS n FROM events GROUP BY ALL",
    "train": "SELECT vec_id AS id, embedding[1:32] AS vec FROM embeddings",
    "val": "SELECT vec_id AS id, embedding[33:64] AS vec FROM embeddings",
    "vectors": "SELECT vec_id AS id, embedding AS vec, label FROM embeddings",
    # Pseudobulks are the joint levels of nation and segment; a condition is the parity of the nation.
    "membership": "SELECT c_nationkey || '|' || c_mktsegment AS pb_id, c_custkey::varchar AS cell_id FROM customer",
    "pb_counts": "SELECT pb_id, gene_id, sum(n)::bigint AS n FROM counts JOIN membership USING (cell_id) GROUP BY ALL",
    "pbs": "SELECT DISTINCT c_nationkey || '|' || c_mktsegment AS pb_id, CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS condition FROM customer",
}

_NEEDS = {"pb_counts": ("counts", "membership")}


def sql(names: str, body: str) -> str:
    """``body`` after the named tables as common table expressions."""
    wanted: list[str] = []
    for name in names.split():
        for n in (*_NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted) + "\n" + body


def more(names: str, *ctes: str) -> str:
    """As ``sql``, with further expressions before the last one, the body."""
    return sql(names, ", " + ",\n".join(ctes[:-1]) + "\n" + ctes[-1])


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, gene_id, n``; zeros are left out."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(part, li.l_partkey == part.p_partkey).join(orders, li.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_custkey").cast("string").alias("cell_id"), F.col("p_brand").alias("gene_id")).agg(F.sum("l_quantity").cast("long").alias("n"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("cell_id"), F.concat(F.lit("G"), F.get_json_object("props", "$.k")).alias("gene_id")).agg(F.count("*").alias("n"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("cell_id"), F.col("c_nationkey").cast("string").alias("sample"), F.col("c_mktsegment").alias("cluster"), F.col("c_acctbal").alias("balance"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("symbol")).distinct()


def vectors(spark: SparkSession, sf_dir: str, first: int = 1, size: int = 64) -> DataFrame:
    """``id, vec, label`` of ``size`` components from the ``first`` on."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", first, size).alias("vec"), "label")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select(F.concat_ws("|", "sample", "cluster").alias("pb_id"), "cell_id")


def pbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("pb_id"), F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("condition")).distinct()


def pb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cytoquill.operators.pseudobulk import aggregate_counts

    return aggregate_counts(counts(spark, sf_dir), membership(spark, sf_dir))
