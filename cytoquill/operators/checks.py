"""Predicates over tables: each returns the rows that break a rule."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invalid_counts(counts: DataFrame, value: str = "n") -> DataFrame:
    """Rows whose count is null, not finite, negative or not whole."""
    x = F.col(value).cast("double")
    return counts.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0) | (x != F.floor(x)))


def duplicate_ids(rows: DataFrame, column: str) -> DataFrame:
    """``id, n`` of ids that come more than once, and of null or empty ones."""
    i = F.col(column).cast("string")
    return rows.groupBy(i.alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null or id = ''")


def axis_mismatch(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """``axis, side, n``: ids of the counts that an axis lacks (side ``counts``), and ids of an axis without counts (side ``axis``)."""
    parts = []
    for axis, ids in (("cell", cells), ("gene", genes)):
        own, given = counts.select(F.col(f"{axis}_id").alias("id")).distinct(), ids.select(F.col(f"{axis}_id").alias("id")).distinct()
        for side, d in (("counts", own.join(given, "id", "left_anti")), ("axis", given.join(own, "id", "left_anti"))):
            parts.append(d.agg(F.count("*").alias("n")).select(F.lit(axis).alias("axis"), F.lit(side).alias("side"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def non_square_edges(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Ends of edges (src, dst) that aren't nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(node)).distinct()
    return ends.join(nodes.select(node), node, "left_anti")


def gene_filter(counts: DataFrame, samples: DataFrame, min_counts: float = 10.0, min_variance: float = 0.0, sample: str = "pb_id") -> DataFrame:
    """``gene_id, total, variance`` of genes whose sum and whose sample variance over all samples, zeros included, lie strictly above the limits."""
    n = samples.select(sample).distinct().agg(F.count("*").alias("k"))
    s = counts.groupBy("gene_id").agg(F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    k, t = F.col("k"), F.col("total").cast("double")
    out = s.join(F.broadcast(n), how="cross").select("gene_id", "total", F.try_divide(F.col("squares") - t * t / k, k - 1).alias("variance"))  # one row
    return out.where((F.col("total") > min_counts) & (F.col("variance") > min_variance))


def sanitize(name: Column) -> Column:
    """Names fit for files and formulas: what isn't a letter, digit or underscore becomes an underscore, runs as one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z_]+", "_"), r"^_+|_+$", "")


def sanitize_text(name: str) -> str:
    return re.sub(r"^_+|_+$", "", re.sub(r"[^0-9A-Za-z_]+", "_", name))


#: Column names of gene annotations, by the name they get.
SYNONYMS = {
    "gene_id": ("gene_id", "ensembl_id", "ensembl_gene_id", "ensg", "gene"),
    "gene_name": ("gene_name", "symbol", "gene_symbol", "external_gene_name", "hgnc_symbol"),
}


def standard_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations with canonical names of the first synonym found, one row for each gene_id (the smallest name)."""
    rename = {}
    for to, names in SYNONYMS.items():
        if (found := next((c for n in names for c in annotations.columns if c.lower() == n), None)) is not None:
            rename[found] = to
    out = annotations.withColumnsRenamed(rename)
    if "gene_id" not in out.columns:
        raise KeyError("annotations need a gene id")
    return out.groupBy("gene_id").agg(*[F.min(c).alias(c) for c in out.columns if c != "gene_id"])


def annotate(results: DataFrame, annotations: DataFrame | None, gene: str = "gene") -> DataFrame:
    """Results with ``gene_id`` and ``gene_name``; without an annotation both are the gene itself."""
    if annotations is None:
        return results.withColumns({"gene_id": F.col(gene), "gene_name": F.col(gene)})
    a = standard_annotations(annotations).withColumnRenamed("gene_id", "_id").withColumnRenamed("gene_name", "_name")
    joined = results.join(a, results[gene] == a["_id"], "left")
    name = F.coalesce(F.col("_name"), F.col(gene)) if "_name" in a.columns else F.col(gene)
    return joined.withColumns({"gene_id": F.coalesce("_id", gene), "gene_name": name}).drop("_id", "_name")
