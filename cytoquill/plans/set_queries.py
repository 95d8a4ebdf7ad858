"""Queries: gene sets, enrichment, plot tables. Genes are parts, pathways brands, libraries part types, contrasts return flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import feeds, genesets
from cytoquill.plans import domain
from cytoquill.plans.base import query
from cytoquill.sources import tables

_DE = """de AS (SELECT contrast, gene, stat, round(1 / (1 + stat * stat), 9) AS pvalue FROM (SELECT l_returnflag AS contrast, l_partkey::varchar AS gene, round((avg(l_discount) - 0.05) * 200, 6) + 0.0 AS stat FROM lineitem GROUP BY ALL))"""
_ST = [_DE, "gs AS (SELECT p_type AS library, p_brand AS pathway, p_partkey::varchar AS gene FROM part)", "sz AS (SELECT library, pathway, count(*)::int AS size FROM gs GROUP BY ALL)",
  "ag AS (SELECT contrast, library, pathway, count(stat) AS n, avg(stat) AS mean_t, stddev_samp(stat) AS sd FROM de JOIN gs USING (gene) GROUP BY ALL)",
  "es AS (SELECT c.contrast, sz.library, sz.pathway, size, coalesce(n, 0) AS n, mean_t, CASE WHEN n >= 3 AND sd > 0 THEN mean_t / (sd / sqrt(n)) END AS t FROM (SELECT DISTINCT contrast FROM de) c CROSS JOIN sz LEFT JOIN ag ON ag.contrast = c.contrast AND ag.library = sz.library AND ag.pathway = sz.pathway)"]
ALPHA = 0.1


def _sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def _de(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = domain.read_table(spark, sf_dir, "lineitem")
    d = li.groupBy(F.col("l_returnflag").alias("contrast"), F.col("l_partkey").cast("string").alias("gene")).agg(F.round((F.avg("l_discount") - 0.05) * 200, 6).alias("stat"))
    return d.withColumn("pvalue", F.round(1 / (1 + F.col("stat") * F.col("stat")), 9))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the parser makes them from lines of a gene-set file."""
    p = domain.read_table(spark, sf_dir, "part").select(F.col("p_type").alias("library"), F.col("p_brand").alias("pathway"), F.col("p_partkey").cast("string").alias("gene"))
    return p.groupBy("library", "pathway").agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genesets.statistics(genesets.prepared(_de(spark, sf_dir)), _sets(spark, sf_dir), ALPHA)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("gene_sets_parse", "SELECT 'PROMO' AS library, p_brand AS pathway, array_to_string(list(p_partkey::varchar ORDER BY p_partkey), ',') AS genes FROM part WHERE p_type = 'PROMO' GROUP BY p_brand")
def gene_sets_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.read_table(spark, sf_dir, "part").where("p_type = 'PROMO'")
    lines = p.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")).alias("g"))
    lines = lines.select(F.concat_ws("\t", "p_brand", F.lit("NA"), F.array_join("g", "\t"), F.lit("")).alias("value"))
    return tables.parse_gmt(lines, "PROMO").withColumn("genes", F.array_join("genes", ","))


#: Names of libraries that are read at once, at most.
MOST_LIBRARIES = 1000


@query("gene_set_libraries", "SELECT DISTINCT p_type AS library FROM part WHERE p_type LIKE 'S%'")
def gene_set_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r[0] for r in domain.read_table(spark, sf_dir, "part").select("p_type").distinct().limit(MOST_LIBRARIES + 1).collect()]
    if len(names) > MOST_LIBRARIES:
        raise ValueError(f"more than {MOST_LIBRARIES} libraries")
    return spark.createDataFrame([(x,) for x in tables.resolve_libraries(["SMALL", "STANDARD", "SMALL"], names)], "library string")


@query("enrich_prepared", _sql(_DE, "SELECT contrast, gene, stat, pvalue FROM de"))
def enrich_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genesets.prepared(_de(spark, sf_dir))


@query("enrich_tstat", _sql(*_ST, "SELECT contrast, library, pathway, size, n, round(mean_t, 10) AS mean_t, round(t, 6) AS enrichment_t FROM es"))
def enrich_tstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_stats(spark, sf_dir), "enrichment_t").withColumn("mean_t", F.round("mean_t", 10)).drop("nom_sig_genes")


@query("enrich_sig_genes", _sql(*_ST, f"SELECT es.contrast, es.library, es.pathway, coalesce(string_agg(gene, ',' ORDER BY abs(stat) DESC, gene) FILTER (pvalue < {ALPHA} AND sign(stat) = sign(t)), '') AS nom_sig_genes FROM es LEFT JOIN (de JOIN gs USING (gene)) m ON m.contrast = es.contrast AND m.library = es.library AND m.pathway = es.pathway GROUP BY ALL"))
def enrich_sig_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("contrast", "library", "pathway", "nom_sig_genes")


@query("enrich_full")
def enrich_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genesets.enrich(genesets.prepared(_de(spark, sf_dir)), _sets(spark, sf_dir), ALPHA, {"PROMO": "promotion"})


@query("enrich_stat_columns")
def enrich_stat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    de = _de(spark, sf_dir).withColumn("other", F.col("stat") * 2)
    return genesets.enrich_by_columns(de, _sets(spark, sf_dir), {"A": "stat", "N": "other", "R": "stat"}, ALPHA)


def _bh_sql(by: str) -> str:
    return f"""x AS (SELECT *, pvalue * count(pvalue) OVER (PARTITION BY {by}) / row_number() OVER (PARTITION BY {by} ORDER BY pvalue, gene) AS raw FROM d),
    y AS (SELECT *, least(1, min(raw) OVER (PARTITION BY {by} ORDER BY pvalue, gene ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS padj FROM x)"""


@query("bh_adjust", _sql(_DE, "d AS (SELECT * FROM de)", _bh_sql("contrast"), "SELECT contrast, gene, round(padj, 6) AS padj FROM y"))
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(genesets.adjust(_de(spark, sf_dir), "pvalue", ("contrast",), ("gene",)), "padj").select("contrast", "gene", "padj")


@query("bh_by_library", _sql(_DE, "d AS (SELECT de.*, p_type AS library FROM de JOIN part ON gene = p_partkey::varchar)", _bh_sql("contrast, library"), "SELECT contrast, library, gene, round(padj, 6) AS padj FROM y"))
def bh_by_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_type").alias("library"))
    return _round(genesets.adjust(_de(spark, sf_dir).join(p, "gene"), "pvalue", ("contrast", "library"), ("gene",)), "padj").select("contrast", "library", "gene", "padj")


@query("enrich_heatmap_z", _sql(*_ST, "SELECT contrast, library, pathway, round(CASE WHEN stddev_pop(t) OVER w > 1e-12 THEN (t - avg(t) OVER w) / stddev_pop(t) OVER w END, 6) AS z FROM es WHERE t IS NOT NULL WINDOW w AS (PARTITION BY library, pathway)"))
def enrich_heatmap_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(feeds.heatmap_z(_stats(spark, sf_dir)), "z")


@query("enrich_heatmap_matrix", _sql(*_ST, "z AS (SELECT contrast, library, pathway, CASE WHEN stddev_pop(t) OVER w > 1e-12 THEN (t - avg(t) OVER w) / stddev_pop(t) OVER w END AS z FROM es WHERE t IS NOT NULL WINDOW w AS (PARTITION BY library, pathway))",
  "SELECT library, pathway, round(max(z) FILTER (contrast = 'A'), 6) AS \"A\", round(max(z) FILTER (contrast = 'N'), 6) AS \"N\", round(max(z) FILTER (contrast = 'R'), 6) AS \"R\" FROM z GROUP BY ALL HAVING count(z) > 0"))
def enrich_heatmap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(feeds.heatmap_matrix(feeds.heatmap_z(_stats(spark, sf_dir)), ["A", "N", "R"]), "A", "N", "R")


@query("scurve_rank", _sql(*_ST, "SELECT contrast, library, pathway, row_number() OVER (PARTITION BY contrast ORDER BY round(t, 6), library, pathway)::int AS rank FROM es WHERE t IS NOT NULL"))
def scurve_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.s_curve(_round(_stats(spark, sf_dir), "enrichment_t")).select("contrast", "library", "pathway", "rank")


@query("volcano_feed", _sql(_DE, "SELECT contrast, gene, stat, round(-log10(pvalue + 1e-300), 6) + 0.0 AS neglog10_p, pvalue < 0.05 AS significant FROM de"))
def volcano_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(feeds.volcano(_de(spark, sf_dir), "stat", "pvalue"), "neglog10_p").drop("pvalue")


@query("reverse_contrast", _sql(_DE, "SELECT 'not A' AS contrast, gene, -stat AS stat, pvalue FROM de WHERE contrast = 'A'"))
def reverse_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.reverse_contrast(_de(spark, sf_dir), "A", "not A", ["stat"]).select("contrast", "gene", "stat", "pvalue")


@query("density_difference", _sql(_DE, "r AS (SELECT stat, gene IN (SELECT p_partkey::varchar FROM part WHERE p_brand = 'Brand#1') AS m FROM de WHERE contrast = 'A')", "b AS (SELECT m, count(*) AS n, stddev_samp(stat) * pow(count(*), -0.2::double) AS h FROM r GROUP BY m)",
  "sp AS (SELECT min(stat) AS low, (max(stat) - min(stat)) / 63 AS dx FROM r)", "k AS (SELECT i, low + i * dx AS x, any_value(dx) AS dx, sum(CASE WHEN m THEN v ELSE 0 END) AS members, sum(CASE WHEN m THEN 0 ELSE v END) AS background FROM (SELECT i, low, dx, m, exp(-0.5::double * pow((low + i * dx - stat) / h, 2)) / (h * sqrt(2 * pi()) * n) AS v FROM r JOIN b USING (m), sp, range(64) g(i)) GROUP BY i, low + i * dx)",
  "a AS (SELECT sum(CASE WHEN i IN (0, 63) THEN 0.5 ELSE 1 END * members * dx) AS am, sum(CASE WHEN i IN (0, 63) THEN 0.5 ELSE 1 END * background * dx) AS ab FROM k)", "SELECT round(x, 6) AS x, round(members / am, 6) AS members, round(background / ab, 6) AS background, round(members / am - background / ab, 6) AS difference FROM k, a"))
def density_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = domain.read_table(spark, sf_dir, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").cast("string").alias("gene"))
    return _round(feeds.density_difference(_de(spark, sf_dir).where("contrast = 'A'"), genes, 64), "x", "members", "background", "difference")


@query("category_counts", "SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY ALL")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.category_counts(domain.read_table(spark, sf_dir, "customer"), "c_mktsegment")
