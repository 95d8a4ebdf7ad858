"""Queries: quality control, normalisation, splitting and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import checks, normalize, qc, split
from cytoquill.plans import domain
from cytoquill.plans.base import query
from cytoquill.plans.domain import more

#: Stand-ins for feature sets and cut-offs that suit the driver's tables.
FEATURES = {"mt_prefix": "B1", "ribo_prefixes": ("B21", "B22", "B3"), "lnc_genes": ("B5", "B24")}
CUTOFFS = {"min_total_counts": 300.0, "min_n_genes": 8, "max_pct_mito": 60.0, "doublet_max_pct_mito": 50.0, "fragment_mito_high_pct": 45.0, "fragment_lncRNA_high_pct": 12.0, "fragment_lncRNA_low_pct": 4.0}

FLAGS = "flags AS (SELECT gene_id, symbol, starts_with(symbol, 'B1') AS mt, starts_with(symbol, 'B21') OR starts_with(symbol, 'B22') OR starts_with(symbol, 'B3') AS ribo, symbol IN ('B5', 'B24') AS \"lncRNA\" FROM genes)"
METRICS = """m0 AS (SELECT cells.cell_id, coalesce(sum(n), 0)::bigint AS total_counts, count(n) FILTER (n > 0) AS n_genes_by_counts, coalesce(sum(n) FILTER (mt), 0)::bigint AS total_counts_mt,
  coalesce(sum(n) FILTER (ribo), 0)::bigint AS total_counts_ribo, coalesce(sum(n) FILTER ("lncRNA"), 0)::bigint AS "total_counts_lncRNA" FROM cells LEFT JOIN counts USING (cell_id) LEFT JOIN flags USING (gene_id) GROUP BY ALL),
m AS (SELECT *, 100.0::double * total_counts_mt / nullif(total_counts, 0) AS pct_counts_mt, 100.0::double * total_counts_ribo / nullif(total_counts, 0) AS pct_counts_ribo,
  100.0::double * "total_counts_lncRNA" / nullif(total_counts, 0) AS "pct_counts_lncRNA" FROM m0)"""
THRESHOLDS = """t AS (SELECT quantile_cont(total_counts, 0.98)::double AS doublet_total_counts, quantile_cont(n_genes_by_counts, 0.98)::double AS doublet_n_genes,
  quantile_cont(total_counts, 0.75)::double AS fragment_max_total_counts, quantile_cont(n_genes_by_counts, 0.75)::double AS fragment_max_n_genes FROM m)"""
CLASSES = """k AS (SELECT m.*, CASE WHEN total_counts >= doublet_total_counts AND n_genes_by_counts >= doublet_n_genes AND pct_counts_mt <= 50 THEN 'doublet_candidate'
  WHEN "pct_counts_lncRNA" >= 12 AND pct_counts_mt <= 45 AND total_counts <= fragment_max_total_counts AND n_genes_by_counts <= fragment_max_n_genes THEN 'fragment_nuclear_lncRNA_enriched'
  WHEN "pct_counts_lncRNA" <= 4 AND pct_counts_mt >= 45 AND total_counts <= fragment_max_total_counts THEN 'fragment_anucleated'
  WHEN total_counts < 300 OR n_genes_by_counts < 8 OR pct_counts_mt > 60 THEN 'low_quality' ELSE 'pass_qc' END AS qc_category FROM m, t)"""
_R = "round({0}, 6) AS {0}"
PCTS = ", ".join(f'round({c}, 6) AS {c}' for c in ("pct_counts_mt", "pct_counts_ribo", '"pct_counts_lncRNA"'))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.metrics(domain.counts(spark, sf_dir), qc.flag_features(domain.genes(spark, sf_dir), **FEATURES), domain.cells(spark, sf_dir))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return qc.classify(m, qc.thresholds(m, **CUTOFFS))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_RATIOS = tuple(c for c in qc.METRICS if c.startswith(("pct", "log")))


@query("qc_feature_flags", more("genes", FLAGS, "SELECT * FROM flags"))
def qc_feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.flag_features(domain.genes(spark, sf_dir), **FEATURES)


@query("qc_metrics", more("counts cells genes", FLAGS, METRICS, f"""SELECT cell_id, total_counts, n_genes_by_counts, total_counts_mt, total_counts_ribo, "total_counts_lncRNA", {PCTS},
  round(ln(1 + total_counts), 6) AS log1p_total_counts, round(ln(1 + total_counts_mt), 6) AS log1p_total_counts_mt, round(ln(1 + total_counts_ribo), 6) AS log1p_total_counts_ribo,
  round(ln(1 + "total_counts_lncRNA"), 6) AS "log1p_total_counts_lncRNA" FROM m"""))
def qc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir), *_RATIOS)


@query("qc_thresholds", more("counts cells genes", FLAGS, METRICS, THRESHOLDS, """SELECT t.*, 50.0::double AS doublet_max_pct_mito, 12.0::double AS "fragment_lncRNA_high_pct", 4.0::double AS "fragment_lncRNA_low_pct",
  45.0::double AS fragment_mito_high_pct, 300.0::double AS min_total_counts, 8.0::double AS min_n_genes, 60.0::double AS max_pct_mito FROM t"""))
def qc_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.thresholds(_metrics(spark, sf_dir), **CUTOFFS)


@query("qc_classify", more("counts cells genes", FLAGS, METRICS, THRESHOLDS, CLASSES, f"SELECT cell_id, total_counts, n_genes_by_counts, {PCTS}, qc_category, qc_category = 'pass_qc' AS qc_keep FROM k"))
def qc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = [f"pct_counts_{s}" for s in qc.SETS]
    return _rounded(_classified(spark, sf_dir), *pct).select("cell_id", "total_counts", "n_genes_by_counts", *pct, "qc_category", "qc_keep")


@query("qc_summary", more("counts cells genes", FLAGS, METRICS, THRESHOLDS, CLASSES, "SELECT qc_category, count(*) AS n_cells FROM k GROUP BY ALL"))
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.summary(_classified(spark, sf_dir))


@query("qc_filtered_counts", more("counts cells genes", FLAGS, METRICS, THRESHOLDS, CLASSES, "SELECT counts.* FROM counts SEMI JOIN (SELECT cell_id FROM k WHERE qc_category = 'pass_qc') USING (cell_id)"))
def qc_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.filter_counts(domain.counts(spark, sf_dir), _classified(spark, sf_dir)).select("cell_id", "gene_id", "n")


@query("qc_metrics_frame", more("counts cells genes", FLAGS, METRICS, THRESHOLDS, CLASSES, f"SELECT cell_id, total_counts AS obs_total_counts, round(pct_counts_mt, 6) AS obs_pct_counts_mt, qc_category AS obs_qc_category FROM k"))
def qc_metrics_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.metrics_frame(_classified(spark, sf_dir), "obs_", ("total_counts", "pct_counts_mt"), ("qc_category",)), "obs_pct_counts_mt")


@query("qc_plot_long", more("counts cells genes", FLAGS, METRICS, """SELECT cell_id, 'total_counts' AS metric, total_counts::double AS value FROM m UNION ALL SELECT cell_id, 'n_genes_by_counts', n_genes_by_counts::double FROM m
  UNION ALL SELECT cell_id, 'pct_counts_mt', round(pct_counts_mt, 6) FROM m"""))
def qc_plot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.plot_long(_metrics(spark, sf_dir), ("total_counts", "n_genes_by_counts", "pct_counts_mt")), "value")


@query("qc_plot_sample", more("counts cells genes", FLAGS, METRICS, "SELECT cell_id, total_counts FROM m ORDER BY md5(cell_id), cell_id LIMIT 100"))
def qc_plot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.plot_sample(_metrics(spark, sf_dir), 1.0, 100, 1000).select("cell_id", "total_counts")


# Normalisation.
_D = "d AS (SELECT cells.cell_id, coalesce(sum(n), 0)::double AS depth FROM cells LEFT JOIN counts USING (cell_id) GROUP BY ALL)"
_P = "p AS (SELECT cell_id, gene_id, n * (SELECT avg(depth) FROM d) / depth AS value FROM counts JOIN d USING (cell_id))"
_L = "l AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM p)"
_NORM_SQL = {
    "raw": (_D, "SELECT cell_id, gene_id, n::double AS value FROM counts"),
    "pf": (_D, _P, "SELECT cell_id, gene_id, round(value, 6) AS value FROM p"),
    "log": (_D, "SELECT cell_id, gene_id, round(ln(1 + n), 6) AS value FROM counts"),
    "pf_log": (_D, _P, _L, "SELECT cell_id, gene_id, round(value, 6) AS value FROM l"),
    "pf_log_pf": (_D, _P, _L, "d2 AS (SELECT cells.cell_id, coalesce(sum(value), 0) AS depth FROM cells LEFT JOIN l USING (cell_id) GROUP BY ALL)", "SELECT cell_id, gene_id, round(value * (SELECT avg(depth) FROM d2) / depth, 6) AS value FROM l JOIN d2 USING (cell_id)"),
    "cpm_log": (_D, "SELECT cell_id, gene_id, round(ln(1 + n * 1e6 / depth), 6) AS value FROM counts JOIN d USING (cell_id)"),
    "cp10k_log": (_D, "SELECT cell_id, gene_id, round(ln(1 + n * 1e4 / depth), 6) AS value FROM counts JOIN d USING (cell_id)"),
    "sqrt": (_D, "SELECT cell_id, gene_id, round(sqrt(n), 6) AS value FROM counts"),
    "depth": (_D, _P, "SELECT cell_id, gene_id, round(value, 6) AS value FROM p"),
    "tenk": (_D, "SELECT cell_id, gene_id, round(n / (depth / 1e4), 6) AS value FROM counts JOIN d USING (cell_id)"),
}


def _normalizer(name: str) -> None:
    @query(f"norm_{name}", more("counts cells", *_NORM_SQL[name]))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(normalize.normalize(domain.counts(spark, sf_dir), name, domain.cells(spark, sf_dir)), "value")


for _name in _NORM_SQL:
    _normalizer(_name)


@query("norm_pearson_residuals", more("counts cells genes", _D, "g AS (SELECT gene_id, coalesce(sum(n), 0)::double AS g FROM genes LEFT JOIN counts USING (gene_id) GROUP BY ALL)",
  "u AS (SELECT cell_id, gene_id, coalesce(n, 0) AS n, depth * g / (SELECT sum(n)::double FROM counts) AS mu FROM d CROSS JOIN g LEFT JOIN counts USING (cell_id, gene_id))",
  "SELECT cell_id, gene_id, round(coalesce(CASE WHEN mu > 0 THEN greatest(least((n - mu) / sqrt(mu + mu * mu / 100), sqrt((SELECT count(*) FROM cells))), -sqrt((SELECT count(*) FROM cells))) END, 0), 6) AS value FROM u"))
def norm_pearson_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize.pearson_residuals(domain.counts(spark, sf_dir), domain.cells(spark, sf_dir), domain.genes(spark, sf_dir)), "value")


# Splitting.
_SPLIT = """o AS (SELECT cell_id, gene_id, ('0x' || md5('7|' || cell_id || '|' || gene_id || '|' || i)[1:8])::bigint / 4294967296.0::double AS u FROM ecounts, unnest(range(1, n + 1)) AS x(i)),
s AS (SELECT cell_id, gene_id, count(*) FILTER (u < 0.325) AS n_train, count(*) FILTER (u >= 0.325 AND u < 0.65) AS n_val, count(*) FILTER (u >= 0.65) AS n_test FROM o GROUP BY ALL)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(domain.event_counts(spark, sf_dir), (0.325, 0.325, 0.35), 7)


@query("split_counts3", more("ecounts", _SPLIT, "SELECT * FROM s"))
def split_counts3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


@query("split_totals", more("ecounts", _SPLIT, "SELECT 'train' AS split, sum(n_train)::bigint AS total FROM s UNION ALL SELECT 'val', sum(n_val)::bigint FROM s UNION ALL SELECT 'test', sum(n_test)::bigint FROM s"))
def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.long_splits(_split(spark, sf_dir)).groupBy("split").agg(F.sum("n").alias("total"))


@query("split_conservation", more("ecounts", _SPLIT, "SELECT count(*) FILTER (n <> n_train + n_val + n_test) AS n_broken, sum(n)::bigint AS n_molecules FROM ecounts JOIN s USING (cell_id, gene_id)"))
def split_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.event_counts(spark, sf_dir)
    broken = split.conservation(c, _split(spark, sf_dir)).agg(F.count("*").alias("n_broken"))
    return broken.join(F.broadcast(c.agg(F.sum("n").alias("n_molecules"))), how="cross")  # one row each


@query("split_normalized", more("ecounts", _SPLIT, "l AS (SELECT 'train' AS split, cell_id, gene_id, n_train AS n FROM s UNION ALL SELECT 'val', cell_id, gene_id, n_val FROM s)",
  "d AS (SELECT split, cell_id, sum(n) AS depth FROM l WHERE n > 0 GROUP BY ALL)", "SELECT split, cell_id, gene_id, round(ln(1 + n * 1e4 / depth), 6) AS value FROM l JOIN d USING (split, cell_id) WHERE n > 0"))
def split_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = split.long_splits(_split(spark, sf_dir)).where("split <> 'test'")
    each = [normalize.normalize(long.where(F.col("split") == s), "cp10k_log").select(F.lit(s).alias("split"), "cell_id", "gene_id", F.round("value", 6).alias("value")) for s in ("train", "val")]
    return each[0].unionByName(each[1])


# Checks.
@query("check_invalid_counts", "SELECT l_orderkey, l_linenumber, l_discount AS n FROM lineitem WHERE l_discount IS NULL OR NOT isfinite(l_discount) OR l_discount < 0 OR l_discount <> floor(l_discount)")
def check_invalid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = domain.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("n"))
    return checks.invalid_counts(li)


@query("duplicate_ids", "SELECT o_custkey::varchar AS id, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_ids(domain.read_table(spark, sf_dir, "orders"), "o_custkey")


@query("axis_mismatch", more("counts cells genes", "x AS (SELECT DISTINCT cell_id FROM counts)", "y AS (SELECT DISTINCT gene_id FROM counts)", """SELECT 'cell' AS axis, 'counts' AS side, (SELECT count(*) FROM x ANTI JOIN cells USING (cell_id)) AS n
  UNION ALL SELECT 'cell', 'axis', (SELECT count(*) FROM cells ANTI JOIN x USING (cell_id)) UNION ALL SELECT 'gene', 'counts', (SELECT count(*) FROM y ANTI JOIN genes USING (gene_id)) UNION ALL SELECT 'gene', 'axis', (SELECT count(*) FROM genes ANTI JOIN y USING (gene_id))"""))
def axis_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.axis_mismatch(domain.counts(spark, sf_dir), domain.cells(spark, sf_dir), domain.genes(spark, sf_dir))


@query("sanitized_names", "SELECT DISTINCT p_name, regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS clean FROM part")
def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return domain.read_table(spark, sf_dir, "part").select("p_name", checks.sanitize(name).alias("clean")).distinct()


@query("pb_gene_filter", more("pb_counts pbs", "k AS (SELECT count(*)::double AS k FROM pbs)", "v AS (SELECT gene_id, sum(n)::bigint AS total, (sum(n::double * n) - sum(n)::double * sum(n)::double / any_value(k)) / (any_value(k) - 1) AS variance FROM pb_counts, k GROUP BY gene_id)",
  "SELECT gene_id, total, round(variance, 4) AS variance FROM v WHERE total > 10 AND variance > 1"))
def pb_gene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(checks.gene_filter(domain.pb_counts(spark, sf_dir), domain.pbs(spark, sf_dir), 10.0, 1.0), "variance", digits=4)


@query("annotated_results", more("counts genes", "SELECT gene_id AS gene, sum(n)::bigint AS total, gene_id, coalesce(symbol, gene_id) AS gene_name FROM counts LEFT JOIN genes USING (gene_id) GROUP BY gene_id, symbol"))
def annotated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = domain.counts(spark, sf_dir).groupBy(F.col("gene_id").alias("gene")).agg(F.sum("n").alias("total"))
    return checks.annotate(totals, domain.genes(spark, sf_dir))
