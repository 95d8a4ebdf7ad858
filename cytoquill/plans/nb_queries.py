"""Queries: size factors, dispersions, tests. Pseudobulks are nation and segment; the condition is the nation's parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import design, nb, nbfit
from cytoquill.plans import domain
from cytoquill.plans.base import query
from cytoquill.plans.domain import more

_G = "g AS (SELECT gene_id, pb_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT gene_id FROM pb_counts) CROSS JOIN pbs LEFT JOIN pb_counts USING (gene_id, pb_id))"
_SF = """lm AS (SELECT gene_id, sum(ln(n)) / (SELECT count(*) FROM pbs) AS m FROM pb_counts WHERE n > 0 GROUP BY gene_id HAVING count(*) = (SELECT count(*) FROM pbs)),
sf AS (SELECT pb_id, exp(median(ln(n) - m)) AS s FROM pb_counts JOIN lm USING (gene_id) WHERE n > 0 GROUP BY pb_id)"""
_Q = "q AS (SELECT g.gene_id, g.pb_id, condition AS grp, n, s, n / s AS q FROM g JOIN sf USING (pb_id) JOIN pbs USING (pb_id))"
_BASE = (_G, _SF, _Q)
_MU = "mu AS (SELECT gene_id, pb_id, grp, n, s * avg(q) OVER w AS mu, 0.1::double AS alpha, ln(avg(q) OVER w) AS beta FROM q WINDOW w AS (PARTITION BY gene_id, grp))"
_HAT = "hat AS (SELECT *, (greatest(0.5, mu) / (1 + alpha * greatest(0.5, mu))) / (sum(greatest(0.5, mu) / (1 + alpha * greatest(0.5, mu))) OVER (PARTITION BY gene_id, grp) + 1e-6::double) AS hat FROM mu)"
_CK = "ck AS (SELECT gene_id, pb_id, grp, n, (n - mu) * (n - mu) / (mu + alpha * mu * mu) / 2 * hat / ((1 - hat) * (1 - hat)) AS cooks FROM hat)"
_SAMPLES = "pb_counts pbs"


def _q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = domain.pb_counts(spark, sf_dir), domain.pbs(spark, sf_dir)
    return nb.with_group(nb.normed(nb.grid(c, p), nb.size_factors(c, p)), p.select("pb_id", F.col("condition").alias("grp")))


def _mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = F.avg("q").over(Window.partitionBy("gene_id", "grp"))
    return _q(spark, sf_dir).select("gene_id", "pb_id", "grp", "n", (F.col("s") * m).alias("mu"), F.lit(0.1).alias("alpha"), F.log(m).alias("beta"))


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("size_factors_ratio", more(_SAMPLES, _SF, "SELECT pb_id, round(s, 6) AS size_factor FROM sf"))
def size_factors_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.size_factors(domain.pb_counts(spark, sf_dir), domain.pbs(spark, sf_dir)), "size_factor")


@query("size_factors_poscounts", more(_SAMPLES, "lm AS (SELECT gene_id, sum(ln(n)) / (SELECT count(*) FROM pbs) AS m FROM pb_counts WHERE n > 0 GROUP BY gene_id)", "l AS (SELECT pb_id, median(ln(n) - m) AS l FROM pb_counts JOIN lm USING (gene_id) WHERE n > 0 AND m > 0 GROUP BY pb_id)",
  "SELECT pb_id, round(exp(l - (SELECT avg(l) FROM l)), 6) AS size_factor FROM l"))
def size_factors_poscounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.size_factors(domain.pb_counts(spark, sf_dir), domain.pbs(spark, sf_dir), "poscounts"), "size_factor")


@query("normed_counts", more(_SAMPLES, *_BASE, "SELECT gene_id, pb_id, n, round(s, 6) AS s, round(q, 6) AS q FROM q"))
def normed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_q(spark, sf_dir).drop("grp"), "s", "q")


@query("mu_linear", more(_SAMPLES, *_BASE, "SELECT gene_id, pb_id, round(greatest(0.5, s * avg(q) OVER (PARTITION BY gene_id, grp)), 6) AS mu FROM q"))
def mu_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.linear_mu(_q(spark, sf_dir)), "mu")


_ROUGH = "ro AS (SELECT gene_id, greatest(0, sum(((q - m) * (q - m) - m) / (m * m)) / (count(*) - count(DISTINCT grp))) AS dispersion FROM (SELECT *, greatest(1, avg(q) OVER (PARTITION BY gene_id, grp)) AS m FROM q) GROUP BY gene_id)"
_MOM = "mo AS (SELECT gene_id, coalesce((var_samp(q) - avg(1 / s) * avg(q)) / nullif(avg(q) * avg(q), 0), 0) AS dispersion FROM q GROUP BY gene_id)"


@query("disp_rough", more(_SAMPLES, *_BASE, _ROUGH, "SELECT gene_id, round(dispersion, 6) AS dispersion FROM ro"))
def disp_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.rough_dispersion(_q(spark, sf_dir)), "dispersion")


@query("disp_moments", more(_SAMPLES, *_BASE, _MOM, "SELECT gene_id, round(dispersion, 6) AS dispersion FROM mo"))
def disp_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.moments_dispersion(_q(spark, sf_dir)), "dispersion")


@query("disp_start", more(_SAMPLES, *_BASE, _ROUGH, _MOM, "SELECT gene_id, round(least(greatest(least(ro.dispersion, mo.dispersion), 1e-8), 10), 6) AS dispersion FROM ro JOIN mo USING (gene_id)"))
def disp_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.start_dispersion(_q(spark, sf_dir)), "dispersion")


_TV = """t1 AS (SELECT gene_id, pb_id, grp, q, count(*) OVER (PARTITION BY gene_id, grp) AS size, row_number() OVER (PARTITION BY gene_id, grp ORDER BY q, pb_id) AS r FROM q),
t2 AS (SELECT *, CASE WHEN size < 3.5 THEN 1.0::double / 3 WHEN size < 23.5 THEN 0.25 ELSE 0.125 END AS trim, CASE WHEN size < 3.5 THEN 2.04 WHEN size < 23.5 THEN 1.86 ELSE 1.51 END AS scale FROM t1 WHERE size >= 3),
t3 AS (SELECT *, avg(q) FILTER (r > floor(size * trim) AND r <= size - floor(size * trim)) OVER (PARTITION BY gene_id, grp) AS m FROM t2),
t4 AS (SELECT *, (q - m) * (q - m) AS d, row_number() OVER (PARTITION BY gene_id, grp ORDER BY (q - m) * (q - m), pb_id) AS r2 FROM t3),
tv AS (SELECT gene_id, max(v) AS variance FROM (SELECT gene_id, grp, any_value(scale) * avg(d) FILTER (r2 > floor(size * trim) AND r2 <= size - floor(size * trim)) AS v FROM t4 GROUP BY gene_id, grp) GROUP BY gene_id)"""


@query("trimmed_cell_variance", more(_SAMPLES, *_BASE, _TV, "SELECT gene_id, round(variance, 4) AS variance FROM tv"))
def trimmed_cell_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.trimmed_variance(_q(spark, sf_dir)).withColumn("variance", F.round("variance", 4))


@query("disp_robust", more(_SAMPLES, *_BASE, _TV, "SELECT gene_id, round(greatest((variance - m) / (m * m), 0.04), 6) AS dispersion FROM tv JOIN (SELECT gene_id, avg(q) AS m FROM q GROUP BY gene_id) USING (gene_id)"))
def disp_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.robust_dispersion(_q(spark, sf_dir)), "dispersion")


@query("replicate_counts", more("pbs", "SELECT pb_id, count(*) OVER (PARTITION BY condition) AS replicates FROM pbs"))
def replicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.replicates(domain.pbs(spark, sf_dir).select("pb_id", F.col("condition").alias("grp")))


@query("leverage_onehot", more(_SAMPLES, *_BASE, _MU, _HAT, "SELECT gene_id, pb_id, round(hat, 6) AS hat FROM hat"))
def leverage_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.leverage(_mu(spark, sf_dir)), "hat")


def _cooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = _mu(spark, sf_dir)
    return nb.cooks(mu.join(nb.leverage(mu), ["gene_id", "pb_id"]), 2)


@query("cooks_given_fit", more(_SAMPLES, *_BASE, _MU, _HAT, _CK, "SELECT gene_id, pb_id, round(cooks, 6) AS cooks FROM ck"))
def cooks_given_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_cooks(spark, sf_dir), "cooks")


@query("cooks_outliers", more(_SAMPLES, *_BASE, _MU, _HAT, _CK, "mx AS (SELECT gene_id, max(cooks) AS c, arg_max(n, cooks) AS at_n FROM ck GROUP BY gene_id)", "SELECT gene_id, any_value(c) > 0.05 AND count(*) FILTER (n > at_n) < 3 AS outlier FROM ck JOIN mx USING (gene_id) GROUP BY gene_id"))
def cooks_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = replicate_counts(spark, sf_dir)
    c = _cooks(spark, sf_dir).join(_q(spark, sf_dir).select("gene_id", "pb_id", "n"), ["gene_id", "pb_id"]).join(reps, "pb_id")
    return nb.cooks_outliers(c, 0.05)


@query("wald_onehot", more(_SAMPLES, *_BASE, _MU, "m AS (SELECT gene_id, grp, sum(mu / (1 + alpha * mu)) AS m, any_value(beta) AS beta, CASE WHEN grp = 'even' THEN 1 ELSE -1 END AS c FROM mu GROUP BY gene_id, grp)",
  "w AS (SELECT gene_id, sum(c * beta) AS effect, sqrt(sum(c * c * m / ((m + 1e-6::double) * (m + 1e-6::double)))) AS se FROM m GROUP BY gene_id)", "SELECT gene_id, round(effect, 6) AS effect, round(se, 6) AS se, round(effect / se, 6) AS stat FROM w"))
def wald_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([("even", 1.0), ("odd", -1.0)], "grp string, c double")
    return _round(nb.wald(_mu(spark, sf_dir), c), "effect", "se", "stat")


@query("contrast_all_vs_rest", "WITH s AS (SELECT DISTINCT c_mktsegment AS grp FROM customer) SELECT a.grp AS contrast, b.grp AS grp, round(CASE WHEN a.grp = b.grp THEN 1 ELSE -1.0::double / ((SELECT count(*) FROM s) - 1) END, 6) AS c FROM s a, s b")
def contrast_all_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [r[0] for r in domain.cells(spark, sf_dir).select("cluster").distinct().orderBy("cluster").collect()]
    rows = [(k, g, round(float(v), 6)) for k, vector in design.one_vs_rest(levels).items() for g, v in zip(levels, vector, strict=True)]
    return spark.createDataFrame(rows, "contrast string, grp string, c double")


@query("design_dummies", more("pbs", "SELECT pb_id, (condition = 'even')::int::double AS condition_even, (condition = 'odd')::int::double AS condition_odd FROM pbs"))
def design_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.dummies(domain.pbs(spark, sf_dir), "condition")


@query("vst_transform", more(_SAMPLES, *_BASE, "SELECT gene_id, pb_id, round(log2((1 + 2 + 2 * 0.05::double * q + 2 * sqrt(0.05::double * q * (1 + 2 + 0.05::double * q))) / (4 * 0.05::double)), 6) AS value FROM q"))
def vst_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.vst(_q(spark, sf_dir), 2.0, 0.05), "value")


@query("vst_mean_transform", more(_SAMPLES, *_BASE, "SELECT gene_id, pb_id, round((2 * asinh(sqrt(0.1::double * q)) - ln(0.1::double) - ln(4)) / ln(2), 6) AS value FROM q"))
def vst_mean_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(nb.vst(_q(spark, sf_dir), 0.0, 0.0, 0.1), "value")


_RES = "re AS (SELECT l_partkey::varchar AS gene_id, round(avg(l_quantity), 6) AS \"baseMean\", round(pow(abs(avg(l_discount) - 0.05) * 40 + 1, -8), 9) AS pvalue FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)"


@query("independent_filter_counts", f"""WITH {_RES}, sp AS (SELECT avg(("baseMean" = 0)::int) AS low FROM re), th AS (SELECT j, low + j * ((CASE WHEN low < 0.95 THEN 0.95 ELSE 1 END) - low) / 49 AS theta FROM sp, range(50) r(j)),
  cu AS (SELECT j::int AS j, theta, quantile_cont("baseMean", 0) AS x FROM th, re GROUP BY ALL), so AS (SELECT list("baseMean" ORDER BY "baseMean") AS v FROM re),
  ct AS (SELECT j, theta, v[floor(theta * (len(v) - 1))::int + 1] + (v[least(floor(theta * (len(v) - 1))::int + 2, len(v))] - v[floor(theta * (len(v) - 1))::int + 1]) * (theta * (len(v) - 1) - floor(theta * (len(v) - 1))) AS cutoff FROM cu, so),
  rk AS (SELECT j, pvalue, row_number() OVER (PARTITION BY j ORDER BY pvalue, gene_id) AS r, count(*) OVER (PARTITION BY j) AS m FROM re JOIN ct ON "baseMean" >= cutoff)
  SELECT ct.j, round(theta, 6) AS theta, coalesce(max(r) FILTER (pvalue * m / r < 0.05), 0)::int AS rejections FROM ct LEFT JOIN rk ON ct.j = rk.j GROUP BY ct.j, theta""")
def independent_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = domain.read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    p = F.round(F.pow(F.abs(F.avg("l_discount") - 0.05) * 40 + 1, F.lit(-8.0)), 9)
    results = li.groupBy(F.col("l_partkey").cast("string").alias("gene_id")).agg(F.round(F.avg("l_quantity"), 6).alias("baseMean"), p.alias("pvalue"))
    return nb.filter_counts(results).select("j", F.round("theta", 6).alias("theta"), "rejections")


@query("numeric_summary", "SELECT count(*) AS n, count(c_acctbal) AS n_finite, min(c_acctbal) AS min, median(c_acctbal) AS median, max(c_acctbal) AS max FROM customer")
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.numeric_summary(domain.read_table(spark, sf_dir, "customer"), "c_acctbal")


def _fit(spark: SparkSession, sf_dir: str) -> nbfit.Fit:
    kept, d = nbfit.prepare(domain.pb_counts(spark, sf_dir), domain.pbs(spark, sf_dir), "~ 0 + condition")
    return nbfit.fit(kept, d)


@query("disp_map")
def disp_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir).genes.select("gene_id", "base_mean", "disp_genewise", "disp_fit", "disp_map", "dispersion", "outlier_disp")


@query("lfc_fit")
def lfc_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir).genes.select("gene_id", "beta", "converged", "replaced", "max_cooks")


@query("de_pairwise")
def de_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbfit.pairwise_de(_fit(spark, sf_dir))


@query("de_cluster_vs_all")
def de_cluster_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = domain.pbs(spark, sf_dir).withColumn("segment", F.substring_index("pb_id", "|", -1))
    return nbfit.workflow(domain.pb_counts(spark, sf_dir), samples, "~ 0 + segment", filtering=False)[1]


@query("lfc_shrink")
def lfc_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, d = nbfit.prepare(domain.pb_counts(spark, sf_dir), domain.pbs(spark, sf_dir), "~ condition")
    return nbfit.shrink(nbfit.fit(kept, d), "condition_odd")
