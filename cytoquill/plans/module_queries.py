"""Queries: rank correlations, gene modules, replication, publication sets. Samples are regions, splits are halves of the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import features, modules, normalize
from cytoquill.plans import domain
from cytoquill.plans.base import query
from cytoquill.sources import tables

#: Correlations of these tables lie around 0.1, so what lies well below counts as negative here.
CPOS, CNEG = 0.1, 0.05

_GC = """gc AS (SELECT n_regionkey::varchar AS sample, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS split, o_custkey::varchar AS cell_id, p_brand AS gene_id, sum(l_quantity)::bigint AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_RHO = [
    _GC, "cl AS (SELECT DISTINCT sample, split, cell_id FROM gc)", "gn AS (SELECT DISTINCT sample, split, gene_id FROM gc)",
    "rk AS (SELECT sample, split, cell_id, gene_id, rank() OVER w + (count(*) OVER (PARTITION BY sample, split, gene_id, coalesce(n, 0)) - 1) / 2.0 AS r FROM cl JOIN gn USING (sample, split) LEFT JOIN gc USING (sample, split, cell_id, gene_id) WINDOW w AS (PARTITION BY sample, split, gene_id ORDER BY coalesce(n, 0)))",
    "rho AS (SELECT sample, split, a.gene_id AS gene_a, b.gene_id AS gene_b, round(corr(a.r::double, b.r::double), 9) AS rho FROM rk a JOIN rk b USING (sample, split, cell_id) WHERE a.gene_id < b.gene_id GROUP BY ALL)",
]
_EDGES = [*_RHO, f"ed AS (SELECT sample, split, gene_a, gene_b, rho, CASE WHEN rho >= {CPOS} THEN 'pos' ELSE 'neg' END AS sign FROM rho WHERE rho >= {CPOS} OR rho <= {CNEG})"]
_UNION = [*_EDGES, """un AS (SELECT coalesce(t.sample, v.sample) AS sample, coalesce(t.gene_a, v.gene_a) AS gene_a, coalesce(t.gene_b, v.gene_b) AS gene_b, t.rho AS rho_train, v.rho AS rho_val, t.rho IS NOT NULL AS present_train, v.rho IS NOT NULL AS present_val,
  coalesce(t.sign, v.sign) AS sign, coalesce(t.sign <> v.sign, false) AS discordant, (coalesce(t.rho, 0) + coalesce(v.rho, 0)) / ((t.rho IS NOT NULL)::int + (v.rho IS NOT NULL)::int) AS rho_mean,
  CASE WHEN t.rho IS NOT NULL AND v.rho IS NOT NULL THEN 'both' ELSE 'single' END AS confidence
  FROM (SELECT * FROM ed WHERE split = 'train') t FULL JOIN (SELECT * FROM ed WHERE split = 'val') v ON t.sample = v.sample AND t.gene_a = v.gene_a AND t.gene_b = v.gene_b)"""]  # fmt: skip


def _w(rho: str) -> str:
    return f"CASE WHEN {rho} IS NOT NULL THEN round(greatest(ln(1 + CASE WHEN sign = 'pos' THEN greatest({rho} - ({CPOS}), 0) / greatest(1e-6, 1 - ({CPOS})) ELSE greatest({CNEG} - {rho}, 0) / greatest(1e-6, 1 + ({CNEG})) END + 1e-6::double), 1e-3), 6) END"


_WEIGHTS = [*_UNION, f"""we AS (SELECT * EXCLUDE (discordant), {_w("rho_train")} AS w_train, {_w("rho_val")} AS w_val, (coalesce({_w("rho_train")}, 0) + coalesce({_w("rho_val")}, 0)) / (present_train::int + present_val::int) AS w_mean FROM un WHERE NOT discordant)"""]
_TOP = [*_WEIGHTS, "bo AS (SELECT sample, gene_a AS g, gene_b AS h, w_mean AS w FROM we WHERE sign = 'pos' UNION ALL SELECT sample, gene_b, gene_a, w_mean FROM we WHERE sign = 'pos')",
  "tp AS (SELECT sample, least(g, h) AS gene_a, greatest(g, h) AS gene_b, max(w) AS w_mean FROM (SELECT *, row_number() OVER (PARTITION BY sample, g ORDER BY w DESC, h) AS r FROM bo) WHERE r <= 3 GROUP BY ALL)"]
_LAB = "lb AS (SELECT r_regionkey::varchar AS sample, gene_id, (replace(gene_id, 'Brand#', '')::int + CASE WHEN replace(gene_id, 'Brand#', '')::int > 20 THEN r_regionkey ELSE 0 END) % 4 AS module_id FROM region, (SELECT DISTINCT p_brand AS gene_id FROM part))"
_ANT = [*_WEIGHTS, _LAB, "sz AS (SELECT sample, module_id, count(*) AS size FROM lb GROUP BY ALL)", """an AS (SELECT we.sample, least(a.module_id, b.module_id) AS module_a, greatest(a.module_id, b.module_id) AS module_b, count(*) AS n_edges, avg(rho_mean) AS mean_rho
  FROM we JOIN lb a ON we.sample = a.sample AND gene_a = a.gene_id JOIN lb b ON we.sample = b.sample AND gene_b = b.gene_id WHERE sign = 'neg' AND a.module_id <> b.module_id GROUP BY ALL)""",
  "atg AS (SELECT an.*, x.size AS size_a, y.size AS size_b, n_edges / (x.size * y.size) AS edge_density FROM an JOIN sz x ON an.sample = x.sample AND module_a = x.module_id JOIN sz y ON an.sample = y.sample AND module_b = y.module_id)"]
_OVER = [_LAB, "ms AS (SELECT sample, module_id, count(DISTINCT gene_id) AS n FROM lb GROUP BY ALL)", "ov AS (SELECT a.sample AS sample_a, a.module_id AS module_a, b.sample AS sample_b, b.module_id AS module_b, count(*) AS n_shared FROM lb a JOIN lb b USING (gene_id) WHERE a.sample < b.sample GROUP BY ALL)",
  "oj AS (SELECT ov.*, n_shared / (x.n + y.n - n_shared) AS jaccard FROM ov JOIN ms x ON sample_a = x.sample AND module_a = x.module_id JOIN ms y ON sample_b = y.sample AND module_b = y.module_id)"]
#: A replicated module is the set of modules of one number.
_REP = "rp AS (SELECT DISTINCT sample, module_id, module_id % 3 AS replicated_module_id FROM lb)"


def _ctes(parts: list[str], body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, split, cell_id, gene_id, n``."""
    t = lambda n: domain.read_table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    split = F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("val")
    return j.groupBy(F.col("n_regionkey").cast("string").alias("sample"), split.alias("split"), F.col("o_custkey").cast("string").alias("cell_id"), F.col("p_brand").alias("gene_id")).agg(F.sum("l_quantity").cast("long").alias("n"))


def _rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rank_correlation(split_counts(spark, sf_dir), ["sample", "split"])


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = domain.read_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("sample"), F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    return r.withColumns({"cpos": F.lit(CPOS), "cneg": F.lit(CNEG)})


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.threshold_edges(_rho(spark, sf_dir), _cuts(spark, sf_dir))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.weighted_edges(modules.concordant(modules.union_splits(_edges(spark, sf_dir))), _cuts(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.top_k_edges(_weighted(spark, sf_dir).where("sign = 'pos'"), 3)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = domain.genes(spark, sf_dir).select("gene_id", F.replace("gene_id", F.lit("Brand#"), F.lit("")).cast("int").alias("k"))
    r = domain.read_table(spark, sf_dir, "region").select("r_regionkey")
    return r.join(g, how="cross").select(F.col("r_regionkey").cast("string").alias("sample"), "gene_id", ((F.col("k") + F.when(F.col("k") > 20, F.col("r_regionkey")).otherwise(0)) % 4).alias("module_id"))  # a label for each sample and gene


def _replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("sample", "module_id", (F.col("module_id") % 3).alias("replicated_module_id")).distinct()


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("gene_rank_corr", _ctes(_RHO, "SELECT sample, split, gene_a, gene_b, rho FROM rho"))
def gene_rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rho(spark, sf_dir)


@query("gene_edges_threshold", _ctes(_EDGES, "SELECT sample, split, gene_a, gene_b, rho, sign FROM ed"))
def gene_edges_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query("gene_edges_union", _ctes(_UNION, "SELECT * REPLACE (round(rho_mean, 12) AS rho_mean) FROM un"))
def gene_edges_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(modules.union_splits(_edges(spark, sf_dir)), "rho_mean", digits=12)


@query("gene_edge_weights", _ctes(_WEIGHTS, "SELECT sample, gene_a, gene_b, sign, confidence, w_train, w_val, round(w_mean, 10) AS w_mean FROM we"))
def gene_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_weighted(spark, sf_dir), "w_mean", digits=10).select("sample", "gene_a", "gene_b", "sign", "confidence", "w_train", "w_val", "w_mean")


@query("gene_edges_topk", _ctes(_TOP, "SELECT sample, gene_a, gene_b, round(w_mean, 10) AS w_mean FROM tp"))
def gene_edges_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_top(spark, sf_dir), "w_mean", digits=10)


@query("module_degree_strength", _ctes([*_TOP, _LAB, "en AS (SELECT sample, gene_a AS gene_id, w_mean FROM tp UNION ALL SELECT sample, gene_b, w_mean FROM tp)"], "SELECT lb.sample, lb.gene_id, module_id, count(w_mean) AS degree_pos, round(coalesce(sum(w_mean), 0), 10) AS strength_pos FROM lb LEFT JOIN en USING (sample, gene_id) GROUP BY ALL"))
def module_degree_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(modules.degree_strength(_top(spark, sf_dir), _labels(spark, sf_dir)), "strength_pos", digits=10)


@query("module_antagonism", _ctes(_ANT, "SELECT * REPLACE (round(mean_rho, 14) AS mean_rho, round(edge_density, 14) AS edge_density) FROM atg"))
def module_antagonism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(modules.antagonism(_weighted(spark, sf_dir).where("sign = 'neg'"), _labels(spark, sf_dir)), "mean_rho", "edge_density", digits=14)


@query("module_intra_stats", _ctes([*_TOP, _LAB, "sz AS (SELECT sample, module_id, count(*) AS size FROM lb GROUP BY ALL)", "ie AS (SELECT tp.sample, a.module_id, w_mean FROM tp JOIN lb a ON tp.sample = a.sample AND gene_a = a.gene_id JOIN lb b ON tp.sample = b.sample AND gene_b = b.gene_id WHERE a.module_id = b.module_id)"],
  "SELECT sz.sample, sz.module_id, size, count(w_mean) AS n_edges, round(avg(w_mean), 10) AS mean_weight, round(median(w_mean), 10) AS median_weight FROM sz LEFT JOIN ie USING (sample, module_id) GROUP BY ALL"))
def module_intra_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(modules.intra_stats(_top(spark, sf_dir), _labels(spark, sf_dir)), "mean_weight", "median_weight", digits=10)


@query("module_nodes", _ctes([_LAB], "SELECT row_number() OVER (ORDER BY sample, module_id) - 1 AS node_id, sample, module_id, count(DISTINCT gene_id) AS n_genes FROM lb GROUP BY sample, module_id"))
def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.cohort_nodes(_labels(spark, sf_dir))


@query("module_jaccard", _ctes(_OVER, "SELECT sample_a, module_a, sample_b, module_b, n_shared, round(jaccard, 6) AS jaccard FROM oj WHERE jaccard >= 0.3"))
def module_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(modules.module_overlap(_labels(spark, sf_dir)), "jaccard")


_SUP = "su AS (SELECT replicated_module_id, gene_id, count(DISTINCT sample) AS support_n_samples FROM lb JOIN rp USING (sample, module_id) GROUP BY ALL)"


@query("replicated_support", _ctes([_LAB, _REP, _SUP], "SELECT * FROM su"))
def replicated_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.support(_labels(spark, sf_dir), _replicated(spark, sf_dir))


@query("replicated_antagonism", _ctes([*_ANT, _REP], """SELECT least(x.replicated_module_id, y.replicated_module_id) AS replicated_a, greatest(x.replicated_module_id, y.replicated_module_id) AS replicated_b, count(DISTINCT atg.sample) AS support_n_samples, round(avg(n_edges), 14) AS mean_edges,
  median(n_edges)::double AS median_edges, round(avg(mean_rho), 14) AS mean_rho, round(avg(edge_density), 14) AS mean_density FROM atg JOIN rp x ON atg.sample = x.sample AND module_a = x.module_id JOIN rp y ON atg.sample = y.sample AND module_b = y.module_id GROUP BY 1, 2"""))
def replicated_antagonism(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = modules.antagonism(_weighted(spark, sf_dir).where("sign = 'neg'"), _labels(spark, sf_dir))
    return _round(modules.replicated_antagonism(pairs, _replicated(spark, sf_dir)), "mean_edges", "mean_rho", "mean_density", digits=14)


_MOD = "mo AS (SELECT DISTINCT gene_id, module_id FROM lb WHERE sample = '0')"
_SCO = [domain.SQL["counts"] and f"counts AS ({domain.SQL['counts']})", f"cells AS ({domain.SQL['cells']})", _LAB, _MOD, "va AS (SELECT cell_id, gene_id, ln(1 + n * 1e4 / sum(n) OVER (PARTITION BY cell_id)) AS value FROM counts)",
  "sc AS (SELECT c.cluster, g.module_id, coalesce(v.v, 0) / (c.cells * g.genes) AS score FROM (SELECT cluster, count(*) AS cells FROM cells GROUP BY ALL) c CROSS JOIN (SELECT module_id, count(*) AS genes FROM mo GROUP BY ALL) g LEFT JOIN (SELECT cluster, module_id, sum(value) AS v FROM va JOIN cells USING (cell_id) JOIN mo USING (gene_id) GROUP BY ALL) v ON v.cluster = c.cluster AND v.module_id = g.module_id)"]
_PRO = [*_SCO, "me AS (SELECT cluster, CASE WHEN cluster < 'G' THEN 'low' ELSE 'high' END AS meta_cluster FROM (SELECT DISTINCT cluster FROM cells))", "nu AS (SELECT cluster, module_id, score / greatest(sqrt(sum(score * score) OVER (PARTITION BY cluster)), 1e-12) AS u FROM sc)",
  "pm AS (SELECT meta_cluster, module_id, avg(u) AS m, count(DISTINCT cluster) AS n_clusters FROM nu JOIN me USING (cluster) GROUP BY ALL)", "pr AS (SELECT meta_cluster, module_id, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY meta_cluster)), 1e-12) AS profile_weight, n_clusters FROM pm)"]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = normalize.normalize(domain.counts(spark, sf_dir), "cp10k_log")
    return modules.cluster_scores(values, domain.cells(spark, sf_dir), _labels(spark, sf_dir).where("sample = '0'"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = domain.cells(spark, sf_dir).select("cluster").distinct().withColumn("meta_cluster", F.when(F.col("cluster") < "G", "low").otherwise("high"))
    return modules.meta_profiles(_scores(spark, sf_dir), meta)


@query("module_scores", _ctes(_SCO, "SELECT cluster, module_id, round(score, 6) AS score FROM sc"))
def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_scores(spark, sf_dir), "score")


@query("module_cosine_profiles", _ctes(_PRO, "SELECT meta_cluster, module_id, round(profile_weight, 6) AS profile_weight, n_clusters FROM pr"))
def module_cosine_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_profiles(spark, sf_dir), "profile_weight")


_PUB = """dx AS (SELECT meta_cluster, gene_id, (replace(gene_id, 'Brand#', '')::int % 7 - 2)::double AS effect, (replace(gene_id, 'Brand#', '')::int % 5) / 50.0::double AS pvalue FROM (VALUES ('low'), ('high')) t(meta_cluster), (SELECT DISTINCT p_brand AS gene_id FROM part))"""


@query("publication_gene_sets", _ctes([*_PRO, _REP, _SUP, _PUB, "pf AS (SELECT meta_cluster, module_id AS replicated_module_id, round(profile_weight, 6) AS profile_weight FROM pr)", "pt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meta_cluster ORDER BY profile_weight DESC, replicated_module_id) AS r FROM pf) WHERE r <= 2)",
  "ca AS (SELECT meta_cluster, gene_id, replicated_module_id, profile_weight, effect, pvalue, row_number() OVER (PARTITION BY meta_cluster ORDER BY profile_weight DESC, effect DESC, pvalue, gene_id, replicated_module_id) AS rank FROM dx JOIN pt USING (meta_cluster) JOIN (SELECT * FROM su WHERE support_n_samples >= 2) USING (replicated_module_id, gene_id) WHERE pvalue <= 0.05 AND effect > 0)"],
  "SELECT meta_cluster, 'core' AS tier, rank, gene_id, replicated_module_id, profile_weight, effect, pvalue FROM ca WHERE rank <= 3 UNION ALL SELECT meta_cluster, 'extended', rank, gene_id, replicated_module_id, profile_weight, effect, pvalue FROM ca WHERE rank <= 6"))
def publication_gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.replace("gene_id", F.lit("Brand#"), F.lit("")).cast("int")
    de = domain.genes(spark, sf_dir).select(F.explode(F.array(F.lit("low"), F.lit("high"))).alias("meta_cluster"), "gene_id", (k % 7 - 2).cast("double").alias("effect"), ((k % 5) / 50.0).alias("pvalue"))
    profiles = _round(_profiles(spark, sf_dir), "profile_weight").withColumnRenamed("module_id", "replicated_module_id")
    return modules.publication_sets(de, modules.support(_labels(spark, sf_dir), _replicated(spark, sf_dir)), profiles, 0.05, 2, 2, 3, 6)


@query("artifact_index", _ctes(_RHO, f"SELECT sample, split, n_genes, count(*) OVER (PARTITION BY sample) AS n_splits, (SELECT count(*) = count(DISTINCT (gene_a, gene_b)) FROM rho r WHERE r.sample = s.sample AND r.split = s.split) AS pairs_unique, {CPOS}::double AS cpos, {CNEG}::double AS cneg FROM (SELECT sample, split, count(DISTINCT g) AS n_genes FROM (SELECT sample, split, gene_a AS g FROM rho UNION ALL SELECT sample, split, gene_b FROM rho) GROUP BY ALL) s"))
def artifact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.artifact_index(_rho(spark, sf_dir), _cuts(spark, sf_dir))


@query("artifact_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing, sha256(props) AS provenance_sha256 FROM events")
def artifact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.read_table(spark, sf_dir, "events").select("event_id", F.col("props").alias("provenance"))
    return tables.correlation_artifact_fields(e, ["k", "missing"]).drop("provenance")


@query("anticorrelated_genes", _ctes([*_RHO, "lo AS (SELECT gene_a AS gene_id FROM rho WHERE sample = '0' AND split = 'train' AND rho <= -0.05 UNION ALL SELECT gene_b FROM rho WHERE sample = '0' AND split = 'train' AND rho <= -0.05)", "gg AS (SELECT DISTINCT p_brand AS gene_id FROM part)"],
  "SELECT gg.gene_id, count(lo.gene_id) AS n_negative, count(lo.gene_id) >= 3 AS selected FROM gg LEFT JOIN lo USING (gene_id) GROUP BY ALL"))
def anticorrelated_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rho = _rho(spark, sf_dir).where("sample = '0' and split = 'train'")
    return features.anticorrelated_genes(rho, domain.genes(spark, sf_dir), -0.05, 3)


@query("feature_manifest", "WITH g AS (SELECT DISTINCT p_brand AS gene_id FROM part) SELECT to_json(list(gene_id ORDER BY gene_id))::varchar AS feature_ids, to_json(list(gene_id ORDER BY gene_id) FILTER (gene_id LIKE '%1%'))::varchar AS feature_ids_kept, count(*) FILTER (gene_id LIKE '%1%') AS n_kept FROM g")
def feature_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.manifest(domain.genes(spark, sf_dir).select("gene_id", F.col("gene_id").contains("1").alias("selected")))


@query("cohort_modules")
def cohort_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.run_cohort(_rho(spark, sf_dir), _cuts(spark, sf_dir), 3)["modules"]


@query("cohort_support")
def cohort_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.run_cohort(_rho(spark, sf_dir), _cuts(spark, sf_dir), 3)["support"]
