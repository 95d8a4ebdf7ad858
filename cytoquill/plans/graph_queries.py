"""Queries: neighbours, consensus, communities, partitions, decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import community, consensus, decompose, knn
from cytoquill.plans import domain
from cytoquill.plans.base import query
from cytoquill.plans.domain import more

K = 20
_COS = "1 - list_dot_product(a.vec::double[], b.vec::double[]) / (CASE WHEN list_dot_product(a.vec::double[], a.vec::double[]) > 0 THEN sqrt(list_dot_product(a.vec::double[], a.vec::double[])) ELSE 1 END * CASE WHEN list_dot_product(b.vec::double[], b.vec::double[]) > 0 THEN sqrt(list_dot_product(b.vec::double[], b.vec::double[])) ELSE 1 END)"
_L2 = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
_IP = "-list_dot_product(a.vec::double[], b.vec::double[])"


def _knn(name: str, table: str, dist: str = _COS, k: int = K) -> str:
    return f"""{name} AS (SELECT src, rank, dst, dist FROM (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, (src <> dst)::int, dst)::int AS rank
    FROM (SELECT a.id AS src, b.id AS dst, round({dist}, 9) + 0.0 AS dist FROM {table} a, {table} b)) WHERE rank <= {k})"""


def _mask(name: str, table: str) -> str:
    return f"""{name}_s AS (SELECT *, CASE WHEN rank > 11 THEN dist - lag(dist) OVER (PARTITION BY src ORDER BY rank) END AS step FROM {table}),
    {name}_m AS (SELECT src, list_sort(list(step))[ceil(count(step) / 2.0)::int] AS med FROM {name}_s WHERE step IS NOT NULL GROUP BY src),
    {name}_d AS (SELECT src, any_value(med) AS med, greatest(list_sort(list(abs(step - med)))[ceil(count(step) / 2.0)::int], 1e-8) AS mad FROM {name}_s JOIN {name}_m USING (src) WHERE step IS NOT NULL GROUP BY src),
    {name} AS (SELECT src, rank, dst, dist, coalesce(rank < min(CASE WHEN (step - med) / mad >= 3 THEN rank END) OVER (PARTITION BY src), true) AS keep FROM {name}_s LEFT JOIN {name}_d USING (src))"""


def _weigh(name: str, table: str, where: str = "true") -> str:
    return f"""{name} AS (SELECT src, rank, dst, dist, CASE WHEN rank = 1 THEN 1.0::double ELSE 1 - (dist - d2 + 1e-3::double) / ((dl - d2 + 1e-3::double) + 1e-3::double) END AS weight
    FROM (SELECT *, max(dist) FILTER (rank = 2) OVER (PARTITION BY src) AS d2, max(dist) OVER (PARTITION BY src) AS dl FROM {table} WHERE {where}))"""


_GRAPH = [_knn("n", "vectors"), _mask("g", "n"), _weigh("w", "g", "keep"), "e AS (SELECT src, dst, weight FROM w WHERE src <> dst)"]
_MERGE = [
    _knn("nt", "train"), _mask("gt", "nt"), _knn("nv", "val"), _mask("gv", "nv"),
    "o AS (SELECT coalesce(t.src, v.src) AS src, coalesce(t.dst, v.dst) AS dst, t.dist AS dt, v.dist AS dv FROM (SELECT * FROM gt WHERE keep) t FULL JOIN (SELECT * FROM gv WHERE keep) v ON t.src = v.src AND t.dst = v.dst)",
    "mx AS (SELECT src, dst, (coalesce(dt, max(dt) OVER (PARTITION BY src)) + coalesce(dv, max(dv) OVER (PARTITION BY src))) / 2 AS dist FROM o)",
    "mr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, (src <> dst)::int, dst)::int AS rank FROM mx)", _weigh("mw", "mr"),
]


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.one_graph(domain.vectors(spark, sf_dir), K)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.vectors(spark, sf_dir).select("id", "label")


for _name, _dist in (("cosine", _COS), ("l2", _L2), ("ip", _IP)):

    @query(f"knn_{_name}", more("vectors", _knn("n", "vectors", _dist, 10), "SELECT src, rank, dst, dist FROM n"))
    def knn_query(spark: SparkSession, sf_dir: str, metric: str = _name) -> DataFrame:
        return knn.knn(domain.vectors(spark, sf_dir), 10, metric)


@query("knn_gap_mask", more("vectors", *_GRAPH[:2], "SELECT src, rank, dst, keep FROM g"))
def knn_gap_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.gap_mask(knn.knn(domain.vectors(spark, sf_dir), K)).drop("dist")


@query("knn_weights", more("vectors", *_GRAPH[:3], "SELECT src, rank, dst, dist, round(weight, 6) AS weight FROM w"))
def knn_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(knn.weigh(knn.gap_mask(knn.knn(domain.vectors(spark, sf_dir), K)).where("keep")), "weight")


@query("graph_single", more("vectors", *_GRAPH, "SELECT src, dst, round(weight, 6) AS weight FROM e"))
def graph_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_graph(spark, sf_dir), "weight")


_BOTH = "b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


@query("graph_sym_max", more("vectors", *_GRAPH, _BOTH, "SELECT src, dst, round(max(weight), 6) AS weight FROM b GROUP BY ALL"))
def graph_sym_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(knn.symmetric(_graph(spark, sf_dir), "max"), "weight")


@query("graph_sym_avg", more("vectors", *_GRAPH, _BOTH, "SELECT src, dst, round(sum(weight) / 2, 6) AS weight FROM b GROUP BY ALL"))
def graph_sym_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(knn.symmetric(_graph(spark, sf_dir), "avg"), "weight")


@query("graph_top_edges", more("vectors", *_GRAPH, "r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e)", "SELECT src, dst, round(weight, 6) AS weight FROM r WHERE r <= 5"))
def graph_top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(knn.top_edges(_graph(spark, sf_dir), 5), "weight")


@query("graph_within_cluster", more("vectors", *_GRAPH, "SELECT src, dst, round(weight, 6) AS weight FROM e JOIN vectors x ON src = x.id JOIN vectors y ON dst = y.id WHERE x.label = y.label"))
def graph_within_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(knn.within_labels(_graph(spark, sf_dir), _labels(spark, sf_dir)), "weight")


@query("graph_undirected", more("vectors", *_GRAPH, "SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(weight), 6) AS weight FROM e GROUP BY ALL"))
def graph_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(knn.undirected(_graph(spark, sf_dir)), "weight")


@query("graph_bad_ends", more("vectors", _knn("n", "vectors"), "SELECT DISTINCT id FROM (SELECT src AS id FROM n UNION SELECT dst FROM n) WHERE id NOT IN (SELECT id FROM vectors WHERE label < 5)"))
def graph_bad_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cytoquill.operators.checks import non_square_edges

    v = domain.vectors(spark, sf_dir)
    return non_square_edges(knn.knn(v, K), v.where("label < 5"))


def _split_masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(knn.gap_mask(knn.knn(domain.vectors(spark, sf_dir, first, 32), K)) for first in (1, 33))


@query("consensus_edges", more("train val", *_MERGE, "SELECT src, dst, round(weight, 6) AS weight FROM mw WHERE src <> dst"))
def consensus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(consensus.consensus_graph(domain.vectors(spark, sf_dir, 1, 32), domain.vectors(spark, sf_dir, 33, 32), K), "weight")


@query("consensus_distances", more("train val", *_MERGE, "SELECT src, rank, dst, round(dist, 12) AS dist FROM mw"))
def consensus_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.merge(*_split_masks(spark, sf_dir)).withColumn("dist", F.round("dist", 12)).drop("weight")


@query("consensus_overlap_stats", more("train val", *_MERGE[:5], "SELECT src, count(*) FILTER (dt IS NOT NULL AND dv IS NOT NULL) AS n_both, count(*) FILTER (dv IS NULL) AS n_train, count(*) FILTER (dt IS NULL) AS n_val FROM o GROUP BY src"))
def consensus_overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = consensus.overlap(*(m.where("keep") for m in _split_masks(spark, sf_dir)))
    t, v = F.col("d_train").isNotNull(), F.col("d_val").isNotNull()
    return o.groupBy("src").agg(F.count_if(t & v).alias("n_both"), F.count_if(~v).alias("n_train"), F.count_if(~t).alias("n_val"))


@query("modularity_of_labels", more("vectors", *_GRAPH, "x AS (SELECT weight, x.label AS la, y.label AS lb FROM e JOIN vectors x ON src = x.id JOIN vectors y ON dst = y.id)", "d AS (SELECT label, sum(weight) AS d FROM (SELECT la AS label, weight FROM x UNION ALL SELECT lb, weight FROM x) GROUP BY ALL)",
  "SELECT round((SELECT sum(weight) FILTER (la = lb) / sum(weight) FROM x) - (SELECT sum(d * d) FROM d) / (4 * (SELECT sum(weight) * sum(weight) FROM x)), 6) AS modularity"))
def modularity_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(knn.modularity(_graph(spark, sf_dir), _labels(spark, sf_dir)), "modularity")


@query("leiden_labels")
def leiden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.cluster(_graph(spark, sf_dir), domain.vectors(spark, sf_dir).select("id"), 1.0, 7)


@query("balanced_partition")
def balanced_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.partition(_graph(spark, sf_dir), _labels(spark, sf_dir), 10, "label")


@query("gram_matrix", "SELECT i::int AS i, j::int AS j, round(sum(embedding[i]::double * embedding[j]::double), 6) AS g FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.vectors(spark, sf_dir)
    _, _, _, gram = decompose.cross_products(v.select(F.col("vec").alias("a"), F.col("vec").alias("b")), "a", "b")
    return spark.createDataFrame([(i + 1, j + 1, round(float(gram[i, j]), 6)) for i in range(len(gram)) for j in range(len(gram))], "i int, j int, g double")


@query("svd_scores")
def svd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.svd(domain.vectors(spark, sf_dir), 10)[0]


@query("svd_energy", "SELECT id, round(list_dot_product(vec::double[], vec::double[]), 6) AS energy FROM (SELECT vec_id AS id, embedding AS vec FROM embeddings)")
def svd_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components together keep each row's squared norm."""
    scores = decompose.svd(domain.vectors(spark, sf_dir), 64)[0]
    return scores.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"))


@query("split_correlations", "SELECT i::int AS i, j::int AS j, round(corr(embedding[i]::double, embedding[32 + j]::double), 6) AS r FROM embeddings, range(1, 33) a(i), range(1, 33) b(j) GROUP BY ALL")
def split_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r = decompose.correlations(domain.vectors(spark, sf_dir, 1, 32), domain.vectors(spark, sf_dir, 33, 32))
    return spark.createDataFrame([(i + 1, j + 1, round(float(r[i, j]), 6)) for i in range(r.shape[0]) for j in range(r.shape[1])], "i int, j int, r double")


@query("reproducible_pcs")
def reproducible_pcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = decompose.find_components(domain.vectors(spark, sf_dir, 1, 32), domain.vectors(spark, sf_dir, 33, 32), 20)
    return a.withColumnRenamed("vec", "train").join(b.withColumnRenamed("vec", "val"), "id")
