"""Gene modules: edges from correlations, modules, antagonism, replication across samples, gene sets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.operators import community
from cytoquill.sources.tables import checkpointed


def threshold_edges(rho: DataFrame, cuts: DataFrame, by: Sequence[str] = ("sample", "split")) -> DataFrame:
    """``by…, gene_a, gene_b, rho, sign`` of correlations at ``cpos`` or over, or at ``cneg`` or under (``cuts``: by…, cpos, cneg)."""
    e = rho.join(cuts, list(by)).where("gene_a < gene_b and (rho >= cpos or rho <= cneg)")
    return e.select(*by, "gene_a", "gene_b", "rho", F.when(F.col("rho") >= F.col("cpos"), "pos").otherwise("neg").alias("sign"))


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with gene_a < gene_b."""
    return edges.withColumns({"gene_a": F.least("gene_a", "gene_b"), "gene_b": F.greatest("gene_a", "gene_b")})


def union_splits(edges: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Edges of either split: ``by…, gene_a, gene_b, rho_train, rho_val, present_train, present_val, sign, discordant, rho_mean, confidence``.

    ``discordant`` pairs (another sign in each split) are marked, for counting; ``concordant`` drops them.
    """
    t = edges.where("split = 'train'").select(*by, "gene_a", "gene_b", F.col("rho").alias("rho_train"), F.col("sign").alias("st"))
    v = edges.where("split = 'val'").select(*by, "gene_a", "gene_b", F.col("rho").alias("rho_val"), F.col("sign").alias("sv"))
    j = t.join(v, [*by, "gene_a", "gene_b"], "full_outer")
    both = F.col("st").isNotNull() & F.col("sv").isNotNull()
    present = F.col("st").isNotNull().cast("int") + F.col("sv").isNotNull().cast("int")
    return j.select(
        *by, "gene_a", "gene_b", "rho_train", "rho_val", F.col("st").isNotNull().alias("present_train"), F.col("sv").isNotNull().alias("present_val"),
        F.coalesce("st", "sv").alias("sign"), (both & (F.col("st") != F.col("sv"))).alias("discordant"),
        ((F.coalesce("rho_train", F.lit(0.0)) + F.coalesce("rho_val", F.lit(0.0))) / present).alias("rho_mean"), F.when(both, "both").otherwise("single").alias("confidence"),
    )


def concordant(union: DataFrame) -> DataFrame:
    return union.where("not discordant").drop("discordant")


def excess_weight(rho: Column, sign: Column, cpos: Column, cneg: Column, eps: float = 1e-6, floor: float = 1e-3) -> Column:
    """How far a correlation goes beyond its cut-off, relative to what is left, on a log scale; null for a null rho."""
    up = F.greatest(rho - cpos, F.lit(0.0)) / F.greatest(F.lit(eps), 1 - cpos)
    down = F.greatest(cneg - rho, F.lit(0.0)) / F.greatest(F.lit(eps), 1 + cneg)
    e = F.when(sign == "pos", up).otherwise(down)
    return F.when(rho.isNotNull(), F.round(F.greatest(F.log1p(e + eps), F.lit(floor)), 6))


def weighted_edges(union: DataFrame, cuts: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """``union_splits`` rows with ``w_train``, ``w_val`` and ``w_mean``, the mean over the splits that have the edge."""
    wide = cuts.groupBy(*by).agg(*[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{c}_{s}") for s in ("train", "val") for c in ("cpos", "cneg")])
    j = union.join(wide, list(by))
    j = j.withColumns({f"w_{s}": excess_weight(F.col(f"rho_{s}"), F.col("sign"), F.col(f"cpos_{s}"), F.col(f"cneg_{s}")) for s in ("train", "val")})
    n = F.col("w_train").isNotNull().cast("int") + F.col("w_val").isNotNull().cast("int")
    mean = (F.coalesce("w_train", F.lit(0.0)) + F.coalesce("w_val", F.lit(0.0))) / n
    return j.withColumn("w_mean", mean).drop(*[f"{c}_{s}" for s in ("train", "val") for c in ("cpos", "cneg")])


def default_k(n: int, least: int = 10, most: int = 200) -> int:
    """ln n rounded, ``least`` at least, ``most`` and n - 1 at most."""
    return min(max(least, round(math.log(max(n, 1)))), most, max(n - 1, 0))


def default_ks(rho: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """``by…, k``: ``default_k`` of each sample's own number of genes, of both ends of its pairs."""
    genes = rho.select(*by, F.explode(F.array("gene_a", "gene_b")).alias("g")).groupBy(*by).agg(F.count_distinct("g").alias("n"))
    k = F.least(F.greatest(F.lit(10), F.round(F.log("n")).cast("int")), F.lit(200), F.col("n").cast("int") - 1)
    return genes.select(*by, k.alias("k"))


def top_k_edges(edges: DataFrame, k: int | DataFrame, by: Sequence[str] = ("sample",), weight: str = "w_mean") -> DataFrame:
    """Edges that are among the k heaviest of either end; ties go to the smaller neighbour. ``k`` may be a table of by…, k."""
    both = edges.select(*by, F.col("gene_a").alias("g"), F.col("gene_b").alias("h"), F.col(weight).alias("w")).union(edges.select(*by, "gene_b", "gene_a", weight))
    order = Window.partitionBy(*by, "g").orderBy(F.desc("w"), "h")
    ranked = both.withColumn("r", F.row_number().over(order))
    kept = ranked.join(F.broadcast(k), [*by]).where("r <= k") if isinstance(k, DataFrame) else ranked.where(F.col("r") <= k)  # a row for each sample
    return kept.groupBy(*by, F.least("g", "h").alias("gene_a"), F.greatest("g", "h").alias("gene_b")).agg(F.max("w").alias(weight))


def degree_strength(edges: DataFrame, labels: DataFrame, by: Sequence[str] = ("sample",), weight: str = "w_mean") -> DataFrame:
    """``by…, gene_id, module_id, degree_pos, strength_pos`` of every labelled gene; 0 without edges."""
    ends = edges.select(*by, F.explode(F.array("gene_a", "gene_b")).alias("gene_id"), F.col(weight).alias("w"))
    d = ends.groupBy(*by, "gene_id").agg(F.count("*").alias("degree_pos"), F.sum("w").alias("strength_pos"))
    return labels.select(*by, "gene_id", "module_id").join(d, [*by, "gene_id"], "left").fillna({"degree_pos": 0, "strength_pos": 0.0})


def _labelled(edges: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    la = labels.select(*by, F.col("gene_id").alias("gene_a"), F.col("module_id").alias("ma"))
    lb = labels.select(*by, F.col("gene_id").alias("gene_b"), F.col("module_id").alias("mb"))
    return edges.join(la, [*by, "gene_a"]).join(lb, [*by, "gene_b"])


def antagonism(negative: DataFrame, labels: DataFrame, by: Sequence[str] = ("sample",), rho: str = "rho_mean") -> DataFrame:
    """``by…, module_a, module_b, n_edges, mean_rho, size_a, size_b, edge_density`` of negative edges between modules."""
    size = labels.groupBy(*by, "module_id").agg(F.count("*").alias("size"))
    e = _labelled(negative, labels, by).where("ma <> mb")
    e = e.groupBy(*by, F.least("ma", "mb").alias("module_a"), F.greatest("ma", "mb").alias("module_b")).agg(F.count("*").alias("n_edges"), F.avg(rho).alias("mean_rho"))
    for side in "ab":
        e = e.join(size.select(*by, F.col("module_id").alias(f"module_{side}"), F.col("size").alias(f"size_{side}")), [*by, f"module_{side}"])
    return e.withColumn("edge_density", F.col("n_edges") / (F.col("size_a") * F.col("size_b")))


def intra_stats(edges: DataFrame, labels: DataFrame, by: Sequence[str] = ("sample",), weight: str = "w_mean") -> DataFrame:
    """``by…, module_id, size, n_edges, mean_weight, median_weight`` of edges within modules."""
    size = labels.groupBy(*by, "module_id").agg(F.count("*").alias("size"))
    e = _labelled(edges, labels, by).where("ma = mb").groupBy(*by, F.col("ma").alias("module_id"))
    e = e.agg(F.count("*").alias("n_edges"), F.avg(weight).alias("mean_weight"), F.median(weight).alias("median_weight"))
    return size.join(e, [*by, "module_id"], "left").fillna({"n_edges": 0})


def find_modules(edges: DataFrame, genes: DataFrame | None = None, by: str = "sample", resolution: float = 1.0, seed: int = 0, weight: str = "w_mean") -> DataFrame:
    """``sample, gene_id, module_id``: communities of each sample's positive edges; samples are found in parallel."""
    g = edges.select(by, F.col("gene_a").alias("src"), F.col("gene_b").alias("dst"), F.col(weight).alias("weight"))
    nodes = None if genes is None else genes.select(by, F.col("gene_id").alias("id"))
    return community.cluster(g, nodes, resolution, seed, by).select(by, F.col("id").alias("gene_id"), F.col("label").alias("module_id"))


def cohort_nodes(modules: DataFrame) -> DataFrame:
    """``node_id, sample, module_id, n_genes``: modules of all samples, numbered from 0 in order of sample and module."""
    n = modules.groupBy("sample", "module_id").agg(F.count_distinct("gene_id").alias("n_genes"))
    # A row for each module of the cohort: thousands, so one partition for the numbering.
    return n.withColumn("node_id", F.row_number().over(Window.orderBy("sample", "module_id")) - 1).select("node_id", "sample", "module_id", "n_genes")


def module_overlap(modules: DataFrame, least: float = 0.3) -> DataFrame:
    """``sample_a, module_a, sample_b, module_b, n_shared, jaccard`` of modules of different samples, by an inverted index of genes."""
    m = modules.select("sample", "module_id", "gene_id").distinct()
    size = m.groupBy("sample", "module_id").agg(F.count("*").alias("n"))
    a = m.select(F.col("sample").alias("sample_a"), F.col("module_id").alias("module_a"), "gene_id")
    b = m.select(F.col("sample").alias("sample_b"), F.col("module_id").alias("module_b"), "gene_id")
    s = a.join(b, "gene_id").where("sample_a < sample_b").groupBy("sample_a", "module_a", "sample_b", "module_b").agg(F.count("*").alias("n_shared"))
    for side in "ab":
        s = s.join(size.select(F.col("sample").alias(f"sample_{side}"), F.col("module_id").alias(f"module_{side}"), F.col("n").alias(f"n_{side}")), [f"sample_{side}", f"module_{side}"])
    j = s.withColumn("jaccard", F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared")))
    return j.where(F.col("jaccard") >= least).select("sample_a", "module_a", "sample_b", "module_b", "n_shared", "jaccard")


def replicate(modules: DataFrame, least: float = 0.3, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """``sample, module_id, replicated_module_id``: communities of the overlap graph; a module without overlap is one of its own."""
    nodes = cohort_nodes(modules)
    at = lambda s: nodes.select(F.col("sample").alias(f"sample_{s}"), F.col("module_id").alias(f"module_{s}"), F.col("node_id").alias("src" if s == "a" else "dst"))
    e = module_overlap(modules, least).join(at("a"), ["sample_a", "module_a"]).join(at("b"), ["sample_b", "module_b"]).select("src", "dst", F.col("jaccard").alias("weight"))
    found = community.cluster(e, nodes.select(F.col("node_id").alias("id")), resolution, seed)
    return nodes.join(found, nodes.node_id == found.id).select("sample", "module_id", F.col("label").alias("replicated_module_id"))


def support(modules: DataFrame, replicated: DataFrame) -> DataFrame:
    """``replicated_module_id, gene_id, support_n_samples``."""
    j = modules.join(replicated, ["sample", "module_id"])
    return j.groupBy("replicated_module_id", "gene_id").agg(F.count_distinct("sample").alias("support_n_samples"))


def replicated_antagonism(pairs: DataFrame, replicated: DataFrame) -> DataFrame:
    """``antagonism`` rows by replicated pair: samples, mean and median of edges, mean rho, mean density. Pairs within one replicated module stay."""
    a = replicated.select("sample", F.col("module_id").alias("module_a"), F.col("replicated_module_id").alias("ra"))
    b = replicated.select("sample", F.col("module_id").alias("module_b"), F.col("replicated_module_id").alias("rb"))
    j = pairs.join(a, ["sample", "module_a"]).join(b, ["sample", "module_b"])
    return j.groupBy(F.least("ra", "rb").alias("replicated_a"), F.greatest("ra", "rb").alias("replicated_b")).agg(
        F.count_distinct("sample").alias("support_n_samples"), F.avg("n_edges").alias("mean_edges"), F.median("n_edges").alias("median_edges"), F.avg("mean_rho").alias("mean_rho"), F.avg("edge_density").alias("mean_density")
    )


def cluster_scores(values: DataFrame, cells: DataFrame, modules: DataFrame, cluster: str = "cluster", value: str = "value") -> DataFrame:
    """``cluster, module_id, score``: the mean over a cluster's cells of the mean of a module's genes, zeros included."""
    m = modules.select("module_id", "gene_id").distinct()
    n_genes = m.groupBy("module_id").agg(F.count("*").alias("genes"))
    n_cells = cells.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("cells"))
    s = values.join(cells.select("cell_id", F.col(cluster).alias("cluster")), "cell_id").groupBy("cluster", "gene_id").agg(F.sum(value).alias("v"))
    s = s.join(m, "gene_id").groupBy("cluster", "module_id").agg(F.sum("v").alias("v"))
    grid = n_cells.join(n_genes, how="cross")  # the result: clusters times modules
    return grid.join(s, ["cluster", "module_id"], "left").select("cluster", "module_id", (F.coalesce("v", F.lit(0.0)) / (F.col("cells") * F.col("genes"))).alias("score"))


def _unit(x: str, *by: str) -> Column:
    return F.col(x) / F.greatest(F.sqrt(F.sum(F.col(x) * F.col(x)).over(Window.partitionBy(*by))), F.lit(1e-12))


def meta_profiles(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """``meta_cluster, module_id, profile_weight, n_clusters``: unit profiles of clusters, averaged by meta cluster (cluster, meta_cluster) and made unit again."""
    u = scores.withColumn("u", _unit("score", "cluster")).join(meta, "cluster")
    p = u.groupBy("meta_cluster", "module_id").agg(F.avg("u").alias("m"), F.count_distinct("cluster").alias("n_clusters"))
    return p.select("meta_cluster", "module_id", _unit("m", "meta_cluster").alias("profile_weight"), "n_clusters")


def publication_sets(de: DataFrame, modules: DataFrame, profiles: DataFrame, alpha: float = 0.05, min_support: int = 2, top_modules: int = 5, core: int = 50, extended: int = 200) -> DataFrame:
    """``meta_cluster, tier, rank, gene_id, replicated_module_id, profile_weight, effect, pvalue``.

    ``de``: meta_cluster, gene_id, pvalue, effect (up, at ``alpha`` or under); ``modules``: with
    support; ``profiles``: the heaviest modules of each meta cluster. Order: weight, effect, p. A
    gene of several modules counts with each.
    """
    up = de.where((F.col("pvalue") <= alpha) & (F.col("effect") > 0)).select("meta_cluster", "gene_id", "pvalue", "effect")
    per = Window.partitionBy("meta_cluster")
    top = profiles.withColumn("r", F.row_number().over(per.orderBy(F.desc("profile_weight"), "replicated_module_id"))).where(F.col("r") <= top_modules).drop("r")
    known = modules.where(F.col("support_n_samples") >= min_support).select("replicated_module_id", "gene_id")
    c = up.join(top.select("meta_cluster", "replicated_module_id", "profile_weight"), "meta_cluster").join(known, ["replicated_module_id", "gene_id"])
    c = c.withColumn("rank", F.row_number().over(per.orderBy(F.desc("profile_weight"), F.desc("effect"), "pvalue", "gene_id", "replicated_module_id")))
    tier = lambda name, n: c.where(F.col("rank") <= n).withColumn("tier", F.lit(name))
    return tier("core", core).unionByName(tier("extended", extended)).select("meta_cluster", "tier", "rank", "gene_id", "replicated_module_id", "profile_weight", "effect", "pvalue")


def run_cohort(rho: DataFrame, cuts: DataFrame, k: int | None = None, resolution: float = 1.0, seed: int = 0, least_overlap: float = 0.3) -> dict[str, DataFrame]:
    """From correlations of all samples to replicated modules, all samples at once: every table by name.

    Correlations and modules are written once, as most of the tables read them several times.
    """
    rho = checkpointed(rho)
    edges = weighted_edges(concordant(union_splits(threshold_edges(rho, cuts))), cuts)
    positive = top_k_edges(edges.where("sign = 'pos'"), k or default_ks(rho))
    modules = checkpointed(find_modules(positive, resolution=resolution, seed=seed))
    pairs = antagonism(edges.where("sign = 'neg'"), modules)
    replicated = replicate(modules, least_overlap, resolution, seed)
    return {
        "edges": edges, "positive": positive, "modules": degree_strength(positive, modules), "stats": intra_stats(positive, modules), "antagonism": pairs,
        "replicated": replicated, "support": support(modules, replicated), "replicated_antagonism": replicated_antagonism(pairs, replicated),
    }


def sets_from_results(results: DataFrame, meta_of: Mapping[str, str], modules: DataFrame, profiles: DataFrame, alpha: float = 0.05, min_support: int = 1, top_modules: int = 5, core: int = 50, extended: int = 200, pvalue: str | None = None, effect: str | None = None) -> DataFrame:
    """``publication_sets`` of tested contrasts: those that ``meta_of`` names, each as its meta cluster; the others don't count.

    ``results``: contrast, gene_id or gene_name, and columns of p (``pvalue``, else ``padj``) and effect (``stat``, else ``log2FoldChange``) unless named.
    """
    first = lambda *names: next((c for c in names if c in results.columns), None)
    gene, p, e = first("gene_id", "gene_name"), pvalue or first("pvalue", "padj"), effect or first("stat", "log2FoldChange")
    if gene is None or p is None or e is None:
        raise ValueError(f"results need columns of gene, p and effect; there are {', '.join(results.columns)}")
    spark = results.sparkSession
    names = spark.createDataFrame([(str(k), str(v)) for k, v in meta_of.items()], "contrast string, meta_cluster string")
    de = results.join(F.broadcast(names), "contrast").select("meta_cluster", F.col(gene).alias("gene_id"), F.col(p).alias("pvalue"), F.col(e).alias("effect"))  # a row for each contrast
    return publication_sets(de, modules, profiles, alpha, min_support, top_modules, core, extended)
