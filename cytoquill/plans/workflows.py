"""Whole pipelines: counts to consensus graph, graph to differential expression and pathways."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.operators import community, consensus, decompose, features, genesets, knn, nbfit, normalize, pseudobulk, split
from cytoquill.plans.provenance import Envelope
from cytoquill.sources.tables import checkpointed


@dataclass
class Result:
    """Tables by name, how far the pipeline came, and what made it."""

    status: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    diagnostics: dict = field(default_factory=dict)
    provenance: Envelope | None = None


def dense_vectors(values: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """``id, vec``: values of the listed genes in their order, 0 where a cell has none; ids are the cells' ``id``."""
    at = F.create_map(*[x for i, g in enumerate(genes) for x in (F.lit(g), F.lit(i))])
    held = values.where(F.col("gene_id").isin(genes)).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct(at[F.col("gene_id")].alias("k"), "value"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(len(genes) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return cells.select("cell_id", "id").join(held, "cell_id", "left").select("id", vec.alias("vec"))


def consensus_pipeline(
    counts: DataFrame, cells: DataFrame, seed: int = 0, proportions: tuple[float, ...] = (0.325, 0.325, 0.35), normalization: str = "pf_log", components: int = 50, alpha: float = 0.01,
    k: int | None = None, most_genes: int | None = None, feature_alpha: float = 0.05, select_features: bool = True, stop_after: str | None = None, start: Result | None = None,
) -> Result:
    """Split, normalise, select features, decompose both splits, keep what both reproduce, neighbours, consensus, communities.

    ``cells``: cell_id and a numeric id. The status tells where it ended: ``complete``,
    ``stopped``, ``no_features_selected`` or ``no_reproducible_pcs``. Selected are genes with
    an anti-correlated partner in both splits: all of them, or the widest-spread ``most_genes``
    if that is given. More than ``decompose.MOST_COLUMNS`` raise ValueError. ``start``: a result of
    the same counts, cells, seed, proportions and normalization, whose splits and values are taken.
    """
    made = Envelope.create("consensus", {"seed": seed, "proportions": list(proportions), "normalization": normalization, "components": components, "alpha": alpha}, {"columns": sorted(counts.columns)})
    # What several actions read is written once, which also cuts the lineage.
    counts = start.tables["counts"] if start else checkpointed(counts)
    parts = start.tables["splits"] if start else checkpointed(split.split_counts(counts, proportions, seed))
    long = split.long_splits(parts)
    values = {s: start.tables[s] if start else checkpointed(normalize.normalize(long.where(F.col("split") == s).drop("split"), normalization, cells)) for s in ("train", "val")}
    out = Result("stopped", {"counts": counts, "splits": parts, **values}, provenance=made)
    if stop_after == "normalize":
        return out
    genes = counts.select("gene_id").distinct()
    n = cells.count()
    chosen = genes
    if select_features:
        for s in ("train", "val"):
            rho = checkpointed(features.rank_correlation(long.where(F.col("split") == s).drop("split"), cells=cells.select("cell_id")))
            cneg = features.cutoffs(n, rho.count(), feature_alpha)[1]
            found = checkpointed(features.anticorrelated_genes(rho, genes, cneg))
            out.tables[f"features_{s}"] = found
            chosen = chosen.join(found.where("selected").select("gene_id"), "gene_id", "left_semi")
    if most_genes is not None:
        spread = values["train"].join(chosen, "gene_id").groupBy("gene_id").agg(F.sum(F.col("value") * F.col("value")).alias("v"))
        chosen = spread.orderBy(F.desc("v"), "gene_id").limit(most_genes).select("gene_id")
    names = sorted(r["gene_id"] for r in chosen.limit(decompose.MOST_COLUMNS + 1).collect())
    if len(names) > decompose.MOST_COLUMNS:
        raise ValueError(f"more than {decompose.MOST_COLUMNS} genes are selected; lower feature_alpha or give most_genes")
    out.diagnostics["features"] = len(names)
    if not names:
        out.status = "no_features_selected"
        return out
    if stop_after == "features":
        return out
    a, b, found = decompose.find_components(*(checkpointed(dense_vectors(values[s], cells, names)) for s in ("train", "val")), components, alpha)
    a, b = checkpointed(a), checkpointed(b)
    out.tables |= {"pcs_train": a, "pcs_val": b}
    out.diagnostics |= {k2: v for k2, v in found.items() if isinstance(v, int)}
    if not found["train"] or not found["val"]:
        out.status = "no_reproducible_pcs"
        return out
    out.diagnostics["k"] = knn.choose_k(n, k)
    graph = checkpointed(consensus.consensus_graph(a, b, out.diagnostics["k"]))
    out.tables |= {"graph": graph, "labels": community.cluster(graph, cells.select("id"), seed=seed)}
    out.status = "complete"
    out.provenance = made.with_diagnostics(out.diagnostics)
    return out


def de_pipeline(graph: DataFrame, counts: DataFrame, cells: DataFrame, gene_sets: DataFrame | None = None, settings: Mapping | None = None, min_counts: float = 5.0, alpha: float = 0.05, parent: Envelope | None = None) -> Result:
    """Pseudobulks of each cluster, negative-binomial fits, each cluster against the rest, and enrichment of gene sets.

    ``graph``: src, dst, weight by cell_id; ``cells``: cell_id, sample, cluster.
    """
    made = Envelope.create("de", {"min_counts": min_counts, "alpha": alpha}, {"columns": sorted(cells.columns)}, [parent.stable_id] if parent else [])
    tables = pseudobulk.workflow(graph, counts, cells, settings)
    pure = tables["cluster_proportions"].where("proportion = 1").select("pb_id", F.col("label").cast("string").alias("cluster"))
    fitted, results = nbfit.workflow(tables["counts"], pure, "~ 0 + cluster", min_counts, alpha=alpha, filtering=False)
    tables |= {"fit": fitted.genes, "results": results}
    if gene_sets is not None:
        tables["enrichment"] = genesets.enrich(genesets.prepared(results.withColumnRenamed("gene_id", "gene")), gene_sets, alpha)
    return Result("complete", tables, dict(fitted.diagnostics), made.with_diagnostics({k: v for k, v in fitted.diagnostics.items() if isinstance(v, int | float | str)}))
