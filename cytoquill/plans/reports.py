"""Results with names: what was tested, its tables and where it came from; runs from files to files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import checks, community, knn, modules, qc
from cytoquill.plans import workflows
from cytoquill.plans.provenance import Envelope, HashRecord, prefix
from cytoquill.sources import tables


@dataclass
class Contrasts:
    """A table with a column ``contrast``: results of tests, or of gene sets."""

    table: DataFrame
    provenance: Envelope | None = None
    names: tuple[str, ...] = ()

    def available(self) -> list[str]:
        """Names of the contrasts, in the order they were given in, else sorted. The table is read once."""
        if not self.names:
            self.names = tuple(r[0] for r in self.table.select("contrast").distinct().orderBy("contrast").collect())  # a row for each contrast
        return list(self.names)

    def contrast(self, name: str) -> DataFrame:
        """The rows of one contrast; KeyError with the names there are."""
        if name not in self.available():
            raise KeyError(f"no contrast {name!r}; there are {', '.join(self.available())}")
        return self.table.where(F.col("contrast") == name)

    def summary(self, alpha: float = 0.05, p: str = "padj", effect: str = "log2FoldChange") -> DataFrame:
        """``contrast, n, n_tested, n_up, n_down``: rows, those with p, and those at ``alpha`` or under by the sign of their effect."""
        hit = F.col(p) <= alpha
        return self.table.groupBy("contrast").agg(
            F.count("*").alias("n"), F.count(p).alias("n_tested"), F.count_if(hit & (F.col(effect) > 0)).alias("n_up"), F.count_if(hit & (F.col(effect) < 0)).alias("n_down")
        )

    def save(self, folder: str) -> dict[str, str]:
        """A compressed text table for each contrast, and the record of provenance; paths by name."""
        out = {}
        for name in self.available():
            out[name] = f"{folder.rstrip('/')}/{checks.sanitize_text(name)}.tsv.gz"
            tables.write_tsv_gz(self.contrast(name), out[name])
        if self.provenance is not None:
            out["provenance"] = export_provenance(self.provenance, f"{folder.rstrip('/')}/provenance.json", self.table.sparkSession)
        return out


def export_provenance(made: Envelope, path: str, spark: SparkSession) -> str:
    """The record as canonical JSON through Spark's file system; the path."""
    tables.write_json(made.to_dict(), path, spark)
    return path


def read_provenance(spark: SparkSession, path: str) -> Envelope:
    """What ``export_provenance`` wrote; ProvenanceError if it was changed."""
    return Envelope.from_dict(json.loads("".join(r[0] for r in spark.read.text(path).collect())))


def hash_file(spark: SparkSession, path: str, domain: str) -> HashRecord:
    """Digest of a file's bytes after the domain, read piece by piece through Spark's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    digest = hashlib.sha256(prefix(domain))
    try:
        while piece := bytes(stream.readNBytes(1 << 20)):
            digest.update(piece)
    finally:
        stream.close()
    return HashRecord(digest.hexdigest(), domain, "none", encoding="bytes")


def save_result(result: workflows.Result, folder: str, spark: SparkSession) -> None:
    """All tables as Parquet, and what else a result holds as JSON."""
    for name, df in result.tables.items():
        df.write.parquet(f"{folder}/tables/{name}")
    made = None if result.provenance is None else result.provenance.to_dict()
    tables.write_json({"status": result.status, "diagnostics": result.diagnostics, "provenance": made, "tables": sorted(result.tables)}, f"{folder}/result.json", spark)


def load_result(spark: SparkSession, folder: str) -> workflows.Result:
    """What ``save_result`` wrote."""
    got = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/result.json").collect()))
    made = None if got["provenance"] is None else Envelope.from_dict(got["provenance"])
    return workflows.Result(got["status"], {name: spark.read.parquet(f"{folder}/tables/{name}") for name in got["tables"]}, got["diagnostics"], made)


ANNOTATION_COLUMNS = {"Gene stable ID": "gene_id", "Chromosome/scaffold name": "chromosome", "Gene name": "gene_name", "Gene description": "gene_description"}


def read_gene_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id, gene_name, chromosome, gene_description`` and other columns of a text table with tabs; of rows of one gene the first of the file counts.

    KeyError names the columns that are missing. Null names become empty.
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    if missing := [c for c in ANNOTATION_COLUMNS if c not in raw.columns]:
        raise KeyError(f"gene annotations lack the columns {', '.join(missing)}")
    named = raw.withColumnsRenamed(ANNOTATION_COLUMNS).withColumn("at", F.monotonically_increasing_id()).where("gene_id is not null")
    rest = [c for c in named.columns if c not in ("gene_id", "at")]
    first = named.groupBy("gene_id").agg(F.min_by(F.struct(*rest), "at").alias("of"))
    return first.select("gene_id", "of.*").fillna("", ["gene_name"])


def run_quality_control(spark: SparkSession, counts_path: str, out: str, genes_path: str | None = None, cells_path: str | None = None, **how: Mapping) -> dict[str, str]:
    """Read counts, judge the cells, write the kept counts, the metrics and the summary; paths by name.

    Without tables of genes and cells, those of the counts are taken, a gene's symbol being its id.
    """
    counts = tables.read_counts(spark, counts_path)
    genes = spark.read.parquet(genes_path) if genes_path else counts.select("gene_id", F.col("gene_id").alias("symbol")).distinct()
    cells = spark.read.parquet(cells_path) if cells_path else None
    got = qc.quantify_and_filter(counts, genes, cells, **how)
    out = out.rstrip("/")
    paths = {"counts": f"{out}/filtered_counts", "classified": f"{out}/cells", "summary": f"{out}/summary.json"}
    tables.write_counts(got["counts"], paths["counts"])
    got["classified"].write.parquet(paths["classified"])
    tables.write_json(got["summary"], paths["summary"])
    return paths


def write_pseudobulks(built: Mapping[str, DataFrame], out: str) -> dict[str, str]:
    """Counts of ``pseudobulk.workflow`` as Parquet, and the totals with all proportions as compressed CSV, a pseudobulk in a row; paths by name."""
    out = out.rstrip("/")
    paths = {"counts": f"{out}/pseudobulk_counts.parquet", "metadata": f"{out}/pseudobulk_metadata.csv"}
    built["counts"].write.parquet(paths["counts"])
    meta = built["totals"].withColumn("source_cells", F.to_json("source_cells"))
    for name, df in built.items():
        if name.endswith(("_proportions", "_weights")):
            shares = df.groupBy("pb_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), "proportion"))))).alias(name))
            meta = meta.join(shares, "pb_id", "left")
    meta.write.csv(paths["metadata"], header=True, compression="gzip", quoteAll=True)
    return paths


def run_differential_expression(graph: DataFrame, counts: DataFrame, cells: DataFrame, out: str, gene_sets: DataFrame | None = None, **how: object) -> tuple[Contrasts, Contrasts | None, dict[str, str]]:
    """``workflows.de_pipeline`` with its pseudobulks, a table for each contrast, and the enrichment written; results, enrichment, paths."""
    got = workflows.de_pipeline(graph, counts, cells, gene_sets, **how)
    out = out.rstrip("/")
    paths = write_pseudobulks({k: v for k, v in got.tables.items() if k in ("counts", "totals") or k.endswith(("_proportions", "_weights"))}, out)
    results = Contrasts(tables.checkpointed(got.tables["results"]), got.provenance)
    paths |= {f"summary {k}": v for k, v in results.save(f"{out}/summaries").items()}
    sets = None
    if gene_sets is not None:
        sets = Contrasts(tables.checkpointed(got.tables["enrichment"]), got.provenance)
        paths["enrichment"] = f"{out}/pathways.tsv.gz"
        tables.write_tsv_gz(sets.table, paths["enrichment"])
    return results, sets, paths


@dataclass(frozen=True)
class Communities:
    """A graph, the labels of its nodes, and how they were found."""

    graph: DataFrame
    labels: DataFrame
    found_by: Mapping[str, object]


def graph_and_communities(vectors: DataFrame, k: int | None = None, metric: str = "cosine", symmetrize: str = "none", resolution: float = 1.0, seed: int = 0) -> Communities:
    """The graph of nearest neighbours of vectors (id, vec), and its communities."""
    graph = knn.one_graph(vectors, k, metric=metric)
    if symmetrize != "none":
        graph = knn.symmetric(graph, symmetrize)
    graph = tables.checkpointed(graph)
    return Communities(graph, community.cluster(graph, vectors.select("id"), resolution, seed), community_record(seed, resolution))


def community_record(seed: int | None, resolution: float = 1.0) -> dict[str, object]:
    """What communities depend on, ready for JSON."""
    from cytoquill.plans.provenance import versions

    return {"method": "leiden", "seed": None if seed is None else int(seed), "resolution": float(resolution), "versions": versions()}


def selection_failure(error: Exception, split: str, cells: int, genes: int, alpha: float) -> str:
    """A message that names what was tried, what failed, and what can be done about it."""
    hints = []
    if cells < 3:
        hints.append("correlations need three cells at least: relax quality control, or give the split a larger proportion")
    if genes < 2:
        hints.append("correlations need two genes at least: check that gene ids of counts and annotation agree")
    if "memory" in str(error).lower():
        hints.append("pairs of genes grow with their square: filter genes by counts first")
    hints = hints or ["raise alpha, or run without feature selection"]
    return "\n".join([f"feature selection failed in split {split!r} ({cells} cells, {genes} genes, alpha {alpha})", f"{type(error).__name__}: {error}", *(f"- {h}" for h in hints)])


def selection_record(tables_by_split: Mapping[str, DataFrame], removed: Iterable[str] = ()) -> dict[str, object]:
    """Numbers of genes that each split had and selected, those of all splits, and gene sets that were removed before."""
    counts = {s: df.agg(F.count("*").alias("genes"), F.count_if("selected").alias("selected")).first().asDict() for s, df in tables_by_split.items()}
    common = None
    for df in tables_by_split.values():
        own = df.where("selected").select("gene_id")
        common = own if common is None else common.join(own, "gene_id", "left_semi")
    return {"splits": counts, "selected_in_all": 0 if common is None else common.count(), "removed_sets": sorted(removed)}


#: Rows, and columns, of a heat map that are put in order, at most.
MOST_ORDERED = 2000


def cluster_order(rows: np.ndarray, metric: str = "cosine") -> list[int]:
    """An order of rows in which similar ones are neighbours: the leaves of average linkage, the cluster that was joined first on the left. NaN counts as 0."""
    x = np.nan_to_num(np.asarray(rows, float))
    n = len(x)
    if n > MOST_ORDERED:
        raise ValueError(f"more than {MOST_ORDERED} rows to order")
    if n < 2:
        return list(range(n))
    if metric == "cosine":
        norm = np.sqrt((x**2).sum(1))
        unit = x / np.where(norm > 0, norm, 1)[:, None]
        d = np.maximum(1 - unit @ unit.T, 0)
    elif metric == "euclidean":
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
    else:
        raise ValueError(f"no metric {metric!r}")
    np.fill_diagonal(d, np.inf)
    leaves, size = [[i] for i in range(n)], np.ones(n)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        # The mean distance to the joined cluster is that of both, by their sizes.
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        leaves[i], size[i] = leaves[i] + leaves[j], size[i] + size[j]
    return max(leaves, key=len)


def ordered_heatmap(matrix: DataFrame, contrasts: Sequence[str], metric: str = "cosine") -> tuple[DataFrame, list[str]]:
    """``feeds.heatmap_matrix`` with a column ``place`` of its rows by ``cluster_order``, and the contrasts in their order. At most ``MOST_ORDERED`` rows."""
    got = matrix.limit(MOST_ORDERED + 1).toPandas().sort_values(["library", "pathway"], ignore_index=True)
    values = got[list(contrasts)].to_numpy(float) if len(got) else np.empty((0, len(contrasts)))
    place = np.empty(len(got), int)
    place[cluster_order(values, metric)] = np.arange(len(got))
    places = matrix.sparkSession.createDataFrame([(a, b, int(p)) for a, b, p in zip(got["library"], got["pathway"], place, strict=True)], "library string, pathway string, place int")
    return matrix.join(F.broadcast(places), ["library", "pathway"]), [contrasts[i] for i in cluster_order(values.T, metric)]


@dataclass
class CohortRun:
    """Tables of the samples that came through, a row of status for each sample, and paths."""

    tables: Mapping[str, DataFrame]
    status: DataFrame
    paths: dict[str, str] = field(default_factory=dict)


def run_modules_from_artifacts(rho: DataFrame, cuts: DataFrame, out: str | None = None, **how: object) -> CohortRun:
    """``modules.run_cohort`` over correlation tables (sample, split, gene_a, gene_b, rho; cuts: sample, split, cpos, cneg), samples with faults left out.

    The status of a sample: ``complete``, ``missing_split`` (train or val isn't there), ``missing_cutoffs``, or ``no_positive_edges``.
    With ``out`` all tables and the status are written.
    """
    have = rho.groupBy("sample").agg(F.count_distinct(F.when(F.col("split").isin("train", "val"), F.col("split"))).alias("splits"))
    limits = cuts.where("cpos is not null and cneg is not null").groupBy("sample").agg(F.count_distinct("split").alias("limits"))
    judged = have.join(limits, "sample", "left").select("sample", F.when(F.col("splits") < 2, "missing_split").when(F.coalesce("limits", F.lit(0)) < 2, "missing_cutoffs").alias("fault"))
    judged = tables.checkpointed(judged)
    good = F.broadcast(judged.where("fault is null").select("sample"))  # a row for each sample
    got = modules.run_cohort(tables.checkpointed(rho.join(good, "sample", "left_semi")), cuts.join(good, "sample", "left_semi"), **how)
    got["modules"] = tables.checkpointed(got["modules"])
    some = got["modules"].select("sample").distinct()
    status = judged.join(some.withColumn("found", F.lit(True)), "sample", "left").select("sample", F.coalesce("fault", F.when(F.col("found"), "complete").otherwise("no_positive_edges")).alias("status"))
    run = CohortRun(got, status)
    if out is not None:
        for name, df in {**got, "status": status}.items():
            run.paths[name] = f"{out.rstrip('/')}/{name}"
            df.write.parquet(run.paths[name])
    return run


def read_modules(spark: SparkSession, out: str) -> CohortRun:
    """What ``run_modules_from_artifacts`` wrote."""
    names = ("edges", "positive", "modules", "stats", "antagonism", "replicated", "support", "replicated_antagonism")
    return CohortRun({n: spark.read.parquet(f"{out.rstrip('/')}/{n}") for n in names}, spark.read.parquet(f"{out.rstrip('/')}/status"), {n: f"{out.rstrip('/')}/{n}" for n in (*names, "status")})
