"""Negative-binomial fits of genes for any design, and differential expression from them.

Genes are fitted in Arrow batches; the design and the size factors go to every task. The
driver holds only what is fitted across genes: two numbers of each gene for the trend.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.functions import kernels, special
from cytoquill.operators import checks, nb
from cytoquill.operators.design import Design, FitError, build_design, one_vs_rest, pairwise
from cytoquill.operators.genesets import adjust
from cytoquill.sources.tables import checkpointed

MIN_DISP = 1e-8
_ARRAYS = ("counts", "mu", "hat", "cooks")
FIT_SCHEMA = "gene_id string, base_mean double, disp_genewise double, disp_fit double, disp_map double, dispersion double, outlier_disp boolean, replaced boolean, converged boolean, max_cooks double, cooks_outlier boolean, beta array<double>, counts array<double>, mu array<double>, hat array<double>, cooks array<double>"


@dataclass
class Fit:
    """A fitted experiment: ``genes`` has a row for each gene; trend and prior are driver values."""

    genes: DataFrame
    design: Design
    size: np.ndarray
    trend: Mapping[str, float]
    prior_variance: float
    diagnostics: dict = field(default_factory=dict)


def gene_arrays(counts: DataFrame, design: Design) -> DataFrame:
    """``gene_id, at, n``: sample numbers and counts of each gene; zeros are left out."""
    spark = counts.sparkSession
    numbers = spark.createDataFrame(list(zip(design.samples, range(len(design.samples)), strict=True)), "pb_id string, i int")
    rows = counts.where("n > 0").join(F.broadcast(numbers), "pb_id")  # a row for each sample of the design
    return rows.groupBy("gene_id").agg(F.collect_list("i").alias("at"), F.collect_list("n").alias("n"))


#: Counts of genes times samples that are fitted at once.
MOST_VALUES = 1_000_000


def _few(batches: Iterable[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Batches of as many genes as ``MOST_VALUES`` allow with ``n`` samples, one at least."""
    step = max(1, MOST_VALUES // max(n, 1))
    for pdf in batches:
        for at in range(0, len(pdf), step):
            yield pdf.iloc[at : at + step].reset_index(drop=True)


def _matrix(pdf: pd.DataFrame, n: int) -> np.ndarray:
    y = np.zeros((len(pdf), n))
    for k, (at, c) in enumerate(zip(pdf["at"], pdf["n"], strict=True)):
        y[k, np.asarray(at, int)] = c
    return y


def _genewise(y: np.ndarray, x: np.ndarray, size: np.ndarray, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Dispersion of each gene by itself, and the means that it was found with."""
    q = y / size
    start = np.clip(np.minimum(kernels.rough_dispersion(q, x), kernels.moments_dispersion(q, size)), MIN_DISP, high)
    if len(np.unique(x, axis=0)) == x.shape[1]:
        mu = kernels.linear_mu(y, x, size)
    else:
        mu = np.maximum(kernels.fit_glm(y, x, size, start).mu, kernels.MIN_MU)
    return kernels.fit_alpha(y, mu, x, MIN_DISP, high), mu


def _trend_value(trend: Mapping[str, float], mean: np.ndarray) -> np.ndarray:
    return np.full(len(mean), trend["mean"]) if "mean" in trend else trend["a1"] / np.maximum(mean, 1e-300) + trend["a0"]


def fit_trend(mean: np.ndarray, disp: np.ndarray, kind: str = "parametric") -> dict[str, float]:
    """a1 and a0, or ``mean``: the mean without the lowest and highest thousandth of well-determined genes."""
    if kind == "parametric" and (got := kernels.fit_trend(mean, disp)) is not None and min(got) >= 0:
        return {"a1": got[0], "a0": got[1]}
    use = disp[disp > 10 * MIN_DISP]
    return {"mean": float(kernels.trimmed_mean(use[None], 0.001)[0]) if len(use) else 0.1}


def prior_variance(disp: np.ndarray, fitted: np.ndarray, n: int, p: int) -> float:
    """Squared robust spread of log residuals, less what sampling explains; 0.25 at least."""
    ok = disp >= 100 * MIN_DISP
    r = np.log(disp[ok]) - np.log(fitted[ok])
    if not len(r):
        return 0.25
    spread = np.median(np.abs(r - np.median(r))) / NormalDist().inv_cdf(0.75)
    return max(float(spread**2 - special.trigamma(np.array([(n - p) / 2]))[0]), 0.25)


def fit(counts: DataFrame, design: Design, size_factors: DataFrame | None = None, trend: str = "parametric", refit: bool = True, min_replicates: int = 7) -> Fit:
    """All stages: size factors, gene-wise dispersions, trend, prior, MAP dispersions, coefficients, Cook's distances, and the refit of replaced outliers.

    ``counts``: pb_id, gene_id, n. Genes without counts have no row. Without size factors, ratios
    are taken, or positive counts if every gene has a zero.
    """
    spark, counts = counts.sparkSession, checkpointed(counts)  # read by size factors and fits
    x, n = design.x, len(design.samples)
    p = x.shape[1]
    if n <= p:
        raise FitError("there are no more samples than columns", {"samples": n, "columns": p})
    how = "given"
    if size_factors is None:
        samples = spark.createDataFrame([(s,) for s in design.samples], "pb_id string")
        how = "ratio" if nb.has_common_genes(counts, samples) else "poscounts"
        size_factors = nb.size_factors(counts, samples, how)
    found = {r["pb_id"]: r["size_factor"] for r in size_factors.collect()}  # a row for each sample
    if missing := [s for s in design.samples if s not in found]:
        raise FitError("samples without size factors", {"samples": missing})
    size = np.array([found[s] for s in design.samples])
    high = float(max(10, n))
    arrays = gene_arrays(counts, design).persist()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _few(batches, n):
            y = _matrix(pdf, n)
            yield pd.DataFrame({"gene_id": pdf["gene_id"], "base_mean": (y / size).mean(1), "disp": _genewise(y, x, size, high)[0]})

    rows = arrays.mapInPandas(first, "gene_id string, base_mean double, disp double").toPandas()  # three values for each gene
    if not len(rows):
        raise FitError("No genes remain", {"genes": 0})
    mean, disp = rows["base_mean"].to_numpy(), rows["disp"].to_numpy()
    use = disp >= 100 * MIN_DISP
    curve = fit_trend(mean[use], disp[use], trend) if use.any() else {"mean": max(MIN_DISP, float(disp.mean()))}
    variance = prior_variance(disp, np.maximum(_trend_value(curve, mean), MIN_DISP), n, p)
    known = spark.createDataFrame(rows[["gene_id", "disp"]])
    cells = kernels.design_cells(x)
    reps = np.bincount(cells)[cells]
    cutoff = special.f_ppf(0.99, p, n - p)

    def stages(y: np.ndarray, alpha: np.ndarray, center_mean: np.ndarray) -> tuple[np.ndarray, ...]:
        fitted = np.clip(_trend_value(curve, center_mean), MIN_DISP, high)
        mu = _genewise_mu(y, x, size, high)
        shrunk = kernels.fit_alpha(y, mu, x, MIN_DISP, high, fitted, variance)
        apart = np.log(alpha) > np.log(fitted) + 2 * np.sqrt(variance)
        final = np.where(apart, alpha, shrunk)
        return fitted, shrunk, apart, final, kernels.fit_glm(y, x, size, final)

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _few(batches, n):
            y = _matrix(pdf, n)
            alpha, base = pdf["disp"].to_numpy(float).copy(), (y / size).mean(1)
            fitted, shrunk, apart, final, glm = (list(v) if isinstance(v, tuple) and not hasattr(v, "beta") else v for v in stages(y, alpha, base))
            beta, mu, hat, ok = (v.copy() for v in glm)
            distance = np.nan_to_num(kernels.cooks(y, mu, hat, kernels.robust_dispersion(y / size, x), p))
            among = np.where(reps >= 3, distance, -1)
            at = among.argmax(1)
            top = among[np.arange(len(y)), at]
            outlier = (top > cutoff) & ((y > y[np.arange(len(y)), at][:, None]).sum(1) < 3)
            replaced = np.zeros(len(y), bool)
            if refit:
                swap = (distance > cutoff) & (reps >= min_replicates)
                replaced = swap.any(1)
                if replaced.any():
                    new = y.copy()
                    middle = kernels.trimmed_mean(y / size, 0.2)
                    new[swap] = (middle[:, None] * size).astype(np.int64)[swap]
                    i = np.flatnonzero(replaced)
                    live = new[i].sum(1) > 0
                    j = i[live]
                    alpha[j] = _genewise(new[j], x, size, high)[0]
                    base[i] = (new[i] / size).mean(1)
                    f2, s2, a2, d2, g2 = stages(new[j], alpha[j], base[j])
                    fitted[j], shrunk[j], apart[j], final[j] = f2, s2, a2, d2
                    beta[j], mu[j], hat[j], ok[j] = g2
                    dead = i[~live]
                    beta[dead], mu[dead] = 0.0, 0.0
                    # What was replaced no longer counts as an outlier.
                    left = np.where((reps >= 3) & ~swap, distance, -1)
                    outlier[i] = left[i].max(1) > cutoff
            yield pd.DataFrame({
                "gene_id": pdf["gene_id"], "base_mean": base, "disp_genewise": alpha, "disp_fit": fitted, "disp_map": shrunk, "dispersion": final, "outlier_disp": apart, "replaced": replaced,
                "converged": ok, "max_cooks": top, "cooks_outlier": outlier, "beta": list(beta), "counts": list(y), "mu": list(mu), "hat": list(hat), "cooks": list(distance),
            })

    genes = arrays.join(known, "gene_id").mapInPandas(second, FIT_SCHEMA).persist()
    counted = genes.agg(F.count("*").alias("genes"), F.count_if(~F.col("converged")).alias("not_converged"), F.count_if("replaced").alias("replaced"), F.count_if("outlier_disp").alias("dispersion_outliers")).first()
    arrays.unpersist()
    return Fit(genes, design, size, curve, variance, {**counted.asDict(), "size_factors": how, "trend": dict(curve), "prior_variance": variance, "cooks_cutoff": cutoff})


def _genewise_mu(y: np.ndarray, x: np.ndarray, size: np.ndarray, high: float) -> np.ndarray:
    if len(np.unique(x, axis=0)) == x.shape[1]:
        return kernels.linear_mu(y, x, size)
    q = y / size
    start = np.clip(np.minimum(kernels.rough_dispersion(q, x), kernels.moments_dispersion(q, size)), MIN_DISP, high)
    return np.maximum(kernels.fit_glm(y, x, size, start).mu, kernels.MIN_MU)


def iterative_size_factors(counts: DataFrame, design: Design, rounds: int = 10, share: float = 0.95) -> DataFrame:
    """``pb_id, size_factor`` that maximise the likelihood in turn with dispersions, for data in which every gene has a zero.

    Genes of the highest dispersions (above the quantile ``share``) don't count; factors have
    geometric mean 1. The likelihood of a sample's factor is concave in its logarithm, so a few
    Newton steps find it, within 1.5 of the last one: each is a pass over the genes, from which
    two sums for each sample come to the driver.
    """
    spark, n, x = counts.sparkSession, len(design.samples), design.x
    high = float(max(10, n))
    arrays = checkpointed(gene_arrays(counts, design))
    size = np.ones(n)
    for _ in range(rounds):
        now = size

        def fits(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            for pdf in _few(batches, n):
                y = _matrix(pdf, n)
                alpha, mu = _genewise(y, x, now, high)
                yield pd.DataFrame({"alpha": alpha, "y": list(y), "q": list(mu / now)})

        genes = checkpointed(arrays.mapInPandas(fits, "alpha double, y array<double>, q array<double>"))
        limit = genes.agg(F.percentile("alpha", F.lit(share))).first()[0]
        if limit is None:
            break
        used = genes.where(F.col("alpha") <= limit)
        t = np.log(size)
        low, most = t - 1.5, t + 1.5
        for _ in range(30):
            here = t

            def slopes(batches: Iterator[pd.DataFrame], here: np.ndarray = here) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if len(pdf):
                        y, inv = np.stack(pdf["y"].to_numpy()), 1 / pdf["alpha"].to_numpy()[:, None]
                        m = np.maximum(np.stack(pdf["q"].to_numpy()) * np.exp(here), 1e-300)
                        yield pd.DataFrame({"i": np.arange(n), "up": (y - (y + inv) * m / (m + inv)).sum(0), "bend": ((y + inv) * m * inv / (m + inv) ** 2).sum(0)})

            sums = used.mapInPandas(slopes, "i int, up double, bend double").groupBy("i").agg(F.sum("up").alias("up"), F.sum("bend").alias("bend")).orderBy("i").toPandas()  # a row for each sample
            new = np.clip(t + np.clip(sums["up"].to_numpy() / np.maximum(sums["bend"].to_numpy(), 1e-12), -1, 1), low, most)
            done = np.abs(new - t).max() < 1e-9
            t = new
            if done:
                break
        before, size = size, np.exp(t - t.mean())
        if np.abs(np.log(size / before)).max() < 1e-4:
            break
    return spark.createDataFrame(list(zip(design.samples, size.tolist(), strict=True)), "pb_id string, size_factor double")


def vst(counts: DataFrame, samples: DataFrame, formula: str = "~ 1", trend: str = "parametric") -> tuple[DataFrame, Mapping[str, float]]:
    """``gene_id, pb_id, value`` of variance-stabilised counts, and the trend of dispersions that they were stabilised with."""
    counts = checkpointed(counts)
    design = build_design(samples, formula)
    fitted = fit(counts, design, trend=trend, refit=False)
    factors = counts.sparkSession.createDataFrame(list(zip(design.samples, fitted.size.tolist(), strict=True)), "pb_id string, size_factor double")
    q = nb.normed(nb.grid(counts, samples), factors)
    t = fitted.trend
    return (nb.vst(q, 0.0, 0.0, t["mean"]) if "mean" in t else nb.vst(q, t["a1"], t["a0"])), t


RESULT_SCHEMA = "gene_id string, contrast string, baseMean double, log2FoldChange double, lfcSE double, stat double, pvalue double, cooks_outlier boolean"


def test(fitted: Fit, contrasts: Mapping[str, np.ndarray], null: float = 0.0, alternative: str | None = None, cooks_filter: bool = True) -> DataFrame:
    """Wald tests of all contrasts in one pass over the genes; effects in log2, p null for Cook's outliers. ``null`` is in log2."""
    x, ln2 = fitted.design.x, np.log(2)
    vectors = {k: np.asarray(v, float) for k, v in contrasts.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _few(batches, len(x)):
            beta, mu = np.stack(pdf["beta"].to_numpy()), np.stack(pdf["mu"].to_numpy())
            alpha, empty = pdf["dispersion"].to_numpy(float), ~np.stack(pdf["mu"].to_numpy()).any(1)
            for name, c in vectors.items():
                effect, se, stat, p = kernels.wald(beta, np.maximum(mu, 1e-12), x, alpha, c, null * ln2, alternative)
                stat, p = np.where(empty, 0.0, stat), np.where(empty, 1.0, p)
                if cooks_filter:
                    p = np.where(pdf["cooks_outlier"], np.nan, p)
                ps = pd.Series(p).astype(object).where(~np.isnan(p), None)
                yield pd.DataFrame({"gene_id": pdf["gene_id"].to_numpy(), "contrast": name, "baseMean": pdf["base_mean"].to_numpy(), "log2FoldChange": effect / ln2, "lfcSE": se / ln2, "stat": stat, "pvalue": ps, "cooks_outlier": pdf["cooks_outlier"].to_numpy()})

    return fitted.genes.select("gene_id", "base_mean", "dispersion", "cooks_outlier", "beta", "mu").mapInPandas(run, RESULT_SCHEMA)


def independent_filter(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adjusted p of one contrast, null under the mean cut-off that gives most rejections (smoothed); without more than 10 rejections no cut."""
    found = nb.filter_counts(results, alpha).orderBy("j").toPandas()  # 50 rows
    r, theta = found["rejections"].to_numpy(float), found["theta"].to_numpy()
    j = 0
    if r.max() > 10:
        smooth = kernels.lowess(theta, r, 0.2)
        some = r > 0
        limit = smooth.max() - np.sqrt(((r - smooth)[some] ** 2).mean())
        j = int(np.argmax(r > limit)) if (r > limit).any() else 0
    cut = float(found["cutoff"].iloc[j])
    inside = results.withColumn("_p", F.when(F.col("baseMean") >= cut, F.col("pvalue")))
    return adjust(inside, "_p", ("contrast",), ("gene_id",), "padj").drop("_p")


def summarize(fitted: Fit, contrasts: Mapping[str, np.ndarray], alpha: float = 0.05, filtering: bool = True, **how: object) -> DataFrame:
    """Results of all contrasts with adjusted p: within each contrast, with independent filtering if wanted."""
    tested = test(fitted, contrasts, **how).persist()
    if not filtering:
        return adjust(tested, "pvalue", ("contrast",), ("gene_id",), "padj")
    out = None
    for name in contrasts:
        one = independent_filter(tested.where(F.col("contrast") == name), alpha)
        out = one if out is None else out.unionByName(one)
    return out


def shrink(fitted: Fit, column: str, alpha: float = 0.05) -> DataFrame:
    """``gene_id, log2FoldChange, lfcSE, converged`` of one coefficient with a Cauchy prior whose scale comes from the data."""
    d, x, size, ln2 = fitted.design, fitted.design.x, fitted.size, np.log(2)
    index = d.column(column)
    c = np.zeros(x.shape[1])
    c[index] = 1.0
    rows = test(fitted, {column: c}, cooks_filter=False).select("log2FoldChange", "lfcSE").toPandas()  # two numbers for each gene
    scale = prior_scale(rows["log2FoldChange"].to_numpy() * ln2, rows["lfcSE"].to_numpy() * ln2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _few(batches, len(x)):
            if len(pdf):
                b, se, ok = kernels.shrink(np.stack(pdf["counts"].to_numpy()), x, size, pdf["dispersion"].to_numpy(float), np.stack(pdf["beta"].to_numpy()), index, scale)
                yield pd.DataFrame({"gene_id": pdf["gene_id"].to_numpy(), "log2FoldChange": b[:, index] / ln2, "lfcSE": se / ln2, "converged": ok})

    return fitted.genes.select("gene_id", "dispersion", "beta", "counts").mapInPandas(run, "gene_id string, log2FoldChange double, lfcSE double, converged boolean")


def prior_scale(effect: np.ndarray, se: np.ndarray, low: float = 1e-6, high: float = 400.0) -> float:
    """Root of the variance that explains the effects beyond their errors, by bisection within bounds."""
    ok = np.isfinite(effect) & np.isfinite(se) & (se > 0)
    s, v = effect[ok] ** 2, se[ok] ** 2
    if not len(s):
        return 1.0
    excess = lambda a: ((s - v) / (2 * (a + v) ** 2)).sum() / (1 / (2 * (a + v) ** 2)).sum() - a
    if excess(low) < 0:
        return low**0.5
    a, b = low, high
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if excess(m) > 0 else (a, m)
    return ((a + b) / 2) ** 0.5


def prepare(counts: DataFrame, samples: DataFrame, formula: str, min_counts: float = 10.0, min_variance: float = 0.0, genes: DataFrame | None = None) -> tuple[DataFrame, Design]:
    """Filtered counts and the design; FitError if no gene remains."""
    counts = checkpointed(counts)
    kept = checks.gene_filter(counts, samples, min_counts, min_variance).select("gene_id")
    if genes is not None:
        kept = kept.join(genes.select("gene_id"), "gene_id", "left_semi")
    if kept.first() is None:
        raise FitError("No genes remain", {"min_counts": min_counts, "min_variance": min_variance})
    return counts.join(kept, "gene_id", "left_semi"), build_design(samples, formula)


def cluster_vs_rest(fitted: Fit, columns: Sequence[str] | None = None, **how: object) -> DataFrame:
    """Each column against the mean of the others."""
    columns = list(columns or fitted.design.columns)
    out = {}
    for name, v in one_vs_rest(columns).items():
        c = np.zeros(len(fitted.design.columns))
        c[[fitted.design.column(k) for k in columns]] = v
        out[name] = c
    return summarize(fitted, out, **how)


def pairwise_de(fitted: Fit, pairs: Sequence[tuple[str, str]] | None = None, **how: object) -> DataFrame:
    return summarize(fitted, pairwise(fitted.design, pairs), **how)


def workflow(counts: DataFrame, samples: DataFrame, formula: str, min_counts: float = 5.0, **how: object) -> tuple[Fit, DataFrame]:
    """Filter, design, fit, and each column of the design against the rest."""
    kept, design = prepare(counts, samples, formula, min_counts)
    fitted = fit(kept, design)
    return fitted, cluster_vs_rest(fitted, **how)
