"""Size factors, and closed forms of negative-binomial quantities for one-hot designs: DataFrame operations only.

A grid has a row for each gene and sample, zeros too: ``gene_id, pb_id, n``; experiments have
tens to thousands of samples, so it is as wide as counts with their zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RIDGE, MIN_MU = 1e-6, 0.5


def grid(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Every gene of ``counts`` in every sample of ``samples``."""
    every = counts.select("gene_id").distinct().join(samples.select("pb_id").distinct(), how="cross")  # the dense result
    return every.join(counts.select("gene_id", "pb_id", "n"), ["gene_id", "pb_id"], "left").select("gene_id", "pb_id", F.coalesce("n", F.lit(0)).alias("n"))


def size_factors(counts: DataFrame, samples: DataFrame, how: str = "ratio", control: DataFrame | None = None) -> DataFrame:
    """``pb_id, size_factor`` by medians of ratios to geometric means.

    ``ratio``: over genes with counts in every sample, not rescaled; without any such gene no row
    comes out (see ``has_common_genes``). ``poscounts``: zeros add 0 to log means, genes with a
    positive log mean count, medians are over positive counts, and the factors' geometric mean is 1.
    ``control``: genes (gene_id) to restrict to.
    """
    if how not in ("ratio", "poscounts"):
        raise ValueError(f"no size factors {how!r}")
    c = counts.where("n > 0") if control is None else counts.where("n > 0").join(control.select("gene_id"), "gene_id", "left_semi")
    k = F.broadcast(samples.select("pb_id").distinct().agg(F.count("*").alias("k")))  # one row
    means = c.groupBy("gene_id").agg(F.sum(F.log("n")).alias("s"), F.count("*").alias("c")).join(k, how="cross")
    means = means.select("gene_id", (F.col("s") / F.col("k")).alias("m"), "c", "k").where("c = k" if how == "ratio" else "m > 0")
    out = c.join(means, "gene_id").groupBy("pb_id").agg(F.median(F.log("n") - F.col("m")).alias("l"))
    if how == "ratio":
        return out.select("pb_id", F.exp("l").alias("size_factor"))
    center = F.broadcast(out.agg(F.avg("l").alias("a")))  # one row
    return out.join(center, how="cross").select("pb_id", F.exp(F.col("l") - F.col("a")).alias("size_factor"))


def norm_fit(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """``gene_id, m``: log means of the genes with counts in every sample, to take ratios of other samples to."""
    k = F.broadcast(samples.select("pb_id").distinct().agg(F.count("*").alias("k")))  # one row
    means = counts.where("n > 0").groupBy("gene_id").agg(F.avg(F.log("n")).alias("m"), F.count("*").alias("c"))
    return means.join(k, how="cross").where("c = k").select("gene_id", "m")


def norm_transform(counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """``pb_id, gene_id, n, size_factor, q`` of any samples, by the log means of ``norm_fit``."""
    c = counts.where("n > 0").join(fitted, "gene_id").groupBy("pb_id").agg(F.exp(F.median(F.log("n") - F.col("m"))).alias("size_factor"))
    return counts.join(c, "pb_id").select("pb_id", "gene_id", "n", "size_factor", (F.col("n") / F.col("size_factor")).alias("q"))


def has_common_genes(counts: DataFrame, samples: DataFrame) -> bool:
    """Some gene has counts in every sample, so that ratios can be taken."""
    k = samples.select("pb_id").distinct().count()
    return counts.where("n > 0").groupBy("gene_id").agg(F.count_distinct("pb_id").alias("c")).where(F.col("c") == k).first() is not None


def normed(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """``gene_id, pb_id, n, s, q``: counts, size factor, and their ratio."""
    return counts.join(factors, "pb_id").select("gene_id", "pb_id", "n", F.col("size_factor").alias("s"), (F.col("n") / F.col("size_factor")).alias("q"))


def with_group(q: DataFrame, groups: DataFrame) -> DataFrame:
    """Normalised counts with the level of a one-hot design (pb_id, grp)."""
    return q.join(groups, "pb_id")


def linear_mu(q: DataFrame) -> DataFrame:
    """``gene_id, pb_id, mu``: group means times size factors, 0.5 at least."""
    m = F.avg("q").over(Window.partitionBy("gene_id", "grp"))
    return q.select("gene_id", "pb_id", F.greatest(F.lit(MIN_MU), F.col("s") * m).alias("mu"))


def rough_dispersion(q: DataFrame) -> DataFrame:
    """``gene_id, dispersion`` from squared deviations of group means; 0 at least."""
    m = F.greatest(F.lit(1.0), F.avg("q").over(Window.partitionBy("gene_id", "grp")))
    d = q.select("gene_id", "grp", ((((F.col("q") - m) * (F.col("q") - m)) - m) / (m * m)).alias("d"))
    out = d.groupBy("gene_id").agg(F.sum("d").alias("d"), (F.count("*") - F.count_distinct("grp")).alias("df"))
    return out.select("gene_id", F.greatest(F.lit(0.0), F.try_divide("d", F.col("df"))).alias("dispersion"))


def moments_dispersion(q: DataFrame) -> DataFrame:
    """``gene_id, dispersion``: (variance - mean of 1/s times mean) / mean squared; 0 for genes without counts."""
    m = F.avg("q")
    out = q.groupBy("gene_id").agg(F.try_divide(F.var_samp("q") - F.avg(1 / F.col("s")) * m, m * m).alias("d"))
    return out.select("gene_id", F.coalesce("d", F.lit(0.0)).alias("dispersion"))


def start_dispersion(q: DataFrame, low: float = 1e-8, high: float = 10.0) -> DataFrame:
    """The smaller of both estimates, within bounds."""
    a, b = rough_dispersion(q), moments_dispersion(q).withColumnRenamed("dispersion", "m")
    return a.join(b, "gene_id").select("gene_id", F.least(F.greatest(F.least("dispersion", "m"), F.lit(low)), F.lit(high)).alias("dispersion"))


def _trimmed(df: DataFrame, value: str, by: list[str], trim: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*by)
    k = F.floor(F.count("*").over(w) * trim)
    r = F.row_number().over(w.orderBy(value, "pb_id"))
    return df.withColumn("_r", r).withColumn("_k", k).withColumn("_n", F.count("*").over(w)).withColumn(name, F.avg(F.when((F.col("_r") > F.col("_k")) & (F.col("_r") <= F.col("_n") - F.col("_k")), F.col(value))).over(w)).drop("_r", "_k", "_n")


def trimmed_variance(q: DataFrame) -> DataFrame:
    """``gene_id, variance``: the largest over groups of three replicates or more of trimmed squared deviations from trimmed means."""
    size = F.count("*").over(Window.partitionBy("gene_id", "grp"))
    df = q.select("gene_id", "pb_id", "grp", "q", size.alias("size")).where("size >= 3")
    trim = F.when(F.col("size") < 3.5, 1 / 3).when(F.col("size") < 23.5, 1 / 4).otherwise(1 / 8)
    scale = F.when(F.col("size") < 3.5, 2.04).when(F.col("size") < 23.5, 1.86).otherwise(1.51)
    df = _trimmed(df, "q", ["gene_id", "grp"], trim, "m").withColumn("d", (F.col("q") - F.col("m")) * (F.col("q") - F.col("m")))
    df = _trimmed(df, "d", ["gene_id", "grp"], trim, "v").withColumn("v", F.col("v") * scale)
    return df.groupBy("gene_id").agg(F.max("v").alias("variance"))


def robust_dispersion(q: DataFrame) -> DataFrame:
    """``gene_id, dispersion`` from the trimmed variance and the mean over all samples; 0.04 at least."""
    m = q.groupBy("gene_id").agg(F.avg("q").alias("m"))
    d = F.try_divide(F.col("variance") - F.col("m"), F.col("m") * F.col("m"))
    return trimmed_variance(q).join(m, "gene_id").select("gene_id", F.greatest(F.coalesce(d, F.lit(0.04)), F.lit(0.04)).alias("dispersion"))


def replicates(groups: DataFrame) -> DataFrame:
    """``pb_id, replicates``: samples of the same design row."""
    return groups.select("pb_id", F.count("*").over(Window.partitionBy("grp")).alias("replicates"))


def leverage(mu: DataFrame) -> DataFrame:
    """``gene_id, pb_id, hat`` of ``mu`` (gene_id, pb_id, grp, mu, alpha): each weight's share of its group."""
    m = F.greatest(F.lit(MIN_MU), F.col("mu"))
    w = m / (1 + F.col("alpha") * m)
    df = mu.withColumn("w", w)
    return df.select("gene_id", "pb_id", (F.col("w") / (F.sum("w").over(Window.partitionBy("gene_id", "grp")) + RIDGE)).alias("hat"))


def cooks(df: DataFrame, p: int) -> DataFrame:
    """``gene_id, pb_id, cooks`` of ``df`` (gene_id, pb_id, n, mu, hat, alpha: the robust dispersion)."""
    r = (F.col("n") - F.col("mu")) * (F.col("n") - F.col("mu")) / (F.col("mu") + F.col("alpha") * F.col("mu") * F.col("mu"))
    return df.select("gene_id", "pb_id", (r / p * F.col("hat") / ((1 - F.col("hat")) * (1 - F.col("hat")))).alias("cooks"))


def cooks_outliers(df: DataFrame, cutoff: float) -> DataFrame:
    """``gene_id, outlier`` of ``df`` (gene_id, pb_id, n, cooks, replicates): above the cut-off among samples of three replicates or more, unless three samples have more counts than the one of the largest distance."""
    some = df.where("replicates >= 3").groupBy("gene_id").agg(F.max("cooks").alias("c"), F.max_by("n", F.struct("cooks", "pb_id")).alias("at"))
    more = df.join(some, "gene_id").groupBy("gene_id").agg(F.first("c").alias("c"), F.count_if(F.col("n") > F.col("at")).alias("more"))
    return more.select("gene_id", ((F.col("c") > cutoff) & (F.col("more") < 3)).alias("outlier"))


def wald(mu: DataFrame, contrast: DataFrame) -> DataFrame:
    """``gene_id, effect, se, stat`` of ``mu`` (gene_id, pb_id, grp, mu, alpha, beta) for weights (grp, c), in natural logs."""
    w = F.col("mu") / (1 + F.col("alpha") * F.col("mu"))
    g = mu.groupBy("gene_id", "grp").agg(F.sum(w).alias("m"), F.first("beta").alias("beta")).join(F.broadcast(contrast), "grp")  # a row for each level
    s = g.groupBy("gene_id").agg(F.sum(F.col("c") * F.col("beta")).alias("effect"), F.sqrt(F.sum(F.col("c") * F.col("c") * F.col("m") / ((F.col("m") + RIDGE) * (F.col("m") + RIDGE)))).alias("se"))
    return s.select("gene_id", "effect", "se", F.try_divide("effect", "se").alias("stat"))


def vst(q: DataFrame, a1: float, a0: float, alpha: float | None = None) -> DataFrame:
    """``gene_id, pb_id, value``: variance-stabilised log2 values under a parametric trend a1 / mu + a0, or one dispersion ``alpha``."""
    x = F.col("q")
    if alpha is not None:
        v = (2 * F.asinh(F.sqrt(alpha * x)) - F.log(F.lit(alpha)) - F.log(F.lit(4.0))) / F.log(F.lit(2.0))
    else:
        v = F.log2((1 + a1 + 2 * a0 * x + 2 * F.sqrt(a0 * x * (1 + a1 + a0 * x))) / (4 * a0))
    return q.select("gene_id", "pb_id", v.alias("value"))


def filter_counts(results: DataFrame, alpha: float = 0.05, points: int = 50) -> DataFrame:
    """``j, theta, cutoff, rejections``: genes with an adjusted p under ``alpha`` among those at or above each of ``points`` mean cut-offs.

    ``results``: gene_id, baseMean, pvalue. Thetas run from the share of genes without counts to
    0.95 (1 if that share is 0.95 or more); cut-offs are exact quantiles.
    """
    zero = F.avg((F.col("baseMean") == 0).cast("double"))
    span = results.agg(zero.alias("low"), F.array_sort(F.collect_list("baseMean")).alias("means"))  # a number for each gene
    step = (F.when(F.col("low") < 0.95, 0.95).otherwise(1.0) - F.col("low")) / (points - 1)
    th = span.select("means", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"), "low", step.alias("step")).select("j", (F.col("low") + F.col("j") * F.col("step")).alias("theta"), "means")
    at = F.col("theta") * (F.size("means") - 1)
    i = F.least(F.floor(at), F.size("means") - 1).cast("int")
    value = lambda k: F.get("means", F.least(k, F.size("means") - 1))
    cuts = th.select("j", "theta", (value(i) + (value(i + 1) - value(i)) * (at - i)).alias("cutoff"))
    rows = results.where("pvalue is not null").select("gene_id", "baseMean", "pvalue").join(F.broadcast(cuts), F.col("baseMean") >= F.col("cutoff"))  # ``points`` rows
    per = Window.partitionBy("j")
    ranked = rows.select("j", "pvalue", F.row_number().over(per.orderBy("pvalue", "gene_id")).alias("r"), F.count("*").over(per).alias("m"))
    # Adjusted p under alpha: all p up to the last rank with p * m / rank under alpha.
    last = ranked.where(F.col("pvalue") * F.col("m") / F.col("r") < alpha).groupBy("j").agg(F.max("r").alias("rejections"))
    return cuts.join(last, "j", "left").select("j", "theta", "cutoff", F.coalesce("rejections", F.lit(0)).alias("rejections"))
