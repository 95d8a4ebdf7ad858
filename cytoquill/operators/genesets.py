"""Gene-set enrichment: one-sample t statistics of members, adjusted within contrast and library."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType

from cytoquill.functions import special
from cytoquill.sources.tables import checkpointed


#: Spans of p to each power of two.
SPANS = 64


def _alike(a: DataFrame, b: DataFrame, keys: Sequence[str], on: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` where ``keys``, which may be null, and ``on`` are equal; the columns of ``b`` that aren't among them are added."""
    b = b.withColumnsRenamed({c: f"_b_{c}" for c in (*keys, *on)})
    same = [a[c].eqNullSafe(b[f"_b_{c}"]) for c in keys] + [a[c] == b[f"_b_{c}"] for c in on]
    return a.join(b, same, how).drop(*[f"_b_{c}" for c in (*keys, *on)])


def adjust(df: DataFrame, p: str, by: Sequence[str], tie: Sequence[str] = (), name: str = "padj") -> DataFrame:
    """``df`` with Benjamini-Hochberg adjusted p over the groups ``by``.

    Nulls stay out of the count and stay null. Equal p have one adjusted p, that of the last of them,
    whatever their order (``tie``), so ranks are taken of a group's different p only. These lie in
    spans of p, each a window of its own; what a whole group puts in order is a row for each span.
    """
    rows, by = checkpointed(df), list(by)
    span = F.coalesce(F.floor(F.log2(F.col("_p").cast("double")) * SPANS), F.lit(-(1 << 20)))
    span = F.when(F.isnan(F.col("_p").cast("double")), F.lit(1 << 20)).otherwise(span)
    each = rows.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_c")).withColumn("_s", span)
    up, down = (Window.partitionBy(*by, "_s").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("_p"), F.desc("_p")))
    whole = Window.partitionBy(*by)
    before = each.groupBy(*by, "_s").agg(F.sum("_c").alias("_n"))
    before = before.select(*by, "_s", (F.sum("_n").over(whole.orderBy("_s")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_m"))
    raw = _alike(each.withColumn("_r", F.sum("_c").over(up)), before, by, ["_s"]).withColumn("_raw", F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_r")))
    after = raw.groupBy(*by, "_s").agg(F.min("_raw").alias("_low"))
    after = after.select(*by, "_s", F.min("_low").over(whole.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    low = _alike(raw.select(*by, "_s", "_p", F.min("_raw").over(down).alias("_low")), after, by, ["_s"])
    found = low.select(*by, F.col("_p").alias(p), F.least(F.lit(1.0), "_low", "_after").alias(name))
    return _alike(rows, found, by, [p], "left")


@F.pandas_udf(DoubleType())
def t_two_sided(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two-sided p of a t statistic with the given degrees of freedom; null for null."""
    for t, df in batches:
        p = pd.Series(special.t_two_sided(t.astype(float), df.astype(float)))
        yield p.where(p.notna(), None)


def prepared(de: DataFrame, gene: str = "gene", stat: str = "stat", pvalue: str = "pvalue", by: str = "contrast") -> DataFrame:
    """``contrast, gene, stat, pvalue`` without null genes, statistics or p; NaN counts as null; repeated genes stay."""
    num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return de.select(F.col(by).alias("contrast"), F.col(gene).cast("string").alias("gene"), num(stat).alias("stat"), num(pvalue).alias("pvalue")).dropna(subset=["gene", "stat", "pvalue"])


def statistics(de: DataFrame, sets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A row for each contrast, library and pathway: ``size, n, mean_t, enrichment_t, nom_sig_genes``.

    ``de``: as ``prepared``; ``sets``: library, pathway, genes. size is the length of the reference
    set; t needs three members and a spread. Significant genes have p < alpha and t's sign, those
    farthest from 0 first.
    """
    sets = sets.select("library", "pathway", F.size("genes").alias("size"), "genes")
    members = sets.select("library", "pathway", F.explode("genes").alias("gene"))
    s = de.join(members, "gene").groupBy("contrast", "library", "pathway").agg(
        F.count("stat").alias("n"), F.avg("stat").alias("mean_t"), F.stddev_samp("stat").alias("sd"),
        F.array_sort(F.collect_list(F.when((F.col("pvalue") < alpha) & (F.col("stat") > 0), F.struct((-F.col("stat")).alias("o"), "gene")))).alias("up"),
        F.array_sort(F.collect_list(F.when((F.col("pvalue") < alpha) & (F.col("stat") < 0), F.struct(F.col("stat").alias("o"), "gene")))).alias("down"),
    )
    t = F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("mean_t") / (F.col("sd") / F.sqrt("n")))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["gene"]), ",")
    grid = de.select("contrast").distinct().join(sets.drop("genes"), how="cross")  # the result: contrasts times pathways
    out = grid.join(s.withColumn("t", t), ["contrast", "library", "pathway"], "left")
    genes = F.when(F.col("t") > 0, names("up")).when(F.col("t") < 0, names("down")).otherwise("")
    return out.select("contrast", "library", "pathway", "size", F.coalesce("n", F.lit(0)).alias("n"), "mean_t", F.col("t").alias("enrichment_t"), genes.alias("nom_sig_genes"))


def enrich(de: DataFrame, sets: DataFrame, alpha: float = 0.05, sources: Mapping[str, str] | None = None) -> DataFrame:
    """``statistics`` with ``code, source, p, BH_adj_p, signed_neglog10_BH``; pathways without p get an adjusted p of 1."""
    s = statistics(de, sets, alpha).withColumn("p", t_two_sided(F.col("enrichment_t"), (F.col("n") - 1).cast("double")))
    s = adjust(s, "p", ("contrast", "library"), ("pathway",), "BH_adj_p").withColumn("BH_adj_p", F.coalesce("BH_adj_p", F.lit(1.0)))
    prefix = F.substring_index("library", ".", 1)
    source = F.lit("NA")
    for k, v in (sources or {}).items():
        source = F.when(prefix == k, v).otherwise(source)
    signed = -F.log10(F.greatest("BH_adj_p", F.lit(1e-300))) * F.when(F.col("enrichment_t") < 0, -1.0).otherwise(1.0)
    return s.select("contrast", "library", F.col("library").alias("code"), source.alias("source"), "pathway", "size", "mean_t", "enrichment_t", "p", "BH_adj_p", signed.alias("signed_neglog10_BH"), "nom_sig_genes")


def enrich_by_columns(de: DataFrame, sets: DataFrame, stat_by_contrast: Mapping[str, str], alpha: float = 0.05) -> DataFrame:
    """As ``enrich``, with the statistic's column named for each contrast; all contrasts must be named, no others."""
    # As many names as are given, and one more, tell whether they are the same.
    found = {r[0] for r in de.select("contrast").distinct().limit(len(stat_by_contrast) + 1).collect()}
    if found != set(stat_by_contrast):
        raise ValueError(f"statistics are needed for exactly the contrasts of the table, which include {', '.join(sorted(map(str, found)))}")
    stat = None
    for k, c in stat_by_contrast.items():
        stat = F.when(F.col("contrast") == k, F.col(c)) if stat is None else stat.when(F.col("contrast") == k, F.col(c))
    return enrich(prepared(de.withColumn("_stat", stat), stat="_stat"), sets, alpha)
