import random
import re

import numpy as np
import pytest

from cytoquill.operators import checks, community, compat, consensus, decompose, design, feeds, genesets, knn, modules, nb, nbfit, normalize, pseudobulk, qc, split
from cytoquill.plans import provenance
from cytoquill.sources import tables


def long(spark, matrix, cells=None, genes=None):
    m = np.asarray(matrix)
    cells = cells or [f"c{i}" for i in range(m.shape[0])]
    genes = genes or [f"g{j}" for j in range(m.shape[1])]
    rows = [(cells[i], genes[j], int(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]]
    return spark.createDataFrame(rows, "cell_id string, gene_id string, n long")


def test_split_conserves_and_ignores_order(spark):
    c = long(spark, np.arange(24).reshape(6, 4))
    s = split.split_counts(c, (0.25, 0.75), 19, ("train", "val"))
    assert split.conservation(c, s).count() == 0
    again = split.split_counts(c.repartition(7), (0.25, 0.75), 19, ("train", "val"))
    assert sorted(s.collect()) == sorted(again.collect())
    assert sorted(s.collect()) != sorted(split.split_counts(c, (0.25, 0.75), 20, ("train", "val")).collect())


@pytest.mark.parametrize("n", [1.5, float("nan"), -1.0, None])
def test_split_rejects_bad_counts(spark, n):
    c = spark.createDataFrame([("a", "g", n)], "cell_id string, gene_id string, n double")
    with pytest.raises(split.CountSplitError):
        split.split_counts(c)


def test_split_rejects_bad_proportions(spark):
    with pytest.raises(split.CountSplitError):
        split.split_counts(long(spark, [[1]]), (0.3, 0.3))


def test_normalizer_names(spark):
    with pytest.raises(KeyError, match="pf_log"):
        normalize.normalize(long(spark, [[1]]), "none")
    cells = spark.createDataFrame([("c0",), ("c1",), ("empty",)], "cell_id string")
    got = {tuple(r)[:2]: r["value"] for r in normalize.pf(long(spark, [[2, 2], [0, 8]]), cells).collect()}
    assert got == {("c0", "g0"): 2.0, ("c0", "g1"): 2.0, ("c1", "g1"): 4.0}  # the mean of 4, 8 and 0 is 4


def test_qc_of_a_cell_without_counts(spark):
    genes = spark.createDataFrame([("g0", "MT-A"), ("g1", None)], "gene_id string, symbol string")
    cells = spark.createDataFrame([("c0",), ("none",)], "cell_id string")
    out = qc.quantify_and_filter(long(spark, [[3, 1]]), genes, cells, cutoffs={"min_total_counts": 1, "min_n_genes": 1, "max_pct_mito": 80, "doublet_max_pct_mito": 0.0})
    got = {r["cell_id"]: r for r in out["classified"].collect()}
    assert got["none"]["pct_counts_mt"] is None and got["none"]["qc_category"] == "low_quality"
    assert got["c0"]["pct_counts_mt"] == 75.0


def circle(spark, n):
    return spark.createDataFrame([(i, [float(np.cos(2 * np.pi * i / n)), float(np.sin(2 * np.pi * i / n))]) for i in range(n)], "id long, vec array<double>")


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_graph_of_a_circle(spark, metric):
    g = knn.one_graph(circle(spark, 120), metric=metric, symmetrize="max").collect()
    weights = {(r["src"], r["dst"]): r["weight"] for r in g}
    assert all(np.isfinite(w) and w >= 0 for w in weights.values())
    assert all(weights[b, a] == w for (a, b), w in weights.items()) and all(a != b for a, b in weights)


def test_too_few_samples(spark):
    with pytest.raises(ValueError, match="Too few samples"):
        knn.one_graph(circle(spark, 20))


def test_blocks_give_the_same_neighbours(spark, monkeypatch):
    v = circle(spark, 90)
    one = sorted(knn.knn(v, 7).collect())
    monkeypatch.setattr(knn, "BLOCK", 17)
    assert sorted(knn.knn(v, 7).collect()) == one


def test_consensus_fills_missing_sources(spark):
    t = spark.createDataFrame([(0, 1, 0.5, True)], "src long, dst long, dist double, keep boolean")
    v = spark.createDataFrame([(1, 0, 0.25, True)], "src long, dst long, dist double, keep boolean")
    assert {(r["src"], r["dst"]): r["dist"] for r in consensus.merge(t, v).collect()} == {(0, 1): 0.5, (1, 0): 0.25}


def two_triangles(spark):
    e = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    return spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, weight double")


def test_leiden_finds_triangles(spark):
    labels = {r["id"]: r["label"] for r in community.cluster(two_triangles(spark), seed=7).collect()}
    assert labels[0] == labels[1] == labels[2] != labels[3] == labels[4] == labels[5]
    assert labels == {r["id"]: r["label"] for r in community.cluster(two_triangles(spark).repartition(5), seed=7).collect()}


def test_leiden_finds_planted_communities():
    rng = np.random.default_rng(0)
    e = [(i, j, 1.0) for i in range(80) for j in range(i) if rng.random() < (0.5 if i // 20 == j // 20 else 0.02)]
    labels = community.leiden(80, e, 1.0, 3)
    assert len(set(labels)) == 4 and all(len({*labels[k : k + 20]}) == 1 for k in range(0, 80, 20))


def test_balanced_parts():
    parts = community.balanced(25, [(i, i + 1, 1.0) for i in range(24)], 3)
    assert sorted(np.bincount(parts)) == [8, 8, 9]


def test_pseudobulks_keep_boundaries(spark):
    cells = spark.createDataFrame([(i, f"s{i // 4 + 1}", f"c{i // 2 % 2 + 1}") for i in range(8)], "cell_id long, sample string, cluster string")
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(7)], "src long, dst long, weight double")
    got = pseudobulk.build(path, cells, cells_per_pb=2).collect()
    assert len(got) == 8 and {r["cell_id"] for r in got} == set(range(8))
    assert {r["pb_id"].split("__")[0] for r in got} == {"s1|c1", "s1|c2", "s2|c1", "s2|c2"}
    with pytest.raises(pseudobulk.PseudobulkError, match="null"):
        pseudobulk.build(path, cells.unionByName(spark.createDataFrame([(9, None, "c1")], cells.schema)))


def test_held_out_counts_by_membership(spark):
    m = spark.createDataFrame([("pb-0", "c1"), ("pb-0", "c2"), ("pb-1", "c3")], "pb_id string, cell_id string")
    c = long(spark, [[10, 1], [2, 3], [4, 5]], ["c1", "c2", "c3"], ["g1", "g2"])
    got = {(r["pb_id"], r["gene_id"]): r["n"] for r in pseudobulk.apply_membership(m, c, m.select("cell_id")).collect()}
    assert got == {("pb-0", "g1"): 12, ("pb-0", "g2"): 4, ("pb-1", "g1"): 4, ("pb-1", "g2"): 5}
    with pytest.raises(pseudobulk.PseudobulkError, match="missing"):
        pseudobulk.apply_membership(m.where("cell_id <> 'c3'"), c, m.select("cell_id"))


def test_designs(spark):
    s = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), ("c", "x", 5.0), ("d", "y", 7.0)], "pb_id string, f string, z double")
    assert design.build_design(s, "~ f + z").columns == ("Intercept", "f_y", "z")
    d = design.build_design(s, "~ 0 + f")
    assert d.columns == ("f_x", "f_y") and d.one_hot and d.rank == 2 and d.column("x") == 0
    with pytest.raises(KeyError):
        design.build_design(s, "~ missing")
    with pytest.raises(design.DesignError, match="rank deficient"):
        design.build_design(s.withColumn("g", s.f), "~ f + g")
    with pytest.raises(design.DesignError, match="null"):
        design.build_design(s.unionByName(spark.createDataFrame([("e", None, 1.0)], s.schema)), "~ f")
    with pytest.raises(ValueError, match="one column"):
        design.pairwise(d, [("x", "f_x")])


def experiment(spark, rng, n=16, genes=20, outlier=False, zeros=False):
    y = rng.poisson(20, (n, genes))
    y[n // 2 :, : genes // 2] += 10
    if outlier:
        y[0, 0] = 10_000
    if zeros:
        y[np.arange(genes) % n, np.arange(genes)] = 0
    c = long(spark, y, [f"s{i:02}" for i in range(n)]).withColumnRenamed("cell_id", "pb_id")
    s = spark.createDataFrame([(f"s{i:02}", "control" if i < n // 2 else "treated") for i in range(n)], "pb_id string, condition string")
    return c, s


def test_differential_expression(spark):
    c, s = experiment(spark, np.random.default_rng(0), 12, 30)
    kept, d = nbfit.prepare(c, s, "~ 0 + condition")
    ones = spark.createDataFrame([(x, 1.0) for x in d.samples], "pb_id string, size_factor double")  # half of the genes change, so medians can't tell depth
    out = {r["gene_id"]: r for r in nbfit.pairwise_de(nbfit.fit(kept, d, ones), [("treated", "control")], filtering=False).collect()}
    up = [out[f"g{i}"] for i in range(15)]
    assert sum(r["padj"] < 0.1 and r["log2FoldChange"] > 0 for r in up) >= 12
    assert sum(out[f"g{i}"]["padj"] < 0.1 and out[f"g{i}"]["log2FoldChange"] > 0 for i in range(15, 30)) <= 3


def test_an_outlier_is_replaced_and_refitted(spark):
    c, s = experiment(spark, np.random.default_rng(1), outlier=True)
    kept, d = nbfit.prepare(c, s, "~ 0 + condition")
    assert nbfit.fit(kept, d).diagnostics["replaced"] == 1


def test_every_gene_with_a_zero_takes_positive_counts(spark):
    c, s = experiment(spark, np.random.default_rng(2), zeros=True)
    kept, d = nbfit.prepare(c, s, "~ 0 + condition")
    assert nbfit.fit(kept, d).diagnostics["size_factors"] == "poscounts"
    with pytest.raises(design.FitError, match="No genes remain"):
        nbfit.prepare(c, s, "~ condition", min_counts=1e9)


def test_size_factors_follow_depth(spark):
    c = spark.createDataFrame([(f"s{i}", f"g{j}", (i + 1) * (10 + j)) for i in range(3) for j in range(5)], "pb_id string, gene_id string, n long")
    got = [r["size_factor"] for r in nb.size_factors(c, c.select("pb_id").distinct()).orderBy("pb_id").collect()]
    assert np.array(got) / got[0] == pytest.approx([1, 2, 3])


def test_enrichment(spark):
    de = spark.createDataFrame([("k", g, s, 0.001) for g, s in [("A1", 5.0), ("A2", 4.0), ("A3", 6.0), ("B1", -0.2), ("B2", 0.1), ("B3", 0.0)]], "contrast string, gene string, stat double, pvalue double")
    sets = spark.createDataFrame([("h", "Pos", ["A1", "A2", "A3", "gone"]), ("h", "Null", ["B1", "B2", "B3"]), ("h", "Few", ["A1"])], "library string, pathway string, genes array<string>")
    got = {r["pathway"]: r for r in genesets.enrich(genesets.prepared(de), sets).collect()}
    assert got["Pos"]["size"] == 4 and got["Pos"]["nom_sig_genes"] == "A3,A1,A2" and got["Pos"]["p"] < 0.05
    assert got["Few"]["enrichment_t"] is None and got["Few"]["BH_adj_p"] == 1.0 and got["Few"]["mean_t"] == 5.0
    assert got["Pos"]["signed_neglog10_BH"] > abs(got["Null"]["signed_neglog10_BH"])
    with pytest.raises(ValueError, match="exactly"):
        genesets.enrich_by_columns(de, sets, {"other": "stat"})


def test_gmt_lines(spark):
    rows = spark.createDataFrame([("A\tNA\tG1\t\tG2",), ("A\tNA\tG3",), ("\tNA\tG9",), ("only",)], "value string").coalesce(1)
    assert [(r["pathway"], r["genes"]) for r in tables.parse_gmt(rows, "x").collect()] == [("A", ["G3"])]
    assert tables.resolve_libraries("h.all", ["h", "h.2", "c1"]) == ["h", "h.2"]
    with pytest.raises(FileNotFoundError):
        tables.resolve_libraries("c9", ["h"])


def test_module_edges(spark):
    rho = spark.createDataFrame([("s", "train", f"G{i}", f"G{j}", r) for i, j, r in [(0, 1, 0.8), (0, 2, 0.1), (0, 3, -0.7), (1, 2, 0.6), (1, 3, 0.0), (2, 3, -0.2)]], "sample string, split string, gene_a string, gene_b string, rho double")
    cuts = spark.createDataFrame([("s", "train", 0.5, -0.5)], "sample string, split string, cpos double, cneg double")
    got = {(r["gene_a"], r["gene_b"]): r["sign"] for r in modules.threshold_edges(rho, cuts).collect()}
    assert got == {("G0", "G1"): "pos", ("G0", "G3"): "neg", ("G1", "G2"): "pos"}


def test_replicated_modules(spark):
    rows = [("S1", g, 0) for g in "ABC"] + [("S1", g, 1) for g in "DE"] + [("S2", g, 0) for g in "ABF"] + [("S2", g, 2) for g in "DEG"]
    m = spark.createDataFrame(rows, "sample string, gene_id string, module_id int")
    support = {r["gene_id"]: r["support_n_samples"] for r in modules.support(m, modules.replicate(m, 0.2)).collect()}
    assert support == {"A": 2, "B": 2, "C": 1, "F": 1, "D": 2, "E": 2, "G": 1}


def test_decomposition(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    scores, values, right = decompose.svd(v, 5)
    assert values[:3] == pytest.approx(np.linalg.svd(x)[1][:3]) and values[3:] == pytest.approx([0, 0], abs=1e-5)
    got = np.array([r["vec"] for r in scores.orderBy("id").collect()])
    assert got @ right.T == pytest.approx(x, abs=1e-8)


def test_noise_has_no_reproducible_components(spark):
    rng = np.random.default_rng(6)
    frame = lambda x: spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    noise = decompose.find_components(frame(rng.normal(size=(120, 6))), frame(rng.normal(size=(120, 6))), 6)[2]
    assert (noise["train"], noise["val"]) == (0, 0)
    z = rng.normal(size=(120, 1)) * 5
    shared = decompose.find_components(frame(z + rng.normal(size=(120, 6))), frame(z + rng.normal(size=(120, 6))), 6)[2]
    assert shared["train"] >= 1 and shared["val"] >= 1


def test_findings_and_policies(spark):
    c = long(spark, [[5, 2], [0, 3], [1, 1]], ["cell-a", "cell-b", "cell-c"], ["gene-a", "gene-b"])
    cells, genes = c.select("cell_id").distinct(), c.select("gene_id").distinct()
    assert compat.validate(c, cells, genes).is_compatible
    report = compat.validate(c, cells.where("cell_id <> 'cell-b'"), genes, expected={"k": 1}, found={"k": 2})
    assert {f["code"] for f in report.errors} == {"cell_ids_missing_from_axis", "parameter_differs"}
    with pytest.raises(compat.CompatibilityError):
        report.apply_policy("error")
    with pytest.warns(compat.CompatibilityWarning):
        report.apply_policy("warn")


def test_provenance():
    a, b = provenance.hash_ordered_ids(["x", "y"], "d"), provenance.hash_ordered_ids(["y", "x"], "d")
    assert a != b and provenance.hash_membership_ids(["x", "y"], "d") == provenance.hash_membership_ids(["y", "x"], "d")
    e = provenance.Envelope.create("fit", {"k": 1}, {"ids": "h"}, diagnostics={"n": 1})
    assert e.with_diagnostics({"m": 2}).stable_id == e.stable_id
    assert provenance.Envelope.from_dict(e.to_dict()).stable_id == e.stable_id
    with pytest.raises(provenance.ProvenanceError, match="changed"):
        provenance.Envelope.from_dict({**e.to_dict(), "stage": "other"})
    for bad in (float("nan"), {1: 2}, np.zeros(2), object()):
        with pytest.raises(provenance.ProvenanceError):
            provenance.canonical_json(bad)
    with pytest.raises(provenance.ProvenanceError, match="repeated"):
        provenance.normalize_identifiers(["a", "a"])


def test_checks(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "x string")
    assert {r["id"] for r in checks.duplicate_ids(rows, "x").collect()} == {"a", None, ""}
    assert checks.sanitize_text(" a b-c ") == "a_b_c"


def test_reverse_contrast(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "contrast string, stat double")
    assert [tuple(r) for r in feeds.reverse_contrast(df, "a", "z", ["stat"]).collect()] == [("z", -1.0)]


def test_label_propagation(spark):
    labels = {r["id"]: r["label"] for r in community.propagate(two_triangles(spark), 5).collect()}
    assert labels[0] == labels[1] == labels[2] and labels[3] == labels[4] == labels[5]


def test_tables_round_trip(spark, tmp_path):
    c = long(spark, [[1, 2], [0, 3]])
    tables.write_counts(c, str(tmp_path / "c"))
    assert sorted(tables.read_counts(spark, str(tmp_path / "c")).collect()) == sorted(c.collect())
    tables.write_tsv_gz(c, str(tmp_path / "t"))
    assert sorted(tables.read_tsv(spark, str(tmp_path / "t"), "cell_id string, gene_id string, n long").collect()) == sorted(c.collect())
    assert tables.write_json({"b": 1, "a": [2]}, str(tmp_path / "j"), spark) == '{"a":[2],"b":1}'


def test_streams_give_what_batches_give(spark, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    from cytoquill.streaming import qc_stream

    rows = [(datetime(2024, 1, 1, i % 5, i % 60), "ab"[i % 2], float(i)) for i in range(200)]
    schema = "ts timestamp, event_type string, value double"
    df = spark.createDataFrame(rows, schema)
    for i in range(3):
        df.where(F.col("value") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in/e{i}.parquet"))
    stream = qc_stream.read_stream(spark, str(tmp_path / "in"), "*.parquet", schema, 1)
    totals = qc_stream.drain(qc_stream.running_totals(stream.select(F.col("event_type").alias("cell_id"), F.lit(1).alias("n"))), str(tmp_path / "out"), "complete")
    assert {tuple(r) for r in totals.collect()} == {("a", 100), ("b", 100)}
    windows = qc_stream.drain(qc_stream.windowed_counts(stream, "1 hour", "10 hours"), str(tmp_path / "out"), "append")
    assert windows.count() <= 10


def test_workflow_ends_early(spark):
    from cytoquill.plans import workflows

    rng = np.random.default_rng(0)
    c = long(spark, rng.poisson(1, (50, 20)))
    cells = spark.createDataFrame([(f"c{i}", i) for i in range(50)], "cell_id string, id long")
    assert workflows.consensus_pipeline(c, cells, stop_after="normalize").status == "stopped"
    assert workflows.consensus_pipeline(c, cells, feature_alpha=1e-9).status == "no_features_selected"


def test_workflow_completes_on_structured_counts(spark):
    """Two halves of cells, each with ten genes of its own, come apart; unstructured counts reproduce nothing."""
    from cytoquill.plans import workflows

    rng = np.random.default_rng(1)
    means = np.ones((120, 60))
    means[:60, :10] = means[60:, 10:20] = 5
    cells = spark.createDataFrame([(f"c{i}", i) for i in range(120)], "cell_id string, id long")
    out = workflows.consensus_pipeline(long(spark, rng.poisson(means)), cells, seed=123, select_features=False, components=20)
    assert out.status == "complete" and out.diagnostics["k"] == 10 and out.tables["graph"].count() > 0
    labels = {r["id"]: r["label"] for r in out.tables["labels"].collect()}
    assert len(labels) == 120 and all(len({labels[i] for i in half}) == 1 for half in (range(60), range(60, 120))) and labels[0] != labels[60]
    chosen = workflows.consensus_pipeline(long(spark, rng.poisson(means)), cells, seed=123, components=20)
    assert chosen.status == "complete" and chosen.diagnostics["features"] < 60
    assert {r["gene_id"] for r in chosen.tables["features_train"].where("selected").collect()} <= {f"g{j}" for j in range(20)} | {r["gene_id"] for r in chosen.tables["features_train"].collect()}
    nothing = workflows.consensus_pipeline(long(spark, rng.poisson(1, (120, 60))), cells, seed=5, select_features=False, components=5)
    assert nothing.status == "no_reproducible_pcs"


def test_large_graphs_are_contracted_first(spark, monkeypatch):
    from cytoquill.operators import community

    cliques = [(10 * c + i, 10 * c + j, 1.0) for c in range(6) for i in range(10) for j in range(i)] + [(10 * c, 10 * c + 10, 0.1) for c in range(5)]
    edges, nodes = spark.createDataFrame(cliques, "src long, dst long, weight double"), spark.range(63)
    whole = {r["id"]: r["label"] for r in community.cluster(edges, nodes).collect()}
    monkeypatch.setattr(community, "MOST_EDGES", 60)
    parts = {r["id"]: r["label"] for r in community.cluster(edges, nodes).collect()}
    groups = lambda of: {frozenset(i for i in of if of[i] == p) for p in set(of.values())}
    assert groups(parts) == groups(whole) == {frozenset(range(10 * c, 10 * c + 10)) for c in range(6)} | {frozenset([i]) for i in (60, 61, 62)}


def test_balanced_parts_cut_little():
    from cytoquill.operators import community

    rng = random.Random(3)
    for _ in range(20):
        names = list(range(24))
        rng.shuffle(names)
        edges = [(names[6 * c + i], names[6 * c + j], 1.0) for c in range(4) for i in range(6) for j in range(i)] + [(names[rng.randrange(24)], names[rng.randrange(24)], 0.3) for _ in range(12)]
        part = community.balanced(24, edges, 4)
        assert sorted(part.count(p) for p in range(4)) == [6, 6, 6, 6]
        assert all(len({part[names[6 * c + i]] for i in range(6)}) == 1 for c in range(4))
    assert community.balanced(0, [], 1) == [] and sorted(community.balanced(5, [], 2)) == [0, 0, 0, 1, 1]


def test_each_sample_has_its_own_number_of_neighbours(spark):
    from cytoquill.operators import modules

    rho = [("s1", f"a{i:03}", f"a{j:03}", 0.5) for j in range(200) for i in range(j)] + [("s2", f"b{i}", f"b{j}", 0.5) for j in range(4) for i in range(j)]
    got = modules.default_ks(spark.createDataFrame(rho, "sample string, gene_a string, gene_b string, rho double"))
    assert {tuple(r) for r in got.collect()} == {("s1", modules.default_k(200)), ("s2", modules.default_k(4))} == {("s1", 10), ("s2", 3)}


def test_iterative_size_factors_find_the_depths(spark):
    rng = np.random.default_rng(4)
    depth = np.array([0.5, 0.8, 1.0, 1.3, 2.0, 1.0, 0.7, 1.6])
    depth /= np.exp(np.log(depth).mean())
    y = rng.poisson(np.outer(rng.uniform(20, 200, 60), depth))
    for g in range(60):
        y[g, g % 8] = 0  # every gene has a zero
    counts = spark.createDataFrame([(f"p{i}", f"g{g}", int(y[g, i])) for g in range(60) for i in range(8)], "pb_id string, gene_id string, n long")
    made = design.build_design(spark.createDataFrame([(f"p{i}", "ab"[i % 2]) for i in range(8)], "pb_id string, c string"), "~ c")
    got = {r["pb_id"]: r["size_factor"] for r in nbfit.iterative_size_factors(counts, made).collect()}
    found = np.array([got[f"p{i}"] for i in range(8)])
    assert np.log(found).mean() == pytest.approx(0, abs=1e-9) and np.corrcoef(np.log(found), np.log(depth))[0, 1] > 0.98


def test_reports_that_are_too_long_are_an_error(spark, tmp_path, monkeypatch):
    from cytoquill.sources import tables

    monkeypatch.setattr(tables, "MOST_ROWS", 3)
    assert tables.write_json(spark.range(3), str(tmp_path / "a")).count("id") == 3
    with pytest.raises(ValueError):
        tables.write_json(spark.range(4), str(tmp_path / "b"))


def test_workflow_keeps_every_gene(spark, monkeypatch):
    from cytoquill.plans import workflows

    c = spark.createDataFrame([(f"c{i}", f"g{j}", 1 + (i + j) % 3) for i in range(4) for j in range(i, 2010, 2)], "cell_id string, gene_id string, n long")
    cells = spark.createDataFrame([(f"c{i}", i) for i in range(4)], "cell_id string, id long")
    run = lambda **how: workflows.consensus_pipeline(c, cells, select_features=False, stop_after="features", **how).diagnostics["features"]
    assert run() == 2010 and run(most_genes=7) == 7
    monkeypatch.setattr(decompose, "MOST_COLUMNS", 2009)
    with pytest.raises(ValueError):
        run()


def test_registered_workflow_selects_features(spark, monkeypatch):
    from cytoquill.plans import workflow_queries, workflows

    seen = []
    monkeypatch.setattr(workflow_queries, "_cells", lambda *a: None)
    monkeypatch.setattr(workflow_queries.domain, "counts", lambda *a: None)
    monkeypatch.setattr(workflows, "consensus_pipeline", lambda *a, **how: seen.append(how) or workflows.Result("complete"))
    workflow_queries.workflow_consensus(spark, "")
    assert any(how.get("select_features", True) for how in seen) and all(how.get("most_genes") is None for how in seen)


def test_too_many_levels_are_an_error(spark, monkeypatch):
    from cytoquill.plans import set_queries

    rows = spark.createDataFrame([("p", f"l{i}", 0.25) for i in range(4)], "pb_id string, label string, proportion double")
    assert len(pseudobulk.wide_proportions(rows, "x").columns) == 5 and len(design.dummies(rows, "label").columns) == 5
    parts = spark.range(1001).selectExpr("concat('SMALL', id) AS p_type")
    monkeypatch.setattr(set_queries.domain, "read_table", lambda *a: parts)
    monkeypatch.setattr(pseudobulk, "MOST_LABELS", 3, raising=False)
    monkeypatch.setattr(design, "MOST_LEVELS", 3, raising=False)
    for call in (lambda: pseudobulk.wide_proportions(rows, "x"), lambda: design.dummies(rows, "label"), lambda: set_queries.gene_set_libraries(spark, "")):
        with pytest.raises(ValueError, match="more than"):
            call()


def test_registered_workflow_takes_every_component(spark, monkeypatch):
    from cytoquill.plans import workflow_queries, workflows

    seen = []
    v = spark.createDataFrame([(1, [0.5] * 64, 0)], "id long, vec array<float>, label int")
    monkeypatch.setattr(workflow_queries.domain, "vectors", lambda *a: v)
    monkeypatch.setattr(workflow_queries.knn, "one_graph", lambda *a: None)
    monkeypatch.setattr(workflows, "de_pipeline", lambda graph, counts, *a: seen.append(counts.count()) or workflows.Result("complete", {"enrichment": counts}))
    workflow_queries.workflow_de(spark, "")
    assert seen == [64]


def test_adjusted_p_of_large_groups(spark):
    """Running minima over all rows that follow take a number of steps that grows with the square of a group; equal p, nulls and null groups keep their places."""
    from pyspark.sql import functions as F

    n = 200_000
    p = F.when(F.col("id") % 1000 == 7, None).when(F.col("id") % 10 == 3, 1.0).otherwise((F.col("id") * 7919 % 200_003 + 1) / 200_003.0)
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "a").alias("g"), p.alias("p"))
    out = genesets.adjust(df, "p", ("g",), ("id",))
    assert "currentrow$(), unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = out.orderBy("id").toPandas()
    assert got["id"].tolist() == list(range(n))
    for own in (got[got["g"] == "a"], got[got["g"].isna()]):
        some = own[own["p"].notna()].sort_values("p")
        raw = some["p"].to_numpy() * len(some) / np.arange(1, len(some) + 1)
        want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
        assert some["padj"].to_numpy() == pytest.approx(want, rel=1e-12)
        assert own[own["p"].isna()]["padj"].isna().all()


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_nearest_of_streamed_vectors(metric):
    """Queries keep their best of vectors that pass by: copies, far offsets, zeros, NaN and too few vectors; memory is that of a tile, however many pass."""
    import tracemalloc

    rng = np.random.default_rng(3)
    y = np.round(rng.normal(size=(9000, 8)), 2) + (50.0 if metric == "l2" else 0.0)
    y[100:140], y[200], y[300, 2] = y[0], 0.0, np.nan
    ids, k = rng.permutation(9000) + 10**12, 30
    near = knn._Nearest(ids[:400], y[:400], k, metric, 9)
    near.see(ids[:7], y[:7])
    tracemalloc.start()
    near.see(ids[7:], y[7:])
    for _ in range(2):
        near.see(ids[:0], y[:0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    got = {}
    for b in near.found():
        for src, rank, dst, dist in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(src, []).append((rank, dst, dist))
    for i in range(0, 400, 7):
        a = y[i]
        norm = lambda v: np.where(n > 0, n, 1) if (n := np.sqrt((v * v).sum(-1))) is not None else n
        d = ((a - y) ** 2).sum(1) if metric == "l2" else -(y @ a) if metric == "ip" else 1 - (y @ a) / norm(y) / norm(a)
        d = np.round(d, 9) + 0.0
        best = [j for j in np.lexsort((ids, ids != ids[i], d)) if not np.isnan(d[j])][:k]
        assert [(r, dst) for r, dst, _ in got.get(ids[i], [])] == [(r + 1, ids[j]) for r, j in enumerate(best)]
        assert [x for *_, x in got.get(ids[i], [])] == pytest.approx([d[j] for j in best], abs=2e-9)


def test_nearest_are_dealt_out(spark):
    """Some thousand vectors go to more than one task, and rows come out ranked."""
    from pyspark.sql import functions as F

    v = spark.range(2000).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(0.5)).alias("vec"))
    out = knn.knn(v, 5)
    got = out.withColumn("part", F.spark_partition_id()).toPandas()
    assert len(got) == 10_000 and got["part"].nunique() > 1
    assert (got.sort_values(["src", "rank"])["rank"].to_numpy().reshape(-1, 5) == np.arange(1, 6)).all()


def test_nearest_hold_few_pairs():
    """A block's memory beside its queries and their best doesn't grow with the pairs that a tile of vectors shows it."""
    import tracemalloc

    rng = np.random.default_rng(4)
    y, ids = rng.normal(size=(12_000, 64)), np.arange(12_000)
    for metric in ("cosine", "l2"):
        near = knn._Nearest(ids[:8000], y[:8000], 20, metric, 9)
        tracemalloc.start()
        near.see(ids, y)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6 and (near.count == 20).all()


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_nearest_of_many_copies(metric, monkeypatch):
    """Of equal vectors only the smallest ids, and each query itself, are looked at: pairs don't grow with the square of a group; rows are those of brute force."""
    rng = np.random.default_rng(6)
    y = np.round(rng.normal(size=(3000, 6)), 2)
    y[rng.permutation(3000)[:2000]] = y[7]
    ids, k, looked = rng.permutation(3000) * 3 + 10**9, 12, []
    take = knn._Nearest._take
    monkeypatch.setattr(knn._Nearest, "_take", lambda self, rows, *rest: (looked.append(len(rows)), take(self, rows, *rest))[1])
    near = knn._Nearest(ids[:900], y[:900], k, metric, 9)
    for at in range(0, 3000, 500):
        near.see(ids[at : at + 500], y[at : at + 500])
    assert sum(looked) < 900 * 6 * 60
    d = {"l2": lambda a: ((a - y) ** 2).sum(1), "ip": lambda a: -(y @ a), "cosine": lambda a: 1 - (knn._unit(y) @ knn._unit(a[None])[0])}[metric]
    for i in range(0, 900, 5):
        dist = np.round(d(y[i]), 9) + 0.0
        assert near.dst[i].tolist() == ids[np.lexsort((ids, ids != ids[i], dist))[:k]].tolist()


def test_wide_vectors_make_small_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    v = spark.range(90).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(0.5)).alias("vec"))
    one = sorted(knn.knn(v, 5).collect())
    monkeypatch.setattr(knn, "BLOCK_VALUES", 60)
    out = knn.knn(v, 5)
    assert out.rdd.getNumPartitions() == 5 and sorted(out.collect()) == one


@pytest.mark.parametrize("name", ["consensus_overlap_stats", "graph_bad_ends", "graph_within_cluster", "graph_sym_avg", "graph_top_edges", "modularity_of_labels", "graph_undirected"])
def test_python_of_graph_queries_is_one_search(spark, name):
    """All that runs in Python is the search of bounded blocks, once for each embedding, so an executor's Python memory is that of ``_Nearest``."""
    from cytoquill.plans import registry

    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    steps = [line for line in final.splitlines() if re.search("Python|Pandas|InArrow", line)]
    assert len(steps) == (2 if name == "consensus_overlap_stats" else 1) and all("MapInArrow run(" in line for line in steps), final


def counted(spark, df):
    """``df``, and how many of its rows have been made so far, by all that read it."""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(rows, df.schema), made


def test_cohort_reads_correlations_once(spark):
    rows = [(s, split, f"g{i}", f"g{j}", 0.9 if i // 3 == j // 3 else -0.4) for s in "ab" for split in ("train", "val") for i in range(9) for j in range(i + 1, 9)]
    rho, made = counted(spark, spark.createDataFrame(rows, "sample string, split string, gene_a string, gene_b string, rho double"))
    cuts = spark.createDataFrame([(s, split, 0.5, -0.3) for s in "ab" for split in ("train", "val")], "sample string, split string, cpos double, cneg double")
    out = modules.run_cohort(rho, cuts)
    assert sorted(r["support_n_samples"] for r in out["support"].collect()) == [2] * 9
    assert out["modules"].count() == 18 and out["replicated"].count() == 6
    assert made.value == len(rows)


def test_stabilised_counts_are_read_once(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", f"g{j}", int(n)) for j in range(12) for i, n in enumerate(rng.poisson(20 + 5 * j, 8))]
    counts, made = counted(spark, spark.createDataFrame(rows, "pb_id string, gene_id string, n long"))
    samples = spark.createDataFrame([(f"s{i}",) for i in range(8)], "pb_id string")
    assert nbfit.vst(counts, samples)[0].count() == 96
    assert made.value == len(rows)


def test_communities_hold_edges_in_arrays():
    """Half a million edges in less than 200 bytes each; neighbours in the order of edges, repeated ones added up."""
    import tracemalloc

    rows = community._Rows(4, np.array([2, 0, 1, 2]), np.array([0, 1, 2, 0]), np.array([1.0, 2.0, 3.0, 0.5]))
    assert [list(rows[v].items()) for v in range(4)] == [[(2, 1.5), (1, 2.0)], [(0, 2.0), (2, 3.0)], [(0, 1.5), (1, 3.0)], []]
    rng, n = np.random.default_rng(5), 20_000
    a = rng.integers(0, n, 500_000)
    edges = (a, (a // 100 * 100 + rng.integers(0, 100, len(a))) % n, np.ones(len(a)))
    tracemalloc.start()
    community._Rows(n, *edges)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(a)


def test_balanced_parts_of_a_hub():
    """A node that thousands name as their neighbour costs its edges, not their square; sizes stay even."""
    import time

    n = 24_000
    edges = [(0, v, 500.0) for v in range(1, n)] + [(v, v + 1, 900.0 if v % 10 else 1.0) for v in range(1, n - 1)]
    start = time.process_time()
    out = community.balanced(n, edges, n // 10)
    assert time.process_time() - start < 15
    assert sorted(np.bincount(out)) == [10] * (n // 10)


def test_fits_take_few_genes_at_once(spark, monkeypatch):
    """Genes are fitted in slices when samples are many, with the same results; a workflow makes its memberships once."""
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", f"g{j}", int(n)) for j in range(10) for i, n in enumerate(rng.negative_binomial(4, 0.1, 12))]
    counts = spark.createDataFrame(rows, "pb_id string, gene_id string, n long")
    d = design.build_design(spark.createDataFrame([(f"s{i}", "ab"[i % 2]) for i in range(12)], "pb_id string, c string"), "~ 0 + c")
    take = lambda: nbfit.fit(counts, d).genes.orderBy("gene_id").select("dispersion", "beta").toPandas()
    whole = take()
    monkeypatch.setattr(nbfit, "MOST_VALUES", 24)
    assert [len(x) for x in nbfit._few([whole], 12)] == [2] * 5
    few = take()
    assert few["dispersion"].to_numpy() == pytest.approx(whole["dispersion"].to_numpy(), rel=1e-9)
    assert np.stack(few["beta"]) == pytest.approx(np.stack(whole["beta"]), rel=1e-9)


def test_pseudobulk_workflow_builds_once(spark):
    edges, made = counted(spark, spark.createDataFrame([(i, (i + 1) % 40, 1.0) for i in range(40)], "src long, dst long, weight double"))
    cells = spark.range(40).selectExpr("id AS cell_id", "'a' AS sample", "'k' AS cluster")
    out = pseudobulk.workflow(edges, spark.range(40).selectExpr("id AS cell_id", "'g' AS gene_id", "1L AS n"), cells)
    built = made.value
    assert built and sum(r["n_cells"] for r in out["totals"].collect()) == 40
    assert out["cluster_proportions"].count() == out["sample_weights"].count() == out["counts"].count() == 4
    assert made.value == built
