"""Operators without SQL against plain NumPy, or against the conditions that define their results."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from cytoquill.functions import kernels
from cytoquill.operators import community, decompose, genesets, knn, modules, nb, nbfit, pseudobulk
from cytoquill.operators.design import build_design


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def experiment(spark):
    """12 samples, 6 of each condition; 30 genes, of which 15 differ, one has an outlier and one is empty in a condition."""
    rng = np.random.default_rng(3)
    y = rng.negative_binomial(5, 5 / (5 + np.outer(rng.uniform(20, 400, 30), rng.uniform(0.6, 1.6, 12)))).T
    y[6:, :15] *= 3
    y[6:, 20] = 0
    samples = spark.createDataFrame([(f"p{i:02}", "control" if i < 6 else "treated") for i in range(12)], "pb_id string, condition string")
    counts = spark.createDataFrame([(f"p{i:02}", f"g{g:02}", int(y[i, g])) for i in range(12) for g in range(30)], "pb_id string, gene_id string, n long")
    design = build_design(samples, "~ condition")
    fitted = nbfit.fit(counts, design)
    genes = sorted(fitted.genes.collect(), key=lambda r: r["gene_id"])
    return y.T.astype(float), counts, design, fitted, genes


def nll(y, mu, alpha):
    r = 1 / alpha
    return -sum(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + m)) + k * math.log(m / (r + m)) for k, m in zip(y, mu, strict=True))


def test_size_factors_and_means(experiment):
    y, _, _, fitted, genes = experiment
    logs = np.log(y[(y > 0).all(1)])
    size = np.exp(np.median(logs - logs.mean(1, keepdims=True), axis=0))
    assert fitted.size == pytest.approx(size, rel=1e-9)
    assert [r["base_mean"] for r in genes if not r["replaced"]] == pytest.approx([(y[g] / size).mean() for g, r in enumerate(genes) if not r["replaced"]], rel=1e-9)


def test_coefficients_solve_their_equations(experiment):
    y, _, design, fitted, genes = experiment
    x = design.x
    for g, r in enumerate(genes):
        beta, alpha = np.array(r["beta"]), r["dispersion"]
        mu = fitted.size * np.exp(x @ beta)
        if r["replaced"] or (mu < kernels.MIN_MU).any():
            continue
        slope = x.T @ ((y[g] - mu) / (1 + alpha * mu)) - kernels.RIDGE * beta
        weight = (x.T * (mu / (1 + alpha * mu))) @ x
        assert r["converged"] and np.abs(np.linalg.solve(weight, slope)).max() < 1e-4


def test_dispersions_are_modes(experiment):
    """Gene-wise and shrunk dispersions: no other on a fine grid has a smaller loss."""
    y, _, design, fitted, genes = experiment
    x, trend = design.x, fitted.trend
    linear = kernels.linear_mu(y, x, fitted.size)

    def loss(g, alpha, prior):
        w = linear[g] / (1 + alpha * linear[g])
        out = nll(y[g], linear[g], alpha) + 0.5 * np.linalg.slogdet((x.T * w) @ x)[1]
        return out + (np.log(alpha / prior) ** 2 / (2 * fitted.prior_variance) if prior else 0)

    assert fitted.prior_variance >= 0.25
    for g, r in enumerate(genes):
        if r["replaced"]:
            continue
        at = trend["mean"] if "mean" in trend else trend["a1"] / r["base_mean"] + trend["a0"]
        assert r["disp_fit"] == pytest.approx(max(at, 1e-8), rel=1e-6)
        for name, prior in (("disp_genewise", None), ("disp_map", r["disp_fit"])):
            best = min(loss(g, a, prior) for a in np.exp(np.linspace(np.log(1e-8), np.log(12), 400)))
            assert loss(g, r[name], prior) <= best + 1e-6
        apart = np.log(r["disp_genewise"]) > np.log(r["disp_fit"]) + 2 * math.sqrt(fitted.prior_variance)
        assert r["outlier_disp"] == apart and r["dispersion"] == pytest.approx(r["disp_genewise"] if apart else r["disp_map"])


def test_all_pairs_and_each_against_the_rest(spark, experiment):
    _, counts, _, _, _ = experiment
    samples = spark.createDataFrame([(f"p{i:02}", "abc"[i % 3]) for i in range(12)], "pb_id string, c string")
    design = build_design(samples, "~ 0 + c")
    fitted = nbfit.fit(counts, design)
    x = design.x
    by_gene = {r["gene_id"]: r for r in fitted.genes.collect()}
    vectors = {"c_a_vs_c_b": (1, -1, 0), "c_a_vs_c_c": (1, 0, -1), "c_b_vs_c_c": (0, 1, -1)}
    got = nbfit.pairwise_de(fitted, filtering=False).collect()
    assert {r["contrast"] for r in got} == set(vectors) and len(got) == 90
    p_of = {}
    for r in got:
        f, c = by_gene[r["gene_id"]], np.array(vectors[r["contrast"]], float)
        beta, mu = np.array(f["beta"]), fitted.size * np.exp(x @ np.array(f["beta"]))
        info = (x.T * (mu / (1 + f["dispersion"] * mu))) @ x
        h = np.linalg.inv(info + kernels.RIDGE * np.eye(3))
        se = math.sqrt(c @ h @ info @ h @ c)
        assert r["log2FoldChange"] == pytest.approx(c @ beta / math.log(2), abs=1e-7) and r["lfcSE"] == pytest.approx(se / math.log(2), rel=1e-6)
        assert r["stat"] == pytest.approx(c @ beta / se, abs=1e-6)
        if r["pvalue"] is None:
            assert f["cooks_outlier"]
        else:
            assert r["pvalue"] == pytest.approx(math.erfc(abs(c @ beta / se) / math.sqrt(2)), rel=1e-5, abs=1e-12)
            p_of.setdefault(r["contrast"], []).append((r["pvalue"], r["padj"]))
    for values in p_of.values():
        values.sort()
        low = 1.0
        for i in range(len(values) - 1, -1, -1):
            low = min(low, values[i][0] * len(values) / (i + 1))
            assert values[i][1] == pytest.approx(low, rel=1e-9)
    rest = {(r["contrast"], r["gene_id"]): r["log2FoldChange"] for r in nbfit.cluster_vs_rest(fitted, filtering=False).collect()}
    for (name, gene), effect in rest.items():
        b = dict(zip(design.columns, by_gene[gene]["beta"], strict=True))
        own = next(c for c in design.columns if name.startswith(c))
        assert effect == pytest.approx((b[own] - np.mean([v for c, v in b.items() if c != own])) / math.log(2), abs=1e-7)


def test_shrunk_effects_are_modes(experiment):
    y, _, design, fitted, genes = experiment
    tested = sorted(nbfit.test(fitted, {"c": np.array([0.0, 1.0])}, cooks_filter=False).collect(), key=lambda r: r["gene_id"])
    ln2 = math.log(2)
    scale = nbfit.prior_scale(np.array([r["log2FoldChange"] for r in tested]) * ln2, np.array([r["lfcSE"] for r in tested]) * ln2)
    got = {r["gene_id"]: r for r in nbfit.shrink(fitted, "condition_treated").collect()}
    for g, r in enumerate(genes):
        if not got[r["gene_id"]]["converged"]:
            continue
        own = np.array(r["counts"])
        grid = kernels.grid_beta(own[None], design.x, fitted.size, np.array([r["dispersion"]]), -15, 15, 30, scale)
        assert got[r["gene_id"]]["log2FoldChange"] * ln2 == pytest.approx(grid[0, 1], abs=2e-3)


def test_coefficients_by_grid(experiment):
    y, _, design, fitted, genes = experiment
    some = [g for g, r in enumerate(genes) if not r["replaced"] and (np.array(r["mu"]) > 1).all()][:6]
    got = kernels.grid_beta(y[some], design.x, fitted.size, np.array([genes[g]["dispersion"] for g in some]), -12, 12, 40)
    assert got == pytest.approx(np.array([genes[g]["beta"] for g in some]), abs=1e-3)
    with pytest.raises(ValueError):
        kernels.grid_beta(y[:1], np.ones((12, 3)), fitted.size, np.ones(1))


def test_stabilised_counts(spark, experiment):
    y, counts, design, _, _ = experiment
    samples = spark.createDataFrame([(s,) for s in design.samples], "pb_id string")
    values, trend = nbfit.vst(counts, samples)
    logs = np.log(y[(y > 0).all(1)])
    q = y / np.exp(np.median(logs - logs.mean(1, keepdims=True), axis=0))
    got = {(r["gene_id"], r["pb_id"]): r["value"] for r in values.collect()}
    for g in range(30):
        for i in range(12):
            v = q[g, i]
            if "mean" in trend:
                a = trend["mean"]
                want = (2 * math.asinh(math.sqrt(a * v)) - math.log(a) - math.log(4)) / math.log(2)
            else:
                a1, a0 = trend["a1"], trend["a0"]
                want = math.log2((1 + a1 + 2 * a0 * v + 2 * math.sqrt(a0 * v * (1 + a1 + a0 * v))) / (4 * a0))
            assert got[f"g{g:02}", f"p{i:02}"] == pytest.approx(want, abs=1e-6)
    assert nb is not None


def test_scores_and_reproducible_components(spark):
    rng = np.random.default_rng(0)
    shared = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 12)) * 3
    a, b = shared + rng.normal(size=(80, 12)), shared + rng.normal(size=(80, 12))
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    scores, singular, _ = decompose.svd(vectors(spark, a), 5)
    got = np.array([r["vec"] for r in sorted(scores.collect())])
    assert singular == pytest.approx(s[:5], rel=1e-9) and np.abs(got) == pytest.approx(np.abs(u[:, :5] * s[:5]), abs=1e-8)
    train, val, found = decompose.find_components(vectors(spark, a), vectors(spark, b), 6)
    ub, sb, _ = np.linalg.svd(b, full_matrices=False)
    r = np.corrcoef((u[:, :6] * s[:6]).T, (ub[:, :6] * sb[:6]).T)[:6, 6:]
    hit = np.abs(r) * math.sqrt(79) > NormalDist().inv_cdf(1 - 0.01 / 36 / 2)
    assert (found["train"], found["val"]) == (hit.any(1).sum(), hit.any(0).sum()) and found["train"] >= 2
    kept = np.array([x["vec"] for x in sorted(train.collect())])
    assert np.abs(kept) == pytest.approx(np.abs((u[:, :6] * s[:6])[:, hit.any(1)]), abs=1e-8) and len(val.first()["vec"]) == found["val"]


def modularity(n, edges, label, resolution=1.0):
    total = sum(w for _, _, w in edges)
    degree = np.zeros(n)
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
    inside = sum(w for a, b, w in edges if label[a] == label[b])
    mass = {p: sum(degree[i] for i in range(n) if label[i] == p) for p in set(label)}
    return inside / total - resolution * sum(m * m for m in mass.values()) / (4 * total * total)


def test_communities_gain_from_no_move(spark):
    rng = np.random.default_rng(5)
    edges = [(i, j, 1.0 + (i // 10 == j // 10) * 4) for i in range(40) for j in range(i) if rng.random() < (0.6 if i // 10 == j // 10 else 0.05)]
    got = {r["id"]: r["label"] for r in community.cluster(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.range(40), 1.0, 7).collect()}
    label = [got[i] for i in range(40)]
    best = modularity(40, edges, label)
    assert best >= modularity(40, edges, [i // 10 for i in range(40)]) - 1e-12
    for i in range(40):
        for p in {*label, 99}:
            assert modularity(40, edges, [p if k == i else q for k, q in enumerate(label)]) <= best + 1e-12


def test_pseudobulks_follow_boundaries_and_edges(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, (15, 2)) for c in ((0, 5), (5, 0))]) + 1
    label = ["a"] * 15 + ["b"] * 8 + ["c"] * 7
    cells = spark.createDataFrame([(i, s, "k") for i, s in enumerate(label)], "cell_id long, sample string, cluster string")
    got = pseudobulk.build(knn.one_graph(vectors(spark, x), 10), cells, cells_per_pb=5).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["pb_id"], []).append(r["cell_id"])
    assert sorted(i for g in groups.values() for i in g) == list(range(30))
    assert all(len({label[i] for i in g}) == 1 for g in groups.values())
    for s in "abc":
        sizes = [len(g) for g in groups.values() if label[g[0]] == s]
        assert len(sizes) == math.ceil(label.count(s) / 5) and max(sizes) - min(sizes) <= 1


def t_tail(t, df):
    """Two-sided tail of Student's t by the midpoint rule on a bounded scale."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    n = 20_000
    u = (np.arange(n) + 0.5) / n
    z = abs(t) + u / (1 - u)
    return 2 * float((c * (1 + z * z / df) ** (-(df + 1) / 2) / (1 - u) ** 2).mean())


def test_enrichment_of_all_columns(spark):
    rng = np.random.default_rng(8)
    genes = [f"g{i}" for i in range(60)]
    stat = {c: rng.normal(0, 1, 60) + (np.arange(60) < 12) * 1.5 for c in ("k1", "k2")}
    p = {c: np.array([math.erfc(abs(v) / math.sqrt(2)) for v in stat[c]]) for c in stat}
    de = spark.createDataFrame([(c, g, float(stat[c][i]), float(2 * stat[c][i]), float(p[c][i])) for c in stat for i, g in enumerate(genes)], "contrast string, gene string, stat double, other double, pvalue double")
    sets = {f"s{k}": [f"g{i}" for i in range(8 * k, 8 * k + 9)] + ["gone"] for k in range(6)}
    table = spark.createDataFrame([("PROMO.x", name, own) for name, own in sets.items()], "library string, pathway string, genes array<string>")

    def check(got, scale):
        for c in stat:
            want = {}
            for name, own in sets.items():
                i = [genes.index(g) for g in own if g in genes]
                v = stat[c][i] * scale[c]
                t = v.mean() / (v.std(ddof=1) / math.sqrt(len(v)))
                want[name] = (len(own), v.mean(), t, t_tail(t, len(v) - 1), [genes[j] for j in sorted(i, key=lambda j: -abs(stat[c][j])) if p[c][j] < 0.05 and stat[c][j] * t > 0])
            order = sorted(want, key=lambda n: want[n][3])
            adjusted = {n: min(min(1.0, want[m][3] * len(order) / (k + 1)) for k, m in enumerate(order) if k >= order.index(n)) for n in order}
            mine = {r["pathway"]: r for r in got if r["contrast"] == c}
            for n, (size, mean, t, tail, names) in want.items():
                r = mine[n]
                assert (r["size"], r["source"] if scale["k2"] == 1 else "promotion") == (size, "promotion") and r["mean_t"] == pytest.approx(mean) and r["enrichment_t"] == pytest.approx(t)
                assert r["p"] == pytest.approx(tail, rel=1e-4) and r["BH_adj_p"] == pytest.approx(adjusted[n], rel=1e-4)
                assert r["signed_neglog10_BH"] == pytest.approx(math.copysign(math.log10(adjusted[n]), t), rel=1e-3, abs=1e-6) and r["nom_sig_genes"] == ",".join(names)

    check(genesets.enrich(genesets.prepared(de), table, 0.05, {"PROMO": "promotion"}).collect(), {"k1": 1, "k2": 1})
    check(genesets.enrich_by_columns(de, table, {"k1": "stat", "k2": "other"}, 0.05).collect(), {"k1": 1, "k2": 2})


def test_cohort_from_correlations_to_support(spark):
    """Two blocks of genes in each of three samples, one of them in two samples only."""
    rho = []
    for s, blocks in (("s1", "ab"), ("s2", "ab"), ("s3", "a")):
        for split in ("train", "val"):
            for b in blocks:
                rho += [(s, split, f"{b}{i}", f"{b}{j}", 0.9) for j in range(6) for i in range(j)]
            if "b" in blocks:
                rho += [(s, split, f"a{i}", f"b{j}", -0.8) for i in range(3) for j in range(3)]
    cuts = [(s, split, 0.5, -0.5) for s in ("s1", "s2", "s3") for split in ("train", "val")]
    got = modules.run_cohort(spark.createDataFrame(rho, "sample string, split string, gene_a string, gene_b string, rho double"), spark.createDataFrame(cuts, "sample string, split string, cpos double, cneg double"))
    found = {}
    for r in got["modules"].collect():
        found.setdefault((r["sample"], r["module_id"]), set()).add(r["gene_id"])
        assert r["degree_pos"] == 5
    assert sorted((s, "".join(sorted(g))) for (s, _), g in found.items()) == sorted((s, "".join(f"{b}{i}" for i in range(6))) for s, bs in (("s1", "ab"), ("s2", "ab"), ("s3", "a")) for b in bs)
    support = {}
    for r in got["support"].collect():
        support.setdefault(r["replicated_module_id"], {})[r["gene_id"]] = r["support_n_samples"]
    assert sorted((min(g), len(g), set(g.values()).pop()) for g in support.values()) == [("a0", 6, 3), ("b0", 6, 2)]
    pairs = got["antagonism"].collect()
    assert len(pairs) == 2 and all((r["n_edges"], r["size_a"], r["size_b"]) == (9, 6, 6) and r["mean_rho"] == pytest.approx(-0.8) and r["edge_density"] == 0.25 for r in pairs)
