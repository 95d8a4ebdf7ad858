"""Named results, files and records."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoquill.operators import feeds, modules
from cytoquill.plans import provenance, reports, workflows
from cytoquill.plans.provenance import Envelope


def test_contrasts_by_name(spark, tmp_path):
    rows = [("a", "g1", 1.0, 0.01), ("a", "g2", -2.0, 0.05), ("a", "g3", 1.0, None), ("b vs c", "g1", 0.5, 0.2)]
    made = Envelope.create("de", {"x": 1}, {})
    r = reports.Contrasts(spark.createDataFrame(rows, "contrast string, gene_id string, log2FoldChange double, padj double"), made)
    assert r.available() == ["a", "b vs c"] and r.contrast("a").count() == 3
    with pytest.raises(KeyError, match="there are a, b vs c"):
        r.contrast("x")
    assert {tuple(x) for x in r.summary().collect()} == {("a", 3, 2, 1, 1), ("b vs c", 1, 1, 0, 0)}
    paths = r.save(str(tmp_path / "out"))
    written = [x.split("\t") for part in (tmp_path / "out" / "b_vs_c.tsv.gz").glob("*.gz") for x in gzip.open(part, "rt").read().splitlines()]
    assert ["b vs c", "g1", "0.5", "0.2"] in written and set(paths) == {"a", "b vs c", "provenance"}
    assert reports.read_provenance(spark, paths["provenance"]) == made
    assert reports.Contrasts(r.table.limit(0)).available() == []


def test_records_that_were_changed_are_found(spark, tmp_path):
    at = str(tmp_path / "p.json")
    d = Envelope.create("s", {"seed": 1}, {}).to_dict() | {"algorithm": {"seed": 2}}
    from cytoquill.sources import tables

    tables.write_json(d, at, spark)
    with pytest.raises(provenance.ProvenanceError):
        reports.read_provenance(spark, at)


def test_file_hash(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(bytes(range(256)) * 9000)
    got = reports.hash_file(spark, str(tmp_path / "f"), "artifact")
    assert got.digest == hashlib.sha256(provenance.prefix("artifact") + bytes(range(256)) * 9000).hexdigest()
    assert got.digest != reports.hash_file(spark, str(tmp_path / "f"), "other").digest


def test_results_are_saved_and_loaded(spark, tmp_path):
    made = Envelope.create("consensus", {"seed": 3}, {})
    r = workflows.Result("complete", {"t": spark.range(3)}, {"k": 10}, made)
    reports.save_result(r, str(tmp_path / "r"), spark)
    again = reports.load_result(spark, str(tmp_path / "r"))
    assert (again.status, again.diagnostics, again.provenance) == ("complete", {"k": 10}, made) and again.tables["t"].count() == 3


def test_gene_annotations(spark, tmp_path):
    at = tmp_path / "a.tsv"
    at.write_text("Gene stable ID\tGene name\tChromosome/scaffold name\tGene description\tmore\nE1\tA\t1\tfirst\tx\nE1\tB\t2\tsecond\ty\nE2\t\t3\t\tz\n")
    got = {r["gene_id"]: r for r in reports.read_gene_annotations(spark, str(at)).collect()}
    assert got["E1"]["gene_name"] == "A" and got["E1"]["gene_description"] == "first" and got["E2"]["gene_name"] == "" and got["E1"]["more"] == "x"
    at.write_text("Gene stable ID\tother\nE1\tA\n")
    with pytest.raises(KeyError, match="Gene name"):
        reports.read_gene_annotations(spark, str(at))


def test_quality_control_from_file_to_file(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", f"g{j}", int(n)) for i in range(60) for j, n in enumerate(rng.poisson(0.2 if i < 5 else 20, 300)) if n]
    spark.createDataFrame(rows, "cell_id string, gene_id string, n long").write.parquet(str(tmp_path / "counts"))
    paths = reports.run_quality_control(spark, str(tmp_path / "counts"), str(tmp_path / "out"))
    kept = spark.read.parquet(paths["counts"])
    cells = spark.read.parquet(paths["classified"])
    assert {r["cell_id"] for r in kept.select("cell_id").distinct().collect()} == {r["cell_id"] for r in cells.where("qc_keep").collect()}
    assert 0 < cells.where("qc_keep").count() < 60 or cells.count() == 60
    assert sum(r["n"] if "n" in r else r["n_cells"] for r in json.loads("".join(x[0] for x in spark.read.text(paths["summary"]).collect()))) == 60


def test_differential_expression_writes_what_it_finds(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(f"c{i}", f"s{i % 2}", "ab"[i < 40]) for i in range(80)], "cell_id string, sample string, cluster string")
    counts = [(f"c{i}", f"g{j}", int(n)) for i in range(80) for j, n in enumerate(rng.poisson(np.where(np.arange(12) < 4, 9 if i < 40 else 3, 5))) if n]
    edges = [(f"c{i}", f"c{j}", 1.0) for i in range(80) for j in range(i + 1, min(i + 4, 80))]
    sets = spark.createDataFrame([("lib", "up", ["g0", "g1", "g2", "g3"])], "library string, pathway string, genes array<string>")
    results, enriched, paths = reports.run_differential_expression(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(counts, "cell_id string, gene_id string, n long"), cells, str(tmp_path / "de"), sets)
    assert len(results.available()) == 2 and enriched.contrast(results.available()[0]).count() == 1
    up = results.summary().collect()
    assert {r["n"] for r in up} == {12} and all(r["n_up"] + r["n_down"] >= 3 for r in up)
    pb = spark.read.parquet(paths["counts"])
    assert pb.agg(F.sum("n")).first()[0] == sum(c[2] for c in counts)
    meta = spark.read.csv(paths["metadata"], header=True)
    assert meta.count() == pb.select("pb_id").distinct().count() and "cluster_proportions" in meta.columns


def test_graph_and_communities(spark):
    a = [(i, [float(np.cos(0.01 * i)), float(np.sin(0.01 * i)), 0.0]) for i in range(40)] + [(40 + i, [0.0, float(np.cos(0.01 * i)) * 0.01, 1.0]) for i in range(40)]
    got = reports.graph_and_communities(spark.createDataFrame(a, "id long, vec array<double>"), k=10, symmetrize="max")
    labels = {r["id"]: r["label"] for r in got.labels.collect()}
    assert len(labels) == 80 and not {labels[i] for i in range(40)} & {labels[i] for i in range(40, 80)}
    assert json.loads(json.dumps(got.found_by))["seed"] == 0 and got.found_by["method"] == "leiden"


def test_selection_messages_and_records(spark):
    text = reports.selection_failure(MemoryError("out of memory"), "train", 2, 1, 0.05)
    assert all(x in text for x in ("'train'", "MemoryError", "three cells", "two genes", "square"))
    assert "without feature selection" in reports.selection_failure(ValueError("x"), "val", 100, 100, 0.05)
    one = spark.createDataFrame([("a", 1, True), ("b", 0, False)], "gene_id string, n_negative long, selected boolean")
    assert reports.selection_record({"train": one, "val": one}, ["z", "y"]) == {"splits": {"train": {"genes": 2, "selected": 1}, "val": {"genes": 2, "selected": 1}}, "selected_in_all": 1, "removed_sets": ["y", "z"]}


def test_heat_maps_put_similar_rows_together(spark):
    x = np.array([[1, 0, 0], [0, 1, 0], [2, 0.1, 0], [0, 3, 0.1], [np.nan, np.nan, np.nan]])
    order = reports.cluster_order(x)
    assert sorted(order) == list(range(5)) and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    assert reports.cluster_order(x[:1]) == [0] and sorted(reports.cluster_order(x, "euclidean")) == list(range(5))
    z = spark.createDataFrame([(c, "l", f"p{i}", float(v)) for i, row in enumerate(x[:4]) for c, v in zip("abc", row, strict=True)], "contrast string, library string, pathway string, z double")
    rows, columns = reports.ordered_heatmap(feeds.heatmap_matrix(z, ["a", "b", "c"]), ["a", "b", "c"])
    at = {r["pathway"]: r["place"] for r in rows.collect()}
    assert sorted(at.values()) == [0, 1, 2, 3] and abs(at["p0"] - at["p2"]) == 1 and sorted(columns) == ["a", "b", "c"]


def test_modules_from_artifacts_with_faults(spark, tmp_path):
    def block(sample, split, first):
        return [(sample, split, f"g{first + i}", f"g{first + j}", 0.9) for j in range(6) for i in range(j)] + [(sample, split, f"g{first}", "h", -0.8)]

    rho = [r for s in ("s1", "s2") for split in ("train", "val") for r in block(s, split, 0) + block(s, split, 10)]
    rho += block("half", "train", 0) + [r for split in ("train", "val") for r in block("uncut", split, 0)] + [("flat", split, "a", "b", -0.9) for split in ("train", "val")]
    cuts = [(s, split, 0.5, -0.5) for s in ("s1", "s2", "half", "flat") for split in ("train", "val")] + [("uncut", "train", None, -0.5)]
    run = reports.run_modules_from_artifacts(spark.createDataFrame(rho, "sample string, split string, gene_a string, gene_b string, rho double"), spark.createDataFrame(cuts, "sample string, split string, cpos double, cneg double"), str(tmp_path / "m"))
    assert {tuple(r) for r in run.status.collect()} == {("s1", "complete"), ("s2", "complete"), ("half", "missing_split"), ("uncut", "missing_cutoffs"), ("flat", "no_positive_edges")}
    again = reports.read_modules(spark, str(tmp_path / "m"))
    found = {}
    for r in again.tables["modules"].where("sample = 's1'").collect():
        found.setdefault(r["module_id"], set()).add(r["gene_id"])
    assert {frozenset(x) for x in found.values()} >= {frozenset(f"g{a + i}" for i in range(6)) for a in (0, 10)}
    assert {r["sample"] for r in again.tables["modules"].select("sample").distinct().collect()} == {"s1", "s2"}


def test_publication_sets_from_results(spark):
    de = spark.createDataFrame([("k1", "g1", 0.01, 2.0), ("k1", "g2", 0.01, -2.0), ("k2", "g1", 0.5, 1.0), ("other", "g1", 0.001, 9.0)], "contrast string, gene_id string, padj double, log2FoldChange double")
    known = spark.createDataFrame([("r1", "g1", 2), ("r1", "g2", 2)], "replicated_module_id string, gene_id string, support_n_samples int")
    profiles = spark.createDataFrame([("m", "r1", 0.7)], "meta_cluster string, replicated_module_id string, profile_weight double")
    got = modules.sets_from_results(de, {"k1": "m", "k2": "m"}, known, profiles).collect()
    assert {(r["meta_cluster"], r["tier"], r["gene_id"], r["effect"]) for r in got} == {("m", "core", "g1", 2.0), ("m", "extended", "g1", 2.0)}
    assert modules.sets_from_results(de, {}, known, profiles).count() == 0
    with pytest.raises(ValueError, match="p and effect"):
        modules.sets_from_results(de.drop("padj"), {"k1": "m"}, known, profiles)


def test_artifacts_and_libraries_that_lack_something(spark, tmp_path):
    from cytoquill.sources import tables

    corr = spark.createDataFrame([("s", "train", "a", "b", 0.1), ("s", "train", "a", "b", 0.2), ("s", "val", "a", "b", 0.1), ("t", "val", "a", "c", 0.1)], "sample string, split string, gene_a string, gene_b string, rho double")
    cuts = spark.createDataFrame([("s", "train", 0.5)], "sample string, split string, cpos double")
    got = {(r["sample"], r["split"]): (r["n_genes"], r["n_splits"], r["pairs_unique"], r["cpos"]) for r in tables.artifact_index(corr, cuts).collect()}
    assert got == {("s", "train"): (2, 2, False, 0.5), ("s", "val"): (2, 2, True, None), ("t", "val"): (2, 1, True, None)}
    with pytest.raises(ValueError, match="'t'"):
        tables.artifact_index(corr, cuts, require_splits=True)
    for folder, name, text in (("own", "h.gmt", "P1\tx\tA\tB\n"), ("shipped", "h.gmt", "P9\tx\tZ\n"), ("shipped", "k.gmt", "P2\tx\tC\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    folders = [str(tmp_path / f) for f in ("gone", "own", "shipped")]
    assert {(r["library"], r["pathway"]) for r in tables.load_libraries(spark, None, folders).collect()} == {("h", "P1"), ("k", "P2")}
    assert tables.load_libraries(spark, "k", folders).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.load_libraries(spark, "x", folders)
