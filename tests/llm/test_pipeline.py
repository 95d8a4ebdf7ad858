"""The stages against the operators' brute-force rules, and the registration of all queries."""

import os
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")


def test_stages(spark):
    import corpus_pipeline
    from cytoquill.llm import minhash, quality
    from cytoquill.llm.common import read_table

    docs = read_table(spark, SF, "documents")
    (n1, quality_stage), (n2, line_stage), (n3, near_stage), (n4, packing_stage) = corpus_pipeline.STAGES
    assert (n1, n2, n3, n4) == ("quality_classifier", "line_dedup", "minhash_near_dedup", "mixture_packing")
    good = quality_stage(spark, docs, SF).persist()
    assert good.columns == docs.columns
    scored = quality.score_documents(docs, quality.train(docs, read_table(spark, SF, "labels"))).where("predicted = 1")
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in scored.collect()}
    cut = line_stage(spark, good, SF).persist()
    assert cut.columns == docs.columns
    before = {r["doc_id"]: r["text"].split("\n") for r in good.collect()}
    seen: set[str] = set()
    after = {r["doc_id"]: r["text"].split("\n") for r in cut.collect()}
    for i in sorted(after):
        assert not Counter(after[i]) - Counter(before[i])
        for line in after[i]:
            text = " ".join(line.lower().split())
            assert not text or text not in seen
            seen.add(text)
    near = near_stage(spark, cut, SF).persist()
    judged = minhash.near_duplicates(cut, 5, Fraction(4, 5)).where("kept")
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(r["doc_id"] for r in judged.collect())
    packed = packing_stage(spark, near, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in near.collect()}


def parts_of(n, links):
    part = list(range(n))

    def root(i):
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        part[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def similar(sets):
    """Pairs of a Jaccard similarity of 0.8 or more, each compared."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if 5 * len(sets[i]) < 4 * len(sets[j]):
                break
            if sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                yield i, j


def test_every_stage_equals_a_plain_version(spark):
    """The four stages over the whole table: scores by hand, all pairs of lines and of documents, and the ids of every sequence."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from cytoquill.llm import quality
    from cytoquill.llm.common import read_table

    docs = read_table(spark, SF, "documents")
    model = quality.train(docs, read_table(spark, SF, "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i: t for i, t in rows.items() if model.scores(quality.text_features([t]))[0] >= 0.7}
    assert 0 < len(good) < len(rows)

    places = {}
    for i in sorted(good):
        for k, line in enumerate((good[i] or "").split("\n")):
            if normal := " ".join(line.lower().split()):
                places.setdefault(normal, []).append((i, k))
    texts = list(places)
    part = parts_of(len(texts), similar([{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in texts]))
    stays = {}
    for p, x in zip(part, texts, strict=True):
        stays[p] = min([*places[x], *([stays[p]] if p in stays else [])])
    gone = {at for p, x in zip(part, texts, strict=True) for at in places[x] if at != stays[p]}
    cut = {}
    for i, t in good.items():
        left = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        if not any((i, k) in gone for k in range(len((t or "").split("\n")))):
            cut[i] = t
        elif any(map(str.strip, left)):
            cut[i] = "\n".join(left)

    ids = sorted(cut)
    sets = []
    for i in ids:
        ws = (cut[i] or "").encode().lower().split()
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    part = parts_of(len(ids), similar(sets))
    kept = [i for k, i in enumerate(ids) if part[k] == k]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: np.array([*library.encode(cut[i] or "", add_special_tokens=False).ids, 2], "<u4") for i in kept}
    covered, sequences = {i: [] for i in kept}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        own = tokens[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans, whole in [*((s, len(tokens[i])) for i, s in covered.items()), *((s, 4096) for k, s in sequences.items() if k != max(sequences))]:
        assert sorted(spans)[0][0] == 0 and sum(n for _, n in spans) == whole
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:]))


def test_run_packs_every_kept_document(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    whole = Counter()
    for r in rows:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert rows and all(n == k[1] for k, n in whole.items())


def test_all_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op2_url_filters", "op5_exact_topk"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    got = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(str(r[c]) for c in names) for r in df.collect()) == Counter(tuple(map(str, r)) for r in got.fetchall())
