"""The ten operators: results against brute force, and nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from cytoquill.llm import bpe, codec, licenses, lines, media, minhash, packing, quality, shingles, similarity, token_counts, topk, url_filters

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in each column, empty and blank texts, repeats, odd characters, a long text."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(40_000))
    rows = [
        (1, "Hello world, it's the MIT License.\nAgain.", "en", "a", 10), (2, "", "en", "a", 0), (3, None, None, None, None), (4, " \n\t ", "en", "b", 4),
        (1, "Hello world, it's the MIT License.\nAgain.", "en", "a", 10), (5, "Σίσυφος 中文 \x00 é é <|endoftext|> ﬁ ½", "el", None, 9), (None, "no id here at all", "en", "a", 3),
        (6, long, "en", "b", len(long)), (7, long, "en", "c", None), (8, "▁ x  y\n\n z", "", "", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """Columns of the names that operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("row", "uid", "key", "n", "ids", "part", "queue", "items", "removed", "digest", "score", "quality")})


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# BPE.
def test_codec_equals_the_library(odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, x in texts_of(odd_docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, codec.codec_digests(clash(odd_docs), WORDS).collect())) == want


def test_encoded_documents_round_trip(odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    for r in codec.encode_documents(odd_docs, WORDS).collect():
        assert r["decoded"] == t.decode(list(r["ids"]), skip_special_tokens=False)


def test_trie_and_library_agree_on_random_words():
    b = bpe.WordBpe(WORDS)
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(1, 25))) for _ in range(4000)} | {"a", "ab", "abc", "!!!", "'", "½"}
    trie = {w.decode(): ids for w, ids in b.encode_trie([w.encode() for w in words])}
    assert all(b.library.encode(w, add_special_tokens=False).ids == trie[w] for w in words)
    b.learn_by_library(words)
    assert all(np.frombuffer(b.ids[w], "<u4").tolist() == trie[w] for w in words)


def test_every_character_is_encoded_as_the_library_does():
    """Alone, inside a word, and between digits: U+0001 to U+2FFF, one text for each."""
    chars = [chr(c) for c in range(1, 0x3000)]
    texts = [t for c in chars for t in (c, f"ab{c}cd", f"{c}XY 1{c}2")]
    b = bpe.WordBpe(WORDS)
    known = b.library.encode_batch(texts, add_special_tokens=False)
    want = [np.array(e.ids, "<u4").tobytes() for e in known]
    assert b.encode(texts) == want
    b.release()
    split = b.split_all(texts)
    assert [b"".join(map(b.ids.__getitem__, ws)) for ws in split] == want
    assert [b" ".join(map(b.shown.__getitem__, ws)).decode() for ws in split] == [b.library.decode(e.ids, skip_special_tokens=False) for e in known]


def test_small_caches_change_nothing(monkeypatch, odd_docs):
    texts = [x for _, x in texts_of(odd_docs)]
    b = bpe.WordBpe(WORDS)
    whole = b.encode(texts)
    monkeypatch.setattr(bpe.WordBpe, "MOST", 3)
    assert [b.encode([x])[0] for x in texts] == whole


def test_codec_of_no_rows(no_docs):
    assert codec.codec_digests(no_docs, WORDS).count() == 0


# Token counts.
def test_token_counts_equal_the_library(odd_docs):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter(map(tuple, token_counts.count_tokens(clash(odd_docs), PIECES, 100).collect()))
    want = Counter((i, len((x or "").encode()), n := len(s.encode(x or "")), n > 100) for i, x in texts_of(odd_docs))
    assert got == want


def test_token_counts_of_odd_strings():
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(2)
    for most in (0, 5, 10_000):
        p = token_counts.PieceLengths(PIECES, {" the": 1}, most)
        for _ in range(3000):
            x = "".join(rng.choices(" \n\t▁ab,.thé中　\xa0\x00😀<s>", k=rng.randint(0, 30)))
            assert p.count(x) == len(s.encode(x))


def test_token_counts_of_no_rows(no_docs):
    assert token_counts.count_tokens(no_docs, PIECES).count() == 0


# Packing.
def check_packing(pieces, docs, length, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for i, x in docs}
    copies = Counter(i for i, _ in docs)
    sequences, cover = defaultdict(list), Counter()
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["length"] > 0 and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        cover.update((p["doc_id"], k) for k in range(p["start"], p["start"] + p["length"]))
    assert cover == Counter({(i, k): copies[i] for i in ids for k in range(len(ids[i]))})
    for k, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or k == max(sequences)


@pytest.mark.parametrize(("length", "window"), [(64, 256), (50, 50), (7, 300)])
def test_packing_places_each_token_once(spark, odd_docs, length, window):
    docs = odd_docs if length == 64 else odd_docs.where("doc_id is null or doc_id < 6 or doc_id = 8")
    check_packing(packing.pack(clash(docs), WORDS, length, window).collect(), texts_of(docs), length)


def rounds(docs, credit):
    """Deficit round robin as it is told: (round, doc_id, deficit after it) in the order of service."""
    queues = {q: [d for d in docs if d[1] == q] for q in sorted({d[1] for d in docs})}
    deficit, out, now = dict.fromkeys(queues, 0), [], 0
    while any(queues.values()):
        now += 1
        for q, waiting in queues.items():
            if not waiting:
                continue
            deficit[q] += credit[q]
            while waiting and waiting[0][2] <= deficit[q]:
                deficit[q] -= waiting[0][2]
                out.append((now, waiting.pop(0)[0], deficit[q]))
    return out


@pytest.mark.parametrize("target", [None, {"a": 0.6}, {"a": 0.75, "b": 0.25}])
def test_documents_are_served_by_deficit_round_robin(spark, target):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["one", "two", "three"], k=rng.choice([1, 5, 40, 300]))), "", "abc"[min(2, i % 7)], 0) for i in range(400)]
    got = packing.pack(spark.createDataFrame(docs, DOCS).repartition(5, "doc_id"), WORDS, 128, 512, target=target).collect()
    check_packing(got, [d[:2] for d in docs], 128)
    placed = sorted((p["sequence_id"] * 128 + p["offset"], p["round"], p["doc_id"], p["deficit"], p["source"], p["doc_tokens"]) for p in got if p["start"] == 0)
    totals = Counter()
    for *_, q, n in placed:
        totals[q] += n
    rest = sum(n for q, n in totals.items() if q not in (target or {}))
    credit = {q: max(1, round(512 * (target or {}).get(q, (1 - sum((target or {}).values())) * n / rest if rest else 0))) for q, n in totals.items()}
    # Within a queue the order is that of the partitions, as the places show it; all else follows.
    assert [(r, i, left) for _, r, i, left, _, _ in placed] == rounds([(i, q, n) for _, _, i, _, q, n in placed], credit)
    # Every window of rounds holds the shares, up to a document for each source, until a source runs out.
    last = min(max(r for _, r, _, _, q, _ in placed if q == x) for x in totals)
    served = Counter()
    for r in range(1, last):
        for _, at, _, _, q, n in placed:
            if at == r:
                served[q] += n
        for q in totals:
            assert r * credit[q] - 302 < served[q] <= r * credit[q]
    assert len(got) / len(docs) < 2


def test_any_number_of_sources_keep_their_names_and_shares(spark):
    docs = [(i, "one two three four", "", f"s{i % 5000}" if i % 2 else "hot", 0) for i in range(20_000)] + [(20_000, "no source", "", None, 0)]
    got = packing.pack(spark.createDataFrame(docs, DOCS), WORDS, 4096, 16_384, target={"hot": 0.5}).collect()
    assert {(p["doc_id"], p["source"]) for p in got} == {(d[0], d[3]) for d in docs}
    early = [p for p in got if p["round"] == 1]
    assert abs(sum(p["length"] for p in early if p["source"] == "hot") - 8192) <= 5


def test_shares_must_be_possible(odd_docs):
    for target in ({"a": 0.0}, {"a": 0.7, "b": 0.6}):
        with pytest.raises(ValueError, match="shares"):
            packing.pack(odd_docs, WORDS, target=target)


def test_packing_of_no_rows(no_docs):
    assert packing.pack(no_docs, WORDS).count() == 0


# Near-duplicates.
def brute_components(docs, width, up, down):
    sets = []
    for _, x in docs:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        sets.append({tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set())
    part = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and down * len(a & b) >= up * len(a | b):
                part = [part[j] if p == part[i] else p for p in part]
    low = {}
    for p, (i, _) in zip(part, docs, strict=True):
        low[p] = i if low.get(p) is None else low[p] if i is None else min(low[p], i)
    return Counter((i, len(s), low[p], i is None or i == low[p]) if low[p] is not None else (i, len(s), i, True) for (i, _), s, p in zip(docs, sets, part, strict=True))


def near_docs(n=40, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    docs = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.randint(1, 120))
        for _ in range(rng.choice([1, 1, 2, 9])):
            own = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.005, 0.02, 0.08]) else w for w in base]
            docs.append((len(docs), " ".join(own), "", "", 0))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("width", "up", "down"), [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates_equal_brute_force(spark, width, up, down):
    docs = near_docs()
    got = minhash.near_duplicates(clash(spark.createDataFrame(docs, DOCS)), width, Fraction(up, down)).collect()
    assert Counter(map(tuple, got)) == brute_components([d[:2] for d in docs], width, up, down)


def test_near_duplicates_of_odd_rows(odd_docs):
    got = minhash.near_duplicates(odd_docs, 3, Fraction(85, 100)).collect()
    assert Counter(map(tuple, got)) == brute_components(texts_of(odd_docs), 3, 85, 100)


def test_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 900)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(80)] = f"x{rng.random()}"
        docs.append((i, " ".join(own), "", "", 0))
    got = minhash.near_duplicates(spark.createDataFrame(docs, DOCS), 3, Fraction(85, 100)).collect()
    assert Counter(map(tuple, got)) == brute_components([d[:2] for d in docs], 3, 85, 100)


def test_one_of_each_group_stays(spark, odd_docs):
    docs = near_docs(15, 3)
    kept = minhash.keep_one(clash(spark.createDataFrame(docs + docs[:3], DOCS)))
    assert "row" in kept.columns and kept.first()["row"] == "x"
    want = {k[0] for k in brute_components([d[:2] for d in docs], 5, 4, 5) if k[3]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert minhash.keep_one(odd_docs).where("doc_id = 1").count() == 1


def test_near_duplicates_of_no_rows(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.keep_one(no_docs).count() == 0


def test_hot_keys_are_joined_apart(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, i) for i in range(300) for k in ([0] if i < 200 else [i, None])], "k long, i long")
    other = spark.createDataFrame([(k, 10 * k) for k in range(0, 300, 2)], "k long, v long")
    hot = rows.groupBy("k").count().where(F.col("count") * 4 > 300).where("k is not null")
    for how in ("inner", "left"):
        got = similarity.join_hot(rows, other, ["k"], hot, how)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(other, ["k"], how).collect()))
    assert [r["k"] for r in hot.collect()] == [0]


def test_tables_are_small_by_bytes_not_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.range(10).withColumn("lines", F.sequence(F.lit(1), F.lit(1000)))
    assert similarity.few(df, "lines") and similarity.few(df)
    monkeypatch.setattr(similarity, "FEW_BYTES", 10_000)
    assert not similarity.few(df, "lines") and similarity.few(df)


def test_few_and_many_links_agree():
    rng = np.random.default_rng(0)
    for _ in range(50):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0, 0.05, 0.2]), rng.integers(0, 1 << 40, 60).astype(np.uint64), base)) for _ in range(10)]
        uids, blocks = list(range(10)), [0] * 10

        def groups(edges, n=10):
            part = list(range(n))
            for a, b in zip(*edges, strict=True):
                part = [part[a] if p == part[b] else p for p in part]
            return {frozenset(i for i in range(n) if part[i] == p) for p in part}

        assert groups(similarity._few_links(uids, blocks, sets, 3, 4, 5)) == groups(similarity._many_links(uids, blocks, sets, 3, 4, 5))


def test_signatures_estimate_similarity():
    texts = [" ".join(f"w{i}" for i in range(a, a + 400)) for a in (0, 40)]
    a, b = shingles.word_shingles(texts, 3)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = shingles.signatures([a, b], 1024)
    assert abs((s[0] == s[1]).mean() - true) < 0.06
    t = shingles.match_threshold(32, 0.85)
    assert 10 < t < 24


# Lines.
def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    pool = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(2, 30))) for _ in range(60)]
    docs = []
    for i in range(60):
        own = [rng.choice(pool) if rng.random() < 0.4 else " ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(9)) for _ in range(6)]
        own = [x if rng.random() < 0.5 or len(x) < 80 else x[:30] + "#" + x[31:] for x in own]
        docs.append((i, "\n".join([*own, "", "Of.", "Of\tby" if i % 2 else "of  by "]), "en", "a", 7))
    got = {r["doc_id"]: r for r in lines.line_report(clash(spark.createDataFrame(docs, DOCS))).collect()}
    places = defaultdict(list)
    for i, x, *_ in docs:
        for k, line in enumerate(x.split("\n")):
            if normal := " ".join(line.lower().split()):
                places[normal].append((i, k))
    texts = list(places)
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    want = set()
    for p in set(part):
        want |= set(sorted(at for q, x in zip(part, texts, strict=True) if q == p for at in places[x])[1:])
    mine = {(i, k) for i, r in got.items() for k in r["removed"]}
    assert mine == want and all(r["n_lines"] == 9 and r["n_kept"] == 9 - len(r["removed"]) for r in got.values())


def test_pairs_just_over_the_threshold_are_linked(spark):
    rng = random.Random(12)
    docs = []
    for i in range(1200):
        line = rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(94, 104))
        other = line.copy()
        for at in (rng.randint(10, 40), rng.randint(55, 80)):
            other[at] = "#"
        a, b = ({"".join(x[j : j + 5]) for j in range(len(x) - 4)} for x in (line, other))
        assert 80 * len(a | b) <= 100 * len(a & b) <= 85 * len(a | b)
        docs += [(2 * i, "".join(line), "en", "a", 9), (2 * i + 1, "".join(other), "en", "a", 9)]
    got = {r["doc_id"]: r["removed"] for r in lines.line_report(spark.createDataFrame(docs, DOCS)).collect()}
    missed = [i for i in range(1200) if (got[2 * i], got[2 * i + 1]) != ([], [0])]
    assert not missed


def test_lines_are_normalised_alike_on_both_ways():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choices("aB  \n\t\r\x1c\x85\xa0\u2003\u3000ΣİßéÄ.'", weights=[9, 5, 3, 3, 3, *[0.2] * 7, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 30)))
        assert lines.normal_lines(text) == [" ".join(x.lower().split()) for x in text.split("\n")]


def test_signatures_of_both_kinds_overlap():
    """Each two sets of a similarity of 0.8 or more have a kind in common, and coordinates of the binned kind are equal as often as the sets are similar."""
    rng = random.Random(6)
    for n in [*range(40, 70), 300]:
        a = "".join(rng.choices("abcdefghijklmnop", k=n))
        b = a[: n // 2] + "#" + a[n // 2 + 1 :]
        long, binned, short, _ = shingles.line_signatures([a, b, "xyz", "aaaa" * 30], 5, 276)
        x, y = ({t[i : i + 5] for i in range(n - 4)} for t in (a, b))
        assert {0, 1} <= set(long) or {0, 1} <= set(short)
        assert {2, 3} <= set(short) and not {2, 3} & set(long)
        if n == 300:
            assert abs((binned[:, 0] == binned[:, 1]).mean() - len(x & y) / len(x | y)) < 0.1


def test_lines_are_taken_out(spark, odd_docs):
    docs = clash(spark.createDataFrame([(1, "a first line of text\nsecond line here", "en", "a", 9), (2, "A first  line of text\nmy very own line\n", "en", "a", 9), (3, "second line here", "en", "a", 9), (4, None, "en", "a", None), (5, "", "en", "a", 0)], DOCS))
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["row"]) for r in out.collect()} == {
        1: ("a first line of text\nsecond line here", 9, "x"), 2: ("my very own line\n", 17, "x"), 4: (None, None, "x"), 5: ("", 0, "x"),
    }
    report = Counter((r["doc_id"], r["n_lines"], r["n_kept"]) for r in lines.line_report(odd_docs).collect())
    assert report[1, 2, 2] == 2 and report[3, 0, 0] == 1 and report[7, 1, 0] == 1  # 7 repeats 6


def test_lines_of_no_rows(no_docs):
    assert lines.line_report(no_docs).count() == 0 and lines.dedup_lines(no_docs).count() == 0


# URLs.
def test_url_rules(spark):
    pages = [(1, "http://A.Example.org/es/1?x"), (2, "https://example.org/en/12#y"), (3, "http://notexample.org"), (4, "http://x.com/fr/"), (5, "ftp://x.com/de/a://b"), (6, None), (7, "no scheme/com/fr/"), (8, "http://x.com?q=/fr/"), (8, "http://x.com?q=/fr/"), (9, "http://x.org/y")]
    got = url_filters.judge_urls(clash(spark.createDataFrame(pages, "page_id long, url string")), spark.createDataFrame([], "page_id long, good int")).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("notexample.org", "", None, "allow"), 4: ("x.com", "/fr/", "com/fr/", "allow"),
        5: ("x.com", "/de/a://b", "com/de/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("x.com", "", None, "allow"), 9: ("x.org", "/y", "org/", "allow"),
    }
    assert len(got) == 10


def test_very_long_urls(spark):
    host, path = "h" * 300_000 + ".org", "/" + "p" * 2_000_000
    pages = spark.createDataFrame([(1, f"http://{host}{path}?{'q' * 1_000_000}"), (2, "x" * 1_000_000), (3, "http://" + "a." * 50_000 + "com/fr/"), (4, "://" * 100_000)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.judge_urls(pages, spark.createDataFrame([(1, 1)], "page_id long, good int")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == (host, path, "org/") and (got[2]["host"], got[2]["path"]) == ("", "")
    assert got[3]["rule"] == "com/fr/" and got[3]["registered_domain"] == "a.com" and (got[4]["host"], got[4]["path"]) == (":", "//" + "://" * 99_998)


def test_bad_hosts_are_blocked_on_evidence(spark):
    pages = [(i, f"http://{'bad' if i < 40 else f'h{i % 20}'}.site{'x' if i < 40 else i % 7}.net/a") for i in range(400)] + [(1000, "http://once.sitez.net/"), (1001, "http://bad.sitex.net/new")]
    labels = [(i, int(i >= 40)) for i in range(0, 400, 2)] + [(1000, 0), (3, None), (None, 1)]
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).collect()}
    assert all(got[i] == ("block" if i < 40 else "allow") for i in range(400)) and got[1001] == "block" and got[1000] == "allow"


def test_suffixes(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x",), ("",), ("w.x.com",), ("a.b.com.br",), ("x.b.co.site",), ("y.go.jp",)], "h string").select(url_filters.domain_of(F.col("h")), url_filters.suffix_of(F.col("h"))).collect()
    assert list(map(tuple, r)) == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x", "x"), ("", ""), ("x.com", "com"), ("b.com.br", "com.br"), ("co.site", "site"), ("y.go.jp", "go.jp")]
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, good int")).count() == 0


# Media.
def test_html_becomes_a_sequence():
    page = '<head><title>t</title></head><p>One <b>two</b></p><figure><img src="sha256:AB" alt="old"><figcaption>New &amp; <i>own</i></figcaption></figure>tail<img src="x.png" alt="alt"><script>no</script><img>'
    assert [(i["kind"], i["text"], i["digest"], i["source"], i["caption"]) for i in media.parse_sequence(page)] == [
        ("text", "One two", None, None, None), ("media", None, "ab", "sha256:AB", "New & own"), ("text", "tail", None, None, None), ("media", None, None, "x.png", "alt"),
    ]
    assert media.parse_sequence(None) == media.parse_sequence("") == []
    assert media.parse_sequence("<p>a<div>b") and [i["position"] for i in media.parse_sequence(page)] == [0, 1, 2, 3]


def test_pages_with_open_elements_keep_their_text():
    texts = lambda page: [i["text"] or i["source"] for i in media.parse_sequence(page)]
    assert texts("<head><title>t</title><meta x><body>one<p>two") == ["one", "two"]
    assert texts("<head><title>t</title><p>one") == ["one"] and texts("<head>plain text") == ["plain text"]
    assert texts("<p>a<noscript>b<p>c") == ["ab", "c"] and texts("<p>a<noscript>b</noscript>c") == ["ac"]
    assert texts("<p>a<style>b<p>c")[0].startswith("a") and texts("<p>a<style>b</style><style>c<p>d")[-1] == "d"
    page = '<figure><img src="x"><figcaption>cap</figure><p>after'
    assert texts(page) == ["x", "after"] and media.parse_sequence(page)[0]["caption"] == "cap"
    assert texts('<figure><img src="x"><figcaption>cap<p>after') == ["x", "cap", "after"]
    assert texts('<figure><img src="x"></figure><figcaption>a</figcaption>b') == ["x", "a", "b"]
    assert media.parse_sequence('<img src="sha256:00" data-bytes="12"><img src="y" data-bytes="x">')[0]["bytes"] == 12


def test_every_column_of_the_media_query(spark, tmp_path, odd_docs):
    """Against sizes, digests and PNG files made here: nulls, empty, repeated and very long texts."""
    import struct

    from cytoquill.llm import queries

    clash(odd_docs).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, text in texts_of(odd_docs):
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        rows = b"".join(b"\0" + padded[k : k + 64] for k in range(0, len(padded), 64))
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(padded) // 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")
        lines = text.split("\n") if text else []
        position = sum(bool(x.split()) for x in lines[: len(lines) // 2])
        share = Counter(padded)
        mode = max(share.values()) / len(padded)
        mean = sum(padded) / len(padded)
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(png), hashlib.sha256(png).hexdigest(), position, f"{len(raw)} bytes of text", f"{mean:.4f}", f"{mode:.4f}"] += 1
    got = queries.op3_media_columns(spark, str(tmp_path))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "position", "caption")
    assert Counter((*(r[c] for c in columns), *re.fullmatch("mean=(.*);sd=.*;entropy=.*;mode=(.*)", r["feature"]).groups()) for r in got.collect()) == want


def test_page_sequences_equal_a_plain_reading(spark):
    """The texts of the test pages, cut out by patterns, which will do for their few elements."""
    import html
    import os

    from cytoquill.llm import queries

    at = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(at):
        pytest.skip("no test data")
    want = Counter()
    for r in spark.read.parquet(f"{at}/pages.parquet").collect():
        page = re.sub(r"(?is)<!doctype.*?>|<!--.*?-->|<head>.*?</head>", "", r["html"] or "")
        parts = re.split(r"(?i)</?(?:p|div|li|h1|article|br|ul|nav|footer|body|html)\b[^>]*>", page)
        texts = [t for t in (" ".join(html.unescape(re.sub(r"</?\w[^>]*>", "", p)).split()) for p in parts) if t]
        want[r["page_id"], len(texts), len(texts), hashlib.sha256("\n".join(texts).encode()).hexdigest()] += 1
    assert Counter(map(tuple, queries.media_page_sequences(spark, at).collect())) == want


def test_references_resolve_in_place(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:aa"><p>x</p><img src="sha256:zz"><img src="sha256:aa" alt="c">'), (2, None)], "page_id long, html string")
    got = media.resolve(media.interleave(clash(pages)), spark.createDataFrame([("aa", 5, "p")], "digest string, bytes int, position string")).orderBy("id", "position").collect()
    assert [(r["position"], r["kind"], r["media_bytes"], r["caption"]) for r in got] == [(0, "media", 5, None), (1, "text", None, None), (2, "media", None, None), (3, "media", 5, "c")]


def test_payloads_round_trip():
    for raw in (b"", b"a", b"x" * 64, bytes(range(256)) * 3):
        p = media.pad(raw)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(raw) and media.read_back(media.store(p)) == p
    stored = bytearray(media.store(media.pad(b"abc")))
    stored[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.read_back(bytes(stored))
    with pytest.raises(ValueError):
        media.store(b"x")


def test_text_media(odd_docs, no_docs):
    f = {r["digest"]: r for r in media.media_features(media.text_media(clash(odd_docs))).collect()}
    want = {hashlib.sha256(media.pad((x or "").encode())).hexdigest() for _, x in texts_of(odd_docs)}
    assert set(f) == want and all(r["payload_sha256"] == d for d, r in f.items())
    assert media.text_media(no_docs).count() == 0


# Search.
def brute_top(rows, k):
    out = []
    v = [(i, [int(np.floor(1024 * np.float64(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for q, a in v:
        if q % 100 == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in v if c != q and len(b) == len(a)))[:k]
            out += [(q, r + 1, c, -m) for r, (m, c) in enumerate(s)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(700, 8)).astype(np.float32)
    points[200:400] = points[200]
    rows = [(int(i), [float(x) for x in p]) for i, p in zip(rng.permutation(700), points, strict=True)]
    rows += [(None, rows[0][1]), (900, None), (1000, [float("nan")] * 8), (1100, [1.0, None] + [0.0] * 6), (1200, [float("inf")] * 8), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1400, []), (1500, [0.5] * 8)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(5)
    v = topk.quantized(df)
    q = v.where("vec_id % 100 = 0")
    want = brute_top([(i, None if e is None else [None if x is None else np.float32(x) for x in e]) for i, e in rows], 10)
    assert sorted(map(tuple, topk.top_k(v, q).collect())) == want
    assert sorted(map(tuple, topk.top_k(v, q, shard=60, block=3).collect())) == want
    assert topk.top_k(v.limit(0), q.limit(0)).count() == 0


def test_every_pass_reads_the_vectors_once(spark):
    rng = np.random.default_rng(5)
    v = topk.quantized(spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(500)], "vec_id long, embedding array<double>"))
    plans = [topk.top_k(v, v.where(f"vec_id % {m} = 0"), block=10)._jdf.queryExecution().optimizedPlan().toString() for m in (100, 2)]
    assert plans[0].count("Relation") == plans[1].count("Relation") == 2  # the stored vectors, the stored queries


def test_scores_that_doubles_cannot_hold_are_an_error(spark):
    v = topk.quantized(spark.createDataFrame([(1, [1e10, 1.0]), (2, [3e9, 2.0]), (100, [1e10, 5.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(v, v.where("vec_id = 100")).collect()


@pytest.mark.parametrize("leaf", [1, 5, 500])
def test_search_of_one_tree_equals_all_products(leaf):
    rng = np.random.default_rng(leaf)
    x = np.floor(rng.normal(size=(300, 6)) * 50)
    x[100:200] = x[7]
    q = np.concatenate([x[:20], np.floor(rng.normal(size=(20, 6)) * 50), np.zeros((1, 6))])
    qids = np.arange(41)
    tree = topk.BallTree(np.arange(300), x, leaf)
    for floor in (np.full(41, -np.inf), np.sort(q @ x.T, 1)[:, -12]):
        ids, scores = tree.search(qids, q, 10, floor.copy())
        for i in range(41):
            s = x @ q[i]
            s[qids[i]] = -np.inf if qids[i] < 300 else s[qids[i]]
            top = np.lexsort((np.arange(300), -s))[:10]
            assert list(ids[i]) == list(top) and list(scores[i]) == list(s[top])


def test_ball_tree_visits_few_nodes_of_clear_clusters():
    rng = np.random.default_rng(0)
    x = np.floor(np.repeat(rng.normal(size=(8, 8)) * 1000, 500, 0) + rng.normal(size=(4000, 8)))
    t = topk.BallTree(np.arange(4000), x, 64)
    seen = []
    t.points = type("Counted", (), {"__getitem__": lambda self, s, p=t.points: seen.append(1) or p[s]})()
    ids, _ = t.search(np.array([-1]), x[:1], 10, np.array([-np.inf]))
    scores = x @ x[0]
    assert set(ids[0]) == set(np.lexsort((np.arange(4000), -scores))[:10]) and len(seen) < len([n for n in t.nodes if n[2] < 0]) / 2


# Licences.
def test_phrases_and_notices(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in licenses.license_summary(licenses.scan_licenses(clash(odd_docs))).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["score"]) == (8, 1, 5, "mit", 1.0)
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["labels"], got[3]["score"]) == (0, 0, None, "", 0.0)
    assert licenses.scan_licenses(no_docs).count() == 0


def test_fuzzy_hits_equal_a_search_without_seeds():
    import regex

    rng = random.Random(8)
    search = licenses.NoticeSearch()
    for _ in range(150):
        n = rng.choice(licenses.NOTICES)
        own = list(n.text)
        for _ in range(rng.randint(0, n.edits + 2)):
            i = rng.randrange(len(own))
            own[i : i + 1] = rng.choice([[], [rng.choice("xyz")], [own[i], rng.choice("xyz")]])
        text = "some words before " + "".join(own) + " and after it"
        for k, m in enumerate(search.notices):
            direct = regex.search(f"(?b)(?:{regex.escape(m.text)}){{e<={m.edits}}}", text)
            mine = [h for h in search.find(text) if h[0] == k]
            assert bool(direct) == bool(mine)
            assert all(e <= m.edits and 0 <= a < b <= len(text) for _, a, b, e in mine)
            assert not direct or min(h[3] for h in mine) == sum(direct.fuzzy_counts)


def test_every_column_of_the_summary_equals_a_plain_search(spark, odd_docs):
    rng = random.Random(17)
    bits = ["MIT", "License", "license", "Apache", "general", "public", "the", "é中", "GNU General Public License", "all rights reserved", "all rihgts reserved", " released into the public domain "]
    docs = [(i, rng.choice(["", " "]).join(rng.choice(bits) + rng.choice([" ", "  ", "-", "\n", "_"]) for _ in range(rng.randint(0, 40))), "en", "a", 9) for i in range(100, 160)]
    rows = spark.createDataFrame(docs, DOCS).union(odd_docs)
    search = licenses.NoticeSearch()
    want = Counter()
    for i, text in texts_of(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        # Notices by the library alone, over the whole text; the long one is left to the tests of spans.
        found = set() if len(low) > 10_000 else {n.label for n, first in zip(search.notices, search.first, strict=True) if first.search(low)}
        base = {label for _, label in at}
        want[i, len(ws), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | found))] += 1
    got = licenses.license_summary(licenses.scan_licenses(clash(rows))).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) and (r["score"] == 1 or not r["n_base"]) for r in got)


def test_texts_that_repeat_seeds_cost_little():
    import time

    search = licenses.NoticeSearch()
    began = time.process_time()
    assert search.find("permission is hereby " * 1000) == search.find("to any person " * 1000) == []
    assert time.process_time() - began < 1
    assert len(search.find("permission is hereby granted, free of charge, to any person obtaining a copy. " * 100)) == 100


def test_every_hit_of_a_list_is_found():
    import regex

    search = licenses.NoticeSearch()
    two = "gnu general public licence, gnu general public license"
    k = next(k for k, n in enumerate(search.notices) if n.label == "gpl")
    assert [h[1:] for h in search.find(two) if h[0] == k] == [(0, 26, 1), (28, 54, 0)]
    rng = random.Random(21)
    for _ in range(150):
        k = rng.randrange(len(search.notices))
        n, text, planted = search.notices[k], rng.choice(["", "a list: "]), []
        for _ in range(rng.randint(2, 5)):
            own = list(n.text)
            for i in rng.sample(range(3, len(own) - 3), rng.randint(0, n.edits)):
                own[i] = rng.choice(["z", "", own[i] + "z"])
            planted.append((len(text), len(text) + len("".join(own))))
            text += "".join(own) + rng.choice([", ", "; ", " and ", "\n"])
        hits = [h[1:] for h in search.find(text) if h[0] == k]
        assert len(hits) == len(planted) and all(min(b, d) - max(a, c) > (d - c) / 2 for (a, b, _), (c, d) in zip(hits, planted, strict=True))
        # Without seeds: the best of each planted copy, with what lies about it, and nothing in between.
        pattern = regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}")
        want = [pattern.search(text, a and a - 1, b + 1) for a, b in planted]
        assert [e for _, _, e in hits] == [sum(m.fuzzy_counts) for m in want]
        ends = [0, *[x for a, b, _ in hits for x in (a, b)], len(text)]
        assert not any(pattern.search(text, a, b) for a, b in zip(ends[::2], ends[1::2], strict=True))


# Quality.
def test_the_commonest_word_counts_wherever_it_stands():
    words = [f"w{i}" for i in range(300)] + ["again"] * 100
    at = quality.FEATURES.index("commonest_word")
    a, b, c = quality.text_features([" ".join(words), " ".join(words[::-1]), " \n"])[:, at]
    assert a == b == 0.25 and c == 0


def plain_features(text):
    """What the names of ``quality.FEATURES`` say, byte by byte and word by word."""
    raw = (text or "").encode()
    if not raw:
        return dict.fromkeys(quality.FEATURES, 0.0)
    words, lines, share = raw.lower().split(), raw.split(b"\n"), Counter(raw)
    distinct = set(words)
    of = lambda chars: sum(share[ord(c)] for c in chars)
    upper, lower, n = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("abcdefghijklmnopqrstuvwxyz"), max(len(words), 1)
    return {
        "log_bytes": np.log(1 + len(raw)), "log_words": np.log(1 + len(words)), "word_bytes": sum(map(len, distinct)) / max(len(distinct), 1),
        "log_longest_word": np.log(1 + max([len(w) for w in words], default=0)), "log_line_bytes": np.log(1 + len(raw) / len(lines)), "upper": upper / max(upper + lower, 1),
        "digit": of("0123456789") / len(raw), "symbol": of("#$%&*@^~<>{}[]=+\\/_") / len(raw), "stop": of(".") / n, "comma": of(",;:") / n, "bang": of("!?") / n, "pipe": of("|") / n,
        "space": of(" \t\r\n\v\f") / len(raw), "non_ascii": sum(b >= 128 for b in raw) / len(raw), "distinct_words": len(distinct) / n, "distinct_lines": len(set(lines)) / len(lines),
        "commonest_word": max([words.count(w) for w in distinct], default=0) / n, "repeated_neighbours": sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n,
        "compressed": len(zlib.compress(raw, 1)) / len(raw), "entropy": -sum(c / len(raw) * np.log2(c / len(raw)) for c in share.values()),
    }


def test_features_equal_a_plain_version():
    rng = random.Random(11)
    texts = [None, "", " \n\t ", "the the cat cat", "A" * 300, "x " * 5000 + "y", "\n\n|", "é ü 中文!?"]
    texts += ["".join(rng.choices("aAbB zZ09.,;!?|#\n\té中", k=rng.randint(1, 400))) for _ in range(60)]
    got = quality.text_features(texts)
    for row, text in zip(got, texts, strict=True):
        want = plain_features(text)
        assert np.allclose(row, [want[f] for f in quality.FEATURES], atol=1e-9), (text, dict(zip(quality.FEATURES, row, strict=True)), want)


def test_scores_of_odd_rows(spark, odd_docs):
    """Very long texts, repeats, nulls; labels that repeat an id, and columns of the labels' names beside the texts."""
    rows = texts_of(odd_docs)
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, None), (8, 1), (None, 1), (4, 0)], "doc_id long, quality int")
    model = quality.train(clash(odd_docs), labels, rows=3)
    got = quality.score_documents(clash(odd_docs), model).collect()
    scores = model.scores(quality.text_features([t for _, t in rows]))
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in got) == Counter((i, round(s, 9)) for (i, _), s in zip(rows, scores.tolist(), strict=True))
    x = quality.text_features([rows[0][1], rows[7][1]])
    by_hand = np.full(2, model.intercept)
    for f, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
        by_hand += [table[sum(v >= e for e in edges)] for v in x[:, f]]
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        by_hand += [table[sum(u >= e for e in model.pair_edges[a]), sum(v >= e for e in model.pair_edges[b])] for u, v in zip(x[:, a], x[:, b], strict=True)]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-by_hand)))


def test_model_learns_and_holds_out(spark):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(500)]
    good = lambda: ". ".join(" ".join(rng.choices(words, k=9)).capitalize() for _ in range(rng.randint(1, 9))) + "."
    bad = lambda: rng.choice([lambda: "!! ".join(rng.choices(words, k=60)).upper(), lambda: "%%% ".join(rng.choices(words, k=50)), lambda: "Same thing. " * 40])()
    docs = [(i, (good if i % 3 else bad)(), "en", "a", 0) for i in range(900)] + [(5000, None, None, None, None), (5001, "", "", "", 0)]
    labels = [(i, int(i % 3 > 0)) for i in range(900)] + [(None, 1), (3, None), (9999, 0), (4, 1)]
    d, y = clash(spark.createDataFrame(docs, DOCS)).drop("quality"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(d, y)
    got = {r["doc_id"]: r for r in quality.score_documents(d, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == 902 and sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) / len(held) > 0.97
    flipped = spark.createDataFrame([(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels], "doc_id long, quality int")
    assert np.allclose(quality.train(d, flipped).scores(quality.text_features([docs[1][1]])), model.scores(quality.text_features([docs[1][1]])))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    kept = quality.keep_good(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    alone = quality.fit_gam(x[:2000], y[:2000], pairs=0).scores(x[2000:])
    both = quality.fit_gam(x[:2000], y[:2000]).scores(x[2000:])
    assert ((alone > 0.5) == y[2000:]).mean() < 0.65 and ((both > 0.5) == y[2000:]).mean() > 0.9


def test_quality_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(odd_docs, none)
    assert {r["score"] for r in quality.score_documents(odd_docs, model).collect()} == {0.5}
    assert quality.score_documents(no_docs, quality.train(no_docs, none)).count() == 0
