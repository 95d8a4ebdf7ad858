"""Fuzzy line dedup: MinHash bands over character shingles, exact confirmation, union-find."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm import shingles, similarity
from cytoquill.llm.common import discard, map_batches, materialize, pieces
from cytoquill.llm.minhash import ROW, row_keys


#: A bucket of keys is to hold so many, in the mean; it is one task's at a time.
BUCKET_KEYS = 1 << 20
#: Keys name their lines by so many bits of the digest; what agrees in these is told apart afterwards.
NEAR = (1 << 48) - 1
#: White space beside spaces and line feeds.
_OTHER_SPACES = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normal_lines(text: str) -> list[str]:
    """What of each line counts: lower case, white space as single spaces, none at the ends."""
    low = text.lower()
    if "  " in low or any(c in low for c in _OTHER_SPACES):
        return [" ".join(x.split()) for x in low.split("\n")]
    return [x.strip(" ") for x in low.split("\n")]


def digests(texts: Iterable[str]) -> np.ndarray:
    """A row of two 64-bit integers for each text."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts]), "<i8").reshape(-1, 2)


def bands(texts: list[str], width: int, count: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of texts, each of ``rows`` coordinates: the numbers of texts, and ``count`` rows with a key for each; some texts stand there twice."""
    odd = np.random.default_rng(5).integers(1, 1 << 63, (rows, count, 1), dtype=np.uint64) | np.uint64(1)
    numbers, found = [], []
    for first in range(0, len(texts), 512):  # blocks that stay in the cache
        long, binned, short, hashed = shingles.line_signatures(texts[first : first + 512], width, count * rows)
        for number, signatures, kind in ((long, binned, 0), (short, hashed, count)):  # the two kinds never meet
            s = signatures.reshape(rows, count, len(number))
            keys = s[0] * odd[0]
            for i in range(1, rows):
                keys += s[i] * odd[i]
            keys += np.arange(kind, kind + count, dtype=np.uint64)[:, None]
            numbers.append(number + first)
            found.append(shingles._mixed(keys))
    return np.concatenate(numbers), np.concatenate(found, axis=1)


def split_lines(docs: DataFrame) -> DataFrame:
    """``row, row2, doc_id, line, hi, lo, chars`` of each line that isn't blank; hi and lo are the digest of what counts of it.

    Besides, a row for each document, with the number of its lines as ``chars`` and no line and digest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):  # small, so that arrays stay in the cache
                new: dict[str, int] = {}
                at: list[int] = []  # of each line, among the new ones
                owner: list[int] = []
                number: list[int] = []
                sizes: list[int] = []
                for d, text in enumerate(part.column(3).to_pylist()):
                    own = normal_lines(text) if text else ()
                    sizes.append(len(own))
                    for i, line in enumerate(own):
                        if line:
                            at.append(new.setdefault(line, len(new)))
                            owner.append(d)
                            number.append(i)
                none = pa.nulls(part.num_rows)
                names = ["row", "row2", "doc_id", "line", "hi", "lo", "chars"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(sizes, pa.int32())], names=names)
                if not at:
                    continue
                places = np.array(at)
                digest = digests(new)[places]
                chars = np.array([len(x) for x in new], np.int32)[places]
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(own) for i in range(3)), pa.array(number, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(chars)], names=names)

    return map_batches(docs.select("row", "row2", "doc_id", "text"), run, "row long, row2 long, doc_id long, line int, hi long, lo long, chars int")


def postings(docs: DataFrame, width: int, count: int, rows: int, bits: int) -> DataFrame:
    """``bucket, keys, low, high``: the band keys of each batch's distinct lines of ``width`` characters or more, packed by the first ``bits`` bits of the key.

    ``keys`` has 32 further bits of each key, ``low`` and ``high`` 48 bits of its line's digest. Packed, a key moves in
    10 bytes; lines that agree in these bits only are told apart by the exact check. Shorter lines are linked with equal ones only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                distinct = list({line: None for text in part.column(0).to_pylist() if text for line in normal_lines(text) if len(line) >= width})
                for first in range(0, len(distinct), 16_384):  # short lines are many
                    yield packed(distinct[first : first + 16_384])

    def packed(lines: list[str]) -> pa.RecordBatch:
        whose, found = bands(lines, width, count, rows)
        keys = found.reshape(-1)
        near = np.tile(digests(lines)[:, 0].view(np.uint64)[whose], count)
        bucket = (keys >> np.uint64(64 - bits)).astype(np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        bucket, near = bucket[order], near[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cuts, len(bucket))
        columns = [
            pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
            for x in ((keys >> np.uint64(32 - bits)).astype(np.uint32)[order], near.astype(np.uint32), (near >> np.uint64(32)).astype(np.uint16))
        ]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *columns], names=["bucket", "keys", "low", "high"])

    return map_batches(docs.select("text"), run, "bucket int, keys binary, low binary, high binary")


def line_stars(packed: DataFrame) -> DataFrame:
    """``leader, near`` of ``postings``, as ``similarity.stars`` has them: a key's leader is its line of the smallest ``near``. A task holds one bucket at a time."""

    def whole(keys: list[np.ndarray], near: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of keys that come more than once, the lines, sorted; equal ones once."""
        k, u = np.concatenate(keys), np.concatenate(near)
        order = np.sort(k.astype(np.uint64) << np.uint64(32) | np.arange(len(k), dtype=np.uint64))
        k, u = (order >> np.uint64(32)).astype(np.uint32), u[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        same = k[1:] == k[:-1]
        more = np.append(False, same) | np.append(same, False)
        once_k, once_u = k[~more], u[~more]
        k, u = k[more], u[more]
        order = np.lexsort((u, k))
        k, u = k[order], u[order]
        new = np.append(True, (k[1:] != k[:-1]) | (u[1:] != u[:-1])) if len(k) else np.empty(0, bool)
        return np.concatenate([k[new], once_k]), np.concatenate([u[new], once_u])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, near, size, limit = None, [], [], 0, 1 << 21

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            k, u = whole(keys, near)
            new = np.append(True, k[1:] != k[:-1])
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(k)))
            shared = np.repeat(counts > 1, counts)
            if shared.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(u[first], counts)[shared]), pa.array(u[shared])], names=["leader", "near"])

        for batch in batches:
            for bucket, k, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from flush()
                    now, keys, near, size, limit = bucket, [], [], 0, 1 << 21
                keys.append(np.frombuffer(k, np.uint32))
                near.append(np.frombuffer(high, np.uint16).astype(np.int64) << 32 | np.frombuffer(low, np.uint32))
                size += len(keys[-1])
                if size > limit:  # lines that stand in many batches count once
                    k, u = whole(keys, near)
                    keys, near, size, limit = [k], [u], len(k), 2 * max(len(k), 1 << 20)
        yield from flush()

    return map_batches(packed.repartition("bucket").sortWithinPartitions("bucket"), run, "leader long, near long").distinct()


def find_removals(docs: DataFrame, similarity_at_least: Fraction = Fraction(4, 5), width: int = 5, count: int = 46, rows: int = 6) -> tuple[DataFrame, DataFrame]:
    """``row, row2, removed``: the numbers of the lines to take out of each document of ``docs`` (row, row2, doc_id, text) that loses any; and the table of ``split_lines``.

    Lines are linked if they are equal, or their sets of ``width``-character shingles have this Jaccard similarity or
    more, after ``normal_lines``; of each component the line of the smallest doc_id, then number, stays.
    Equal lines are always found; a pair of similarity s meets in a band with a chance of
    1 - (1 - s ** rows) ** count (46 bands of 6: all but 1e-6 at 0.8), and is then confirmed exactly. Blank lines stay.
    """
    found = materialize(split_lines(docs))
    own = found.where("hi is not null")
    total = found.count()
    bits = min(20, max(12, math.ceil(math.log2(max(1, total) * count / BUCKET_KEYS))))
    members = materialize(line_stars(postings(docs, width, count, rows, bits)))
    # One row for each different line, with a number of its own and its first place.
    first = F.min(F.struct("doc_id", "line", "row", "row2")).alias("first")
    distinct = own.groupBy("hi", "lo").agg(F.count("*").alias("c"), first, F.max("chars").alias("n")).withColumn("uid", F.monotonically_increasing_id())
    distinct = materialize(distinct.select("uid", "hi", "lo", "c", "n", F.col("hi").bitwiseAND(F.lit(NEAR)).alias("near"), "first"))
    owners = materialize(distinct.join(members.select("near").distinct(), "near", "left_semi").select("near", "uid", "n", "first.row", "first.row2", "first.line"))
    leaders = owners.select(F.col("near").alias("leader_near"), F.col("uid").alias("leader"))
    stars = materialize(members.withColumnRenamed("leader", "leader_near").join(owners, "near").join(leaders, "leader_near").select("leader", "uid", "n", *ROW, "line"))
    # By one key, so that the table is small; what a clash of keys brings up besides isn't an owner's.
    asked = materialize(owners.groupBy("row").agg(F.collect_list("line").alias("lines")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        served = set()  # rows that repeat both id and text give their lines once
        for batch in batches:
            for part in pieces(batch):
                out = {"row": [], "row2": [], "line": [], "text": []}
                for row, row2, text, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (row, row2) in served:
                        continue
                    served.add((row, row2))
                    lines = normal_lines(text) if text else []
                    wanted = [i for i in wanted if i < len(lines)]
                    out["row"] += [row] * len(wanted)
                    out["row2"] += [row2] * len(wanted)
                    out["line"] += wanted
                    out["text"] += [lines[i] for i in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int64()), pa.array(out["row2"], pa.int64()), pa.array(out["line"], pa.int32()), pa.array(out["text"], pa.string())], names=list(out))

    texts = map_batches(similarity.with_few(docs.select(*ROW, "text"), asked, ["row"], "lines").select(*ROW, "text", "lines"), run, "row long, row2 long, line int, text string")
    roots = similarity.components(similarity.confirm(stars, texts, [*ROW, "line"], lambda t: shingles.char_shingles(t, width), similarity_at_least))
    # What comes once and has no link stays; of the rest, the place that stays is told by line.
    named = materialize(distinct.join(roots, "uid", "left").where("c > 1 or root is not null").select("hi", "lo", "c", F.coalesce("root", "uid").alias("root"), "first"))
    sizes = named.groupBy("root").agg(F.min("first").alias("stays"), F.count("*").alias("m"))
    stays = materialize(sizes.select("root", "m", F.col("stays.row").alias("own_row"), F.col("stays.row2").alias("own_row2"), F.col("stays.line").alias("own_line")))
    lines = named.count()
    judged = materialize(similarity.join_hot(named, stays.drop("m"), ["root"], stays.where(F.col("m") * similarity.HOT > lines)).select("hi", "lo", "c", "own_row", "own_row2", "own_line"))
    gone = similarity.join_hot(own.select(*ROW, "line", "hi", "lo"), judged.drop("c"), ["hi", "lo"], judged.where(F.col("c") * similarity.HOT > total))
    gone = gone.where("row <> own_row or row2 <> own_row2 or line <> own_line").groupBy(*ROW).agg(F.sort_array(F.collect_set("line")).alias("removed"))
    gone = materialize(gone)
    discard(members, distinct, owners, stars, asked, roots, named, stays, judged)
    return gone, found


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """``doc_id, n_lines, n_kept, removed`` of each row of ``docs``; see ``find_removals`` for ``how``.

    Null and empty texts have no lines. Rows that repeat both id and text lose the same lines. Other columns are left out.
    """
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone, found = find_removals(mine.select("doc_id", "text", *row_keys()), **how)
    out = found.where("hi is null").select(*ROW, "doc_id", F.col("chars").cast("long").alias("n_lines"))
    out = out.join(gone, ROW, "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(removed)).alias("n_kept"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **how: object) -> DataFrame:
    """The rows of ``docs``, with all columns, without the lines of ``find_removals``.

    A row that loses lines and has only blank ones left is dropped: all it said stands elsewhere.
    ``chars_col``, if there is one, gets the new length. Rows without removed lines stay as they are.
    """
    marks, lost = [_free(docs, c) for c in ROW], _free(docs, "removed")
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone, found = find_removals(mine.select("doc_id", "text", *row_keys()), **how)
    discard(found)
    keys = row_keys(F.col(id_col).cast("long"), F.col(text_col), marks)
    joined = similarity.with_few(docs.select("*", *keys), gone.toDF(*marks, lost), marks, lost, "left").select(*[f"`{c}`" for c in docs.columns], lost)
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts, keep = part.column(at).to_pylist(), []
                lines = part.column(part.num_columns - 1).to_pylist()
                for i, out in enumerate(lines):
                    if out:
                        left = [x for k, x in enumerate(texts[i].split("\n")) if k not in set(out)]
                        texts[i] = "\n".join(left)
                        keep.append(any(map(str.strip, left)))
                    else:
                        keep.append(True)
                cols = list(part.columns[:-1])
                cols[at] = pa.array(texts, cols[at].type)
                if chars is not None:
                    now = [len(t) if out else None for t, out in zip(texts, lines, strict=True)]
                    cols[chars] = pa.array([b if a is None else a for a, b in zip(now, cols[chars].to_pylist(), strict=True)], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return map_batches(joined, run, docs.schema)


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name
