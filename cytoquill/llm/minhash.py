"""Near-duplicate documents by a signature-coordinate inverted join.

A document's signature has k coordinates. Each coordinate with its value is a key, under which
the document is posted. Two sets of at least the wanted similarity share at least t of the k
keys (but for a chance below ``miss``). So, with each document's keys in one order, rarest first:
a document with fewer than t keys that any other has takes no part; and two documents with t
shared keys share one of the first k - t + 1 of each (the prefix). Only prefixes are joined; the
frequent keys behind them are skipped. What meets is counted and confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import struct
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquill.llm import shingles, similarity
from cytoquill.llm.common import arrow_map, discard, materialize


#: Columns that tell rows apart.
ROW = ["row", "row2"]


def row_keys(doc_id: Column | str = "doc_id", text: Column | str = "text", names: list[str] = ROW) -> list[Column]:
    """128 bits that tell rows apart; rows that repeat both id and text are alike."""
    return [F.xxhash64(doc_id, text).alias(names[0]), F.xxhash64(F.lit(1), text, doc_id).alias(names[1])]


def signed(docs: DataFrame, width: int, k: int) -> DataFrame:
    """``row, row2, doc_id, n, hi, lo, signature``: set size, 128 bits of the set's digest (null: empty set), and k minima."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        sets = shingles.word_shingles(cols["text"], width)
        digest = [digest_of(s) for s in sets]
        return {
            "row": cols["row"], "row2": cols["row2"], "doc_id": cols["doc_id"], "n": [len(s) for s in sets],
            "hi": [d[0] for d in digest], "lo": [d[1] for d in digest], "signature": list(shingles.signatures(sets, k).view(np.int32)),
        }

    return arrow_map(docs.select(*row_keys(), "doc_id", "text"), run, "row long, row2 long, doc_id long, n long, hi long, lo long, signature array<int>")


def digest_of(s: np.ndarray) -> tuple[int | None, int | None]:
    return struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest()) if len(s) else (None, None)


def prefix_keys(items: DataFrame, k: int, least: int) -> DataFrame:
    """``key, uid, weight`` of the prefixes of ``items`` (uid, signature: distinct); weight: how many of the item's keys another has.

    Keys that only one item has come first in its order and lead nowhere; they are only counted.
    """
    posted = items.select("uid", F.posexplode("signature").alias("at", "value")).select("uid", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("key"))
    common = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    mine = posted.join(common, "key").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))  # k entries at most
    mine = mine.withColumn("weight", F.size("keys")).where(F.col("weight") >= least)
    return mine.select("uid", "weight", F.explode(F.slice("keys", F.lit(1), F.col("weight") - least + 1)).alias("e")).select(F.col("e.key").alias("key"), "uid", "weight")


def near_duplicates(docs: DataFrame, width: int = 5, similarity_at_least: Fraction = Fraction(4, 5), k: int = 32, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    Linked are documents whose sets of ``width``-word shingles have this Jaccard similarity or
    more; a component is named by its smallest doc_id, whose row is kept. Documents without words
    are components of their own. Equal sets count as one item, so copies are never compared.
    Rows that repeat a doc_id are in one component if their sets are linked or equal. Other columns are left out. The Jaccard condition is
    exact; a pair at exactly this similarity stays unseen with a chance of ``miss``.
    """
    out = _named(docs, width, similarity_at_least, k, miss, id_col, text_col)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named(docs: DataFrame, width: int, similarity_at_least: Fraction, k: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """``row, row2, doc_id, n, best`` of each row; best: the first row of the component (null: the row is alone)."""
    least = shingles.match_threshold(k, float(similarity_at_least), miss)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(signed(docs, width, k))
    # One row for each different set, with a number of its own and its first document.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)).alias("best")
    items = rows.where("hi is not null").groupBy("hi", "lo").agg(F.first("signature").alias("signature"), best, F.max("n").alias("n"), F.count("*").alias("c"))
    items = materialize(items.withColumn("uid", F.monotonically_increasing_id()))
    keys = materialize(prefix_keys(items, k, least))
    members = materialize(similarity.stars(keys))
    owners = materialize(items.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", "n", "best.row", "best.row2"))
    stars = materialize(members.join(owners.select("uid", "n"), "uid"))
    # Rows that repeat both id and text give their text once.
    texts = similarity.with_few(docs.select(*row_keys(), "text"), owners.select(*ROW, "uid"), ROW).groupBy("uid").agg(F.first("text").alias("text"))
    roots = similarity.components(similarity.confirm(stars, texts, ["uid"], lambda t: shingles.word_shingles(t, width), similarity_at_least))
    named = materialize(items.select("uid", "hi", "lo", "c", "best").join(roots, "uid", "left").where("c > 1 or root is not null").withColumn("root", F.coalesce("root", "uid")))
    first = materialize(named.groupBy("root").agg(F.min("best").alias("best"), F.count("*").alias("m")))
    named = named.drop("best", "uid")
    judged = materialize(similarity.join_hot(named, first.drop("m"), ["root"], first.where(F.col("m") * similarity.HOT > named.count())).select("hi", "lo", "c", "best"))
    hot = judged.where(F.col("c") * similarity.HOT > rows.count())
    discard(keys, members, owners, stars, items, roots)
    return similarity.join_hot(rows.drop("signature"), judged.drop("c"), ["hi", "lo"], hot, "left").select(*ROW, "doc_id", "n", "best")


def keep_one(docs: DataFrame, width: int = 5, similarity_at_least: Fraction = Fraction(4, 5), k: int = 32, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns: one of each component of ``near_duplicates``, that of the smallest doc_id.

    Of rows that repeat both id and text one stays, whichever, with its other columns; rows without words all stay, but for such repeats.
    """
    marks = []
    for mark in ROW:
        while mark in docs.columns:
            mark += "_"
        marks.append(mark)
    named = _named(docs, width, similarity_at_least, k, miss, id_col, text_col)
    stays = F.coalesce((F.col("best.row") == F.col("row")) & (F.col("best.row2") == F.col("row2")), F.lit(True))
    judged = named.groupBy(*ROW).agg(F.count("*").alias("c"), F.bool_and(stays).alias("stays"))
    judged = materialize(judged.where("not stays or c > 1").toDF(*marks, "c", "stays"))
    some = F.broadcast if similarity.few(judged) else lambda d: d
    keyed = docs.select("*", *row_keys(F.col(id_col).cast("long"), F.col(text_col), marks))
    own = [f"`{c}`" for c in docs.columns]
    once = keyed.join(some(judged.select(marks)), marks, "left_anti")
    again = keyed.join(some(judged.where("stays").select(marks)), marks, "left_semi").dropDuplicates(marks)
    return once.select(own).union(again.select(own))
