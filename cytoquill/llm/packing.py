"""Mixture-controlled packing of tokenised documents into sequences of one length, by deficit round robin.

Each source is a queue of whole documents. In each round, which fills a window of tokens, every
queue's deficit grows by its credit, its share of the window; then it serves documents from its
head while the deficit covers them, and each takes its tokens off the deficit. What is left
is carried to the next round. A queue isn't empty before its end, so its deficit after round r
is r * credit less the tokens that it has served: a document whose tokens end at place e of
its queue is served in round ceil(e / credit). So the rounds of all documents follow from their
places in their queues, whatever partition they are in, and deficits carry over from window to window and from
partition to partition. What each round serves of each queue is summed once, and running sums of
these loads place every document in the stream, which is then cut into sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.llm import bpe, similarity
from cytoquill.llm.common import arrow_map, discard, map_batches, materialize, pieces


def queue_key(source: Column) -> Column:
    """A name for each source that isn't null, the null source too."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``part, queue, doc_id, start, n, ids``: ids as little-endian unsigned 16 or 32-bit integers, the end id last.

    ``start`` counts the tokens before the document in its queue within its partition, ``part``.
    """
    rows = docs.select(queue_key(F.col(source_col)).alias("queue"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe.load(vocabulary)
        kind = "<u2" if max(max(b.text), end_id, *b.added.values()) < 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        part, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in pieces(batch, 4 << 20):
                queues, starts, sizes, ids = piece.column(0).to_pylist(), [], [], []
                for q, raw in zip(queues, b.encode(piece.column(2).to_pylist()), strict=True):
                    ids.append(np.frombuffer(raw, "<u4").astype(kind).tobytes() + end)
                    sizes.append(len(raw) // 4 + 1)
                    starts.append(so_far.get(q, 0))
                    so_far[q] = starts[-1] + sizes[-1]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), piece.column(0), piece.column(1), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["part", "queue", "doc_id", "start", "n", "ids"])
        b.release()

    return map_batches(rows, run, "part int, queue string, doc_id long, start long, n long, ids binary")


def credits(totals: DataFrame, window: int, target: Mapping[str | None, float] | None) -> DataFrame:
    """``queue, credit``: tokens of each queue in a window, one at least; ``totals``: queue, n.

    Without a target, and for what a target leaves to sources that it doesn't name, shares are in
    proportion to what the sources hold.
    """
    target = {"" if q is None else f"={q}": share for q, share in (target or {}).items()}
    if any(not share > 0 for share in target.values()) or sum(target.values()) > 1 + 1e-9:
        raise ValueError("shares are positive, and 1 together at most")
    named = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])[F.col("queue")].cast("double") if target else F.lit(None).cast("double")
    totals = totals.withColumn("named", named)
    rest = totals.where("named is null").agg(F.sum("n").alias("rest"))
    share = F.coalesce("named", F.lit(max(0.0, 1 - sum(target.values()))) * F.col("n") / F.col("rest"))
    return totals.join(F.broadcast(rest)).select("queue", F.greatest(F.round(share * window), F.lit(1)).cast("long").alias("credit"))


def running(loads: DataFrame) -> DataFrame:
    """``loads`` (round, queue, tokens) with ``at``, the tokens of all earlier rounds, and of this round's queues of smaller names.

    Running sums by three levels of blocks of rounds; the last has a row for each million rounds.
    """
    before = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: F.coalesce(F.sum("tokens").over(w), F.lit(0))
    loads = loads.withColumns({"block": F.shiftright("round", 10), "super": F.shiftright("round", 20)})
    blocks = loads.groupBy("super", "block").agg(F.sum("tokens").alias("tokens"))
    supers = blocks.groupBy("super").agg(F.sum("tokens").alias("tokens"))
    supers = supers.select("super", upto(before([], "super")).alias("of_super"))
    blocks = blocks.select("super", "block", upto(before(["super"], "block")).alias("of_block")).join(supers, "super").select("block", (F.col("of_super") + F.col("of_block")).alias("of_block"))
    within = loads.withColumn("within", upto(before(["block"], "round", "queue")))
    return within.join(blocks, "block").withColumn("at", F.col("of_block") + F.col("within")).drop("block", "super", "of_block", "within")


def cut(places: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents that lie at ``places`` of the stream: row, offset in the document, size, place."""
    first = places // length
    count = (places + sizes - 1) // length + 1 - first
    row = np.repeat(np.arange(len(places)), count)
    k = np.arange(len(row)) - np.repeat(count.cumsum() - count, count)
    at = np.where(k == 0, places[row], (first[row] + k) * length)
    end = np.minimum((first[row] + k + 1) * length, (places + sizes)[row])
    return row, at - places[row], end - at, at


def pack(
    docs: DataFrame, vocabulary: str, length: int = 4096, window: int = 64 * 4096, end_id: int = 2, target: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, round, deficit`` of each piece.

    Each document's ids, with ``end_id`` after them (null and empty texts: only that), lie in
    pieces of exactly one sequence each; only sequences' ends cut documents. All sequences but the last are full. ``target`` gives
    shares of a ``window`` of tokens by source, see ``credits``; a source that runs out leaves its share to the others. If
    named sources take everything, one that isn't named gets a token in each window, so most of it comes last.
    Null sources are a queue of their own; any number of sources keep theirs. Repeated rows are packed each;
    other columns are left out. The order within a queue is that of the input's partitions.
    ``round`` is the window in which a document is served, and ``deficit`` what its queue has left after it.
    """
    if length < 1 or window < 1:
        raise ValueError("lengths are positive")
    rows = materialize(tokenized(docs, vocabulary, end_id, id_col, text_col, source_col))
    sums = rows.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select("part", "queue", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    plan = materialize(sums.join(credits(sums.groupBy("queue").agg(F.sum("n").alias("n")), window, target), "queue").select("part", "queue", "base", "credit"))

    def served(columns: list[str]) -> DataFrame:
        """Columns of ``rows`` with the round of each document, its place in its queue, and the deficit after it."""
        got = similarity.with_few(rows.select("part", "queue", "start", "n", *columns), plan, ["part", "queue"]).withColumn("start", F.col("start") + F.col("base"))
        got = got.withColumn("round", F.expr("(start + n + credit - 1) div credit"))
        return got.select("queue", "start", "n", "round", (F.col("round") * F.col("credit") - F.col("start") - F.col("n")).alias("deficit"), *columns)

    loads = served([]).groupBy("round", "queue").agg(F.sum("n").alias("tokens"), F.min("start").alias("lead"))
    loads = materialize(running(materialize(loads)).select("round", "queue", "lead", "at"))
    placed = similarity.with_few(served(["doc_id", "ids"]), loads, ["round", "queue"])
    placed = placed.select("doc_id", "n", "ids", "queue", "round", "deficit", (F.col("at") + F.col("start") - F.col("lead")).alias("place"))
    discard(sums)

    def run(cols: dict[str, list]) -> dict[str, list]:
        n = np.array(cols["n"], np.int64)
        row, starts, sizes, at = cut(np.array(cols["place"], np.int64), n, length)
        wide = [np.frombuffer(ids, "<u2" if len(ids) == 2 * m else "<u4").astype("<u4").tobytes() for ids, m in zip(cols["ids"], cols["n"], strict=True)]
        rows = row.tolist()
        return {
            "doc_id": [cols["doc_id"][r] for r in rows],
            "start": starts.tolist(),
            "length": sizes.tolist(),
            "ids_crc32": [zlib.crc32(wide[r][4 * a : 4 * (a + s)]) for r, a, s in zip(rows, starts.tolist(), sizes.tolist(), strict=True)],
            "doc_tokens": n[row].tolist(),
            "sequence_id": (at // length).tolist(),
            "offset": (at % length).tolist(),
            "source": [cols["queue"][r][1:] if cols["queue"][r] else None for r in rows],
            "round": [cols["round"][r] for r in rows],
            "deficit": [cols["deficit"][r] for r in rows],
        }

    return arrow_map(placed, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, round long, deficit long")
