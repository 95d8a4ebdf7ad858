"""From shared keys to components of similar sets: stars of candidates, exact confirmation, union-find.

Items are distinct shingle sets or lines, known by ``uid``, a number of their own. Items that share
a key are candidates of each other. Each key names one of its items as leader, and all items of
its keys gather around a leader: a star. Two items that share a key are in its leader's star, so
confirming within stars loses no candidate, and no pair is ever written out: the rows are as many
as keys. A large star is dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.common import discard, map_batches, materialize, pieces

#: Size of all sets of a block, about.
BLOCK = 1 << 20
#: Bytes of a table that is broadcast, at most; beyond that Spark joins by shuffle.
FEW_BYTES = 64 << 20
#: A key with more than this part of all rows is joined by broadcast; there are fewer such keys than that.
HOT = 256


def stars(keys: DataFrame) -> DataFrame:
    """``leader, uid`` of ``keys`` (key, uid, and weight if wanted): a key's leader is its item of the greatest weight, then the smallest uid.

    Each leader stands in its own star; keys of one item, however often it comes, have none. Rows
    are sorted by key, leader first, and streamed: a task holds one leader, however many rows a key has.
    """
    order = ["key", F.desc("weight"), "uid"] if "weight" in keys.columns else ["key", "uid"]
    dealt = keys.repartition("key").sortWithinPartitions(*order).select("key", "uid")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, lead, shown = None, 0, False  # of the run of rows that may go on, and whether its leader was written
        for batch in batches:
            key, uid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(key):
                continue
            new = np.empty(len(key), bool)
            new[0] = last_key is None or key[0] != last_key
            np.not_equal(key[1:], key[:-1], out=new[1:])
            run_of = new.cumsum()  # 0: the run of the batch before
            leaders = np.concatenate([[lead], uid[new]])
            at = leaders[run_of]
            other = uid != at
            runs = np.unique(run_of[other])
            if shown:
                runs_new = runs[runs > 0]
            else:
                runs_new = runs
            if len(runs):
                a = np.concatenate([at[other], leaders[runs_new]])
                b = np.concatenate([uid[other], leaders[runs_new]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["leader", "uid"])
            end = int(run_of[-1])
            shown = bool(len(runs) and runs[-1] == end) or (end == 0 and shown)
            last_key, lead = key[-1], leaders[end]

    return map_batches(dealt, run, "leader long, uid long").distinct()


def few(df: DataFrame, lists: str | None = None) -> bool:
    """Whether ``df`` (materialized: numbers, and a column of lists of numbers) takes ``FEW_BYTES`` at most as a broadcast table."""
    rows, entries = df.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0)).first()
    return 64 * rows + 8 * entries <= FEW_BYTES


def with_few(rows: DataFrame, other: DataFrame, columns: list[str], lists: str | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` (materialized) by columns of both; ``other`` goes by broadcast only if it is small."""
    return rows.join(F.broadcast(other) if few(other, lists) else other, columns, how)


def join_hot(rows: DataFrame, other: DataFrame, columns: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other``, which has one row for each key; ``hot``, of ``HOT`` keys at most, names those that are joined by broadcast."""
    hot = F.broadcast(hot.select(columns))
    much = rows.join(F.broadcast(other.join(hot, columns, "left_semi")), columns)
    return much.unionByName(rows.join(hot, columns, "left_anti").join(other, columns, how))


def confirm(members: DataFrame, texts: DataFrame, by: list[str], sets_of: Callable[[list[str]], list[np.ndarray]], similarity: Fraction) -> DataFrame:
    """``a, b``: edges that join all items of a star between which links of at least ``similarity`` lead.

    ``members`` (materialized): leader, uid, n, distinct, the leader among them; ``texts``: ``by`` (columns of ``members``), text, from which
    ``sets_of`` makes the sets in the task: texts are smaller than sets. An item may come more than once.
    Of the links within what is already joined, some are left out. In a star of more than a block
    the items are first compared with the leader; only those that aren't linked with it meet the others, block by block.
    """
    keep = ["leader", "uid", "n", *[c for c in by if c != "uid"]]
    members = members.select(keep)
    weights = materialize(members.groupBy("leader").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK).select("leader", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks")))
    zero = F.lit(0)
    if weights.isEmpty():
        return linked(members.withColumns({"low": zero, "high": zero, "own": zero}), texts, by, sets_of, similarity)
    small = linked(members.join(weights, "leader", "left_anti").withColumns({"low": zero, "high": zero, "own": zero}), texts, by, sets_of, similarity)
    large = materialize(members.join(weights, "leader").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")))
    each = F.explode(F.sequence(zero, F.col("blocks") - 1))
    spread = large.where("uid <> leader").unionByName(large.where("uid = leader").withColumn("own", each))
    near = materialize(linked(spread.withColumns({"low": F.col("own"), "high": F.col("own")}), texts, by, sets_of, similarity, leader_only=True))
    pairs = near.select(F.col("a").alias("leader"), F.col("b").alias("uid"))
    others = large.where("uid <> leader")
    rest = materialize(others.join(pairs, ["leader", "uid"], "left_anti"))
    parts = materialize(rest.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts")))
    rest = rest.join(parts, "leader").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    joined = others.join(pairs, ["leader", "uid"], "left_semi").join(parts, "leader").withColumn("own", F.col("own") + F.col("parts"))
    rest = rest.withColumn("other", F.explode(F.sequence(zero, F.col("parts") + F.col("blocks") - 1)))
    joined = joined.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
    grid = rest.unionByName(joined).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    return small.union(near).union(linked(grid, texts, by, sets_of, similarity))


def linked(dealt: DataFrame, texts: DataFrame, by: list[str], sets_of: Callable[[list[str]], list[np.ndarray]], similarity: Fraction, leader_only: bool = False) -> DataFrame:
    """``a, b``: edges within each group of leader, low, high; see ``confirm``."""
    dealt = dealt.join(texts, by).select("leader", "low", "high", "own", "uid", "text")
    up, down = similarity.numerator, similarity.denominator

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, uids, owns, held = None, [], [], []
        out: tuple[list[int], list[int]] = ([], [])

        def flush() -> None:
            if len(uids) > 1:
                a, b = leader_links(uids, held, key[0], up, down) if leader_only else links(uids, owns, held, key[0], up, down)
                out[0].extend(a)
                out[1].extend(b)

        for batch in batches:
            for part in pieces(batch):
                keys = zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)
                sets = sets_of(part.column(5).to_pylist())
                for k, own, uid, s in zip(keys, part.column(3).to_pylist(), part.column(4).to_pylist(), sets, strict=True):
                    if k != key:
                        flush()
                        key, uids, owns, held = k, [], [], []
                    uids.append(uid)
                    owns.append(own)
                    held.append(s)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
                    out[0].clear()
                    out[1].clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    sorted_rows = dealt.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high")
    return map_batches(sorted_rows, run, "a long, b long")


def leader_links(uids: list[int], sets: list[np.ndarray], leader: int, up: int, down: int) -> tuple[list[int], list[int]]:
    """Edges from the leader to all that link with it."""
    x = sets[uids.index(leader)]
    found = []
    for uid, y in zip(uids, sets, strict=True):
        if uid == leader or min(len(x), len(y)) * down < max(len(x), len(y)) * up:
            continue
        both = np.concatenate([x, y])
        both.sort(kind="stable")  # merges the two runs
        c = int(np.count_nonzero(both[1:] == both[:-1]))
        if c * down >= (len(x) + len(y) - c) * up:
            found.append(uid)
    return [leader] * len(found), found


def links(uids: list[int], blocks: list[int], sets: list[np.ndarray], leader: int, up: int, down: int) -> tuple[list[int], list[int]]:
    """Edges that span the linked items: |x & y| * down >= |x | y| * up. Of two blocks only pairs across them count."""
    return (_few_links if len(uids) <= 12 else _many_links)(uids, blocks, sets, leader, up, down)


def _few_links(uids: list[int], blocks: list[int], sets: list[np.ndarray], leader: int, up: int, down: int) -> tuple[list[int], list[int]]:
    order = sorted(range(len(uids)), key=lambda i: (uids[i] != leader, len(sets[i])))
    across = min(blocks) != max(blocks)
    part = list(range(len(uids)))
    a, b = [], []
    for p, i in enumerate(order):
        x = sets[i]
        for j in order[p + 1 :]:
            y = sets[j]
            n, m = len(x), len(y)
            if part[i] == part[j] or (across and blocks[i] == blocks[j]) or min(n, m) * down < max(n, m) * up:
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # merges the two runs
            c = int(np.count_nonzero(both[1:] == both[:-1]))
            if c * down >= (n + m - c) * up:
                a.append(uids[i])
                b.append(uids[j])
                old = part[j]
                part = [part[i] if q == old else q for q in part]
    return a, b


def _many_links(uid_list: list[int], block_list: list[int], sets: list[np.ndarray], leader: int, up: int, down: int) -> tuple[list[int], list[int]]:
    uids, blocks = np.array(uid_list, np.int64), np.array(block_list)
    n = len(uids)
    sizes = np.array([len(s) for s in sets])
    cuts = sizes.cumsum() - sizes
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parent = np.arange(n)
    a: list[int] = []
    b: list[int] = []
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    across = len(np.unique(blocks)) > 1

    def meet(i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that link with i."""
        others = others[(np.minimum(sizes[others], sizes[i]) * down >= np.maximum(sizes[others], sizes[i]) * up)]
        if not len(others):
            return others
        mine = flat[cuts[i] : cuts[i] + sizes[i]]
        mark[mine] = True
        if 4 * len(others) > n:
            both = np.add.reduceat(mark[flat], cuts, dtype=np.int64)[others]
        else:
            both = np.array([int(mark[flat[cuts[j] : cuts[j] + sizes[j]]].sum()) for j in others])
        mark[mine] = False
        return others[both * down >= (sizes[others] + sizes[i] - both) * up]

    first = int(np.flatnonzero(uids == leader)[0]) if (uids == leader).any() else int(sizes.argmax())
    # The items in the order of the leader, then of size: later ones have most of their links behind them.
    for i in [first, *[j for j in np.argsort(sizes, kind="stable") if j != first]]:
        others = np.flatnonzero(parent != parent[i])
        if across:
            others = others[blocks[others] != blocks[i]]
        for j in meet(i, others):
            if parent[j] != parent[i]:
                a.append(int(uids[i]))
                b.append(int(uids[j]))
                parent[parent == parent[j]] = parent[i]
    return a, b


def components(edges: DataFrame) -> DataFrame:
    """``uid, root`` of every end of ``edges`` (a, b): the smallest uid that is connected with it.

    Distributed union-find: large-star and small-star steps in turn until nothing changes. Each
    step groups by node with partial minima; its rows never outnumber the edges. Each round is
    written to the shared folder, which cuts the lineage.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, materialize(small)
        discard(before)
        was, mark = mark, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == was:
            break
    roots = materialize(now.select(F.col("u").alias("uid"), F.col("v").alias("root")).union(now.select(F.col("v").alias("uid"), F.col("v").alias("root")).distinct()))
    discard(now)
    return roots
