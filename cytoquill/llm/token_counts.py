"""Token counts of whole documents under a sentencepiece model, by a two-tier pre-token lookup."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.common import arrow_map

#: The character that stands for a space inside pieces.
MARK = "▁"
#: A line feed, or spaces with what follows them: no piece reaches over such a boundary.
_PRETOKEN = re.compile(r"\n| *[^ \n]+| +")
#: Longer pre-tokens are counted each time and not kept.
_KEPT_CHARS = 64


class PieceLengths(dict):
    """Pre-token -> number of tokens. Tier 1: the frequent ones, given; tier 2: misses, kept up to ``most``."""

    def __init__(self, model: str, frequent: dict[str, int], most: int = 200_000) -> None:
        super().__init__(frequent)
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model)
        self.frequent, self.most = frequent, most
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not self.library.is_byte(i)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError(f"{model}: a piece reaches over a space or line feed")
        if self._raw("a  b\n") != self._raw("a") + self._raw(" b") + 1:
            raise ValueError(f"{model}: spaces aren't kept as they stand")

    def _raw(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1))

    def __missing__(self, pretoken: str) -> int:
        # The library puts a space before each text; a line feed parts it from what follows.
        n = self._raw(pretoken[1:]) if pretoken[0] == " " and len(pretoken) > 1 else self._raw("\n" + pretoken) - 2
        if len(pretoken) <= _KEPT_CHARS:
            if len(self) >= self.most + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[pretoken] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a text; none for null or empty."""
        return sum(map(self.__getitem__, pretokens(text))) if text else 0


def pretokens(text: str) -> list[str]:
    """What the model encodes independently: its text is their concatenation, after the leading space that it adds."""
    return _PRETOKEN.findall(" " + text.replace(MARK, " "))


@lru_cache(maxsize=2)
def _worker(model: str, key: int, frequent: Callable[[], dict[str, int]]) -> PieceLengths:
    return PieceLengths(model, frequent())


def frequent_lengths(docs: DataFrame, model: str, text_col: str = "text", sample_rows: int = 2000, entries: int = 16_384) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens in at most ``sample_rows`` rows, each of 20,000 characters at most.

    It only warms the lookup: counts are the same whatever it holds. So the sample is bounded,
    and no pre-token is shuffled.
    """
    text = F.col(text_col)
    seen: Counter[str] = Counter()
    rows = docs.select(text.alias("text")).where((F.length(text) <= 20_000) & (F.pmod(F.xxhash64(text), F.lit(16)) == 0))
    for row in rows.take(sample_rows):  # reads a few partitions, as many as it needs
        seen.update(pretokens(row["text"]))
    lengths = PieceLengths(model, {})
    return {w: lengths[w] for w, n in seen.most_common(entries) if n > 1 and len(w) <= _KEPT_CHARS}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each text, without begin, end or other added tokens.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows are counted each; other columns are left out.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model, text_col))
    key = table._jbroadcast.id() if table._jbroadcast is not None else id(table)

    def run(cols: dict[str, list]) -> dict[str, list]:
        lengths = _worker(model, key, _Value(table, key))
        n = [lengths.count(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) if t else 0 for t in cols["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class _Value:
    """A broadcast as an argument of a cached function: equal if of the same broadcast."""

    def __init__(self, broadcast, key: int) -> None:
        self.broadcast, self.key = broadcast, key

    def __call__(self) -> dict[str, int]:
        return self.broadcast.value

    def __hash__(self) -> int:
        return self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Value) and other.key == self.key
