"""BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a batch form a trie. Its depth-first order is the order of the sorted
words, so the trie needs no nodes: a stack holds the states of the current path, and the next
word cuts the stack to the prefix that both share. The state of a prefix is the last token of
its encoding and the length of that token; a state follows from earlier states on the same
path, because an encoding is right exactly if each token encodes itself and each two neighbours
stay apart under the merges. So every shared prefix is encoded once.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

#: White space, letters and numbers among the characters that FAST covers, after lower-casing.
_SPACE, _LETTER, _NUMBER = r"\t-\r ", "a-zªµºß-öø-ÿĀ-ɏ", "0-9²³¹¼-¾"
#: Characters up to U+024F, where _LETTER ends, but for those whose small forms lie beyond it.
_LATIN = "".join(c for c in map(chr, range(0xA1, 0x250)) if max(c.lower()) < chr(0x250))
#: Texts with other characters are normalised and split by the library itself.
_SLOW = re.compile(f"[^\x00-\x1b\x20-\x84{_LATIN}‐-‧€]")
_WORD = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_LETTER}{_NUMBER}]+")
END = "</w>"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends (``</w>``), from a tokenizers JSON file.

    ``encode_words`` fills ``ids`` (little-endian unsigned 32-bit ids) and ``shown`` (the
    decoded text in UTF-8) for words; both are bounded caches.
    """

    #: Words, and bytes of words, that the caches hold at most before they start anew; results don't depend on it.
    MOST = 300_000
    MOST_BYTES = 8 << 20

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec["decoder"] is not None:
            raise ValueError(f"{path}: a BPE vocabulary with {END} word ends and no decoder is needed")
        self.library = Tokenizer.from_file(path)
        chars = _byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in vocab.items()}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t, i in vocab.items():
            end = t.endswith(END) and len(t) > len(END)
            raw = bytes(self.byte_of[c] for c in (t[: -len(END)] if end else t) if c in self.byte_of)
            (self.final if end else self.inner)[raw] = i
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = r
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = r, pair
        self.apart: dict[tuple[int, int], bool] = {}
        self.inner = {k: i for k, i in self.inner.items() if self._whole(i)}
        self.final = {k: i for k, i in self.final.items() if self._whole(i)}
        self.ends = {*self.final.values()}
        self.inner_reach, self.final_reach = self._reach(self.inner), self._reach(self.final)
        self.four = {i: i.to_bytes(4, "little") for i in [*self.text, *(a["id"] for a in spec["added_tokens"])]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, bytes] = {t: i.to_bytes(4, "little") for t, i in self.added.items()}
        self.shown: dict[str, bytes] = {t: t.encode() for t in self.added}
        self.held = 0

    @staticmethod
    def _reach(known: dict[bytes, int]) -> dict[bytes, int]:
        """Length of the longest token with these last two bytes."""
        out: dict[bytes, int] = {}
        for t in known:
            out[t[-2:]] = max(out.get(t[-2:], 1), len(t))
        return out

    def _stays_apart(self, a: int, b: int, below: int) -> bool:
        """No merge of rank under ``below`` joins what the merges make of the end of a and the start of b.

        Undoes merges from the latest on: at each step only the two symbols at the boundary can
        join, and they do so if their merge comes before the undone one.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        while True:
            if merged.get((a, b), below) < below:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Of equal ranks, the left one was merged first; so the right one is undone first, and the boundary merge may tie with it.
            if ra > rb:
                below, a = min(below, ra), parts[a][1]
            else:
                below, b = min(below, rb + 1), parts[b][0]

    def _whole(self, t: int) -> bool:
        """The token's own text is encoded as this one token."""
        if t not in self.rank:
            return True
        a, b = self.parts[t]
        return self._whole(a) and self._whole(b) and self._stays_apart(a, b, self.rank[t])

    def _pair(self, a: int, b: int) -> bool:
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            got = self.apart[a, b] = self._stays_apart(a, b, 1 << 60)
        return got

    def encode_trie(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Distinct words with their ids, by one depth-first walk of their trie."""
        pair, apart = self._pair, self.apart.get
        tokens: list[int] = []  # last token of each prefix on the path, and its length
        sizes: list[int] = []
        before = b""

        def last(known: dict[bytes, int], reach: dict[bytes, int], n: int) -> tuple[int, int]:
            # Exactly one token can end here; all shorter prefixes are on the path.
            size = min(n, reach.get(w[n - 2 : n], 1)) if n > 1 else 1
            while size:
                t = known.get(w[n - size : n])
                if t is not None:
                    if size == n:
                        return t, size
                    left = tokens[n - size - 1]
                    ok = apart((left, t))
                    if pair(left, t) if ok is None else ok:
                        return t, size
                size -= 1
            raise ValueError(f"no encoding for {w[:n]!r}")

        for w in sorted(words):
            most = min(len(before), len(w) - 1, len(tokens))
            same = most if before[:most] == w[:most] else next(i for i in range(most) if before[i] != w[i])
            del tokens[same:], sizes[same:]
            for n in range(same + 1, len(w)):
                t, size = last(self.inner, self.inner_reach, n)
                tokens.append(t)
                sizes.append(size)
            before = w
            t, size = last(self.final, self.final_reach, len(w))
            ids, at = [t], len(w) - size
            while at:
                ids.append(tokens[at - 1])
                at -= sizes[at - 1]
            ids.reverse()
            yield w, ids

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text, and added tokens as they stand."""
        if self.split_added is not None and "<|" in text:
            got: list[str] = []
            for i, part in enumerate(self.split_added.split(text)):
                got += ([part] if i % 2 else self._plain(part)) if part else []
            return got
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _SLOW.search(text):
            text = self.library.normalizer.normalize_str(text)
            return [bytes(self.byte_of[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _WORD.findall(text.lower())

    def learn(self, new: Iterable[str], shown: bool = True) -> None:
        """Fill the caches for distinct words that they lack, by the trie walk."""
        by_bytes = {w.encode("utf-8", "surrogateescape"): w for w in new}
        self.held += sum(map(len, by_bytes))
        four, text = self.four.__getitem__, self.text.__getitem__
        for raw, ids in self.encode_trie(by_bytes):
            w = by_bytes[raw]
            self.ids[w] = b"".join(map(four, ids))
            if shown:
                self.shown[w] = " ".join(map(text, ids)).encode()

    def release(self) -> None:
        """Give the caches' memory back, at the end of a task: an idle worker holds the vocabulary only."""
        self._clear()
        self.apart.clear()

    def learn_by_library(self, new: Iterable[str]) -> None:
        """Fill ``ids`` for distinct words as the library encodes them, many in one call: each word's last token ends it."""
        new = list(new)
        for i in range(0, len(new), 8192):
            self._learn_some(new[i : i + 8192])

    def _learn_some(self, new: list[str]) -> None:
        got = self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids
        self.held += sum(map(len, new))
        ends = [i + 1 for i, t in enumerate(got) if t in self.ends]
        if len(ends) != len(new):
            self.learn(new, shown=False)
            return
        raw = struct.pack(f"<{len(got)}I", *got)
        self.ids.update(zip(new, map(raw.__getitem__, map(slice, [0, *(4 * e for e in ends[:-1])], [4 * e for e in ends])), strict=True))

    def split_all(self, texts: list[str | None]) -> list[list[str]]:
        """Pre-tokens of each text (null: none); afterwards ``ids`` and ``shown`` hold each of them."""
        if len(self.ids) > self.MOST or self.held > self.MOST_BYTES:
            self._clear()
        split = [self.words(t) if t else [] for t in texts]
        self.learn(set().union(*split).difference(self.shown))
        return split

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the library encodes the words that are new."""
        if len(self.ids) > 2 * self.MOST or self.held > 2 * self.MOST_BYTES:
            self._clear()
        split = [self.words(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.ids)
        if new:
            self.learn_by_library(new)
        return [b"".join(map(self.ids.__getitem__, ws)) for ws in split]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One vocabulary for each worker process."""
    return WordBpe(path)
