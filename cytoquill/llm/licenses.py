"""Fuzzy search for short licence notices, with edits and spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.common import arrow_map


class Notice(NamedTuple):
    """A notice in lower case, its label, and the edits (characters added, lost or replaced) that a hit may have."""

    label: str
    text: str
    edits: int


NOTICES: tuple[Notice, ...] = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted, free of charge, to any person obtaining a copy", 8),
    Notice("mit", "the software is provided \"as is\", without warranty of any kind", 6),
    Notice("apache-2.0", "licensed under the apache license, version 2.0", 4),
    Notice("gpl", "gnu general public license", 2),
    Notice("gpl-3.0", "gnu general public license, version 3", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl-2.0", "mozilla public license, version 2.0", 3),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-nc", "licensed under cc by-nc", 2),
    Notice("cc0", "cc0 1.0 universal", 1),
    Notice("public-domain", "released into the public domain", 3),
    Notice("all-rights-reserved", "all rights reserved", 1),
)

#: Phrases of whole words that are looked for without edits.
PHRASES: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_UPPER = {ord("A") + i: ord("a") + i for i in range(26)}
#: Bytes of words stay, in lower case; all others part words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class NoticeSearch:
    """All notices at once: a notice with e edits allowed is cut into e + 1 seeds, of which a hit has one unchanged.

    Where seeds stand, windows are laid about them; edit distances narrow these to the parts with hits, and the regex library finds spans and edits there.
    """

    def __init__(self, notices: Sequence[Notice] = NOTICES) -> None:
        import ahocorasick
        import regex

        self.notices = list(notices)
        self.first, self.best = ([regex.compile(f"{flag}(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in self.notices] for flag in ("", "(?b)"))
        self.places = [{c: sum(1 << i for i, x in enumerate(n.text) if x == c) for c in set(n.text)} for n in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            cuts = [len(n.text) * i // (n.edits + 1) for i in range(n.edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    raise ValueError(f"{n.text!r} is too short for {n.edits} edits")
                seeds.setdefault(n.text[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for s, at in seeds.items():
            self.seeds.add_word(s, (len(s), at))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Hits in a lower-case text: number of the notice, start, end, edits; of one notice they don't overlap."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.seeds.iter(text):
            for k, offset in places:
                n = self.notices[k]
                start = last + 1 - size - offset - n.edits
                end = start + len(n.text) + 2 * n.edits
                got = windows.setdefault(k, [])
                if got and start <= got[-1][1]:
                    got[-1][0], got[-1][1] = min(start, got[-1][0]), max(end, got[-1][1])
                else:
                    got.append([start, end])
        near = ((k, a, b) for k, spans in windows.items() for start, end in spans for a, b in self._near(k, text, max(start, 0), min(end, len(text))))
        return sorted(hit for k, a, b in near for hit in self._hits(k, text, a, b))

    def _near(self, k: int, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        """The parts of a window in which all hits of notice k lie, apart from each other.

        Edit distances to all ends by bit-parallel columns of the dynamic programme: a few integer
        operations a character, so text that repeats seeds without being the notice costs the regex library nothing.
        """
        n, places = self.notices[k], self.places[k]
        size = len(n.text)
        full, top = (1 << size) - 1, size - 1
        up, down, distance = full, 0, size
        spans: list[tuple[int, int]] = []
        for at in range(start, stop):
            same = places.get(text[at], 0)
            x = same | down
            y = (((same & up) + up) ^ up) | same
            plus, minus = down | ~(y | up) & full, up & y
            distance += (plus >> top) - (minus >> top)
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = minus | ~(x | plus) & full, plus & x
            if distance <= n.edits:
                a = max(start, at + 1 - size - n.edits)
                if spans and a <= spans[-1][1]:
                    spans[-1] = spans[-1][0], at + 1
                else:
                    spans.append((a, at + 1))
        return spans

    def _hits(self, k: int, text: str, at: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
        """Hits of notice k from left to right: of those about the first place that matches the best one, then what lies before it and after it."""
        n = self.notices[k]
        least = max(len(n.text) - n.edits, 1)
        while stop - at >= least and (m := self.first[k].search(text, at, stop)):
            best = self.best[k].search(text, m.start(), min(m.start() + len(n.text) + 3 * n.edits, stop))
            yield from self._hits(k, text, m.start(), best.start())
            yield k, best.start(), best.end(), sum(best.fuzzy_counts)
            at = best.end()


def lower(text: str) -> str:
    """A-Z in lower case, so that places stay as they are."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


@lru_cache(maxsize=2)
def _search(notices: tuple[Notice, ...]) -> NoticeSearch:
    return NoticeSearch(notices)


def scan_licenses(docs: DataFrame, notices: Sequence[Notice] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, phrases, hits`` of each text.

    ``phrases``: array of (label, word), where words of a phrase stand consecutively; ``hits``:
    array of (label, start, end, edits, share), spans in characters, share of the notice that is
    unchanged. Null and empty texts: no words, no hits. Each repeated row is scanned; other
    columns are left out.
    """
    notices = tuple(map(Notice._make, notices))
    wanted = [(label, [w.encode() for w in p.split(" ")]) for p, label in phrases]

    def run(cols: dict[str, list]) -> dict[str, list]:
        search = _search(notices)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_words": [], "phrases": [], "hits": []}
        for text in cols["text"]:
            ws = words(text) if text else []
            found = []
            for label, want in wanted:
                at = -1
                last = want[-1]
                while ws:
                    try:
                        at = ws.index(last, at + 1)
                    except ValueError:
                        break
                    start = at + 1 - len(want)
                    if start >= 0 and ws[start : at + 1] == want:
                        found.append({"label": label, "word": start})
            out["n_words"].append(len(ws))
            out["phrases"].append(found)
            out["hits"].append([{"label": search.notices[k].label, "start": a, "end": b, "edits": e, "share": 1 - e / len(search.notices[k].text)} for k, a, b, e in search.find(lower(text))] if text else [])
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, n_words long, phrases array<struct<label:string,word:long>>, hits array<struct<label:string,start:long,end:long,edits:int,share:double>>")


def license_summary(scanned: DataFrame) -> DataFrame:
    """One row for each document of ``scan_licenses``: counts, first and last place, labels, and the best share as score."""
    starts = F.expr("transform(phrases, x -> x.word)")
    base = F.expr("transform(phrases, x -> x.label)")
    own = F.expr("transform(hits, x -> x.label)")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.expr("transform(hits, x -> x.share)")), F.lit(0.0))).alias("score"),
    )
