"""Interleaved document sequences: ordered text and media references, payloads by digest."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.common import arrow_map

ITEM = "struct<position:int,kind:string,text:string,digest:string,source:string,caption:string,bytes:long>"
#: References of this form carry a payload's SHA-256.
SCHEME = "sha256:"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_HIDDEN = {"script", "style", "template", "noscript", "title", "head"}
#: What stands in a head; any other element ends it.
_IN_HEAD = _HIDDEN | {"meta", "link", "base"}
_BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "br", "tr", "td", "th", "ul", "ol", "table", "figure", "nav", "header", "footer", "main", "blockquote", "pre", "hr", "body", "html"}
#: Samples of a stored row.
WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"


class _Sequence(HTMLParser):
    """Collects items. An element that is never closed neither hides the rest of a page nor takes it as its caption."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        low = page.lower()
        self.closes = {tag: low.count(f"</{tag}") for tag in (*_HIDDEN, "figcaption", "figure")}
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden: list[str] = []
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def add(self, **item: object) -> None:
        self.items.append({"position": len(self.items), "kind": None, "text": None, "digest": None, "source": None, "caption": None, "bytes": None} | item)

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text:
            self.add(kind="text", text=text)

    def set_cdata_mode(self, elem: str, **how: object) -> None:
        if self.hidden and self.hidden[-1] == elem:  # else it is never closed, and what follows is read as usual
            super().set_cdata_mode(elem, **how)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden and self.hidden[-1] == "head" and tag not in _IN_HEAD:
            self.hidden.pop()
        if tag in _HIDDEN and (tag == "head" or self.closes[tag] > 0):
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.end_caption()
            self.figure.append(len(self.items))
        elif tag == "figcaption" and (self.closes["figcaption"] > 0 or (self.figure and self.closes["figure"] > 0)):
            self.flush()
            self.end_caption()
            self.caption = []
        elif tag in _MEDIA and (source := dict(attrs).get("src")):
            self.flush()
            declared = dict(attrs).get("data-bytes") or ""
            digest = source[len(SCHEME) :].lower() if source.startswith(SCHEME) else None
            self.add(kind="media", digest=digest, source=source, caption=dict(attrs).get("alt") or None, bytes=int(declared) if declared.isdecimal() and len(declared) < 19 else None)

    def end_caption(self) -> None:
        """What was read of a caption goes to the media of its figure; without any, it is text."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        media = [i for i in self.items[self.figure[-1] :] if i["kind"] == "media"] if self.figure else []
        for item in media:
            item["caption"] = text or item["caption"]
        if text and not media:
            self.add(kind="text", text=text)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.closes:
            self.closes[tag] -= 1
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            return
        if tag == "figcaption":
            self.end_caption()
            return
        if tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.end_caption()
            if self.figure:
                self.figure.pop()

    def handle_data(self, data: str) -> None:
        if self.hidden == ["head"] and data.strip():
            self.hidden.clear()
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse_sequence(page: str | None) -> list[dict]:
    """Text runs and media references of a page, in order; a figure's caption goes to its media, else ``alt`` does.

    ``bytes`` is the size that a reference declares as ``data-bytes``.
    """
    p = _Sequence(page or "")
    p.feed(page or "")
    p.close()
    p.end_caption()
    p.flush()
    return p.items


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", kinds: tuple[str, ...] = ("text", "media")) -> DataFrame:
    """``id, items`` of each page, with the items of the wanted kinds at their positions among all. Null and empty pages: no items; broken HTML is read as far as it goes."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"id": cols["id"], "items": [[i for i in parse_sequence(x) if i["kind"] in kinds] for x in cols["html"]]}

    return arrow_map(pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")), run, f"id long, items array<{ITEM}>")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each item of ``interleave``, with the columns of ``media`` (one row for each digest) beside it.

    Text items and references without a payload have nulls there; position and caption stay with their item.
    """
    items = sequences.select("id", F.explode("items").alias("item")).select("id", "item.*")
    # Items without a digest, most of all, have a key each, so that they don't meet in one task.
    items = items.withColumn("key", F.coalesce("digest", F.concat(F.lit("~"), F.xxhash64("id", "position").cast("string"))))
    media = media.select(F.col("digest").alias("key"), *[F.col(c).alias(f"media_{c}") for c in media.columns if c != "digest"])
    return items.join(media, "key", "left").drop("key")


def store(payload: bytes) -> bytes:
    """A lossless 8-bit greyscale PNG, ``WIDTH`` samples a row, of a payload whose length is a positive multiple of ``WIDTH``."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload isn't a positive multiple of a row")
    rows = len(payload) // WIDTH
    body = bytearray(len(payload) + rows)
    for i in range(rows):
        body[i * (WIDTH + 1) + 1 : (i + 1) * (WIDTH + 1)] = payload[i * WIDTH : (i + 1) * WIDTH]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(body), 1)) + chunk(b"IEND", b"")


def read_back(stored: bytes) -> bytes:
    """The payload of what ``store`` made; ValueError if a checksum or the shape is wrong."""
    if stored[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    raw = zlib.decompress(data)
    if shape is None or shape[2:] != (8, 0, 0, 0, 0) or len(raw) != shape[1] * (shape[0] + 1) or any(raw[:: shape[0] + 1]):
        raise ValueError("the shape is wrong")
    w = shape[0] + 1
    return b"".join([raw[i + 1 : i + w] for i in range(0, len(raw), w)])


def features(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and the share of the commonest sample, of the samples of a payload."""
    import numpy as np

    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / len(payload)
    mean = float((p * np.arange(256)).sum())
    sd = float(np.sqrt(max(0.0, float((p * np.arange(256.0) ** 2).sum()) - mean * mean)))
    held = p[p > 0]
    return f"mean={mean:.4f};sd={sd:.4f};entropy={abs(float(-(held * np.log2(held)).sum())):.4f};mode={p.max():.4f}"


def pad(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of ``WIDTH``."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``page_id, html``: a page for each document, its lines as paragraphs; in their midst stands a figure that refers to the padded text by digest.

    Pages are put together by Spark's own functions, so that texts go to Python once, as the pages that are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(raw)
    padded = F.rpad(raw, F.greatest(F.ceil(size / WIDTH) * WIDTH, F.lit(WIDTH)).cast("int"), F.lit(b"\0"))
    n = size.cast("string")
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(padded, 256), F.lit('" data-bytes="'), n, F.lit('" alt=""><figcaption>'), n, F.lit(" bytes of text</figcaption></figure>"))
    escaped = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(name))
    rows = docs.select(F.col(id_col).cast("long").alias("page_id"), figure.alias("figure"), F.when(text != "", F.split(escaped, "\n", -1)).otherwise(F.array().cast("array<string>")).alias("lines"))
    half = F.floor(F.size("lines") / 2).cast("int")
    paragraphs = lambda first, count: F.array_join(F.transform(F.slice("lines", first, count), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    return rows.select("page_id", F.concat(paragraphs(F.lit(1), half), "figure", paragraphs(half + 1, F.size("lines"))).alias("html"))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest, stored``: each different padded text once, as a PNG. Equal texts of one batch are stored once, the rest by digest."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = {hashlib.sha256(p).hexdigest(): p for p in (pad((t or "").encode()) for t in cols["text"])}
        return {"digest": list(found), "stored": [store(p) for p in found.values()]}

    rows = arrow_map(_two(docs, id_col, text_col), run, "digest string, stored binary")
    return rows.groupBy("digest").agg(F.first("stored").alias("stored"))


def media_features(media: DataFrame) -> DataFrame:
    """``digest`` and what is read back from ``stored``: sizes, digests, checksum of the last 64 bytes, features."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        read = [read_back(s) for s in cols["stored"]]
        return {
            "digest": cols["digest"],
            "payload_bytes": [len(p) for p in read],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in read],
            "tail_crc32": [zlib.crc32(p[-64:]) for p in read],
            "bytes": [len(s) for s in cols["stored"]],
            "sha256": [hashlib.sha256(s).hexdigest() for s in cols["stored"]],
            "feature": [features(p) for p in read],
        }

    return arrow_map(media.select("digest", "stored"), run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, bytes long, sha256 string, feature string")


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
