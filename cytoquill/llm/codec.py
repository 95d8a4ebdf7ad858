"""Encode and decode whole documents with a word-end BPE vocabulary."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm import bpe
from cytoquill.llm.common import arrow_map


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (string) of each text.

    Null and empty texts: no ids, decoded empty. Repeated rows are encoded each. Other
    columns, whatever their names, are left out.
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        import numpy as np

        b = bpe.load(vocabulary)
        split = b.split_all(cols["text"])
        return {
            "doc_id": cols["doc_id"],
            "ids": [np.frombuffer(b"".join(map(b.ids.__getitem__, ws)), "<u4").astype("i4") for ws in split],
            "decoded": [b" ".join(map(b.shown.__getitem__, ws)).decode() for ws in split],
        }

    return arrow_map(_two(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string", lambda: bpe.load(vocabulary).release(), 4 << 20)


def codec_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text, as ``encode_documents`` encodes and decodes it.

    The digests are taken where the ids arise, so neither ids nor decoded texts leave the worker.
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        b = bpe.load(vocabulary)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ws in b.split_all(cols["text"]):
            ids = b"".join(map(b.ids.__getitem__, ws))
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b" ".join(map(b.shown.__getitem__, ws))).hexdigest())
        return out

    return arrow_map(_two(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: bpe.load(vocabulary).release(), 4 << 20)


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
