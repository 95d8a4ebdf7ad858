"""Canonical JSON, domain-separated hashes and provenance records."""

from __future__ import annotations

import hashlib
import json
import math
import platform
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime
from importlib import metadata
from types import MappingProxyType
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "cytoquill-provenance/1"


class ProvenanceError(ValueError):
    """A value that can't be recorded, or a record that was changed."""


def to_jsonable(value: Any, _seen: tuple[int, ...] = ()) -> Any:
    """Plain JSON values: no NaN or infinity, no arrays, no cycles, only datetimes with a time zone, only string keys."""
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, np.bool_):
        return bool(value)
    if isinstance(value, int | np.integer):
        return int(value)
    if isinstance(value, float | np.floating):
        if not math.isfinite(value):
            raise ProvenanceError(f"{value} isn't finite")
        return float(value)
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ProvenanceError("a datetime needs a time zone")
        return value.astimezone(UTC).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if id(value) in _seen:
        raise ProvenanceError("a value contains itself")
    seen = (*_seen, id(value))
    if isinstance(value, Mapping):
        if bad := [k for k in value if not isinstance(k, str)]:
            raise ProvenanceError(f"keys must be strings, not {bad[0]!r}")
        return {k: to_jsonable(v, seen) for k, v in value.items()}
    if isinstance(value, set | frozenset):
        return sorted((to_jsonable(v, seen) for v in value), key=canonical_json)
    if isinstance(value, Sequence) and not isinstance(value, bytes | bytearray):
        return [to_jsonable(v, seen) for v in value]
    raise ProvenanceError(f"{type(value).__name__} has no JSON form")


def canonical_json(value: Any) -> str:
    return json.dumps(to_jsonable(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def freeze(value: Any) -> Any:
    """A view of a JSON value that can't be changed."""
    value = to_jsonable(value)

    def cold(v: Any) -> Any:
        return MappingProxyType({k: cold(x) for k, x in v.items()}) if isinstance(v, dict) else tuple(map(cold, v)) if isinstance(v, list) else v

    return cold(value)


@dataclass(frozen=True)
class HashRecord:
    digest: str
    domain: str
    ordering: str = "none"
    algorithm: str = "sha256"
    encoding: str = "canonical-json"

    def to_dict(self) -> dict[str, str]:
        return {k: getattr(self, k) for k in ("algorithm", "digest", "domain", "encoding", "ordering")}

    @classmethod
    def from_dict(cls, d: Mapping[str, str]) -> HashRecord:
        out = cls(**d)
        if out.algorithm != "sha256" or len(out.digest) != 64:
            raise ProvenanceError("not a SHA-256 record")
        return out


def prefix(domain: str) -> bytes:
    return f"{SCHEMA}:{domain}".encode() + b"\0"


def hash_bytes(data: bytes, domain: str, ordering: str = "none", encoding: str = "canonical-json") -> HashRecord:
    return HashRecord(hashlib.sha256(prefix(domain) + data).hexdigest(), domain, ordering, encoding=encoding)


def hash_payload(value: Any, domain: str) -> HashRecord:
    return hash_bytes(canonical_json(value).encode(), domain)


def normalize_identifiers(ids: Iterable[Any]) -> list[str]:
    """Ids as strings; empty and repeated ones are errors that name the first."""
    out, seen = [], set()
    for i, x in enumerate(ids):
        s = str(x)
        if not s:
            raise ProvenanceError(f"id {i} is empty")
        if s in seen:
            raise ProvenanceError(f"id {s!r} is repeated at {i}")
        seen.add(s)
        out.append(s)
    return out


def hash_ordered_ids(ids: Iterable[Any], domain: str) -> HashRecord:
    return hash_bytes(canonical_json(normalize_identifiers(ids)).encode(), domain, "ordered")


def hash_membership_ids(ids: Iterable[Any], domain: str) -> HashRecord:
    return hash_bytes(canonical_json(sorted(normalize_identifiers(ids))).encode(), domain, "sorted")


def hash_array(values: np.ndarray, domain: str) -> HashRecord:
    """Of shape, type and little-endian content."""
    a = np.ascontiguousarray(values)
    head = canonical_json({"shape": list(a.shape), "dtype": a.dtype.newbyteorder("<").str}).encode()
    return hash_bytes(head + b"\0" + a.astype(a.dtype.newbyteorder("<")).tobytes(), domain, encoding="array")


def hash_rows(df: DataFrame, ids: Sequence[str]) -> HashRecord:
    """Of a table's content whatever its order: the sum of row hashes, so that nothing is sorted or gathered."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    got = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h"), F.bit_xor(row).alias("x")).first()
    return hash_payload({"columns": sorted(df.columns), "ids": list(ids), "rows": got["n"], "sum": str(got["h"]), "xor": str(got["x"])}, "table")


def membership_digest(ids: Column, domain: str) -> Column:
    """``hash_membership_ids`` of each group, in an aggregate; ids must be ASCII for the same text. A group's ids meet in one row."""
    text = F.to_json(F.array_sort(F.collect_set(ids.cast("string"))))
    return F.sha2(F.concat(F.lit(bytearray(prefix(domain))), text.cast("binary")), 256)


def stable_identifier(kind: str, value: Any) -> str:
    if not kind or ":" in kind:
        raise ProvenanceError("a kind is a word without colon")
    return f"{kind}:{hash_payload(value, kind).digest}"


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def versions(packages: Sequence[str] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    found = {"python": platform.python_version()}
    for p in packages:
        try:
            found[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            found[p] = "missing"
    return found


@dataclass(frozen=True)
class Envelope:
    """What made a result. Its id depends on stage, parents, algorithm and inputs; not on environment, diagnostics and time."""

    stage: str
    parents: tuple[str, ...]
    algorithm: Mapping[str, Any]
    inputs: Mapping[str, Any]
    environment: Mapping[str, Any]
    diagnostics: Mapping[str, Any]
    created: str
    stable_id: str
    schema_version: str = "1"

    @classmethod
    def create(cls, stage: str, algorithm: Mapping[str, Any], inputs: Mapping[str, Any], parents: Sequence[str] = (), diagnostics: Mapping[str, Any] | None = None) -> Envelope:
        identity = {"stage": stage, "parents": list(parents), "algorithm": algorithm, "inputs": inputs}
        return cls(stage, tuple(parents), freeze(algorithm), freeze(inputs), freeze(versions()), freeze(diagnostics or {}), utc_now(), stable_identifier("provenance", identity))

    def with_diagnostics(self, diagnostics: Mapping[str, Any]) -> Envelope:
        return replace(self, diagnostics=freeze({**_thaw(self.diagnostics), **diagnostics}))

    def to_dict(self) -> dict[str, Any]:
        return {k: _thaw(getattr(self, k)) for k in self.__dataclass_fields__}

    def to_json(self) -> str:
        return canonical_json(self.to_dict())

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> Envelope:
        """ProvenanceError if what the id stands for was changed."""
        if d.get("schema_version") != "1":
            raise ProvenanceError("unknown version")
        identity = {k: d[k] for k in ("stage", "parents", "algorithm", "inputs")}
        if stable_identifier("provenance", identity) != d["stable_id"]:
            raise ProvenanceError("the record was changed")
        rest = {k: freeze(d[k]) for k in ("algorithm", "inputs", "environment", "diagnostics")}
        return cls(stage=d["stage"], parents=tuple(d["parents"]), created=d["created"], stable_id=d["stable_id"], **rest)


def _thaw(v: Any) -> Any:
    return {k: _thaw(x) for k, x in v.items()} if isinstance(v, Mapping) else [_thaw(x) for x in v] if isinstance(v, tuple) else v
