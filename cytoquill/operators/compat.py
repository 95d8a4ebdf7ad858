"""Do tables belong together: findings as rows, and a report with policies."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDINGS = "code string, severity string, subject string, n long, example string"


class CompatibilityError(ValueError):
    def __init__(self, report: Report) -> None:
        super().__init__(f"{len(report.errors)} findings: " + ", ".join(f["code"] for f in report.errors))
        self.report = report


class CompatibilityWarning(UserWarning):
    pass


@dataclass(frozen=True)
class Report:
    """Findings in a fixed order; the id depends on them alone."""

    findings: tuple[Mapping, ...]

    @property
    def errors(self) -> list[Mapping]:
        return [f for f in self.findings if f["severity"] == "error"]

    @property
    def is_compatible(self) -> bool:
        return not self.errors

    @property
    def report_id(self) -> str:
        return "report:" + hashlib.sha256(json.dumps([dict(f) for f in self.findings], sort_keys=True).encode()).hexdigest()

    def apply_policy(self, policy: str = "report") -> Report:
        if policy not in ("report", "warn", "error"):
            raise ValueError(f"no policy {policy!r}")
        if not self.is_compatible and policy == "error":
            raise CompatibilityError(self)
        if not self.is_compatible and policy == "warn":
            warnings.warn(", ".join(f["code"] for f in self.errors), CompatibilityWarning, stacklevel=2)
        return self


def _finding(bad: DataFrame, code: str, subject: str, example: str, severity: str = "error") -> DataFrame:
    """One row if there are bad rows: how many, and the smallest example."""
    return bad.agg(F.count("*").alias("n"), F.min(F.col(example).cast("string")).alias("example")).where("n > 0").select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(subject).alias("subject"), "n", "example")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def axis_findings(axis: str, ids: DataFrame, counts: DataFrame) -> list[DataFrame]:
    """Repeated or empty ids of an axis, ids that counts have beyond it, and ids without counts (a warning)."""
    c = f"{axis}_id"
    twice = ids.groupBy(c).agg(F.count("*").alias("k")).where(f"k > 1 or {c} is null or {c} = ''")
    own = counts.select(c).distinct()
    return [
        _finding(twice, f"{axis}_ids_not_unique", axis, c),
        _finding(own.join(ids, c, "left_anti"), f"{axis}_ids_missing_from_axis", axis, c),
        _finding(ids.select(c).distinct().join(own, c, "left_anti"), f"{axis}_ids_without_counts", axis, c, "warning"),
    ]


def order_mismatch(left: DataFrame, right: DataFrame, position: str = "position", value: str = "id") -> DataFrame:
    """One row if two ordered axes differ: how many positions, and the first with both ids."""
    j = left.select(position, F.col(value).alias("l")).join(right.select(position, F.col(value).alias("r")), position, "full_outer").where("not (l <=> r)")
    first = F.min(F.struct(position, "l", "r"))
    return j.agg(F.count("*").alias("n"), first.alias("f")).where("n > 0").select("n", F.col(f"f.{position}").alias(position), F.col("f.l").alias("left"), F.col("f.r").alias("right"))


def count_findings(counts: DataFrame) -> list[DataFrame]:
    from cytoquill.operators.checks import invalid_counts

    twice = counts.groupBy("cell_id", "gene_id").agg(F.count("*").alias("k")).where("k > 1")
    return [_finding(invalid_counts(counts), "counts_invalid", "counts", "cell_id"), _finding(twice, "counts_repeated", "counts", "cell_id")]


def split_findings(counts: DataFrame, split: DataFrame) -> list[DataFrame]:
    from cytoquill.operators.split import conservation

    return [_finding(conservation(counts, split), "splits_not_conserved", "splits", "cell_id")]


def graph_findings(edges: DataFrame, cells: DataFrame) -> list[DataFrame]:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("x")).select(F.col("x").cast("string").alias("cell_id")).distinct()
    w = F.col("weight")
    return [
        _finding(ends.join(cells.select(F.col("cell_id").cast("string").alias("cell_id")), "cell_id", "left_anti"), "graph_nodes_unknown", "graph", "cell_id"),
        _finding(edges.where(w.isNull() | F.isnan(w) | (w < 0)), "graph_weights_invalid", "graph", "src"),
    ]


def metadata_findings(metadata: DataFrame, cells: DataFrame) -> list[DataFrame]:
    return [
        _finding(cells.select("cell_id").join(metadata, "cell_id", "left_anti"), "metadata_missing", "metadata", "cell_id"),
        _finding(metadata.select("cell_id").join(cells, "cell_id", "left_anti"), "metadata_unknown", "metadata", "cell_id"),
    ]


def parameter_findings(expected: Mapping, found: Mapping) -> list[dict]:
    """Parameters that differ, are missing or unknown."""
    out = []
    for k in sorted({*expected, *found}):
        code = "parameter_missing" if k not in found else "parameter_unknown" if k not in expected else "parameter_differs" if expected[k] != found[k] else None
        if code:
            out.append({"code": code, "severity": "error" if code != "parameter_unknown" else "warning", "subject": "parameters", "n": 1, "example": k})
    return out


def findings(counts: DataFrame, cells: DataFrame, genes: DataFrame, split: DataFrame | None = None, edges: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """All findings of tables that should belong together, at most one row for each check."""
    parts = [*axis_findings("cell", cells, counts), *axis_findings("gene", genes, counts), *count_findings(counts)]
    if split is not None:
        parts += split_findings(counts, split)
    if edges is not None:
        parts += graph_findings(edges, cells)
    if metadata is not None:
        parts += metadata_findings(metadata, cells)
    return _union(parts)


def validate(*tables: DataFrame, expected: Mapping | None = None, found: Mapping | None = None, policy: str = "report", **more: DataFrame) -> Report:
    """A report of ``findings`` and of parameters, after the policy."""
    rows = [r.asDict() for r in findings(*tables, **more).collect()]  # a row for each check at most
    rows += parameter_findings(expected or {}, found or {})
    return Report(tuple(sorted(rows, key=lambda f: (f["severity"], f["code"], f["subject"], f["example"] or "")))).apply_policy(policy)
