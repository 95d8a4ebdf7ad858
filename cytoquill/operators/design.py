"""Additive designs, contrasts and their records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


#: Levels that are looked up for columns, at most.
MOST_LEVELS = 10_000


class DesignError(ValueError):
    pass


class FitError(ValueError):
    """A fit that can't be made, with what was found."""

    def __init__(self, message: str, diagnostics: Mapping | None = None) -> None:
        super().__init__(message)
        self.diagnostics = dict(diagnostics or {})


@dataclass(frozen=True)
class Design:
    """A design matrix with its samples in order, its columns, rank and condition number."""

    formula: str
    terms: tuple[str, ...]
    samples: tuple[str, ...]
    columns: tuple[str, ...]
    matrix: tuple[tuple[float, ...], ...] = field(repr=False)
    rank: int
    condition: float
    fit_id: str

    @property
    def x(self) -> np.ndarray:
        return np.array(self.matrix)

    @property
    def one_hot(self) -> bool:
        """Each sample has a single 1, all else 0."""
        x = self.x
        return bool(((x == 0) | (x == 1)).all() and (x.sum(1) == 1).all())

    def column(self, name: str) -> int:
        """A column by its name, or by the part of it after a factor if that is unique."""
        if name in self.columns:
            return self.columns.index(name)
        found = [i for i, c in enumerate(self.columns) if c.endswith(f"_{name}") or c.endswith(f"__{name}")]
        if len(found) != 1:
            raise ValueError(f"{name!r} fits {len(found)} of the columns {', '.join(self.columns)}")
        return found[0]


def parse_formula(formula: str) -> tuple[list[str], bool]:
    """Terms and whether there is an intercept; ``0`` and ``- 1`` remove it. Only sums of columns are allowed."""
    text = formula.strip().removeprefix("~").replace("-", "+ -")
    terms: list[str] = []
    intercept = True
    for t in (t.strip() for t in text.split("+")):
        if t.replace(" ", "") in ("0", "-1"):
            intercept = False
        elif t in ("1", ""):
            continue
        elif t.startswith("-") or any(c in t for c in ":*()|^"):
            raise DesignError(f"only sums of columns are allowed, not {t!r}")
        elif t in terms:
            raise DesignError(f"{t!r} comes twice")
        else:
            terms.append(t)
    return terms, intercept


def build_design(samples: DataFrame, formula: str, sample: str = "pb_id") -> Design:
    """The design of ``samples`` (a row for each; they come to the driver, numbers and levels only).

    Numeric columns enter as they are; levels of others are sorted, and the first is the
    reference with an intercept. Missing columns, nulls and deficient rank are errors.
    """
    terms, intercept = parse_formula(formula)
    if missing := [t for t in terms if t not in samples.columns]:
        raise KeyError(f"no columns {', '.join(missing)}")
    rows = samples.select(sample, *terms).orderBy(sample).collect()
    names = [str(r[sample]) for r in rows]
    if len(set(names)) < len(names):
        raise DesignError("sample ids must be unique")
    columns, data = (["Intercept"], [np.ones(len(rows))]) if intercept else ([], [])
    full = not intercept
    for t in terms:
        values = [r[t] for r in rows]
        if any(v is None for v in values):
            raise DesignError(f"{t!r} has a null level")
        if isinstance(samples.schema[t].dataType, NumericType):
            columns.append(t)
            data.append(np.array(values, float))
            continue
        levels = sorted({str(v) for v in values})
        for level in levels if full else levels[1:]:
            columns.append(f"{t}_{level}")
            data.append(np.array([float(str(v) == level) for v in values]))
        full = False
    x = np.stack(data, 1) if data else np.empty((len(rows), 0))
    rank = int(np.linalg.matrix_rank(x)) if x.size else 0
    if rank < x.shape[1]:
        raise DesignError(f"the design is rank deficient: {rank} of {x.shape[1]} columns")
    key = json.dumps([formula, names, columns, x.tolist()], sort_keys=True)
    return Design(formula, tuple(terms), tuple(names), tuple(columns), tuple(map(tuple, x.tolist())), rank, float(np.linalg.cond(x)) if x.size else 0.0, "fit:" + hashlib.sha256(key.encode()).hexdigest())


def dummies(samples: DataFrame, factor: str, sample: str = "pb_id", levels: Sequence[str] | None = None) -> DataFrame:
    """``sample`` and a 0/1 column for each level of a factor, in Spark. Without ``levels`` they are looked up; more than 10,000 raise DesignError."""
    if levels is None:
        levels = [r[0] for r in samples.select(F.col(factor).cast("string")).distinct().orderBy(factor).limit(MOST_LEVELS + 1).collect()]
        if len(levels) > MOST_LEVELS:
            raise DesignError(f"{factor!r} has more than {MOST_LEVELS} levels; name those wanted")
    return samples.select(sample, *[F.when(F.col(factor) == v, 1.0).otherwise(0.0).alias(f"{factor}_{v}") for v in levels])


def select_columns(columns: Sequence[str], wanted: Sequence[str] | None = None) -> list[str]:
    """Columns asked for, else all proportions of clusters, else all their weights."""
    if wanted is not None:
        return list(wanted)
    for prefix in ("cluster_prop__", "cluster_weight__"):
        if found := [c for c in columns if c.startswith(prefix)]:
            return found
    raise ValueError("no cluster columns; name the columns of the design")


def one_vs_rest(columns: Sequence[str]) -> dict[str, np.ndarray]:
    """For each column, 1 for it and -1 / (K - 1) for the others."""
    k = len(columns)
    if k < 2:
        raise ValueError("two columns are needed at least")
    return {c: np.array([1.0 if i == j else -1 / (k - 1) for j in range(k)]) for i, c in enumerate(columns)}


def pairwise(design: Design, pairs: Sequence[tuple[str, str]] | None = None) -> dict[str, np.ndarray]:
    """1 and -1 for each pair of columns (all pairs unless given)."""
    pairs = list(combinations(design.columns, 2)) if pairs is None else list(pairs)
    out = {}
    for a, b in pairs:
        i, j = design.column(a), design.column(b)
        if i == j:
            raise ValueError(f"{a!r} and {b!r} are one column")
        v = np.zeros(len(design.columns))
        v[i], v[j] = 1.0, -1.0
        out[f"{design.columns[i]}_vs_{design.columns[j]}"] = v
    return out


def factor_contrast(design: Design, factor: str, level: str, reference: str) -> np.ndarray:
    """A contrast of two levels; with an intercept the first level has no column."""
    v = np.zeros(len(design.columns))
    for name, sign in ((level, 1.0), (reference, -1.0)):
        if (c := f"{factor}_{name}") in design.columns:
            v[design.columns.index(c)] += sign
        elif "Intercept" not in design.columns:
            raise ValueError(f"no column for level {name!r} of {factor!r}")
    return v


def contrast_record(design: Design, name: str, vector: np.ndarray, results: DataFrame) -> dict:
    """A contrast's stable id, and how many results aren't finite."""
    key = json.dumps([design.fit_id, name, [float(v) for v in vector]])
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c))
    n = results.agg(F.count("*").alias("n"), bad("log2FoldChange").alias("lfc"), bad("pvalue").alias("p")).first()
    return {"contrast_id": "contrast:" + hashlib.sha256(key.encode()).hexdigest(), "name": name, "vector": [float(v) for v in vector], "n": n["n"], "n_lfc_not_finite": n["lfc"], "n_p_not_finite": n["p"]}


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, finite, min, median, max of the finite values."""
    x = F.col(column).cast("double")
    ok = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return df.agg(F.count("*").alias("n"), F.count(ok).alias("n_finite"), F.min(ok).alias("min"), F.median(ok).alias("median"), F.max(ok).alias("max"))


def describe(design: Design) -> dict:
    return {k: v for k, v in asdict(design).items() if k != "matrix"}
