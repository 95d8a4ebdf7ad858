"""Names of the registered queries, their functions and their SQL."""

from __future__ import annotations

from cytoquill.plans import graph_queries, integrity_queries, module_queries, nb_queries, pseudobulk_queries, qc_queries, report_queries, set_queries, workflow_queries  # noqa: F401
from cytoquill.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
