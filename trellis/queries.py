"""The registered queries of the reference operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from trellis.plans import directory, ledger, lists, metrics, singles, texts  # noqa: F401  they register their queries
from trellis.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
