"""All registered queries."""

from __future__ import annotations

from answerloom.plans import extraction_queries, matching_queries, text_queries, workflow_queries  # noqa: F401  (importing registers)
from answerloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
