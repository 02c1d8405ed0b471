"""All queries of this package."""

from __future__ import annotations

from answerloom.llm import queries  # noqa: F401  (importing registers)
from answerloom.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
