"""All queries of the engine by name, and their oracles."""

from __future__ import annotations

from . import lifecycle, matching, publishing, records, relational, reporting, retrieval  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
