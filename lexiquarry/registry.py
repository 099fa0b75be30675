"""All queries of the package's own operators, and their SQL."""

from __future__ import annotations

from .plans import cleaning, embeddings, lexical, shares, topics  # noqa: F401  they register themselves
from .plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
