"""All registered queries of the document engine and the SQL that states the same result."""

from __future__ import annotations

from quire.plans import absorbing, compiling, curating, listing, people, retrieval, series, storing, validating  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
