"""All queries of the engine by name, with the SQL twin of each."""

from __future__ import annotations

from . import curation, joining, normalise, reporting  # noqa: F401
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "ag_12"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
