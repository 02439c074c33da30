"""All queries outside the training-data subpackage, by name."""

from __future__ import annotations

from .plans import jobs
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "jobs"]
