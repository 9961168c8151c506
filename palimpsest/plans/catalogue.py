"""All queries of the retrieval library and their SQL."""

from __future__ import annotations

from . import analysis, extras, memory, questions, retrieval, textual, timeline, tuning  # noqa: F401  modules register their queries as they are imported
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
