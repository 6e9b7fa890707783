"""All queries of the library and their SQL."""

from __future__ import annotations

from . import answer_queries, artifact_queries, bundle_queries, constraint_queries, detail_queries, progress_queries, retrieval_queries, source_queries, table_queries, text_queries, work_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES
from .retrieval_queries import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
