"""Registered queries. Importing a module of this package registers its queries."""

from . import detection_queries, file_queries, finding_queries, governance_queries, source_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
