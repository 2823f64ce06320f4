"""Queries of every operator on the given tables."""

from . import match_queries, record_queries, table_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "match_queries", "record_queries", "table_queries"]
