"""Operators for training-data pipelines and their queries."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
