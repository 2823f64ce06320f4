"""Compact keys for wide setting vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(columns: Sequence[str | Column]) -> Column:
    """SHA-256 over a canonical text of the columns, nulls included.

    Setting vectors hold tweak texts of many kilobytes; shuffles carry this key
    and the texts travel once per group.
    """
    fields = [F.col(f"`{c}`") if isinstance(c, str) else c for c in columns]
    named = [f.alias(f"c{i}") for i, f in enumerate(fields)]
    return F.unhex(F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256))


def col(name: str) -> Column:
    """Column by exact name; setting and report names hold spaces and '#'."""
    return F.col(f"`{name}`")
