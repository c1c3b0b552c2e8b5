"""Column names that clash with nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, stem: str) -> str:
    """A name starting with ``stem`` that no column of ``df`` has, whatever its case."""
    taken, k = {c.lower() for c in df.columns}, 0
    while f"{stem}_{k}".lower() in taken:
        k += 1
    return f"{stem}_{k}"
