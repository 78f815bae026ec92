"""Names of helper columns that clash with no column of the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(base: str, *tables: DataFrame) -> str:
    """``base`` with as many underscores before it as no table's column has."""
    taken = {c.lower() for d in tables for c in d.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = "_" + name
    return name
