"""Hints to the optimizer that need no session setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinned(column: Column) -> Column:
    """The column, marked as not deterministic. Filters on it stay above its projection: pushed below, they would carry
    its whole expression, with every name that it uses many times over replaced in turn."""
    return F.when(F.monotonically_increasing_id() >= 0, column)
