"""What several operators need of tables: the engine's stored ones, and names for columns of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..stored import discard, shared_dir, spread, written

__all__ = ["discard", "shared_dir", "spread", "unused", "written"]


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one if df has a column of that name, in capitals or not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
