"""Latest row per key.

An aggregation, not a window: ``max_by`` has a partial (map-side) step, so
a key that owns a third of all rows is reduced to one row per map task
before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """For each ``key``, the row with the greatest ``order`` tuple (last one wins)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")
