"""Size checks that guard every broadcast.

A side is broadcast only when a count taken on it proves that it fits;
otherwise the caller's plan falls back to a shuffle join (salted where a key
can be hot). Counting a small side is one cheap job; the big side is never
counted for this purpose.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default bound for a broadcast side, in rows. Each engine-side row that gets
# broadcast here is narrow (an id, a term, a few numbers), so 2M rows stays
# well under Spark's 8 GB broadcast ceiling and far under executor memory.
DEFAULT_BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Sized:
    df: DataFrame
    rows: int
    broadcast: bool


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> Sized:
    """Broadcast ``df`` if it has at most ``max_rows`` rows; count it once."""
    n = df.count()
    if n <= max_rows:
        return Sized(F.broadcast(df), n, True)
    return Sized(df, n, False)
