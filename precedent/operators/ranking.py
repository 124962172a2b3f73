"""Deterministic per-query ranking.

Every ranking in the engine orders by the score rounded to ``digits``
decimals, descending, then by id ascending, so results do not depend on the
order in which floating-point sums were taken. ``row_number() <= k`` is
planned by Catalyst as a partial ``WindowGroupLimit`` before the exchange and
a final one after it, so a query with millions of candidates ships at most
``k`` rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group: str, score: str, tie: str, *,
                digits: int = 9, rank_col: str = "rank") -> DataFrame:
    """Add a 1-based BIGINT rank per ``group`` (no gaps, ties broken by ``tie``)."""
    w = Window.partitionBy(group).orderBy(F.round(F.col(score), digits).desc(),
                                          F.col(tie).asc())
    return df.withColumn(rank_col, F.row_number().over(w).cast("long"))


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int, *,
          digits: int = 9, rank_col: str = "rank") -> DataFrame:
    """Keep the ``k`` best rows per ``group``; adds ``rank_col``."""
    return rank_within(df, group, score, tie, digits=digits, rank_col=rank_col) \
        .filter(F.col(rank_col) <= k)


def first_n(df: DataFrame, rank_col: str, n: int) -> DataFrame:
    """First ``n`` entries of an already ranked list."""
    return df.filter(F.col(rank_col) <= n)
