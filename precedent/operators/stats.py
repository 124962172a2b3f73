"""Counts and index statistics (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category_counts(df: DataFrame, col: str = "category") -> DataFrame:
    """(category, n) sorted by category (A1, L3)."""
    return (df.groupBy(F.col(col).alias("category"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("category"))


def resolution_counts(df: DataFrame, col: str = "resolved") -> DataFrame:
    """total / resolved / unresolved (A2)."""
    ok = F.coalesce(F.col(col), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("resolved"),
                  F.count_if(~ok).alias("unresolved"))


def index_stats(vectors: DataFrame, category: str = "category",
                vec: str = "embedding") -> DataFrame:
    """Points per category with index totals and vector width (A3), exact over
    every point."""
    per = vectors.groupBy(F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim"))
    # A row per category: the window over them all is as small as they are few.
    every = Window.partitionBy()
    return per.select("category", "n", F.sum("n").over(every).cast("long").alias("points"),
                      F.max("dim").over(every).cast("int").alias("dim"))
