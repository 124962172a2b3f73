"""Row filters (F1, F4, F5). F2 and F3 live inside retrieval, before ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precedent.functions.text import clean_text

# Messages for a rejected form entry.
MISSING_ISSUE = "Please provide an issue title."
MISSING_DESCRIPTION = "Please provide a detailed description."


def only_resolved(df: DataFrame, col: str = "resolved") -> DataFrame:
    """Keep resolved cases (F1); NULL counts as unresolved."""
    return df.filter(F.coalesce(F.col(col), F.lit(False)))


def blank(c: Column | str) -> Column:
    return F.coalesce(F.length(clean_text(c)), F.lit(0)) == 0


def validation_reason(issue: str = "issue", description: str = "description") -> Column:
    """NULL for a valid entry, else the first problem found."""
    return (F.when(blank(issue), F.lit(MISSING_ISSUE))
            .when(blank(description), F.lit(MISSING_DESCRIPTION)))


def validate_cases(df: DataFrame, issue: str = "issue", description: str = "description"
                   ) -> tuple[DataFrame, DataFrame]:
    """Split into (valid rows, rejected rows with ``reason``)."""
    tagged = df.withColumn("reason", validation_reason(issue, description))
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))


def is_error(col: str = "error") -> Column:
    """Result row that failed."""
    return F.col(col).isNotNull()
