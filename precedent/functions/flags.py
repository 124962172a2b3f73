"""Coercion of a text flag to boolean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precedent.schema import TRUE_WORDS


def parse_flag(c: Column | str) -> Column:
    """True for 'true'/'1'/'yes' (any case, trimmed) or a non-zero number.

    A NULL or blank cell is False (the reference counts a blank CSV cell as
    resolved because NaN is truthy; we do not copy that).
    """
    col = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.trim(col.cast("string")))
    d = s.try_cast("double")
    numeric_true = d.isNotNull() & ~F.isnan(d) & (d != 0)
    return F.coalesce(s.isin(*TRUE_WORDS) | numeric_true, F.lit(False))
