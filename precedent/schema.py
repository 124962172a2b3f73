"""Table schemas and the default parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Normalised case (ticket) record.
CASE_FIELDS = ["ticket_id", "issue", "description", "category", "date",
               "resolution", "agent_name", "resolved"]

CASE_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.StringType(), False),
    T.StructField("issue", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("date", T.StringType(), False),
    T.StructField("resolution", T.StringType(), True),
    T.StructField("agent_name", T.StringType(), True),
    T.StructField("resolved", T.BooleanType(), True),
])

# One neighbour inside a result row.
NEIGHBOUR_SCHEMA = T.StructType([
    T.StructField("rank", T.LongType(), False),
    T.StructField("ticket_id", T.StringType(), True),
    T.StructField("issue", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("resolution", T.StringType(), True),
    T.StructField("agent_name", T.StringType(), True),
    T.StructField("resolved", T.BooleanType(), True),
    T.StructField("similarity_score", T.DoubleType(), True),
])

REJECT_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
])

# Fixed values that must equal the reference behaviour.
# Defaults for a missing key when normalising a record.
DEFAULT_TICKET_ID = "UNKNOWN"
DEFAULT_CATEGORY = "Unknown"
# Text values that count as a true "resolved" flag.
TRUE_WORDS = ["true", "1", "yes"]
# Message when a query has no neighbour at all.
NO_MATCH_MESSAGE = ("No similar tickets found in the database. "
                    "Please escalate to a senior agent.")
# Category choice that means "no category filter" in the manual form.
ALL_CATEGORIES = "All Categories"
# Missing value shown in prompts and reports.
MISSING = "N/A"


@dataclass(frozen=True)
class RetrievalParams:
    """Search parameters. Defaults are the reference's defaults."""
    k: int = 3                      # neighbours returned per query
    candidates_per_list: int | None = None     # over-fetch per list before fusion; None: 2k
    rrf_c: float = 60.0             # reciprocal rank fusion constant
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    min_score: float | None = None  # threshold 0.0 in the reference, never applied
    dim: int = 384                  # hashing encoder width
    # Decimal places a score is rounded to before ranking; ties then break by id.
    rank_digits: int = 9

    @property
    def fetch(self) -> int:
        return 2 * self.k if self.candidates_per_list is None else self.candidates_per_list
