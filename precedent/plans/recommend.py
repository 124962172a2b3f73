"""Batch recommendation (M5, E2) and single-ticket recommendation.

One set-based job for all query tickets: hybrid search → payload of the
top-k → nested neighbours → prompt → generator. There is no per-ticket
loop; a ticket whose generation fails carries ``error`` instead of failing
the batch (U2, F5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.operators.generate import generate
from precedent.operators.lookup import hydrate, nest_neighbours
from precedent.operators.render import build_prompt, extractive_recommendation
from precedent.plans.case_index import CaseIndex, search, with_row_key
from precedent.schema import NEIGHBOUR_SCHEMA, NO_MATCH_MESSAGE

RESULT_FIELDS = ["ticket_id", "issue", "description", "category", "similar_tickets",
                 "recommendation", "processing_time_seconds", "error"]


def neighbours(queries: DataFrame, index: CaseIndex, **search_kw) -> DataFrame:
    """Flat neighbour rows (query_id, rank, ticket_id, ..., similarity_score)."""
    hits = search(queries, index, **search_kw)
    return hydrate(hits, index.cases, key=index.key)


def recommend(queries: DataFrame, index: CaseIndex, *, generator=None,
              with_prompt: bool = False, query_key: str | None = None, clock=None,
              **search_kw) -> DataFrame:
    """One result row per query row (``query_key``: a column known to be unique, else row keys
    are assigned): query fields, ranked ``similar_tickets``, ``recommendation``,
    nullable ``processing_time_seconds`` and ``error`` (M5). With a ``clock`` (``generate``) the seconds
    are those of each row's generator call, rounded to 2; without one they stay NULL."""
    if query_key is None:
        # Every row is a query of its own, whatever its ticket id.
        query_key = "_query_key"
        queries = with_row_key(queries, query_key, "queries")
    nested = nest_neighbours(neighbours(queries, index, query_key=query_key, **search_kw))
    base = queries.select(*dict.fromkeys([query_key, "ticket_id", "issue", "description", "category"]))
    empty = F.array().cast(T.ArrayType(NEIGHBOUR_SCHEMA))
    res = (base.join(nested.withColumnRenamed("query_id", query_key), query_key, "left")
           .withColumn("similar_tickets", F.coalesce(F.col("similar_tickets"), empty))
           .withColumn("prompt", build_prompt()))
    if generator is None:
        res = res.withColumn("recommendation", extractive_recommendation()) \
            .withColumn("error", F.lit(None).cast("string"))
    else:
        # One pass: rows without neighbours get the no-match text (M4)
        # without a generator call.
        res = generate(res.withColumn("_no_hits", F.size("similar_tickets") == 0), "prompt",
                       generator, skip_col="_no_hits", fallback=NO_MATCH_MESSAGE, clock=clock,
                       seconds_col="_seconds").drop("_no_hits")
    timed = F.round("_seconds", 2) if "_seconds" in res.columns else F.lit(None).cast("double")
    res = res.withColumn("processing_time_seconds", timed)
    cols = RESULT_FIELDS + (["prompt"] if with_prompt else [])
    return res.select(*cols)


def run_summary(results: DataFrame) -> DataFrame:
    """total / succeeded / failed / mean seconds of successes."""
    ok = F.col("error").isNull()
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, F.col("processing_time_seconds"))).alias("mean_seconds"))
