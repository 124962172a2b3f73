"""Attaching case payloads to hits (J5) and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.session import materialize

#: Hits of at most this many bytes are broadcast to the payload scan.
HITS_BROADCAST_BYTES = 256 << 20
# Score, rank and the row's share of the hash table, beside the two ids.
_HIT_BYTES = 64

NEIGHBOUR_FIELDS = ["ticket_id", "issue", "description", "category", "resolution",
                    "agent_name", "resolved"]


def hydrate(hits: DataFrame, cases: DataFrame, *, key: str = "ticket_id",
            max_broadcast_bytes: int = HITS_BROADCAST_BYTES) -> DataFrame:
    """hits(query_id, doc_id, score, rank) ⋈ cases on ``key`` → neighbour rows.

    Ranking ran on ids only; the payload is joined to at most k rows per
    query. The hits are written once and their bytes summed on the way; when
    they fit ``max_broadcast_bytes`` they are broadcast and the payload is
    scanned where it lies, without an exchange. Larger hits meet it in a
    shuffle join on the key, which adaptive execution splits at a hot case.
    """
    ids = F.coalesce(F.octet_length(F.col("query_id").cast("string")), F.lit(0)) \
        + F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0))
    hits, size = materialize(hits.select("query_id", "doc_id", "score", "rank"), "hits",
                             {"bytes": F.sum(ids + F.lit(_HIT_BYTES))})
    if (size["bytes"] or 0) <= max_broadcast_bytes:
        hits = F.broadcast(hits)
    payload = cases.select(F.col(key).alias("doc_id"),
                           *[F.col(c) for c in NEIGHBOUR_FIELDS if c != key])
    out = payload.join(hits, "doc_id")
    if key in NEIGHBOUR_FIELDS:
        out = out.withColumn(key, F.col("doc_id"))
    return out.select("query_id", "rank", *NEIGHBOUR_FIELDS,
                      F.col("score").alias("similarity_score"))


def nest_neighbours(neighbours: DataFrame) -> DataFrame:
    """(query_id, similar_tickets array<struct> ordered by rank).

    Each group holds at most k rows, so ``collect_list`` is bounded.
    """
    fields = ["rank", *NEIGHBOUR_FIELDS, "similarity_score"]
    neighbours = neighbours.withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return neighbours.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("similar_tickets"))


def lookup_case(cases: DataFrame, ids: DataFrame, *, key: str = "ticket_id") -> DataFrame:
    """For each requested id, the latest matching case or a 'not found' row."""
    found = cases.withColumn("_found", F.lit(True))
    out = ids.join(found, key, "left")
    return out.withColumn("status", F.when(F.col("_found"), F.lit("found"))
                          .otherwise(F.lit("not found"))).drop("_found")
