"""Reciprocal rank fusion (A6) and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.operators.bm25 import KeywordIndex, bm25_topk
from precedent.operators.dense import dense_topk
from precedent.operators.ranking import top_k
from precedent.schema import RetrievalParams


def rrf_fuse(lists: list[DataFrame], c: float = 60.0) -> DataFrame:
    """(query_id, doc_id, score) with score = sum over lists of 1 / (c + rank).

    A list that lacks a document adds nothing for it. Each input holds at
    most a few ranked rows per query, so the union is small and the
    aggregation has a partial (map-side) step.
    """
    u = None
    for lst in lists:
        part = lst.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.lit(float(c)) + F.col("rank"))).alias("score"))


def hybrid_topk(queries: DataFrame, vectors: DataFrame, keywords: KeywordIndex, *,
                query_id: str, q_vec: str, q_text: str, doc_id: str, d_vec: str,
                query_group: str | None = None, doc_group: str | None = None,
                exclude_self: bool = False,
                params: RetrievalParams = RetrievalParams(),
                dense_queries: DataFrame | None = None) -> DataFrame:
    """Dense top-2k and BM25 top-2k fused by RRF, best ``k`` kept.

    The two candidate lists are independent branches of one plan. ``min_score``
    is a bound on cosines and applies to the dense list alone.
    ``dense_queries`` supplies the query vectors when they live in another
    frame than the query texts (same ``query_id`` column).
    """
    fetch = params.fetch
    dq = dense_queries if dense_queries is not None else queries
    dense = dense_topk(dq, vectors, fetch, params=params, query_id=query_id,
                       q_vec=q_vec, doc_id=doc_id, d_vec=d_vec,
                       query_group=query_group, doc_group=doc_group,
                       exclude_self=exclude_self)
    sparse = bm25_topk(queries, keywords, fetch, query_id=query_id, text=q_text,
                       query_group=query_group, exclude_self=exclude_self, params=params)
    fused = rrf_fuse([dense, sparse], params.rrf_c)
    return top_k(fused, "query_id", "score", "doc_id", params.k, digits=params.rank_digits)
