"""Retrieval quality (A7, A8) and exact containment ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.functions.text import tokenize
from precedent.operators.bm25 import KeywordIndex
from precedent.operators.sizing import DEFAULT_BROADCAST_ROWS, maybe_broadcast


def containment_truth(passages: DataFrame, pid: str, ptext: str, docs: DataFrame,
                      did: str, dtext: str, index: KeywordIndex,
                      broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(pid, did) pairs where the document text contains the passage verbatim.

    No cross join: a containing document must hold every interior term of the
    passage (the first and last may be cut words), so each passage is joined
    only to the postings of its rarest interior term, and ``contains`` checks
    those candidates. Passages of one or two terms use all their terms.
    """
    toks = passages.select(F.col(pid).alias("pid"), F.col(ptext).alias("ptext"),
                           tokenize(ptext).alias("t"))
    inner = F.when(F.size("t") >= 3, F.slice("t", 2, F.size("t") - 2)).otherwise(F.col("t"))
    terms = toks.select("pid", "ptext", F.explode(F.array_distinct(inner)).alias("term"))
    rare = (terms.join(index.terms.select("term", "df"), "term")
            .groupBy("pid", "ptext")
            .agg(F.min_by("term", F.struct("df", "term")).alias("term")))
    cand = rare.join(index.postings.select("term", F.col("doc_id").alias("did")), "term") \
        .select("pid", "ptext", "did")
    # Candidates are few (each passage brings the postings of its rarest
    # term): broadcast them into the document scan so no document text is
    # shuffled; past the bound, both sides shuffle on the document id.
    sized = maybe_broadcast(cand, broadcast_rows)
    body = docs.select(F.col(did).alias("did"), F.col(dtext).alias("dtext"))
    return (body.join(sized.df, "did").filter(F.contains("dtext", "ptext"))
            .select(F.col("pid").alias(pid), F.col("did").alias(did)))


def hit_rank(hits: DataFrame, truth: DataFrame, *, query_id: str, doc_id: str) -> DataFrame:
    """Each truth pair with the rank it got in ``hits`` (NULL when missed)."""
    h = hits.select(F.col("query_id").alias(query_id), F.col("doc_id").alias(doc_id), "rank")
    return truth.join(h, [query_id, doc_id], "left").withColumn("hit", F.col("rank").isNotNull())


def hit_summary(ranked_truth: DataFrame) -> DataFrame:
    """hit rate and mean reciprocal rank over truth pairs."""
    return ranked_truth.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"))


def category_agreement(neighbours: DataFrame, queries: DataFrame, *,
                       query_key: str = "ticket_id") -> DataFrame:
    """Per query: neighbours sharing its category / all neighbours."""
    q = queries.select(F.col(query_key).alias("query_id"), F.col("category").alias("q_cat"))
    n = neighbours.join(q, "query_id")
    same = F.col("category") == F.col("q_cat")
    return n.groupBy("query_id").agg(F.count_if(same).alias("same_category"),
                                     F.count(F.lit(1)).alias("neighbours")) \
        .withColumn("agreement", F.col("same_category") / F.col("neighbours"))
