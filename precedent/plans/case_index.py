"""Case index build (E1) and hybrid case search.

The index is three tables keyed by ``ticket_id``: the case payload, the
vectors, and the BM25 postings; plus two scalars. ``build_case_index`` keeps
them as DataFrames; ``sources.index_store`` persists and reloads them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.functions.text import dense_text, sparse_text
from precedent.operators import bm25
from precedent.operators.dense import dense_topk
from precedent.operators.embed import HashingEncoder, embed, hash_embed
from precedent.operators.fusion import hybrid_topk
from precedent.schema import RetrievalParams
from precedent.session import materialize


@dataclass
class CaseIndex:
    cases: DataFrame                 # normalised payload (CASE_FIELDS)
    vectors: DataFrame               # ticket_id, category, embedding
    keywords: bm25.KeywordIndex      # postings over issue + ' ' + description
    params: RetrievalParams
    key: str = "ticket_id"           # column that identifies a case in all three tables
    category_parts: int = 0          # folders that vectors and postings are stored in, by category (0: one)


#: Partition column of a stored index whose vectors and postings lie in folders by category.
PART = "_category_part"


def category_part(category: str, parts: int):
    """The folder of a category: a hash, so that any number of categories, empty and odd names fit ``parts`` folders."""
    return F.pmod(F.xxhash64(category), F.lit(parts)).cast("int")


def pruned(index: CaseIndex, queries: DataFrame) -> CaseIndex:
    """``index`` reduced to the folders of the queries' categories, by a partition filter: the others are neither
    listed for reading nor read. At most ``category_parts`` + 1 numbers reach the driver. A query without a
    category searches every case, so with one in the batch nothing is left out."""
    if not index.category_parts:
        return index
    part = F.when(F.col("category").isNotNull(), category_part("category", index.category_parts))
    asked = {r[0] for r in queries.select(part).distinct().collect()}
    if None in asked:
        return index
    keep = F.col(PART).isin(sorted(asked))
    return replace(index, vectors=index.vectors.where(keep),
                   keywords=replace(index.keywords, postings=index.keywords.postings.where(keep)))


def with_texts(cases: DataFrame) -> DataFrame:
    """Add the embedded text (P4) and the keyword text (P5)."""
    return cases.withColumn("dense_text", dense_text("issue", "description")) \
        .withColumn("sparse_text", sparse_text("issue", "description"))


def case_vectors(cases: DataFrame, encoder=None, params: RetrievalParams = RetrievalParams(),
                 key: str = "ticket_id") -> DataFrame:
    texts = with_texts(cases).select(key, "category", "dense_text")
    if encoder is None:
        # Default encoder, computed JVM-side (same vectors as HashingEncoder).
        vec = hash_embed(texts, key, "dense_text", params.dim)
        return texts.select(key, "category").join(vec, key, "left")
    return embed(texts, "dense_text", encoder).select(key, "category", "embedding")


def with_row_key(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a unique ``key`` per row, written once so that every use sees the same keys.

    Ticket ids may be missing (one default for all) or repeated, so they cannot tell rows apart."""
    return materialize(rows.withColumn(key, F.monotonically_increasing_id()), name)


def build_case_index(cases: DataFrame, encoder=None,
                     params: RetrievalParams = RetrievalParams(),
                     vectors: DataFrame | None = None,
                     store_cases: bool = True, key: str = "ticket_id") -> CaseIndex:
    """``key`` must be unique per case (``with_row_key`` gives one). Payload + vectors + keyword index over ``cases`` (resolved and unresolved
    alike). The payload is stored once, so every later use (query side,
    hydration) reads the stored table instead of re-deriving the cases."""
    if store_cases:
        cases = materialize(cases, "cases")
    if vectors is None:
        # Encoded once and checkpointed: both the query side and the corpus
        # scan read the stored vectors.
        vectors = materialize(case_vectors(cases, encoder, params, key), "vectors")
    vecs = vectors
    kw = bm25.build_keyword_index(with_texts(cases), key, F.col("sparse_text"),
                                  group="category")
    return CaseIndex(cases, vecs, kw, params, key)


def search(queries: DataFrame, index: CaseIndex, *, query_vectors: DataFrame | None = None,
           encoder=None, category_filter: bool = False, exclude_self: bool = False,
           dense_only: bool = False, k: int | None = None, fetch: int | None = None,
           query_key: str = "ticket_id") -> DataFrame:
    """(query_id, doc_id, score, rank) best neighbours per query case.

    ``category_filter`` restricts a query with a non-NULL category to cases of
    that category (F2), and reads only the folders of the asked categories where
    the index is stored by category. ``dense_only`` is the fallback without the keyword
    list (J4). ``exclude_self`` drops the query's own id from its results.
    ``query_key`` names the column that is unique per query; ``fetch`` overrides
    the 2k candidates taken from each list.
    """
    p = index.params if k is None else replace(index.params, k=k)
    p = p if fetch is None else replace(p, candidates_per_list=fetch)
    if category_filter:
        index = pruned(index, queries)
    q = with_texts(queries)
    if query_vectors is not None:
        qv = query_vectors
    else:
        # Query batches are encoded row by row where they are (no exchange):
        # the Python encoder gives the same vectors as the corpus-scale JVM one.
        qv = case_vectors(queries, encoder or HashingEncoder(p.dim), p, query_key)
    grp = "category" if category_filter else None
    if dense_only:
        return dense_topk(qv, index.vectors, p.k, params=p, query_id=query_key,
                          q_vec="embedding", doc_id=index.key, d_vec="embedding",
                          query_group=grp, doc_group="category" if grp else None,
                          exclude_self=exclude_self)
    return hybrid_topk(q, index.vectors, index.keywords, query_id=query_key,
                       q_vec="embedding", q_text="sparse_text", doc_id=index.key,
                       d_vec="embedding", query_group=grp,
                       doc_group="category" if grp else None,
                       exclude_self=exclude_self, params=p, dense_queries=qv)
