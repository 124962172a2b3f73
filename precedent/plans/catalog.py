"""The registered queries with their DuckDB oracles.

Every query reads whole supplied tables (or views Spark derives from them).
Case retrieval runs leave-one-out: every case is a query against all *other*
cases, so no row is set aside and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.operators import bm25
from precedent.operators.dense import dense_topk
from precedent.operators.embed import hash_embed_sparse
from precedent.plans.case_index import build_case_index, case_vectors, pruned, search
from precedent.plans.fixtures import CATEGORIES, cases, with_cases
from precedent.functions.text import (choice_label, clean_text, dense_text, first_line,
                                      parse_label, sparse_text)
from precedent.operators import render as R
from precedent.operators.dedupe import latest_by_key
from precedent.operators.embed import cache_misses, embed_cached, text_key
from precedent.operators.evaluate import (category_agreement, containment_truth, hit_rank,
                                         hit_summary)
from precedent.operators.filters import (MISSING_DESCRIPTION, MISSING_ISSUE, only_resolved,
                                         validation_reason)
from precedent.operators.lookup import lookup_case
from precedent.operators.normalize import normalize_records
from precedent.operators.stats import category_counts, index_stats, resolution_counts
from precedent.operators.verbatim import verbatim_truth
from precedent.plans.recommend import neighbours, recommend, run_summary
from precedent.plans.registry import register
from precedent.plans.sql_snippets import (bm25_ctes, clean, hash_cosine_cte, hash_vector_ctes,
                                          lit, na, ranked, rrf_cte, tokens, vector_cosine_cte)
from precedent.schema import NEIGHBOUR_SCHEMA, NO_MATCH_MESSAGE, RetrievalParams
from precedent.session import materialize, shared_path
from precedent.sources.files import csv_rejects, read_csv, read_json
from precedent.sources.index_store import load_index, upsert_index, write_index
from precedent.sources.sinks import load_cache, number_results, save_cache, write_results_json
from precedent.sources.tables import read_table
from precedent.streaming.recommend_stream import NEW_TICKET_COLUMNS, recommend_stream

P = RetrievalParams()
SCORE_DIGITS = 6


def _score(c: str = "score") -> F.Column:
    return F.round(F.col(c), SCORE_DIGITS).alias(c)


# ---------------------------------------------------------------- keyword search
@register("q17_bm25_topk", "WITH " + ",\n".join(
    bm25_ctes("documents", "doc_id", "text", "benchmark", "item_id", "text")) + "\n"
    f"SELECT query_id AS item_id, doc_id, rank, round(score, {SCORE_DIGITS}) + 0.0 AS score "
    f"FROM ({ranked('b_sc', P.k)})")
def q17_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 documents per benchmark passage by BM25."""
    docs = read_table(spark, sf_dir, "documents")
    bench = read_table(spark, sf_dir, "benchmark")
    index = bm25.build_keyword_index(docs, "doc_id", "text")
    hits = bm25.bm25_topk(bench, index, P.k, query_id="item_id", text="text", params=P)
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", "rank", _score())


# ---------------------------------------------------------------- dense search
def _emb(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _dense_vectors(spark, sf_dir, k, group=False, min_score=None):
    emb = _emb(spark, sf_dir)
    p = RetrievalParams(min_score=min_score)
    hits = dense_topk(emb, emb, k, params=p, query_id="vec_id", q_vec="embedding",
                      doc_id="vec_id", d_vec="embedding",
                      query_group="label" if group else None,
                      doc_group="label" if group else None, exclude_self=True)
    return hits.select(F.col("query_id").alias("vec_id"), F.col("doc_id").alias("neighbour_id"),
                       "rank", _score())


def _dense_oracle(group=False, min_score=None):
    cte = vector_cosine_cte("embeddings", "vec_id", "embedding", "d_sc",
                            grp="label" if group else None, min_score=min_score)
    return (f"WITH {cte}\nSELECT query_id AS vec_id, doc_id AS neighbour_id, rank, "
            f"round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('d_sc', P.k)})")


@register("q14_dense_topk", _dense_oracle())
def q14_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine top-3 neighbours of every vector among all other vectors."""
    return _dense_vectors(spark, sf_dir, P.k)


@register("q15_dense_category", _dense_oracle(group=True))
def q15_dense_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same, restricted to neighbours with the query's label (F2 pre-filter)."""
    return _dense_vectors(spark, sf_dir, P.k, group=True)


MIN_SCORE = 0.3


@register("q16_min_score", _dense_oracle(min_score=MIN_SCORE))
def q16_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense top-3 keeping only cosines >= 0.3."""
    return _dense_vectors(spark, sf_dir, P.k, min_score=MIN_SCORE)


# ---------------------------------------------------------------- keyword statistics
@register("q18_bm25_stats", "WITH " + ",\n".join(
    bm25_ctes("documents", "doc_id", "text", "benchmark", "item_id", "text")[:4]) + "\n"
    f"SELECT term, df, round(ln(1 + (s.n - df + 0.5) / (df + 0.5)), {SCORE_DIGITS}) AS idf, "
    f"s.n AS n_docs, round(s.avgdl, {SCORE_DIGITS}) AS avgdl FROM b_df CROSS JOIN b_stats s")
def q18_bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and IDF per term, corpus size and mean length (A5)."""
    docs = read_table(spark, sf_dir, "documents")
    index = bm25.build_keyword_index(docs, "doc_id", "text")
    n = float(index.n_docs)
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    return index.terms.select(
        "term", "df", F.round(idf, SCORE_DIGITS).alias("idf"),
        F.lit(index.n_docs).cast("long").alias("n_docs"),
        F.round(F.lit(index.avgdl), SCORE_DIGITS).alias("avgdl"))


# ---------------------------------------------------------------- hashing encoder
@register("q27_hash_embed", "WITH " + ",\n".join(
    hash_vector_ctes("documents", "doc_id", tokens("text"), "h")) + "\n"
    f"SELECT id AS doc_id, CAST(bucket AS INTEGER) AS bucket, round(u, {SCORE_DIGITS}) + 0.0 AS weight "
    f"FROM h_u")
def q27_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing-encoder vector of every document in sparse form: the unit-norm
    weight of each bucket hit by at least one of its terms (M1)."""
    docs = read_table(spark, sf_dir, "documents")
    vec = hash_embed_sparse(docs.select("doc_id", "text"), "doc_id", "text", P.dim)
    return vec.select("doc_id", "bucket",
                      F.round(F.col("weight").cast("double"), SCORE_DIGITS).alias("weight"))


# ---------------------------------------------------------------- hybrid case search
def _case_queries_sql(fetch: int = P.fetch) -> list[str]:
    """Oracle CTEs for leave-one-out hybrid search over ``cases``."""
    dense_tok = (f"list_concat(['issue'], {tokens('issue')}, ['description'], "
                 f"{tokens('description')})")
    return [
        *hash_vector_ctes("cases", "ticket_id", dense_tok, "cv"),
        hash_cosine_cte("cv", "dense_sc"),
        f"dense_r AS ({ranked('dense_sc', fetch)})",
        *bm25_ctes("cases", "ticket_id", "issue || ' ' || description", "cases", "ticket_id",
                   "issue || ' ' || description", prefix="cb", exclude_self=True),
        f"sparse_r AS ({ranked('cb_sc', fetch)})",
        rrf_cte(["dense_r", "sparse_r"], "fused"),
    ]


def _case_hits(spark: SparkSession, sf_dir: str, *, k: int | None = None,
               dense_only: bool = False, fetch: int | None = None) -> DataFrame:
    index = build_case_index(cases(spark, sf_dir), params=P)
    return search(index.cases, index, query_vectors=index.vectors, exclude_self=True,
                  dense_only=dense_only, k=k, fetch=fetch)


@register("q19_rrf_fuse", with_cases(
    f"SELECT query_id AS ticket_id, doc_id AS neighbour_id, rank, "
    f"round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('fused', 2 * P.fetch)})",
    *_case_queries_sql()))
def q19_rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole fused list: dense top-6 and BM25 top-6 per case merged by RRF."""
    hits = _case_hits(spark, sf_dir, k=2 * P.fetch, fetch=P.fetch)
    return hits.select(F.col("query_id").alias("ticket_id"),
                       F.col("doc_id").alias("neighbour_id"), "rank", _score())


@register("q20_hybrid_topk", with_cases(
    f"SELECT query_id AS ticket_id, doc_id AS neighbour_id, rank, "
    f"round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('fused', P.k)})",
    *_case_queries_sql()))
def q20_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid top-3 similar cases for every case."""
    hits = _case_hits(spark, sf_dir)
    return hits.select(F.col("query_id").alias("ticket_id"),
                       F.col("doc_id").alias("neighbour_id"), "rank", _score())


# ---------------------------------------------------------------- payload, prompt, generation
def _nb_ctes() -> list[str]:
    return [*_case_queries_sql(),
            f"top AS ({ranked('fused', P.k)})",
            "nb AS (SELECT t.query_id, t.rank, c.ticket_id, c.issue, c.description, c.category, "
            "c.resolution, c.agent_name, c.resolved, t.score AS similarity_score "
            "FROM top t JOIN cases c ON c.ticket_id = t.doc_id)"]


def _prompt_sql() -> str:
    ok = "coalesce(resolved, false)"
    block = (f"printf({lit(R.PROMPT_NEIGHBOUR)}, rank, similarity_score, "
             f"CASE WHEN {ok} THEN {lit(R.RESOLVED_WORD)} ELSE {lit(R.UNRESOLVED_WORD)} END, "
             f"{na('ticket_id')}, {na('issue')}, {na('description')}, {na('category')}, "
             f"{na('resolution')}, {na('agent_name')}, "
             f"CASE WHEN {ok} THEN '' ELSE {lit(R.PROMPT_CAUTION)} END)")
    return (f"pb AS (SELECT query_id, string_agg({block}, chr(10) ORDER BY rank) AS blocks "
            f"FROM nb GROUP BY query_id)")


def _extractive_sql() -> str:
    ok = "coalesce(resolved, false)"
    return (f"ex AS (SELECT query_id, "
            f"arg_min(ticket_id, rank) FILTER (WHERE {ok} AND length(resolution) > 0) AS b_id, "
            f"arg_min(similarity_score, rank) FILTER (WHERE {ok} AND length(resolution) > 0) AS b_s, "
            f"arg_min(resolution, rank) FILTER (WHERE {ok} AND length(resolution) > 0) AS b_r, "
            f"count(*) FILTER (WHERE {ok} AND length(resolution) > 0) AS n_best, "
            f"string_agg({na('ticket_id')}, ', ' ORDER BY rank) FILTER (WHERE NOT {ok}) AS open_ids, "
            f"count(*) FILTER (WHERE NOT {ok}) AS n_open, count(*) AS n FROM nb GROUP BY query_id),\n"
            f"rec AS (SELECT c.ticket_id, CASE WHEN coalesce(ex.n, 0) = 0 THEN {lit(NO_MATCH_MESSAGE)} "
            f"ELSE (CASE WHEN ex.n_best = 0 THEN {lit(R.REC_NONE)} "
            f"ELSE printf({lit(R.REC_LEAD)}, b_id, b_s, b_r) END) || "
            f"CASE WHEN n_open > 0 THEN {lit(R.REC_CAUTION_HEAD)} || open_ids || "
            f"CASE WHEN n_open = 1 THEN ' was' ELSE ' were' END || {lit(R.REC_CAUTION_TAIL)} "
            f"ELSE '' END END AS recommendation, coalesce(ex.n, 0) AS n "
            f"FROM cases c LEFT JOIN ex ON ex.query_id = c.ticket_id)")


def _case_results(spark: SparkSession, sf_dir: str, with_prompt: bool = False) -> DataFrame:
    index = build_case_index(cases(spark, sf_dir), params=P)
    return recommend(index.cases, index, query_vectors=index.vectors, exclude_self=True,
                     with_prompt=with_prompt, query_key="ticket_id")


@register("q21_neighbours", with_cases(
    "SELECT query_id AS ticket_id, rank, ticket_id AS neighbour_id, issue, category, "
    "resolution, agent_name, resolved, "
    f"round(similarity_score, {SCORE_DIGITS}) + 0.0 AS similarity_score FROM nb",
    *_nb_ctes()))
def q21_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 neighbours of every case with their payload, flattened."""
    index = build_case_index(cases(spark, sf_dir), params=P)
    nb = neighbours(index.cases, index, query_vectors=index.vectors, exclude_self=True)
    return nb.select(F.col("query_id").alias("ticket_id"), "rank",
                     F.col("ticket_id").alias("neighbour_id"), "issue", "category",
                     "resolution", "agent_name", "resolved", _score("similarity_score"))


@register("q22_prompt", with_cases(
    f"SELECT c.ticket_id, {lit(R.PROMPT_HEAD)} || printf({lit(R.PROMPT_QUERY)}, "
    f"{na('c.ticket_id')}, {na('c.issue')}, {na('c.description')}, {na('c.category')}) || "
    f"coalesce(pb.blocks, '') || {lit(R.PROMPT_TAIL)} AS prompt "
    "FROM cases c LEFT JOIN pb ON pb.query_id = c.ticket_id",
    *_nb_ctes(), _prompt_sql()))
def q22_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator prompt of every case from its ranked neighbours."""
    return _case_results(spark, sf_dir, with_prompt=True).select("ticket_id", "prompt")


@register("q23_extractive", with_cases(
    "SELECT ticket_id, recommendation FROM rec", *_nb_ctes(), _extractive_sql()))
def q23_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default (extractive) recommendation of every case (M3 default, M4)."""
    return _case_results(spark, sf_dir).select("ticket_id", "recommendation")


_RECOMMEND_SQL = with_cases(
    "SELECT c.ticket_id, c.issue, c.category, CAST(r.n AS INTEGER) AS n_similar, "
    "coalesce(ids.neighbour_ids, '') AS neighbour_ids, r.recommendation, "
    "CAST(NULL AS VARCHAR) AS error FROM cases c JOIN rec r USING (ticket_id) "
    "LEFT JOIN (SELECT query_id, string_agg(ticket_id, ',' ORDER BY rank) AS neighbour_ids "
    "FROM nb GROUP BY query_id) ids ON ids.query_id = c.ticket_id",
    *_nb_ctes(), _extractive_sql())


@register("q24_recommend", _RECOMMEND_SQL)
def q24_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch recommendation for every case: hybrid search → payload → prompt →
    generator, one set-based job (M5); flattened for comparison."""
    return _flat(_case_results(spark, sf_dir))


def _flat(res: DataFrame) -> DataFrame:
    return res.select("ticket_id", "issue", "category",
                      F.size("similar_tickets").alias("n_similar"),
                      F.array_join(F.transform("similar_tickets", lambda x: x["ticket_id"]), ",")
                      .alias("neighbour_ids"), "recommendation", "error")


@register("q40_results_json", _RECOMMEND_SQL)
def q40_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every case written as JSON Lines and read back (K3)."""
    path = shared_path(spark, "results-json")
    results = _case_results(spark, sf_dir)
    write_results_json(results, path)
    return _flat(spark.read.schema(results.schema).json(path))


@register("q41_stream", _RECOMMEND_SQL)
def q41_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case as a new ticket of a stream over CSV files, against a stored index: stopped after the first
    half of the files and started again with the same checkpoint (M6)."""
    root, incoming, out, state = (shared_path(spark, f"stream-{n}") for n in ("index", "incoming", "out", "state"))
    write_index(build_case_index(cases(spark, sf_dir), params=P), root)
    new = cases(spark, sf_dir).withColumn("half", F.col("conv_id") % 2)
    columns = ["ticket_id", "issue", "description", "category", "date"]
    for half in (0, 1):
        (new.where(F.col("half") == half).select(*[F.col(c).alias(n) for c, n in zip(columns, NEW_TICKET_COLUMNS)])
         .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).mode("append").csv(incoming))
        recommend_stream(spark, incoming, root, out, checkpoint=state, exclude_self=True,
                         query_key="ticket_id").awaitTermination()
    results = spark.read.schema(_results_schema()).json(f"{out}/batch_id=*")
    return _flat(results)


def _results_schema() -> T.StructType:
    return T.StructType([*[T.StructField(c, T.StringType()) for c in ("ticket_id", "issue", "category", "recommendation",
                                                                     "error")],
                         T.StructField("similar_tickets", T.ArrayType(NEIGHBOUR_SCHEMA))])


@register("q43_result_numbers", with_cases(
    "SELECT ticket_id, row_number() OVER (ORDER BY ticket_id) AS result_no FROM cases"))
def q43_result_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the results in the text report, by ticket id, without one task for all."""
    return number_results(cases(spark, sf_dir)).select("ticket_id", F.col("result_no").cast("long").alias("result_no"))


@register("q44_cache_roundtrip", "SELECT sha256(text) AS text_hash, CAST(1 AS BIGINT) AS n, CAST(CASE WHEN "
          "bool_or(lang = 'en') THEN 1 ELSE 2 END AS BIGINT) AS written FROM documents WHERE text IS NOT NULL GROUP BY text")
def q44_cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding cache filled from the English documents, then from all: each text is encoded once, in the
    first or the second write (S10, K2, M2)."""
    path = shared_path(spark, "cache")
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    for part in (docs.where("lang = 'en'"), docs):
        _, new_rows = embed_cached(part.select("doc_id", "text"), "text", load_cache(spark, path))
        save_cache(materialize(new_rows, "cache-rows"), path)
        if part is not docs:
            first = materialize(load_cache(spark, path).select("text_hash", F.lit(1).alias("early")), "cache-first")
    cache = load_cache(spark, path).groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"))
    return cache.join(first, "text_hash", "left").select(
        "text_hash", "n", F.when(F.col("early") == 1, 1).otherwise(2).cast("long").alias("written"))


@register("q45_index_upsert", with_cases(
    f"SELECT query_id AS ticket_id, doc_id AS neighbour_id, rank, "
    f"round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('fused', P.k)})", *_case_queries_sql()))
def q45_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid top-3 on an index of which a third of the cases was replaced by an upsert."""
    root = shared_path(spark, "upsert-index")
    whole = materialize(cases(spark, sf_dir), "upsert-cases")
    third = F.col("conv_id") % 3 == 0
    before = whole.withColumn("description", F.when(third, F.reverse("description")).otherwise(F.col("description")))
    write_index(build_case_index(before, params=P), root)
    upsert_index(spark, root, build_case_index(whole.where(third), params=P))
    index = load_index(spark, root)
    hits = search(index.cases, index, query_vectors=index.vectors, exclude_self=True)
    return hits.select(F.col("query_id").alias("ticket_id"), F.col("doc_id").alias("neighbour_id"), "rank", _score())


class PromptClock:
    """A generator that answers with its prompt's length, and the clock it moves: a sixteenth of a second for
    each character beyond a multiple of 100."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def generate(self, prompts):
        self.now += sum(len(p) % 100 for p in prompts) / 16
        return ThirdFails().generate(prompts)


class ThirdFails:
    """A generator that answers with its prompt's length and fails where 3 divides it."""

    def generate(self, prompts):
        if any(len(p) % 3 == 0 for p in prompts):
            raise ValueError("prompt length")
        return [f" {len(p)} " for p in prompts]


def _generated_sql() -> list[str]:
    """CTE ``gen(ticket_id, recommendation, error)``: what ``ThirdFails`` makes of every prompt."""
    return [*_nb_ctes(), _prompt_sql(), f"""prompts AS (
        SELECT c.ticket_id, pb.query_id IS NULL AS none, length({lit(R.PROMPT_HEAD)} ||
        printf({lit(R.PROMPT_QUERY)}, {na('c.ticket_id')}, {na('c.issue')}, {na('c.description')},
        {na('c.category')}) || coalesce(pb.blocks, '') || {lit(R.PROMPT_TAIL)}) AS n
        FROM cases c LEFT JOIN pb ON pb.query_id = c.ticket_id)""",
            f"""gen AS (SELECT ticket_id, CASE WHEN none THEN {lit(NO_MATCH_MESSAGE)}
        WHEN n % 3 <> 0 THEN CAST(n AS VARCHAR) END AS recommendation,
        CASE WHEN NOT none AND n % 3 = 0 THEN 'ValueError: prompt length' END AS error FROM prompts)"""]


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_case_index(cases(spark, sf_dir), params=P)
    return recommend(index.cases, index, query_vectors=index.vectors, exclude_self=True,
                     query_key="ticket_id", generator=ThirdFails())


@register("q29_run_summary", with_cases(
    "SELECT count(*) AS total, count(*) - count(error) AS succeeded, count(error) AS failed, "
    "CAST(NULL AS DOUBLE) AS mean_seconds FROM gen", *_generated_sql()))
def q29_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summary over batch results of which some failed: total / succeeded / failed."""
    return run_summary(_generated(spark, sf_dir))


@register("q42_generate_errors", with_cases(
    "SELECT ticket_id, recommendation, error FROM gen", *_generated_sql()))
def q42_generate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator that fails on some prompts: their rows carry the error, others their text."""
    return _generated(spark, sf_dir).select("ticket_id", "recommendation", "error")


@register("q48_mean_seconds", with_cases(
    "SELECT count(*) AS total, count(*) - count(g.error) AS succeeded, count(g.error) AS failed, "
    "round(avg(CASE WHEN g.error IS NULL THEN CASE WHEN none THEN 0.0 ELSE round((n % 100) / 16.0, 2) END END), 6) "
    "AS mean_seconds FROM gen g JOIN prompts USING (ticket_id)", *_generated_sql()))
def q48_mean_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean seconds of the generator calls that succeeded, each call timed in its worker, rounded to 2 (A4)."""
    index = build_case_index(cases(spark, sf_dir), params=P)
    clock = PromptClock()
    res = recommend(index.cases, index, query_vectors=index.vectors, exclude_self=True, query_key="ticket_id",
                    generator=clock, clock=clock)
    return run_summary(res).withColumn("mean_seconds", F.round("mean_seconds", 6))


# Ticket ids that are missing for a third of the cases and shared by another third.
_BLURRED = ("CASE CAST(substr({0}, 6) AS BIGINT) % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'TWICE' "
            "ELSE {0} END")


@register("q34_no_id_cases", with_cases(
    f"SELECT query_id AS case_key, rank, {_BLURRED.format('ticket_id')} AS neighbour_id, "
    f"issue, round(similarity_score, {SCORE_DIGITS}) + 0.0 AS similarity_score FROM nb", *_nb_ctes()))
def q34_no_id_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without or with repeated ticket ids, told apart by their row key: each is indexed
    and answered on its own."""
    rows = cases(spark, sf_dir).withColumn("case_key", F.col("ticket_id")) \
        .withColumn("ticket_id", F.expr(_BLURRED.format("ticket_id")))
    index = build_case_index(rows, params=P, key="case_key")
    nb = neighbours(index.cases, index, query_vectors=index.vectors, exclude_self=True,
                    query_key="case_key")
    return nb.select(F.col("query_id").alias("case_key"), "rank",
                     F.col("ticket_id").alias("neighbour_id"), "issue", _score("similarity_score"))


@register("q35_topk_20", with_cases(
    f"SELECT query_id AS ticket_id, doc_id AS neighbour_id, rank, "
    f"round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('fused', 20)})",
    *_case_queries_sql(40)))
def q35_topk_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid top-20: 2k candidates are taken from each list whatever k is."""
    return _case_hits(spark, sf_dir, k=20).select(
        F.col("query_id").alias("ticket_id"), F.col("doc_id").alias("neighbour_id"), "rank", _score())


@register("q36_mixed_width", "WITH " + vector_cosine_cte(
    "(SELECT * FROM embeddings WHERE vec_id % 7 <> 0)", "vec_id", "embedding", "d_sc")
    + f"\nSELECT query_id AS vec_id, doc_id AS neighbour_id, rank, "
      f"round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('d_sc', P.k)})")
def q36_mixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector is one component longer: the common width is searched, the others
    are left out (``width_rejects`` lists them)."""
    emb = _emb(spark, sf_dir).withColumn("embedding", F.when(
        F.col("vec_id") % 7 == 0, F.array_append("embedding", F.lit(9.0).cast("float")))
        .otherwise(F.col("embedding")))
    hits = dense_topk(emb, emb, P.k, params=P, query_id="vec_id", q_vec="embedding",
                      doc_id="vec_id", d_vec="embedding", exclude_self=True)
    return hits.select(F.col("query_id").alias("vec_id"), F.col("doc_id").alias("neighbour_id"),
                       "rank", _score())


def _markdown_sql() -> str:
    ok = "coalesce(resolved, false)"
    block = (f"printf({lit(R.MD_BLOCK)}, CASE WHEN rank = 1 THEN ' open' ELSE '' END, rank, "
             f"{na('ticket_id')}, similarity_score * 100.0, "
             f"CASE WHEN {ok} THEN {lit(R.RESOLVED_COLOUR)} ELSE {lit(R.UNRESOLVED_COLOUR)} END, "
             f"CASE WHEN {ok} THEN {lit(R.RESOLVED_WORD)} ELSE {lit(R.UNRESOLVED_WORD)} END, "
             f"{na('issue')}, {na('category')}, {na('description')}, {na('resolution')}, "
             f"{na('agent_name')})")
    return (f"mb AS (SELECT query_id, string_agg({block}, '' ORDER BY rank) AS blocks "
            f"FROM nb GROUP BY query_id)")


@register("q30_markdown", with_cases(
    f"SELECT r.ticket_id, printf({lit(R.MD_HEAD)}, r.recommendation, 'N/A', r.n) || "
    f"coalesce(mb.blocks, '') || CASE WHEN r.n = 0 THEN {lit(R.MD_EMPTY)} ELSE '' END "
    "AS markdown, CASE WHEN length(r.recommendation) > 500 THEN "
    "substring(r.recommendation, 1, 500) || '...' ELSE r.recommendation END AS preview "
    "FROM rec r LEFT JOIN mb ON mb.query_id = r.ticket_id",
    *_nb_ctes(), _extractive_sql(), _markdown_sql()))
def q30_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown view and 500-character preview of every result."""
    res = _case_results(spark, sf_dir)
    return res.select("ticket_id", R.markdown().alias("markdown"),
                      R.recommendation_preview().alias("preview"))


# ---------------------------------------------------------------- normalisation and text
_FIRST_LINE = "split_part(text, chr(10), 1)"
_DENSE_CONCAT = "'Issue: ' || issue || '. Description: ' || description"

def _raw_case_records(cs: DataFrame) -> DataFrame:
    """Case rows re-expressed as source records with mixed key spellings and
    text flags, the way heterogeneous files arrive (even ids: Title keys and
    yes/no; odd ids: snake keys and 1/0; no resolution keys when empty)."""
    even = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    flag = F.when(even, F.when(F.col("resolved"), F.lit("Yes")).otherwise(F.lit("no"))) \
        .otherwise(F.when(F.col("resolved"), F.lit("1")).otherwise(F.lit("0")))
    has_res = F.col("resolution") != ""

    def rec(names):
        base = [F.lit(names[0]), F.col("ticket_id"), F.lit(names[1]), F.col("issue"),
                F.lit(names[2]), F.col("description"), F.lit(names[3]), F.col("category")]
        res = [F.lit(names[4]), F.col("resolution"), F.lit(names[5]), F.col("agent_name"),
               F.lit(names[6]), flag]
        return F.when(has_res, F.create_map(*base, *res)).otherwise(F.create_map(*base))
    title = ["Ticket ID", "Issue", "Description", "Category", "Resolution", "Agent Name",
             "Resolved"]
    snake = ["ticket_id", "issue", "description", "category", "resolution", "agent_name",
             "resolved"]
    return cs.select(F.when(even, rec(title)).otherwise(rec(snake)).alias("rec"))


@register("q01_normalize", with_cases(
    "SELECT ticket_id, issue, description, category, '' AS date, "
    "CASE WHEN resolution <> '' THEN resolution END AS resolution, "
    "CASE WHEN resolution <> '' THEN agent_name END AS agent_name, "
    "CASE WHEN resolution <> '' THEN resolved END AS resolved FROM cases"))
def q01_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-spelling records with text flags → the case schema."""
    return normalize_records(_raw_case_records(cases(spark, sf_dir)))


# ---------------------------------------------------------------- sources and stores
CSV_FIELDS = {"ticket_id": "Ticket ID", "issue": "Issue", "description": "Description", "category": "Category",
              "resolution": "Resolution", "agent_name": "Agent Name", "resolved": "Resolved"}


@register("q37_csv_roundtrip", with_cases(
    "SELECT ticket_id, issue, description, category, '' AS date, resolution, agent_name, resolved FROM cases"))
def q37_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as CSV, quoted line breaks included, and read back by byte ranges."""
    path = shared_path(spark, "cases-csv")
    (cases(spark, sf_dir).select(*[F.col(c).cast("string").alias(n) for c, n in CSV_FIELDS.items()])
     .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_csv(spark, path).drop("_source_file", "_row")


@register("q38_json_shapes", with_cases(
    "SELECT ticket_id, issue, description, category, '' AS date, resolution, agent_name, resolved FROM cases"))
def q38_json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as JSON files of the four shapes (lists, index-oriented, column arrays, single objects) and
    read back, lists by byte ranges (S3-S6, P1)."""
    path = shared_path(spark, "cases-json")
    rec = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in CSV_FIELDS.items()])
    h = F.xxhash64("ticket_id")
    # One case in 50 is a file of its own; the others lie some 500 to a file.
    rows = cases(spark, sf_dir).select(
        rec.alias("rec"), F.when(F.pmod(h, F.lit(50)) == 0, "object").otherwise(
            F.element_at(F.array(*[F.lit(x) for x in ("records", "indexed", "columns")]),
                         (F.pmod(h, F.lit(3)) + 1).cast("int"))).alias("shape"), "ticket_id")
    rows, stat = materialize(rows, "cases-shaped", {"n": F.count(F.lit(1))})
    part = F.when(F.col("shape") == "object", F.col("ticket_id")).otherwise(
        F.pmod(F.xxhash64("ticket_id", F.lit(1)), F.lit(stat["n"] // 1500 + 1)).cast("string"))
    files = rows.groupBy("shape", part.alias("part")).agg(F.collect_list("rec").alias("recs"))
    names = list(CSV_FIELDS.values())
    index = F.transform(F.sequence(F.lit(0), F.size("recs") - 1), lambda i: i.cast("string"))
    columns = F.struct(*[F.col("recs")[n].alias(n) for n in names])
    indexed = F.struct(*[F.map_from_arrays(index, F.col("recs")[n]).alias(n) for n in names])
    text = (F.when(F.col("shape") == "records", F.to_json("recs")).when(F.col("shape") == "indexed", F.to_json(indexed))
            .when(F.col("shape") == "columns", F.to_json(columns)).otherwise(F.to_json(F.col("recs")[0])))
    (files.select(F.concat_ws("-", "shape", F.xxhash64("part").cast("string")).alias("file"), text.alias("value"))
     .write.partitionBy("file").text(path))
    return read_json(spark, path + "/*/*.txt").drop("_source_file", "_row")


@register("q39_rejects", """
WITH marked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) + 1 AS line, doc_id % 40 AS g
                FROM documents),
bad AS (SELECT g, min(line) AS line FROM marked WHERE g % 8 = 3 AND doc_id % 7 = 2 GROUP BY g)
SELECT 'group=' || g AS file, 'line ' || line || ' is not UTF-8' AS reason FROM bad""")
def q39_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files made from all documents, some lines with a byte that UTF-8 does not have: each such file is
    rejected with the first bad line, the others load (S7)."""
    path = shared_path(spark, "rejects-csv")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("group"))
    bad = (F.col("group") % 8 == 3) & (F.col("doc_id") % 7 == 2)
    # Text parts are written as they are, so bytes that are not UTF-8 stay.
    value = F.concat(F.encode(F.col("doc_id").cast("string"), "UTF-8"), F.lit(b",n"),
                     F.when(bad, F.lit(b"\xff")).otherwise(F.lit(b""))).cast("string")
    head = rows.select("group").distinct().select("group", F.lit(None).cast("long").alias("doc_id"),
                                                  F.lit("Ticket ID,Issue").alias("value"))
    lines = head.unionByName(rows.select("group", "doc_id", value.alias("value")))
    (lines.repartition(40, "group").sortWithinPartitions("group", F.asc_nulls_first("doc_id")).select("group", "value")
     .write.partitionBy("group").text(path))
    return csv_rejects(spark, path + "/*/*.txt").select(F.regexp_extract("source_file", r"(group=\d+)", 1).alias("file"), "reason")


@register("q02_clean_text",
          f"SELECT doc_id, {clean('text')} AS clean_text FROM documents")
def q02_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace-normalised text of every document."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", clean_text("text").alias("clean_text"))


@register("q03_dense_text", with_cases(
    f"SELECT ticket_id, {clean(_DENSE_CONCAT)} "
    "AS dense_text FROM cases"))
def q03_dense_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled, cleaned text that is embedded, per case."""
    return cases(spark, sf_dir).select("ticket_id", dense_text("issue", "description")
                                       .alias("dense_text"))


@register("q04_sparse_text", with_cases(
    "SELECT ticket_id, issue || ' ' || description AS sparse_text FROM cases"))
def q04_sparse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-search text per case (P5)."""
    return cases(spark, sf_dir).select("ticket_id", sparse_text("issue", "description")
                                       .alias("sparse_text"))


@register("q05_tokenize",
          f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS term "
          f"FROM documents) GROUP BY term")
def q05_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term occurrence counts over all documents."""
    return bm25.term_counts(read_table(spark, sf_dir, "documents"), "text")


@register("q06_validate",
          f"SELECT doc_id, CASE WHEN length({clean(_FIRST_LINE)}) = 0 "
          f"THEN {lit(MISSING_ISSUE)} WHEN length({clean('text')}) = 0 "
          f"THEN {lit(MISSING_DESCRIPTION)} END AS reason FROM documents")
def q06_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document checked as a form entry (first line = issue)."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", validation_reason(first_line("text"), F.col("text"))
                       .alias("reason"))


@register("q07_only_resolved", with_cases(
    "SELECT ticket_id, category FROM cases WHERE resolved"))
def q07_only_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved cases only (F1)."""
    return only_resolved(cases(spark, sf_dir)).select("ticket_id", "category")


# ---------------------------------------------------------------- counts
@register("q08_category_counts",
          "SELECT source AS category, count(*) AS n FROM documents GROUP BY source")
def q08_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source, sorted (A1, L3)."""
    return category_counts(read_table(spark, sf_dir, "documents"), "source")


@register("q09_resolution_counts", with_cases(
    "SELECT count(*) AS total, count(*) FILTER (WHERE resolved) AS resolved, "
    "count(*) FILTER (WHERE NOT resolved) AS unresolved FROM cases"))
def q09_resolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, resolved and unresolved cases (A2)."""
    return resolution_counts(cases(spark, sf_dir))


@register("q10_index_stats", with_cases(
    f"SELECT category, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS points, "
    f"{P.dim} AS dim FROM cases GROUP BY category"))
def q10_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per category, total points and vector width of the case index (A3)."""
    cs = cases(spark, sf_dir)
    vecs = case_vectors(cs, params=P)
    return index_stats(vecs).select("category", "n", F.col("points").cast("long"),
                                    F.col("dim").cast("int"))


@register("q11_latest_by_key",
          "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, "
          "arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def q11_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last turn of every conversation: last row wins per key."""
    conv = read_table(spark, sf_dir, "conversations")
    return latest_by_key(conv, "conv_id", ["turn"]).select("conv_id", "turn", "role", "text")


@register("q12_lookup", with_cases(
    "SELECT l.doc_id, 'TCKT-' || CAST(l.doc_id AS VARCHAR) AS requested, "
    "CASE WHEN c.ticket_id IS NULL THEN 'not found' ELSE 'found' END AS status, "
    "c.ticket_id || ': ' || c.issue AS label, c.category FROM labels l "
    "LEFT JOIN cases c ON c.ticket_id = 'TCKT-' || CAST(l.doc_id AS VARCHAR)"))
def q12_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up the case of every labelled id; label built and parsed back."""
    cs = cases(spark, sf_dir).withColumn("label", choice_label("ticket_id", "issue"))
    # The id is recovered from the label, as a dropdown choice would be.
    cs = cs.withColumn("ticket_id", parse_label("label"))
    ids = read_table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("TCKT-"), F.col("doc_id").cast("string")).alias("ticket_id"))
    found = lookup_case(cs.select("ticket_id", "label", "category"), ids)
    return found.select("doc_id", F.col("ticket_id").alias("requested"), "status", "label",
                        "category")


@register("q13_union_files",
          "SELECT doc_id, source, NULL::VARCHAR AS lang FROM documents WHERE lang = 'en' "
          "UNION ALL SELECT doc_id, NULL::VARCHAR AS source, lang FROM documents "
          "WHERE lang <> 'en'")
def q13_union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two differently shaped slices appended by column name."""
    docs = read_table(spark, sf_dir, "documents")
    a = docs.filter(F.col("lang") == "en").select("doc_id", "source")
    b = docs.filter(~F.col("lang").eqNullSafe("en")).select("doc_id", "lang")
    return a.unionByName(b, allowMissingColumns=True)


# ---------------------------------------------------------------- evaluation and cache
@register("q25_hit_rank", "WITH " + ",\n".join(
    bm25_ctes("documents", "doc_id", "text", "benchmark", "item_id", "text")) + ",\n"
    f"top AS ({ranked('b_sc', P.k)}),\n"
    "truth AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d "
    "ON contains(d.text, b.text))\n"
    "SELECT t.item_id, t.doc_id, top.rank, top.rank IS NOT NULL AS hit FROM truth t "
    "LEFT JOIN top ON top.query_id = t.item_id AND top.doc_id = t.doc_id")
def q25_hit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every verbatim-containing document in the BM25 top-3 of its
    benchmark passage (A7); ground truth found without a cross join."""
    docs = read_table(spark, sf_dir, "documents")
    bench = read_table(spark, sf_dir, "benchmark")
    index = bm25.build_keyword_index(docs, "doc_id", "text")
    truth = containment_truth(bench, "item_id", "text", docs, "doc_id", "text", index)
    hits = bm25.bm25_topk(bench, index, P.k, query_id="item_id", text="text", params=P)
    return hit_rank(hits, truth, query_id="item_id", doc_id="doc_id") \
        .select("item_id", "doc_id", "rank", "hit")


# The first word, two words cut inside, and the first run of symbols.
_SLICES = {"word": r"^\S+", "cut": r"\S\s+\S{1,3}", "symbols": r"[^\p{L}\p{N}\s]+"}


@register("q46_short_passages", "WITH slices AS (" + " UNION ALL ".join(
    f"SELECT item_id || ':{kind}' AS passage_id, regexp_extract(text, '{pattern}') AS passage FROM benchmark"
    for kind, pattern in _SLICES.items()) + ")\n"
    "SELECT s.passage_id, count(DISTINCT d.doc_id) AS n_docs, min(d.doc_id) AS first_doc FROM slices s "
    "JOIN documents d ON contains(d.text, s.passage) WHERE s.passage <> '' GROUP BY s.passage_id")
def q46_short_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each short slice of the benchmark passages verbatim: one word, two cut words, or
    symbols only, which no term index finds (A7)."""
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    slices = bench.select(F.explode(F.array(*[
        F.struct(F.concat(F.col("item_id").cast("string"), F.lit(f":{kind}")).alias("passage_id"),
                 F.regexp_extract("text", pattern, 0).alias("passage"))
        for kind, pattern in _SLICES.items()])).alias("s")).select("s.*")
    truth = verbatim_truth(slices, "passage_id", "passage", read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return truth.groupBy("passage_id").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@register("q26_category_agreement", with_cases(
    "SELECT query_id AS ticket_id, count(*) FILTER (WHERE n.category = q.category) "
    "AS same_category, count(*) AS neighbours, "
    "round(count(*) FILTER (WHERE n.category = q.category) / count(*), 6) AS agreement "
    "FROM nb n JOIN cases q ON q.ticket_id = n.query_id GROUP BY query_id",
    *_nb_ctes()))
def q26_category_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each case's neighbours that have its category."""
    index = build_case_index(cases(spark, sf_dir), params=P)
    nb = neighbours(index.cases, index, query_vectors=index.vectors, exclude_self=True)
    agg = category_agreement(nb, index.cases)
    return agg.select(F.col("query_id").alias("ticket_id"), "same_category", "neighbours",
                      F.round("agreement", 6).alias("agreement"))


@register("q28_cache_misses",
          "SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE sha256(text) NOT IN "
          "(SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL) "
          "AND text IS NOT NULL")
def q28_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to encode given a cache already holding the English documents."""
    docs = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    cached = docs.filter(F.col("lang") == "en").select(text_key("text").alias("text_hash"))
    return cache_misses(docs, "text", cached).select("text_hash")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested batch result for every case: hybrid top-3 neighbours with payload,
    recommendation and error columns (M5)."""
    return _case_results(spark, sf_dir)


# ---------------------------------------------------------------- more search variants and quality
@register("q31_hit_summary", "WITH " + ",\n".join(
    bm25_ctes("documents", "doc_id", "text", "benchmark", "item_id", "text")) + ",\n"
    f"top AS ({ranked('b_sc', P.k)}),\n"
    "truth AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d "
    "ON contains(d.text, b.text)),\n"
    "hr AS (SELECT t.item_id, t.doc_id, top.rank FROM truth t "
    "LEFT JOIN top ON top.query_id = t.item_id AND top.doc_id = t.doc_id)\n"
    "SELECT count(*) AS pairs, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) "
    "AS hit_rate, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM hr")
def q31_hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate at 3 and mean reciprocal rank of BM25 over the containment truth."""
    docs = read_table(spark, sf_dir, "documents")
    bench = read_table(spark, sf_dir, "benchmark")
    index = bm25.build_keyword_index(docs, "doc_id", "text")
    truth = containment_truth(bench, "item_id", "text", docs, "doc_id", "text", index)
    hits = bm25.bm25_topk(bench, index, P.k, query_id="item_id", text="text", params=P)
    s = hit_summary(hit_rank(hits, truth, query_id="item_id", doc_id="doc_id"))
    return s.select("pairs", F.round("hit_rate", 6).alias("hit_rate"),
                    F.round("mrr", 6).alias("mrr"))


@register("q32_dense_only", with_cases(
    f"SELECT query_id AS ticket_id, doc_id AS neighbour_id, rank, "
    f"round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('dense_sc', P.k)})",
    *_case_queries_sql()[:6]))
def q32_dense_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense-only fallback: cosine top-3 similar cases for every case."""
    hits = _case_hits(spark, sf_dir, dense_only=True)
    return hits.select(F.col("query_id").alias("ticket_id"),
                       F.col("doc_id").alias("neighbour_id"), "rank", _score())


def _category_sql() -> list[str]:
    dense_tok = (f"list_concat(['issue'], {tokens('issue')}, ['description'], "
                 f"{tokens('description')})")
    return [
        *hash_vector_ctes("cases", "ticket_id", dense_tok, "cv"),
        hash_cosine_cte("cv", "dense_all"),
        "dense_sc AS (SELECT s.* FROM dense_all s JOIN cases qa ON qa.ticket_id = s.query_id "
        "JOIN cases da ON da.ticket_id = s.doc_id WHERE qa.category = da.category)",
        f"dense_r AS ({ranked('dense_sc', P.fetch)})",
        *bm25_ctes("cases", "ticket_id", "issue || ' ' || description", "cases", "ticket_id",
                   "issue || ' ' || description", prefix="cb", doc_grp="category",
                   q_grp="category", exclude_self=True),
        f"sparse_r AS ({ranked('cb_sc', P.fetch)})",
        rrf_cte(["dense_r", "sparse_r"], "fused"),
    ]


@register("q33_hybrid_category", with_cases(
    f"SELECT query_id AS ticket_id, doc_id AS neighbour_id, rank, "
    f"round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('fused', P.k)})",
    *_category_sql()))
def q33_hybrid_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid top-3 restricted to the query's category, applied inside both
    searches before ranking; BM25 statistics stay global (F2, J3)."""
    index = build_case_index(cases(spark, sf_dir), params=P)
    hits = search(index.cases, index, query_vectors=index.vectors, exclude_self=True,
                  category_filter=True)
    return hits.select(F.col("query_id").alias("ticket_id"),
                       F.col("doc_id").alias("neighbour_id"), "rank", _score())


@register("q47_category_pruned", with_cases(
    f"SELECT f.query_id AS ticket_id, f.rank, n.ticket_id AS neighbour_id, n.category, n.issue, n.resolution, "
    f"round(f.score, {SCORE_DIGITS}) + 0.0 AS score FROM ({ranked('fused', P.k)}) f "
    "JOIN cases n ON n.ticket_id = f.doc_id",
    *_category_sql()))
def q47_category_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of each category as a batch of their own against an index stored by category: each batch reads
    the folders of its category alone, and the payload is scanned without an exchange (F2, J5, S9)."""
    root = shared_path(spark, "category-index")
    write_index(build_case_index(cases(spark, sf_dir), params=P), root, category_parts=16)
    index = load_index(spark, root)
    out = None
    for category in CATEGORIES:
        own = F.col("category") == category
        found = neighbours(index.cases.where(own), index, query_vectors=pruned(index, index.cases.where(own))
                           .vectors.where(own), exclude_self=True, category_filter=True)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("query_id").alias("ticket_id"), "rank", F.col("ticket_id").alias("neighbour_id"),
                      "category", "issue", "resolution", F.round("similarity_score", SCORE_DIGITS).alias("score"))
