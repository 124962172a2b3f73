"""DuckDB building blocks shared by the oracle queries.

They restate the engine's definitions (tokeniser, BM25, ranking) in plain SQL
so that every registered query has an independent check.
"""

from __future__ import annotations

from precedent.schema import RetrievalParams

P = RetrievalParams()


def tokens(expr: str) -> str:
    """DuckDB twin of ``functions.text.tokenize``."""
    return (f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda x: x <> '')")


def clean(expr: str) -> str:
    """DuckDB twin of ``functions.text.clean_text``."""
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def bm25_ctes(docs: str, doc_id: str, text: str, queries: str, query_id: str,
              qtext: str, prefix: str = "b", doc_grp: str | None = None,
              q_grp: str | None = None, exclude_self: bool = False) -> list[str]:
    """CTEs ending in ``{prefix}_sc(query_id, doc_id, score)``."""
    dg = f", {doc_grp} AS grp" if doc_grp else ""
    qg = f", {q_grp} AS qgrp" if q_grp else ""
    post_grp = ", grp" if doc_grp else ""
    q_grp_sel = ", qgrp" if q_grp else ""
    conds = []
    if exclude_self:
        conds.append("q.query_id <> p.doc_id")
    if doc_grp and q_grp:
        conds.append("(q.qgrp IS NULL OR q.qgrp = p.grp)")
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    k1, b = P.bm25_k1, P.bm25_b
    return [
        f"{prefix}_dt AS (SELECT {doc_id} AS doc_id, {tokens(text)} AS toks{dg} FROM {docs})",
        f"{prefix}_stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {prefix}_dt)",
        f"{prefix}_post AS (SELECT doc_id, len(toks) AS dl, t AS term{post_grp}, count(*) AS tf "
        f"FROM (SELECT doc_id, toks{post_grp}, unnest(toks) AS t FROM {prefix}_dt) "
        f"GROUP BY ALL)",
        f"{prefix}_df AS (SELECT term, count(*) AS df FROM {prefix}_post GROUP BY term)",
        f"{prefix}_q AS (SELECT DISTINCT query_id, term{q_grp_sel} FROM "
        f"(SELECT {query_id} AS query_id, unnest({tokens(qtext)}) AS term{qg} FROM {queries}))",
        f"{prefix}_sc AS (SELECT q.query_id, p.doc_id, "
        f"sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * {k1 + 1.0} / "
        f"(p.tf + {k1} * ({1.0 - b} + {b} * p.dl / s.avgdl))) AS score "
        f"FROM {prefix}_q q JOIN {prefix}_post p ON q.term = p.term "
        f"JOIN {prefix}_df f ON f.term = q.term CROSS JOIN {prefix}_stats s {where} "
        f"GROUP BY q.query_id, p.doc_id)",
    ]


def ranked(src: str, k: int, digits: int = 9) -> str:
    """``src(query_id, doc_id, score)`` → top-k with BIGINT rank."""
    return (f"SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER "
            f"(PARTITION BY query_id ORDER BY round(score, {digits}) DESC, doc_id) AS BIGINT) "
            f"AS rank FROM {src}) WHERE rank <= {k}")


def hash_vector_ctes(src: str, id_expr: str, tok_expr: str, prefix: str,
                     dim: int = P.dim) -> list[str]:
    """CTEs ending in ``{prefix}_u(id, bucket, u)`` (unit hashing vector, float32
    values) and ``{prefix}_un(id, un)`` (norm of those float32 values)."""
    return [
        f"{prefix}_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT {id_expr} AS id, "
        f"unnest({tok_expr}) AS term FROM {src}) GROUP BY ALL)",
        f"{prefix}_hw AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS bucket, "
        f"sum(CASE WHEN ('0x' || substr(md5(term), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END"
        f" * (1 + ln(tf))) AS w FROM {prefix}_tf GROUP BY ALL)",
        f"{prefix}_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM {prefix}_hw GROUP BY id)",
        f"{prefix}_u AS (SELECT id, bucket, CAST(CAST(w / n AS FLOAT) AS DOUBLE) AS u "
        f"FROM {prefix}_hw JOIN {prefix}_n USING (id) WHERE n > 0)",
        f"{prefix}_un AS (SELECT id, sqrt(sum(u * u)) AS un FROM {prefix}_u GROUP BY id)",
    ]


def hash_cosine_cte(prefix: str, out: str, exclude_self: bool = True,
                    grp: str | None = None) -> str:
    """``{out}(query_id, doc_id, score)`` cosine of every pair sharing a bucket."""
    cond = " AND a.id <> b.id" if exclude_self else ""
    return (f"{out} AS (SELECT a.id AS query_id, b.id AS doc_id, "
            f"sum(a.u * b.u) / (na.un * nb.un) AS score FROM {prefix}_u a "
            f"JOIN {prefix}_u b ON a.bucket = b.bucket{cond} "
            f"JOIN {prefix}_un na ON na.id = a.id JOIN {prefix}_un nb ON nb.id = b.id "
            f"GROUP BY a.id, b.id, na.un, nb.un)")


def vector_cosine_cte(table: str, id_col: str, vec: str, out: str, exclude_self: bool = True,
                      grp: str | None = None, min_score: float | None = None) -> str:
    """``{out}(query_id, doc_id, score)``: cosine of every valid vector pair."""
    g = f", {grp} AS g" if grp else ""
    conds = (["a.id <> b.id"] if exclude_self else []) + (["a.g = b.g"] if grp else [])
    on = " AND ".join(conds) or "TRUE"
    score = ("list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * "
             "sqrt(list_dot_product(b.v, b.v)))")
    body = (f"SELECT a.id AS query_id, b.id AS doc_id, {score} AS score "
            f"FROM {out}_v a JOIN {out}_v b ON {on}")
    if min_score is not None:
        body = f"SELECT * FROM ({body}) WHERE score >= {min_score}"
    return (f"{out}_v AS (SELECT {id_col} AS id, CAST({vec} AS DOUBLE[]) AS v{g} FROM {table} "
            f"WHERE len({vec}) = (SELECT max(len({vec})) FROM {table}) "
            f"AND list_dot_product(CAST({vec} AS DOUBLE[]), CAST({vec} AS DOUBLE[])) > 0),\n"
            f"{out} AS ({body})")


def rrf_cte(lists: list[str], out: str, c: float = P.rrf_c) -> str:
    """``{out}(query_id, doc_id, score)`` from ranked lists (query_id, doc_id, rank)."""
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {x}" for x in lists)
    return (f"{out} AS (SELECT query_id, doc_id, sum(1.0 / ({c} + rank)) AS score "
            f"FROM ({union}) GROUP BY query_id, doc_id)")


def lit(s: str) -> str:
    """A Python string as a SQL string literal (newlines kept as is)."""
    return "'" + s.replace("'", "''") + "'"


def na(expr: str) -> str:
    return f"coalesce(CAST({expr} AS VARCHAR), 'N/A')"
