"""Queries over the supplied tables that apply each operator with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.llm import (op1_suffix, op2_toxicity, op3_mix, op4_secrets, op5_pack, op6_fingerprints,
                           op7_embeddings, op8_lines, op9_minhash, op10_binary, op11_quality, op12_runs,
                           op13_conversations)
from precedent.llm.common import WORD_RE, documents, read_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_suffix.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op2_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_toxicity.toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op3_mix.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken",
                      F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards"))


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secrets.find_secrets(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pack.pack(documents(spark, sf_dir), tokenizer_path())


def op6_fingerprints_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_fingerprints.fingerprints(documents(spark, sf_dir))


def op7_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op8_lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"),
                      F.col("_n_removed").cast("long").alias("n_removed"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_minhash.near_documents(documents(spark, sf_dir))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_binary.token_files(spark, documents(spark, sf_dir), tokenizer_path())


def op11_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_quality.quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_runs.periodic_runs(documents(spark, sf_dir), damaged=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_conversations.repair(read_table(spark, sf_dir, "conversations"), damaged=True)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_toxicity_scores, op3_mix_sources, op4_secret_spans, op5_packing,
    op6_fingerprints_edited, op7_near_embeddings, op8_line_dedup, op9_near_documents, op10_token_binary,
    op11_quality_scores, op12_word_runs, op13_conversation_repair)}


def _mix_sql(seed: str = "mix", levels: int = op3_mix.SHARD_LEVELS) -> str:
    tree = ["t0 AS (SELECT no_src, src, token, 0 AS node FROM draws)"]
    for k in range(levels):
        tree.append(
            f"t{k + 1} AS (SELECT no_src, src, token, node * 2 + CASE WHEN 2 * (row_number() OVER "
            f"(PARTITION BY node ORDER BY md5('{seed}:tree:{k}:' || src || ':' || token), no_src, src, token) - 1) "
            f"< count(*) OVER (PARTITION BY node) THEN 0 ELSE 1 END AS node FROM t{k})")
    return f"""
WITH sizes AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src,
         coalesce(len(regexp_extract_all(text, '{WORD_RE}')), 0)::BIGINT AS size,
         md5('{seed}:doc:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents),
per AS (SELECT src, no_src, sum(size)::BIGINT AS source_size FROM sizes GROUP BY 1, 2),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1)::DOUBLE AS weight,
                   {op3_mix.MAX_REPEATS}.0::DOUBLE * source_size AS lim FROM per),
tried AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, no_src, src
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, no_src, src
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM weighed),
targets AS (
  SELECT src, no_src, source_size, least(lim, coalesce(max(CASE WHEN lev * weight <= lim THEN lev END) OVER (), 0)
         * weight) AS target FROM tried),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(round(target)::BIGINT / source_size)::BIGINT ELSE 0 END AS passes
  FROM targets),
b AS (SELECT src, no_src, substr(key, 1, {op3_mix.BLOCK_DIGITS}) AS block, sum(size)::BIGINT AS words
      FROM sizes GROUP BY 1, 2, 3),
p AS (SELECT *, md5('{seed}:block:' || src || ':' || block) AS perm FROM b),
ordered AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY no_src, src ORDER BY perm, block
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
blocks AS (
  SELECT o.src, o.no_src, block, perm, words, source_size, target, passes,
         greatest(0, least(words, round(target)::BIGINT - passes * source_size - before)) AS rest
  FROM ordered o JOIN wanted w ON o.src = w.src AND o.no_src = w.no_src),
draws AS (
  SELECT src, no_src, block, perm, nth, block || '/' || nth AS token FROM (
    SELECT *, unnest(range(1, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END + 1)) AS nth
    FROM blocks WHERE words > 0)),
{", ".join(tree)},
quotas AS (SELECT src, no_src, node AS shard, count(*) AS quota FROM t{levels} GROUP BY 1, 2, 3),
ends AS (SELECT *, sum(quota) OVER (PARTITION BY no_src, src ORDER BY shard) AS upto FROM quotas),
ranked AS (SELECT *, row_number() OVER (PARTITION BY no_src, src ORDER BY nth, perm, block) - 1 AS rnk FROM draws),
placed AS (
  SELECT r.src, r.no_src, r.block, r.nth, min(shard) AS shard
  FROM ranked r JOIN ends e ON r.src = e.src AND r.no_src = e.no_src AND e.upto > r.rnk GROUP BY 1, 2, 3, 4),
shards AS (SELECT src, no_src, block, list(shard ORDER BY nth) AS shards FROM placed GROUP BY 1, 2, 3),
rows_ AS (
  SELECT s.doc_id, s.size, k.source_size, k.target, k.passes, h.shards,
         greatest(0, least(s.size, k.rest - coalesce(sum(s.size) OVER (
           PARTITION BY s.no_src, s.src, s.block ORDER BY s.key, s.size, s.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
  FROM (SELECT *, substr(key, 1, {op3_mix.BLOCK_DIGITS}) AS block FROM sizes) s
  JOIN blocks k ON s.src = k.src AND s.no_src = k.no_src AND s.block = k.block
  LEFT JOIN shards h ON s.src = h.src AND s.no_src = h.no_src AND s.block = h.block)
SELECT doc_id, size, source_size, target, (passes * size + part)::BIGINT AS taken,
       coalesce(array_to_string(shards[1:(passes + CASE WHEN part > 0 THEN 1 ELSE 0 END)::INT], ','), '') AS shards
FROM rows_
"""


_LINES_SQL = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - {op8_lines.WINDOW - 1}, 0))) AS pos
           FROM l WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, pos, array_to_string(ls[pos + 1 : pos + {op8_lines.WINDOW}], chr(10)) AS win FROM places),
w2 AS (SELECT * FROM w WHERE regexp_matches(win, '[^ \\t\\r\\n]')),
f AS (SELECT win, doc_id AS d0, pos AS p0 FROM w2
      QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) = 1),
later AS (SELECT w2.doc_id, w2.pos FROM w2 JOIN f ON w2.win = f.win
          WHERE w2.doc_id > d0 OR (w2.doc_id = d0 AND w2.pos > p0)),
covered AS (SELECT DISTINCT doc_id, pos + unnest(range(0, {op8_lines.WINDOW})) AS line FROM later),
lines AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS line FROM l),
kept AS (
  SELECT lines.doc_id, count(*) AS n_lines, count(covered.line) AS n_removed,
         coalesce(string_agg(lines.ls[lines.line + 1], chr(10) ORDER BY lines.line)
                  FILTER (covered.line IS NULL), '') AS text
  FROM lines LEFT JOIN covered ON lines.doc_id = covered.doc_id AND lines.line = covered.line GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(kept.text) END AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


_REACH = """
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
"""

_EMBEDDINGS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE len(x.e) = len(y.e) AND list_dot_product(x.e, y.e)
        / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= {op7_embeddings.THRESHOLD}),
{_REACH},
n AS (SELECT a, count(*) AS n_links FROM sym GROUP BY 1),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""

_NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{WORD_RE}') AS ws FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {op9_minhash.WORDS} THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - {op9_minhash.WORDS - 2}),
              lambda i: array_to_string(ws[i : i + {op9_minhash.WORDS - 1}], ' ')) END) AS g FROM w),
s AS (SELECT DISTINCT doc_id, g FROM grams),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
          GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
          WHERE 100 * i >= {op9_minhash.PERCENT} * (na.n + nb.n - i)),
{_REACH},
c AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.a
"""

ORACLES = {
    "op3_mix_sources": _mix_sql(),
    "op7_near_embeddings": _EMBEDDINGS_SQL,
    "op8_line_dedup": _LINES_SQL,
    "op9_near_documents": _NEAR_SQL,
}
