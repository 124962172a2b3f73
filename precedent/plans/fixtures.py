"""Case-shaped views derived from the supplied tables.

No ticket table is supplied, so the case table is derived from
``conversations`` (one case per conversation): the first user turn is the
description, its first line the issue, the last assistant turn the
resolution, and a case is resolved when the assistant spoke last. Category
and agent are derived from the conversation id. Every conversation becomes a
case; nothing is sampled.

Each builder has a DuckDB twin (``*_SQL``) used as the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.functions.text import first_line
from precedent.sources.tables import read_table

# The four case categories, by conversation id modulo 4.
CATEGORIES = ["Network", "Software", "Hardware", "Account Management"]
AGENTS = 7
CASE_PREFIX = "TCKT-"
AGENT_PREFIX = "agent-"


def cases_from_conversations(conv: DataFrame) -> DataFrame:
    """Normalised case table (ticket_id, issue, description, category, date,
    resolution, agent_name, resolved, conv_id)."""
    per = conv.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("first_user"),
        F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("last_asst"),
        F.max(F.struct("turn", "role")).alias("last_turn"),
    )
    desc = F.coalesce(F.col("first_user.text"), F.lit(""))
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                       (F.pmod(F.col("conv_id"), F.lit(4)) + 1).cast("int"))
    return per.select(
        F.concat(F.lit(CASE_PREFIX), F.col("conv_id").cast("string")).alias("ticket_id"),
        first_line(desc).alias("issue"),
        desc.alias("description"),
        cat.alias("category"),
        F.lit("").alias("date"),
        F.coalesce(F.col("last_asst.text"), F.lit("")).alias("resolution"),
        F.concat(F.lit(AGENT_PREFIX), F.pmod(F.col("conv_id"), F.lit(AGENTS)).cast("string"))
        .alias("agent_name"),
        (F.col("last_turn.role") == "assistant").alias("resolved"),
        F.col("conv_id"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_from_conversations(read_table(spark, sf_dir, "conversations"))


CASES_SQL = """
cases AS (
  SELECT 'TCKT-' || CAST(conv_id AS VARCHAR) AS ticket_id,
         split_part(coalesce(d, ''), chr(10), 1) AS issue,
         coalesce(d, '') AS description,
         CASE conv_id % 4 WHEN 0 THEN 'Network' WHEN 1 THEN 'Software'
              WHEN 2 THEN 'Hardware' ELSE 'Account Management' END AS category,
         '' AS date,
         coalesce(r, '') AS resolution,
         'agent-' || CAST(conv_id % 7 AS VARCHAR) AS agent_name,
         lr = 'assistant' AS resolved,
         conv_id
  FROM (SELECT conv_id,
               min_by(text, turn) FILTER (WHERE role = 'user') AS d,
               max_by(text, turn) FILTER (WHERE role = 'assistant') AS r,
               max_by(role, turn) AS lr
        FROM conversations GROUP BY conv_id) s
)"""


def with_cases(sql_body: str, *extra_ctes: str) -> str:
    """Prefix an oracle query with the ``cases`` CTE (and further CTEs)."""
    ctes = ",\n".join([CASES_SQL.strip(), *[c.strip() for c in extra_ctes]])
    return f"WITH {ctes}\n{sql_body}"
