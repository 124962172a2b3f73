"""Embedding cache store (K2, S10) and result sinks (K3, K4)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from precedent.operators.embed import CACHE_SCHEMA
from precedent.operators.render import REPORT_BANNER, report_block, report_footer
from precedent.session import materialize


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached (text_hash, text, model, embedding); an absent cache is empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def save_cache(new_rows: DataFrame, path: str) -> None:
    """Append only the newly encoded rows (K2)."""
    new_rows.select(*CACHE_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def write_results_json(results: DataFrame, path: str) -> None:
    """Nested results as JSON Lines, one file per partition (K3)."""
    results.write.mode("overwrite").json(path)


def number_results(results: DataFrame, order: str = "ticket_id") -> DataFrame:
    """1-based ``result_no`` in ``order`` (W2) without pulling rows into one task:
    a distributed sort, written with each row's partition and place in it, then the
    number of rows in the partitions before (one narrow row per partition)."""
    at = F.monotonically_increasing_id()        # partition in the upper bits, place in the lower 33
    rows = materialize(results.orderBy(order).withColumn("_at", at), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (rows.join(offsets, "_part").withColumn("result_no", F.col("_before") + place + 1)
            .drop("_part", "_at", "_before"))


def write_results_text(results: DataFrame, path: str, order: str = "ticket_id") -> None:
    """Readable report (K4, R2): banner, one block per result, footer with the total.

    Blocks are rendered on the executors and written as ordered text parts;
    only the total count reaches the driver.
    """
    spark = results.sparkSession
    numbered = number_results(results, order)
    total = numbered.count()
    blocks = numbered.select(F.col("result_no").alias("o"), report_block().alias("value"))
    head = spark.createDataFrame([(0, REPORT_BANNER)], "o long, value string")
    foot = spark.range(1).select(F.lit(total + 1).cast("long").alias("o"),
                                 report_footer(F.lit(total)).alias("value"))
    (head.unionByName(blocks).unionByName(foot).orderBy("o").select("value")
     .write.mode("overwrite").text(path))
