"""Recommendations for tickets as they arrive (M6).

``readStream`` over a folder of new-ticket files; each micro-batch runs the
batch recommender (``plans.recommend.recommend``) inside ``foreachBatch``
(ranking windows are not allowed on a streaming frame, but are inside a
batch). Output goes to ``<out>/batch_id=<n>`` with overwrite, so a replayed
batch rewrites the same folder: exactly-once results on top of the
checkpointed source offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from precedent.operators.normalize import normalize_records, row_to_record
from precedent.plans.case_index import CaseIndex
from precedent.plans.recommend import recommend
from precedent.sources.index_store import IndexNotFound, current_version, load_index, read_text, write_text

NEW_TICKET_COLUMNS = ["Ticket ID", "Issue", "Description", "Category", "Date"]


def new_ticket_stream(spark: SparkSession, source_dir: str,
                      columns: list[str] = NEW_TICKET_COLUMNS) -> DataFrame:
    """Streaming frame of normalised new tickets from header CSV files."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (spark.readStream.schema(schema).option("header", True)
           .option("multiLine", True).option("escape", '"')
           # A file whose header is not ``columns`` fails instead of being read by position.
           .option("enforceSchema", False).csv(source_dir))
    return normalize_records(raw.select(row_to_record(raw, columns).alias("rec")))


VERSIONS = "_index_versions"


def batch_version(spark: SparkSession, root: str, out_dir: str, batch_id: int) -> str:
    """The index version of a batch: the current one when the batch first runs, written beside the results
    before it is used, so that a replay of the batch searches the same index."""
    path = f"{out_dir.rstrip('/')}/{VERSIONS}/{batch_id}"
    known = read_text(spark, path)
    if known:
        return known
    version = current_version(spark, root)
    if version is None:
        raise IndexNotFound(f"no case index at {root}; build it first")
    write_text(spark, path, version)
    return version


def recommend_stream(spark: SparkSession, source_dir: str, index: CaseIndex | str, out_dir: str, *,
                     checkpoint: str, available_now: bool = True,
                     generator=None, columns: list[str] = NEW_TICKET_COLUMNS, **search_kw):
    """Start the streaming query; returns the ``StreamingQuery``. ``checkpoint`` is the
    query's own folder: a restart with the same one goes on where it stopped. ``index`` is an index,
    or the root of a stored one: then each batch searches the version that is current when it begins."""
    tickets = new_ticket_stream(spark, source_dir, columns)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        here = index
        if isinstance(index, str):
            here = load_index(spark, index, batch_version(spark, index, out_dir, batch_id))
        res = recommend(batch, here, generator=generator, **search_kw)
        res.write.mode("overwrite").json(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    writer = (tickets.writeStream.foreachBatch(run_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="10 seconds")
    return writer.start()
