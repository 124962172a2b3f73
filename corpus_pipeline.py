"""A training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.  All
but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.llm import op2_toxicity, op3_mix, op5_pack, op8_lines, op9_minhash
from precedent.llm.catalog import tokenizer_path
from precedent.llm.common import documents, materialize, packed, read_table, shared_path, unpacked

#: Rows scored at least this high are toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below ``TOXIC``; trained on the labelled rows among ``docs``.

    Null and empty texts score as texts without a match; repeated rows share their fate; rows without
    an id are scored like others; columns of any name pass through; no labels, no row goes."""
    model = op2_toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = op2_toxicity.score(packed(docs, "text"), model).where(F.col("_score") < TOXIC)
    return unpacked(scored, docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; so do rows of which nothing is left by that.

    Null and empty texts stay; rows equal in id and text are one place and stay; rows without an id or
    with an id of several texts are places of their own; columns of any name pass through; ``n_chars``
    follows the text where lines went."""
    out = op8_lines.dedup_lines(packed(docs, "doc_id", "text", "n_chars"))
    out = out.where("not (_n_removed > 0 and _n_removed >= _n_lines)")
    return unpacked(out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long"))
                                   .otherwise(F.col("n_chars"))), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least ``doc_id``, null last.

    Texts without words all stay; of repeated rows one stays; rows without an id and rows that share
    one are told apart by their text; columns of any name pass through."""
    return unpacked(op9_minhash.one_of_each(packed(docs, "doc_id", "text")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; the last, partial copy of a document has its first
    words.  Copies lie with their shard, in the order of their places in it.

    Each row is decided by a number of its own, so repeated rows, rows without an id and rows that
    share one are documents like others; texts without words have size 0 and are not taken; a null
    source is a source; columns of any name pass through; ``n_chars`` follows a partial copy's text."""
    rows = materialize(packed(docs, "doc_id", "text", "source", "n_chars").withColumn(
        "row", F.monotonically_increasing_id()), "mix-rows")
    taken = op3_mix.mix(rows, row="row").where("taken > 0").select("row", "size", "repeats", "part", "places")
    part = F.col("part")
    cut = F.array_join(F.slice(F.regexp_extract_all(
        "text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)), 1, part.cast("int")), "")
    copies = rows.join(taken, "row").select("*", F.posexplode("places").alias("nth", "place"))
    partial = F.col("nth") >= F.col("repeats")
    copies = copies.withColumn("text", F.when(partial & (part < F.col("size")), cut).otherwise(F.col("text")))
    copies = copies.withColumn("n_chars", F.when(partial, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    # The salt parts a shard evenly, as places are hashes.
    copies = copies.repartition(F.col("place.shard"), F.substring("place.place", 1, 2))
    return unpacked(copies.sortWithinPartitions("place.shard", "place.place", "row"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences.  Null and empty texts are their end id alone; repeated rows and rows
    without an id are packed each; other columns are not read."""
    return op5_pack.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first and the last stage cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
