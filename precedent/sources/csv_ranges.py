"""Records of CSV files, many tasks a file.

Spark's text reader cuts a file into byte ranges and gives each range the lines that begin in
it, in order.  A line break ends a record only outside quotes, and whether a range begins inside
quotes depends on all ranges before it, so records are found in two passes:

1. Each range tells what it does to either state it may begin in (outside, inside quotes): it ends
   both in the same state, keeps them, or swaps them.  One narrow row a range; the state before a
   range is that of the last range that fixed it, swapped as often as ranges since then swap (a
   prefix scan over the ranges of a file).
2. Each range, now with its state, is cut into records.  Records that pass the end of a range are
   pieces; a file's pieces (two a range at most) are joined in order.

A quote opens a field only at the field's beginning; elsewhere outside quotes it is text, as in
Spark's own reader.  Lines that are not UTF-8 are found on their bytes, with their line number.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from precedent.session import materialize

#: Ranges that begin inside quotes are broadcast up to this many; beyond, lines meet them in a shuffle.
BROADCAST_RANGES = 100_000

CLOSE = re.compile(r'(?:[^"]|"")*+"')


def line_state(line: str, inside: bool) -> bool:
    """Whether a line that begins ``inside`` quotes (or not) ends inside them."""
    at, size = 0, len(line)
    while True:
        if inside or line.startswith('"', at):
            end = CLOSE.match(line, at if inside else at + 1)
            if end is None:
                return True
            at, inside = end.end(), False
        at = line.find(",", at) + 1
        if not at or at >= size:
            return False


def csv_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """``(f, b, o, value, valid)``: lines by file and by the start of their range, in order within it."""
    return spark.read.option("lineSep", "\n").text(pattern).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("o"), F.make_valid_utf8("value").alias("value"),
        F.is_valid_utf8("value").alias("valid"))


def range_states(lines: DataFrame) -> DataFrame:
    """``(f, b, lines_before, bad_line, inside)`` per range: state at its beginning, and the number in the
    file of its first line that is not UTF-8."""
    schema = pa.schema([("f", pa.string()), ("b", pa.int64()), ("s0", pa.bool_()), ("s1", pa.bool_()),
                        ("n", pa.int64()), ("bad", pa.int64())])

    def scan(batches):
        at, state = None, None
        out = []
        for batch in batches:
            for f, b, value, valid in zip(*[batch.column(c).to_pylist() for c in ("f", "b", "value", "valid")]):
                if at != (f, b):
                    if at is not None:
                        out.append((*at, *state))
                    at, state = (f, b), [False, True, 0, None]
                state[2] += 1
                if not valid and state[3] is None:
                    state[3] = state[2]
                if '"' in value:
                    one = line_state(value, state[0])
                    state[1] = one if state[0] == state[1] else line_state(value, state[1])
                    state[0] = one
        if at is not None:
            out.append((*at, *state))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)], schema=schema)

    ranges = lines.select("f", "b", "value", "valid").mapInArrow(
        scan, "f string, b long, s0 boolean, s1 boolean, n long, bad long")
    # A row a range: the windows hold a file's ranges, not its text.
    here = Window.partitionBy("f").orderBy("b")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("s0") & ~F.col("s1")
    ranges = ranges.withColumn("swaps", F.sum(swaps.cast("int")).over(
        here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fixed = F.last(F.when(F.col("s0") == F.col("s1"), F.struct("s0", "swaps")), ignorenulls=True).over(before)
    since = F.coalesce(F.lag("swaps").over(here), F.lit(0)) - F.coalesce(F.col("fixed.swaps"), F.lit(0))
    ranges = ranges.withColumn("fixed", fixed)
    inside = F.coalesce(F.col("fixed.s0"), F.lit(False)) != (since % 2 == 1)
    lines_before = F.coalesce(F.sum("n").over(before), F.lit(0))
    return ranges.select("f", "b", lines_before.alias("lines_before"),
                         (lines_before + F.col("bad")).alias("bad_line"), inside.alias("inside"))


def cut_ranges(lines: DataFrame, states: DataFrame) -> DataFrame:
    """``(f, b, nth, kind, text)``: whole records (kind ``whole``) and pieces: the beginning of a record
    (``head``), a piece from the middle (``body``) and the end (``tail``)."""
    opened = states.where("inside").select("f", "b", "inside")
    schema = pa.schema([("f", pa.string()), ("b", pa.int64()), ("nth", pa.int64()), ("kind", pa.string()),
                        ("text", pa.string())])

    def cut(batches):
        at, inside, early, held, nth = None, False, False, [], 0
        for batch in batches:
            out = []
            for f, b, value, begins in zip(*[batch.column(c).to_pylist() for c in ("f", "b", "value", "inside")]):
                if at != (f, b):
                    if held:
                        out.append((*at, nth, "body" if early else "head", "\n".join(held)))
                    at, inside, early, held, nth = (f, b), bool(begins), bool(begins), [], 0
                if '"' in value:
                    inside = line_state(value, inside)
                held.append(value)
                if not inside:
                    out.append((f, b, nth, "tail" if early else "whole", "\n".join(held)))
                    early, held, nth = False, [], nth + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)],
                                                 schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], x.type) for c, x in zip((*at, nth, "body" if early else "head", "\n".join(held)), schema)],
                schema=schema)

    if opened.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        told = lines.join(F.broadcast(opened), ["f", "b"], "left")      # keeps the order of the lines
    else:
        told = lines.join(opened, ["f", "b"], "left").repartition("f", "b").sortWithinPartitions("f", "b", "o")
    return told.select("f", "b", "value", "inside").mapInArrow(
        cut, "f string, b long, nth long, kind string, text string")


def csv_rows(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """``(f, row, text)``, one row per record that is not blank, in the order of ``row`` within a file (header
    included), and ``range_states`` of the files."""
    lines = csv_lines(spark, pattern)
    states = materialize(range_states(lines), "csv-ranges")
    cut = materialize(cut_ranges(lines, states), "csv-cut")
    # A record has a byte at least, so the start of its range and its number in it order it in the file.
    whole = cut.where("kind = 'whole'").select("f", (F.col("b") + F.col("nth")).alias("row"), "text")
    order = Window.partitionBy("f").orderBy("b", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = cut.where("kind <> 'whole'").withColumn("record", F.sum((F.col("kind") == "head").cast("int")).over(order))
    joined = pieces.groupBy("f", "record").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("b") + F.col("nth")).alias("row"), "text"))).alias("p"))
    joined = joined.select("f", F.col("p")[0]["row"].alias("row"),
                           F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    rows = whole.unionByName(joined).withColumn("text", F.regexp_replace("text", r"\r\z", ""))
    return rows.where("text <> ''"), states
