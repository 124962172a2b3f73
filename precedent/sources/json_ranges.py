"""Elements of JSON arrays of objects, many tasks a file.

A JSON array may be one line without a break, so the text reader cuts files at closing braces: each
byte range gets the chunks that begin in it, in order.  Whether a chunk begins inside a string, and how
deep, depends on all ranges before it:

1. Each range tells whether it swaps the string state, and by how much it changes the depth for either
   state that it may begin in.  One narrow row a range; the state before a range is the parity of the
   swaps before it, its depth the sum of the changes that those states chose.
2. Each range, now with state and depth, is cut into elements.  Elements that pass the end of a range are
   pieces, joined in order; what stands between elements is checked where the next one begins.

A backslash never stands before a closing brace in valid JSON, so no escape passes a cut.  Files that do
not begin with a bracket are single objects and are given back whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from precedent.session import materialize
from precedent.sources.csv_ranges import BROADCAST_RANGES

ESCAPE = re.compile(r"\\.", re.S)
FIRST, NEXT = re.compile(r"\s*\[\s*"), re.compile(r"\s*,\s*")
END, EMPTY = re.compile(r"\s*\]\s*"), re.compile(r"\s*\[\s*\]\s*")


def chunk_state(chunk: str, inside: bool) -> tuple[bool, int]:
    """String state after a chunk and the closing brace that follows it, and the change of depth."""
    parts = (ESCAPE.sub("", chunk) if "\\" in chunk else chunk).split('"')
    depth = sum(p.count("{") + p.count("[") - p.count("]") for p in parts[int(inside)::2])
    inside = inside != (len(parts) % 2 == 0)
    return inside, depth - (not inside)


def json_chunks(spark: SparkSession, pattern: str) -> DataFrame:
    """``(f, size, b, o, value)``: what stands between closing braces, by file and start of its range."""
    return spark.read.option("lineSep", "}").text(pattern).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("o"), "value")


def range_states(chunks: DataFrame) -> DataFrame:
    """``(f, b, is_array, inside, depth)`` per range: what its beginning stands in."""
    schema = pa.schema([("f", pa.string()), ("b", pa.int64()), ("first", pa.string()), ("swap", pa.bool_()),
                        ("d0", pa.int64()), ("d1", pa.int64())])

    def scan(batches):
        at, first, states, out = None, "", None, []

        def told():
            return (*at, first, states[0][0], states[0][1], states[1][1])

        for batch in batches:
            for f, b, value in zip(*[batch.column(c).to_pylist() for c in ("f", "b", "value")]):
                if at != (f, b):
                    if at is not None:
                        out.append(told())
                    at, first, states = (f, b), value.lstrip()[:1], [(False, 0), (True, 0)]
                for k, (inside, depth) in enumerate(states):
                    inside, change = chunk_state(value, inside)
                    states[k] = (inside, depth + change)
        if at is not None:
            out.append(told())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)], schema=schema)

    ranges = chunks.select("f", "b", "value").mapInArrow(
        scan, "f string, b long, first string, swap boolean, d0 long, d1 long")
    # A row a range: the windows hold a file's ranges, not its text.
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum(F.col("swap").cast("int")).over(before) % 2 == 1, F.lit(False)))
    change = F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))
    return ranges.select(
        "f", "b", (F.first("first").over(Window.partitionBy("f").orderBy("b")) == "[").alias("is_array"), "inside",
        F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"))


def cut_ranges(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """``(f, b, nth, kind, text)``: elements (``whole``), their pieces (``head``, ``body``, ``tail``), the
    ``end`` of the array, and ``bad`` where something else stands between elements."""
    schema = pa.schema([("f", pa.string()), ("b", pa.int64()), ("nth", pa.int64()), ("kind", pa.string()),
                        ("text", pa.string())])

    def cut(batches):
        at, inside, depth, early, held, nth, out = None, False, 0, False, [], 0, []

        def left():
            return (*at, nth, "body" if early else "head", "".join(held))

        for batch in batches:
            for f, b, value, begins, level in zip(*[batch.column(c).to_pylist()
                                                    for c in ("f", "b", "value", "inside", "depth")]):
                if at != (f, b):
                    if held:
                        out.append(left())
                    at, inside, depth, held, nth = (f, b), begins, level, [], 0
                    early = inside or depth > 1
                text = value
                if not held and not early:
                    gap, brace, rest = value.partition("{")
                    text = brace + rest
                    if not brace:
                        ended = (END if depth else EMPTY).fullmatch(value)
                        out.append((f, b, nth, "end" if ended else "bad", None))
                    elif not (NEXT if depth else FIRST).fullmatch(gap):
                        out.append((f, b, nth, "bad", None))
                inside, change = chunk_state(value, inside)
                depth += change
                if not text and not held and not early:
                    continue
                held.append(text + "}")
                if not inside and depth <= 1:
                    out.append((f, b, nth, "tail" if early else "whole", "".join(held)))
                    early, held, nth = False, [], nth + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)], schema=schema)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], x.type) for c, x in zip(left(), schema)], schema=schema)

    arrays = states.where("is_array").select("f", "b", "inside", "depth")
    if arrays.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        told = chunks.join(F.broadcast(arrays), ["f", "b"])         # keeps the order of the chunks
    else:
        told = chunks.join(arrays, ["f", "b"]).repartition("f", "b").sortWithinPartitions("f", "b", "o")
    return told.select("f", "b", "value", "inside", "depth").mapInArrow(
        cut, "f string, b long, nth long, kind string, text string")


def json_elements(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(f, row, text)`` of the elements of array files, in the order of ``row``; ``(f)`` of array files that
    are no list of objects; ``(f, value)`` of all other files, whole."""
    chunks = json_chunks(spark, pattern)
    states = materialize(range_states(chunks), "json-ranges")
    cut = materialize(cut_ranges(chunks, states), "json-cut")
    whole = cut.where("kind = 'whole'").select("f", (F.col("b") + F.col("nth")).alias("row"), "text")
    order = Window.partitionBy("f").orderBy("b", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = cut.where("kind in ('head', 'body', 'tail')").withColumn(
        "record", F.sum((F.col("kind") == "head").cast("int")).over(order))
    joined = pieces.groupBy("f", "record").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("b") + F.col("nth")).alias("row"), "text"))).alias("p"))
    joined = joined.select("f", F.col("p")[0]["row"].alias("row"),
                           F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    broken = (states.where("is_array").select("f", F.lit(0).alias("bad"), F.lit(0).alias("ends"))
              .unionAll(cut.where("kind in ('bad', 'end')").select(
                  "f", (F.col("kind") == "bad").cast("int"), (F.col("kind") == "end").cast("int")))
              .groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("ends").alias("ends"))
              .where("bad > 0 or ends <> 1").select("f"))
    single = states.where("not is_array").select("f", "b")
    parts = chunks.join(single, ["f", "b"]).groupBy("f", "size").agg(
        F.sort_array(F.collect_list(F.struct("b", "o", "value"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["value"]), "}")
    # The reader drops a closing brace at the very end; the size of the file tells.
    value = F.when(F.octet_length(body) < F.col("size"), F.concat(body, F.lit("}"))).otherwise(body)
    return whole.unionByName(joined), broken, parts.select("f", value.alias("value"))
