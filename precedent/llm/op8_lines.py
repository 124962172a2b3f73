"""Line dedup over overlapping windows of three consecutive lines.

Every run of three consecutive lines is hashed (128 bits, MD5).  A window whose
lines occur at more than one place of the corpus keeps its first place, by
(doc_id with null last, hash of the text, line number); the lines under every later place are covered, windows
that overlap merge by their positions, and covered lines are removed.

All of it is DataFrame code.  Windows are counted with map-side partial sums
before anything is gathered; a window that holds a third of all rows is one
row after that, and the join back to its places is a plain equi-join whose
partitions Spark may split.  Texts move once, to meet their covered lines.

Defined results: null text has no lines and stays null; texts of one or two
lines have no window and stay whole; windows of three blank lines are never
repeats; a row's key is its id and its text's hash: rows equal in both are one place and
do not remove each other, rows with the same ``doc_id`` and other texts, or without an
id, are documents of their own; an empty table gives no rows; further columns are
kept as they are (``dedup_lines``) whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import materialize, packed

WINDOW = 3
#: A row's key, in the order of first places; ``doc_id`` is 0 where it is null.
KEY = ("no_id", "doc_id", "th")


def _text_hash() -> Column:
    return F.unhex(F.md5("text"))


def _windows(docs: DataFrame) -> DataFrame:
    """``(no_id, doc_id, th, pos, h)`` for every window of three lines that is not blank."""
    lines = docs.where("text is not null").select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        _text_hash().alias("th"), F.split("text", "\n", -1).alias("lines"))
    lines = lines.where(F.size("lines") >= WINDOW)
    # Each window as one string: the separator cannot stand inside a line.
    cut = F.expr(
        f"transform(sequence(0, size(lines) - {WINDOW}), "
        f"i -> array_join(slice(lines, i + 1, {WINDOW}), '\n'))")
    win = lines.select(*KEY, F.posexplode(cut).alias("pos", "w"))
    win = win.where(F.col("w").rlike(r"[^ \t\r\n]"))
    return win.select(*KEY, "pos", F.unhex(F.md5("w")).alias("h"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """``(no_id, doc_id, th, covered)``: sorted distinct line numbers under a later occurrence."""
    win = materialize(_windows(docs.select("doc_id", "text")), "line-windows")
    # One row per (window, document) first: repeats inside a document end here.
    first = win.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "pos")).alias("first"))
    first = first.where("n > 1")
    later = win.join(first, "h").where(
        F.struct(*KEY, "pos") > F.col("first"))
    lines = later.select(*KEY, F.explode(F.array(*[F.col("pos") + i for i in range(WINDOW)]))
                         .alias("line")).distinct()
    return lines.groupBy(*KEY).agg(F.sort_array(F.collect_list("line")).alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its covered lines, and ``_n_lines``, ``_n_removed`` (in place of columns so named)."""
    # Merged positions as one flag per line up to the last covered one: each covered line
    # ends a stretch of lines that stay, so the flags take one pass.
    stretch = ("transform(covered, (c, i) -> c - if(i = 0, -1, covered[i - 1]) - 1)")
    flags = F.expr(f"flatten(transform({stretch}, n -> concat(array_repeat(false, n), array(true))))")
    cover = covered_lines(docs).select(*[F.col(k).alias(f"_cover_{k}") for k in KEY], flags.alias("_flags"),
                                       F.size("covered").alias("_n_covered"))
    same = ((F.col("doc_id").isNull() == F.col("_cover_no_id")) & (_text_hash() == F.col("_cover_th"))
            & (F.coalesce("doc_id", F.lit(0)) == F.col("_cover_doc_id")))
    # Further columns travel in a struct, so that none can clash with those of this step.
    out = packed(docs, "doc_id", "text").join(cover, same, "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    text = F.when(F.col("_flags").isNull(), F.col("text")).otherwise(F.expr(
        "array_join(filter(split(text, '\n', -1), "
        "(l, i) -> i >= size(_flags) or not _flags[i]), '\n')"))
    added = {"_n_lines": n_lines, "_n_removed": F.coalesce("_n_covered", F.lit(0))}
    kept = [c for c in docs.columns if c not in added]
    out = out.select("doc_id", text.alias("text"), "_row", *[v.alias(k) for k, v in added.items()])
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in kept], *added)
