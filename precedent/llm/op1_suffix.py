"""Suffix-array dedup: removal of every byte under a 400-byte string that occurs more than once.

Equal strings must meet in one task without sorting the corpus as a whole.  Every
400-byte string has an anchor, the least hash of the 128-byte grams inside it, which
depends on its bytes alone; consecutive starts with the same anchor form a run, and a
run's text (399 bytes more than its starts) is a *stretch*.  Equal strings have equal
anchors, so only stretches of one anchor (a bin) can share them.

1. One pass over the texts writes a narrow row per stretch: place, anchor, 128-bit hash.
2. Stretches are counted with partial sums.  Those that occur twice are covered whole,
   wherever they stand.  A bin with one distinct stretch needs nothing more.
3. Of the other bins each distinct stretch is fetched once, from its first place.  Bins
   are gathered in blocks of about ``BLOCK`` bytes, and each block is suffix-sorted in
   two stages (``suffixes``): suffixes smaller than their successors directly, all
   others induced by bucket scans; common prefixes of neighbours give the repeats.
4. A bin with more than ``MAX_BIN`` distinct stretches would burden one task.  Its
   stretches are cut anew by anchors of longer grams (``GRAMS``): strings that hold more
   than a few bytes outside a common passage get anchors of their own.  The strings of
   bins that are still too large after the last grams are counted by 128-bit hash over
   all tasks: exact as well.
5. Covered ranges meet their document, are merged, and the rest is hashed.

Copies of texts or passages, however many, are one row after step 2, so no group
lands in one task.  Only narrow rows, the distinct stretches of unsettled bins, and
the texts (once to be cut, once to be hashed) are shuffled.

Defined results: null text counts as empty; texts under 400 bytes lose nothing; rows
with the same ``doc_id`` and text are copies of each other, rows with the same
``doc_id`` and other texts are documents of their own; null ``doc_id`` stays null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.suffixes import anchored_runs, repeated_starts
from precedent.llm.common import materialize, n_partitions, small_batches, spread

LENGTH = 400
GRAMS = (128, 320, 384)
BLOCK = 1 << 20
MAX_BIN = 1_000

STRETCH = "doc long, th long, base long, start long, n_win long, anchor long, s1 long, s2 long"


def _rows(cols, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc, th, doc_id, text)``: a row's key is its id and its text's hash."""
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc"),
                       F.xxhash64("text").alias("th"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def whole_texts(docs: DataFrame, length: int) -> DataFrame:
    """``(doc, th, base, raw)``: what may hold a repeat, from its place ``base`` on."""
    return _keyed(docs).where(F.octet_length("text") >= length).select(
        "doc", "th", F.lit(0).cast("long").alias("base"), F.col("text").cast("binary").alias("raw"))


def stretches(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per stretch of every part; ``start`` counts from the document's beginning."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "th", "base", "start", "n_win", "anchor", "s1", "s2")])

    def run(batches):
        import numpy as np
        import xxhash

        for batch in small_batches(batches, "raw"):
            cols = [[] for _ in schema]
            for doc, th, base, raw in zip(*[batch.column(c).to_pylist() for c in ("doc", "th", "base", "raw")]):
                starts, counts, anchors = anchored_runs(np.frombuffer(raw, np.uint8), length, gram)
                digests = b"".join(xxhash.xxh3_128_digest(raw[s:s + n + length - 1])
                                   for s, n in zip(starts.tolist(), counts.tolist()))
                halves = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
                for col, values in zip(cols, (np.full(len(starts), doc), np.full(len(starts), th),
                                              np.full(len(starts), base), starts + base, counts,
                                              anchors.view(np.int64), halves[:, 0], halves[:, 1])):
                    col.append(values)
            yield _rows([np.concatenate(c) for c in cols], schema)

    return parts.mapInArrow(run, STRETCH)


def fetch(parts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` stretches with their bytes, each cut from its part."""
    per = wanted.groupBy("doc", "th", "base").agg(F.collect_list(
        F.struct("start", "n_win", "anchor", "s1", "s2")).alias("cuts"))
    names = ["doc", "th", "start", "anchor", "s1", "s2", "raw"]
    schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [("raw", pa.binary())])

    def run(batches):
        for batch in small_batches(batches, "raw"):
            cols = [[] for _ in schema]
            for doc, th, base, raw, cuts in zip(*[batch.column(c).to_pylist()
                                                  for c in ("doc", "th", "base", "raw", "cuts")]):
                for c in cuts:
                    at = c["start"] - base
                    row = (doc, th, c["start"], c["anchor"], c["s1"], c["s2"], raw[at:at + c["n_win"] + length - 1])
                    for col, value in zip(cols, row):
                        col.append(value)
            yield _rows(cols, schema)

    return parts.join(per, ["doc", "th", "base"]).mapInArrow(
        run, ", ".join(f"{n} long" for n in names[:-1]) + ", raw binary")


RANGES = "doc long, th long, start long, end long"


def sorted_bins(cut: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """Repeated ranges inside the stretches of ``cut``, by suffix arrays over blocks of whole bins."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "th", "start", "end")])

    def solve(strings):
        import numpy as np

        data = np.frombuffer(b"".join(s[-1] for s in strings), np.uint8)
        sizes = np.array([len(s[-1]) for s in strings])
        base = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(strings)), sizes)
        within = np.arange(len(data)) - base[owner]
        found = repeated_starts(data, sizes[owner] - within >= length, length)
        # Ranges of starts that follow each other within one stretch.
        gap = np.concatenate(([True], (found[1:] != found[:-1] + 1) | (owner[found[1:]] != owner[found[:-1]]))) \
            if len(found) else np.empty(0, bool)
        firsts = found[gap]
        lasts = found[np.concatenate((gap[1:], [True]))] if len(found) else found
        cols = [[] for _ in schema]
        for first, last in zip(firsts.tolist(), lasts.tolist()):
            s = strings[owner[first]]
            at = s[2] - int(base[owner[first]])
            for col, value in zip(cols, (s[0], s[1], at + first, at + last + length)):
                col.append(value)
        return _rows(cols, schema)

    def run(batches):
        held, size, anchor, seen = [], 0, None, set()
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc", "th", "start", "anchor", "s1", "s2", "raw")]):
                doc, th, start, a, s1, s2, raw = row
                if a != anchor:
                    anchor, seen = a, set()
                    if size >= block:
                        yield solve(held)
                        held, size = [], 0
                if (s1, s2) not in seen:       # repeated rows of the table give a stretch twice
                    seen.add((s1, s2))
                    held.append((doc, th, start, raw))
                    size += len(raw)
        if held:
            yield solve(held)

    n = n_partitions(cut.sparkSession)
    return cut.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, RANGES)


def hashed_windows(cut: DataFrame, length: int) -> DataFrame:
    """The same ranges for bins too large for one task: their windows counted by hash."""
    names = ["doc", "th", "start", "w1", "w2"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        import numpy as np
        import xxhash

        for batch in small_batches(batches, "raw", 256 << 10):
            cols = [[] for _ in schema]
            for doc, th, start, raw in zip(*[batch.column(c).to_pylist() for c in ("doc", "th", "start", "raw")]):
                n = len(raw) - length + 1
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i:i + length]) for i in range(n)),
                                       ">i8").astype(np.int64).reshape(-1, 2)
                for col, values in zip(cols, (np.full(n, doc), np.full(n, th), np.arange(start, start + n),
                                              halves[:, 0], halves[:, 1])):
                    col.append(values)
            if cols[0]:
                yield _rows([np.concatenate(c) for c in cols], schema)

    win = materialize(cut.mapInArrow(
        run, ", ".join(f"{n} long" for n in names)), "suffix-windows")
    twice = win.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return win.join(twice, ["w1", "w2"]).select("doc", "th", "start", (F.col("start") + length).alias("end"))


def repeated_ranges(parts: DataFrame, length: int = LENGTH, grams=GRAMS, max_bin: int = MAX_BIN,
                    block: int = BLOCK) -> DataFrame:
    """``(doc, th, start, end)``: ranges that together cover every ``length``-byte string that
    repeats within ``parts(doc, th, base, raw)``."""
    rows = materialize(stretches(parts, length, grams[0]), "suffix-stretches")
    distinct = rows.groupBy("anchor", "s1", "s2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "base", "start", "n_win")).alias("place"))
    bins = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    unsettled, stat = materialize(distinct.join(bins, "anchor").select(
        "place.*", "anchor", "s1", "s2", "d"), "suffix-unsettled", {"large": F.sum((F.col("d") > max_bin).cast("int"))})
    twice = distinct.where("n > 1").select("anchor", "s1", "s2")
    out = rows.join(twice, ["anchor", "s1", "s2"]).select(
        "doc", "th", "start", (F.col("start") + F.col("n_win") + (length - 1)).alias("end"))
    cut = materialize(fetch(parts, unsettled.where(f"d <= {max_bin}"), length), "suffix-cut")
    out = out.unionAll(sorted_bins(cut, length, block))
    if stat["large"]:
        # Repeated rows of the table give a stretch twice.
        hot = materialize(fetch(parts, unsettled.where(f"d > {max_bin}"), length)
                          .dropDuplicates(["anchor", "s1", "s2"]), "suffix-hot")
        if len(grams) > 1:
            hot = hot.select("doc", "th", F.col("start").alias("base"), "raw")
            out = out.unionAll(repeated_ranges(hot, length, grams[1:], max_bin, block))
        else:
            out = out.unionAll(hashed_windows(hot, length))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, grams=GRAMS, max_bin: int = MAX_BIN,
                   block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` per row of ``docs``; ``kept`` the bytes left."""
    cover = repeated_ranges(spread(whole_texts(docs, length)), length, grams, max_bin, block).groupBy("doc", "th").agg(
        F.collect_set(F.struct("start", "end")).alias("ranges"))
    cover = materialize(cover, "suffix-cover")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for batch in small_batches(batches, "text"):
            cols = [[] for _ in schema]
            for doc_id, text, ranges in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges")]):
                raw = text.encode("utf-8", "surrogatepass")
                kept, at, removed, spans = [], 0, 0, 0
                for r in sorted((r["start"], r["end"]) for r in ranges or ()):
                    if r[0] > at or not spans:
                        kept.append(raw[at:r[0]])
                        spans += 1
                        at = r[0]
                    if r[1] > at:
                        removed += r[1] - at
                        at = r[1]
                kept = b"".join([*kept, raw[at:]])
                row = (doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept)
                for col, value in zip(cols, row):
                    col.append(value)
            yield _rows(cols, schema)

    return (_keyed(docs).join(cover, ["doc", "th"], "left").select("doc_id", "text", "ranges")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                             "kept_sha256 string, kept binary"))
