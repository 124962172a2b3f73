"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes of the UTF-8 text ends a chunk wherever it is
-1 modulo the block size.  Each chunk's hash becomes one of 64 letters, so a
text's letters at block size b and at 2b form its fingerprint ``b:letters:letters``.
The block size is the least 3 * 2 ** k that leaves at most ``LENGTH`` expected
chunks, halved while the letters are fewer than half of that.  An edit changes
the letters near it only, as boundaries depend on nearby bytes alone.

Two fingerprints are compared at a block size they share: likeness is 1 less
the edit distance (insertions and deletions; a substitution is one of each)
over the letters of both, the best of the shared sizes; 0 when no block size
is shared or no run of ``GRAM`` letters is common, 1 when they are equal.

The next document by ascending id comes from ranges: cut points are ids that
occur, found from the id column; a task takes one range, sorted, and the
document that opens the next range is sent to it as well.  So each text moves
once, and no window spans the table.

Defined results: null text counts as empty; a lone document is its own next;
repeated ids follow each other ordered by text; null ``doc_id`` rows come last;
texts of any length are read whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import n_partitions, small_batches

LENGTH = 64
GRAM = 4
SMALLEST = 3
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


class Hasher:
    """Fingerprints of byte strings, vectorised over the bytes of each."""

    def __init__(self):
        import numpy as np

        self.np = np
        self.letters = np.frombuffer(LETTERS.encode(), np.uint8)
        self.powers = np.ones(1, np.uint64)

    def rolling(self, data: bytes):
        """A 32-bit hash of the seven bytes that end at each place."""
        np = self.np
        b = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
        h = np.zeros(len(b), np.uint32)
        for back in range(7):
            weight = np.uint32(pow(0x9E3779B1, back + 1, 1 << 32) | 1)
            h[back:] += b[:max(0, len(b) - back)] * weight
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        return h

    def chunk_letters(self, data, ends) -> str:
        """A letter for each chunk that ends before one of ``ends`` or at the text's end."""
        np = self.np
        starts = np.concatenate(([0], ends))
        if starts[-1] == len(data):
            starts = starts[:-1]
        if not len(starts):
            return ""
        lengths = np.diff(np.concatenate((starts, [len(data)])))
        longest = int(lengths.max())
        if longest > len(self.powers):
            grown = np.full(max(longest, 2 * len(self.powers)), 0x100000001B3, np.uint64)
            grown[0] = 1
            self.powers = np.multiply.accumulate(grown)
        within = np.arange(len(data)) - np.repeat(starts, lengths)
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * self.powers[within], starts)
        sums ^= sums >> np.uint64(29)
        sums *= np.uint64(0xBF58476D1CE4E5B9)
        return self.letters[(sums >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    def __call__(self, text: str) -> str:
        np = self.np
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return f"{SMALLEST}::"
        data, h = np.frombuffer(raw, np.uint8), self.rolling(raw)
        size = SMALLEST
        while size * LENGTH < len(raw):
            size *= 2
        while True:
            # A boundary at 2 * size is one at size too.
            ends = np.flatnonzero(h % np.uint32(size) == size - 1) + 1
            if size == SMALLEST or len(ends) >= LENGTH // 2:
                break
            size //= 2
        coarse = ends[h[ends - 1] % np.uint32(2 * size) == 2 * size - 1]
        return f"{size}:{self.chunk_letters(data, ends)}:{self.chunk_letters(data, coarse)}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per letter of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def letters_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) < GRAM:
        return 0.0
    grams = {a[i:i + GRAM] for i in range(len(a) - GRAM + 1)}
    if not any(b[i:i + GRAM] in grams for i in range(len(b) - GRAM + 1)):
        return 0.0
    # Edit distance = len(a) + len(b) - 2 * common subsequence.
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1 for two fingerprints."""
    if x == y:
        return 1.0
    size_x, fine_x, coarse_x = x.split(":")
    size_y, fine_y, coarse_y = y.split(":")
    size_x, size_y = int(size_x), int(size_y)
    if size_x == size_y:
        return max(letters_likeness(fine_x, fine_y) if fine_x or fine_y else 0.0,
                   letters_likeness(coarse_x, coarse_y) if coarse_x and coarse_y else 0.0)
    if size_x == 2 * size_y:
        return letters_likeness(fine_x, coarse_y) if fine_x and coarse_y else 0.0
    if size_y == 2 * size_x:
        return letters_likeness(coarse_x, fine_y) if coarse_x and fine_y else 0.0
    return 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following``'s beginning."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def _ranges(docs: DataFrame, n: int) -> DataFrame:
    """Rows ``(part, tail, doc_id, text)``: each document in its range, and the first of each
    range once more, as ``tail``, in the range before."""
    ids = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000),
                   F.min("doc_id"), F.count(F.lit(1)), F.count("doc_id")).first()
    cuts = sorted(set(ids[0] or []) - {ids[1]})
    has_null = 0 < ids[3] < ids[2]
    n_ranges = len(cuts) + 1 + has_null
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.when(F.col("doc_id").isNull(), F.lit(n_ranges - 1)).otherwise(
        F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    opens = F.col("doc_id").isin([ids[1], *cuts]) if ids[3] else F.lit(False)
    if ids[3] < ids[2]:
        # All null ids stand in the last range, and each may be its first by text.
        opens = opens | F.col("doc_id").isNull()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", part)
    places = F.when(opens, F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")),
        F.struct(F.pmod(F.col("part") - 1, F.lit(n_ranges)).alias("part"), F.lit(True).alias("tail"))
    )).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))))
    return rows.withColumn("place", F.explode(places)).select("place.part", "place.tail", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``."""
    n = n_partitions(docs.sparkSession)
    rows = _ranges(docs, 4 * n)

    def run(batches):
        hasher = Hasher()
        held = None                    # the row before, waiting for its next: (part, doc_id, text, fingerprint)
        done = -1                      # the range whose tail has been met
        for batch in small_batches(batches, "text"):
            out = []
            for part, tail, doc_id, text in zip(*[batch.column(c).to_pylist()
                                                  for c in ("part", "tail", "doc_id", "text")]):
                if tail and (part == done or held is None):
                    continue
                mark = hasher(text)
                if held is not None:
                    out.append(row(hasher, held, text, mark))
                if tail:
                    held, done = None, part
                else:
                    held = (part, doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def row(hasher, held, following, next_mark):
        _, doc_id, text, mark = held
        other = edited(text, following)
        other_mark = hasher(other)
        sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), sha, mark, other_mark, likeness(mark, other_mark), likeness(mark, next_mark))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return (rows.repartition(n, "part")
            .sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), "text")
            .mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double"))
