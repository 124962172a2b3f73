"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids (and its end id) are cut into whole sequences of ``capacity``
ids and a remainder; the remainder is cut in equal parts of at most ``largest``
ids, so that differencing has pieces to balance with.  Whole sequences need no packing.
The remaining pieces are dealt by a hash of their place to groups of about
``group_size`` pieces; within a group, multiway differencing starts from one
partial partition per piece and merges the two with the greatest imbalance so
that large windows of one meet small windows of the other.  The windows come
out nearly equal, so their number is the ids divided by the capacity, and rises
by one whenever a window exceeds the capacity.

Texts are encoded once, in the scan, and never shuffled: what moves is one
narrow row per piece with its checksum.  Groups are bounded by construction (a
hash over a count of pieces), so no source or document decides a task's size.

Defined results: null and empty texts are one id (the end id); texts longer
than the capacity give whole sequences; repeated rows are packed each; null
``doc_id`` stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import materialize, small_batches, spread, token_encoder

CAPACITY = 2048
END_ID = 1
GROUP_SIZE = 384
#: Remainders are cut in equal parts of at most this many ids.
LARGEST = 512

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "place long, whole boolean")


def karmarkar_karp(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``m`` near-equal parts.

    A partial partition is a list of (sum, members), largest sums first, less
    the smallest sum; parts that hold nothing beyond it are left implicit."""
    if m <= 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, n in enumerate(sizes):
        # (-spread, tie, [(sum, members)...] descending, padded to m only when merged)
        heap.append((-n, i, [(n, (i,))]))
    heapq.heapify(heap)
    tie = len(sizes)
    empty = (0, ())
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        a = a + [empty] * (m - len(a))
        b = b + [empty] * (m - len(b))
        # The largest of one meets the smallest of the other.
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        merged.sort(key=lambda p: -p[0])
        low = merged[-1][0]
        if low:
            merged = [(s - low, p) for s, p in merged]
        while merged and not merged[-1][1]:
            merged.pop()
        tie += 1
        heapq.heappush(heap, (-merged[0][0], tie, merged))
    return [list(p) for _, p in heap[0][2] if p] if heap else []


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: as few as the sum allows, more while one exceeds it."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = karmarkar_karp(sizes, m)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        m += 1


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
               largest: int = LARGEST) -> DataFrame:
    """One row per piece; ``place`` numbers pieces uniquely in this run, ``whole`` marks full sequences."""
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        from pyspark import TaskContext

        encoder = token_encoder(tokenizer)
        place = TaskContext.get().partitionId() << 36
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(),
                                   encoder.encode(batch.column("text"))):
                ids += end
                total, at = len(ids) // 4, 0
                while at < total:
                    left = min(capacity, total - at)
                    # A remainder goes in equal parts of at most ``largest`` ids.
                    n_parts = 1 if left == capacity else -(-left // largest)
                    for k in range(n_parts):
                        n = left // n_parts + (k < left % n_parts)
                        rows.append((doc_id, at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), total,
                                     place, left == capacity))
                        at, place = at + n, place + 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64()] * 6 + [pa.bool_()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place", "whole"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return spread(docs.select("doc_id", "text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         group_size: int = GROUP_SIZE) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row per piece."""
    pieces, stat = materialize(
        cut_pieces(docs, tokenizer, capacity, end_id), "pack-pieces",
        {"n": F.sum(F.when(F.col("whole"), 0).otherwise(1))})
    n_groups = max(1, -(-(stat["n"] or 0) // group_size))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    out = [*keep, "sequence_id", "offset"]
    full = pieces.where("whole").select(*keep, (F.col("place") * 2 + 1).alias("sequence_id"),
                                        F.lit(0).cast("long").alias("offset"))

    def fill(key, table):
        table = table.sort_by([("place", "ascending")])
        sizes = table.column("length").to_pylist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for w, members in enumerate(pack_group(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = ((key[0].as_py() << 20) + w) * 2, at
                at += sizes[i]
        return (table.select(keep).append_column("sequence_id", pa.array(sequence, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    rest = (pieces.where("not whole").drop("whole")
            .withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(n_groups)))
            .groupBy("grp").applyInArrow(
                fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                      "sequence_id long, offset long"))
    return full.select(*out).unionAll(rest.select(*out))
