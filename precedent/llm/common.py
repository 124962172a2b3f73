"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import types
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from precedent.session import materialize, shared_path
from precedent.sources.tables import read_table

__all__ = ["documents", "materialize", "shared_path", "read_table", "worker_state", "free_worker",
           "TokenEncoder", "WORD_RE", "prefix_sum", "components", "n_partitions", "spread", "packed", "unpacked"]

# Fixed value of the data contract: words are runs of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is when its scan already has a task per core; otherwise dealt
    round robin, so that one input file does not leave the cluster idle.  Inputs
    cut into many splits by the reader are never shuffled for this."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(n_partitions(spark))


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """``own`` columns and ``_row``, a struct of all others, so that names of a step's own cannot clash with theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*others) if others else F.lit(None).cast("int")).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of a frame that ``packed`` made, in their order."""
    held = getattr(df.schema["_row"].dataType, "names", [])
    return df.select(*[F.col("_row")[c].alias(c) if c in held else F.col(c) for c in columns])


def worker_state(name: str, make):
    """An object kept for the life of a Python worker, across its tasks."""
    box = sys.modules.get("_precedent_worker_state")
    if box is None:
        box = sys.modules["_precedent_worker_state"] = types.ModuleType("_precedent_worker_state")
    if not hasattr(box, name):
        setattr(box, name, make())
    return getattr(box, name)


def free_worker():
    """What earlier steps left in this Python worker goes: objects of ``worker_state``, and freed memory that its
    allocators keep. A worker serves all steps of a session, so a step with tables of its own begins with this."""
    sys.modules.pop("_precedent_worker_state", None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # only glibc has it
        pass


class TokenEncoder:
    """Token ids of whole texts with the ``tokenizers`` library, as little-endian
    unsigned 32-bit bytes.

    A byte-level BPE with the usual pattern always starts a piece at a single
    space that stands between two characters that are not white space, and it
    merges only within pieces.  So a text is cut at those spaces, each distinct
    cut is encoded once per worker, and a text's ids are the concatenation.
    Texts where a space touches other white space are encoded whole.

    Cuts are told apart per batch by Arrow's dictionary encoding, so the memo is
    asked once for each distinct cut of a batch, and ids are put together by one
    ``take``.  The memo is two generations of at most ``max_words / 2`` cuts: when
    the young one is full it becomes the old one, and a cut found there moves back.
    """

    def __init__(self, path: str, max_words: int = 1_200_000):
        import os

        import numpy as np
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # Spark's tasks share the cores
        self.np = np
        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.memo: dict[str, bytes] = {}        # key: a cut without its leading space
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        # U+0120 stands for the space byte in byte-level vocabularies.
        self.spaced[[i for w, i in vocabulary.items() if w.startswith("\u0120")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [self.np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_cuts(self, words: list[str]) -> Iterator[bytes]:
        """Ids of " " + word for each word.  Many words make one text; only the first
        id of a word can begin with a space, and that is where the ids are parted."""
        texts = [" " + " ".join(words[k:k + 1024]) for k in range(0, len(words), 1024)]
        for k in range(0, len(texts), 64):
            for data in self._encode(texts[k:k + 64]):
                at = (4 * self.np.flatnonzero(self.spaced[self.np.frombuffer(data, "<u4")])).tolist() + [len(data)]
                yield from (data[i:j] for i, j in zip(at, at[1:]))

    def _cut_ids(self, words: list[str]) -> list[bytes]:
        """Ids of " " + word for each of the distinct ``words``."""
        if len(self.memo) > self.max_words // 2:
            self.memo, self.older = {}, self.memo
        ids = list(map(self.memo.get, words))
        missing = [i for i, found in enumerate(ids) if found is None]
        for i, found in zip(missing, [self.older.get(words[i]) for i in missing]):
            if found is not None:
                ids[i] = self.memo[words[i]] = found
        missing = [i for i in missing if ids[i] is None]
        for i, found in zip(missing, self._encode_cuts([words[i] for i in missing])):
            ids[i] = self.memo[words[i]] = found
        return ids

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        np = self.np
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        col = pc.fill_null(col.cast(pa.large_string()), "")
        if not len(col):
            return []
        cuts = pc.split_pattern(col, " ")
        words = cuts.flatten().dictionary_encode()
        place = np.asarray(words.indices).astype("i8")              # of each cut in the dictionary
        starts = np.asarray(cuts.offsets).astype("i8")
        starts, ends = starts[:-1] - starts[0], starts[1:] - starts[0]
        distinct = words.dictionary.to_pylist()
        is_first = np.zeros(len(place), dtype=bool)
        is_first[starts] = True
        # A cut that is empty or begins or ends with white space: its text is encoded whole.
        odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in distinct), bool, len(distinct))
        firsts = [distinct[i] for i in place[starts].tolist()]
        whole = np.logical_or.reduceat(odd[place] & ~is_first, starts)
        whole |= np.fromiter((w[-1:].isspace() for w in firsts), bool, len(firsts))
        asked = np.zeros(len(distinct), dtype=bool)
        asked[place[~is_first & ~np.repeat(whole, ends - starts)]] = True
        asked = np.flatnonzero(asked).tolist()
        # Pieces: a cut each, the empty one, then the first cut of each text or the text.
        pieces = [b""] * (len(distinct) + 1)
        for i, ids in zip(asked, self._cut_ids([distinct[i] for i in asked])):
            pieces[i] = ids
        pieces += self._encode([col[i].as_py() if w else firsts[i] for i, w in enumerate(whole.tolist())])
        place[np.repeat(whole, ends - starts)] = len(distinct)
        place[starts] = len(distinct) + 1 + np.arange(len(col))
        joined = pa.array(pieces, pa.large_binary()).take(pa.array(place))
        at = np.frombuffer(joined.buffers()[1], "<i8")
        data = memoryview(joined.buffers()[2] or b"")
        return [bytes(data[i:j]) for i, j in zip(at[starts].tolist(), at[ends].tolist())]


def token_encoder(path: str) -> TokenEncoder:
    return worker_state(f"encoder_{zlib.crc32(path.encode())}", lambda: TokenEncoder(path))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20):
    """Slices of the batches holding about ``max_bytes`` of text each (one row at least),
    so that a task's memory is bounded by its longest text, not by rows per batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
        at, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > max_bytes:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)


def prefix_sum(df: DataFrame, part: list[str], bucket: Column, order: list[Column], value: str,
               out: str, total: str | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over the earlier rows of the same ``part``; ``total`` = over all of them.

    Two levels: sums per (part, bucket) are accumulated over the buckets of a
    part, then rows within their bucket.  ``bucket`` must be a coarse prefix of
    ``order``, so that no window holds a whole part."""
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*part, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*part, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
                       *([F.sum("_sum").over(Window.partitionBy(*part)).alias(total)] if total else []))
    inner = Window.partitionBy(*part, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.join(base, [*part, "_bucket"])
            .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .drop("_bucket", "_base"))


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long ids): ``(id, component)`` with the
    smallest reachable id, for every id that stands in an edge.

    Alternating large-star and small-star steps on written tables; each step
    groups by node with partial aggregation (only the minimum per node is
    gathered, never a node's neighbours), so hub nodes stay cheap.  Ends when
    a round changes no edge; raises after ``max_rounds`` (rounds grow with the
    logarithm of a component's size).
    """
    cur = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
           .distinct())
    state = {"n": F.count(F.lit(1)), "s": F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))}
    cur, done = materialize(cur, f"{name}-edges", state)
    for _ in range(max_rounds):
        if not done["n"]:
            break
        # Large star: every larger neighbour of a node is linked to the node's least neighbour.
        both = cur.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(
            cur.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(
            "x", F.least("m", "x").alias("m"))
        # cur holds (u > v): for node v its larger neighbours are the u's.
        large = (cur.join(least, cur.v == least.x).select(F.col("u"), F.col("m").alias("v"))
                 .unionAll(least.where("m < x").select(F.col("x").alias("u"), F.col("m").alias("v")))
                 .where("u > v").distinct())
        # Small star: smaller neighbours of a node and the node itself go to the least of them.
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v")
                 .unionAll(least2.select("u", F.col("m").alias("v"))).distinct())
        cur, now = materialize(small, f"{name}-cc", state)
        if now == done:
            break
        done = now
    else:
        raise RuntimeError(f"components of {name}: no end after {max_rounds} rounds")
    members = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionAll(roots)
