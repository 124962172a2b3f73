"""Text → vector (M1), with a text-keyed cache.

The encoder is pluggable: any object with ``encode(list) -> list[vector]``.
It runs inside Arrow UDFs, some rows at a time, so the corpus is embedded where it
lies, partition by partition; nothing passes through the driver.

The default ``HashingEncoder`` needs no model files: signed feature hashing
of the tokens (the same tokens the keyword index uses, produced JVM-side),
weight ``1 + ln(tf)``, L2-normalised. It is deterministic, so it has a SQL
oracle.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.functions.text import tokenize
from precedent.operators.bm25 import counted_terms, spread_scan

VECTOR_TYPE = T.ArrayType(T.FloatType())
# Rows that an encoder gets at a time: the tokens of a whole Arrow batch would be millions of Python strings.
ENCODE_ROWS = 512
# Terms whose slots a Python worker keeps.
MEMO_TERMS = 200_000
# Bytes of input for each partition that vectors are summed in.
SUM_BYTES = 8 << 20
# An estimate of the size may be far too high, as it multiplies over joins.
MAX_PARTS = 4_096


class HashingEncoder:
    """Signed hashing of terms into ``dim`` buckets.

    bucket = first 8 hex digits of md5(term) as an integer, modulo ``dim``;
    sign   = +1 when the 9th hex digit is even, else -1.
    """

    tokens_input = True

    def __init__(self, dim: int = 384):
        self.dim = dim
        self._memo: dict[str, tuple[int, float]] = {}

    def _slot(self, term: str) -> tuple[int, float]:
        hit = self._memo.get(term)
        if hit is None:
            h = hashlib.md5(term.encode("utf-8")).hexdigest()
            hit = (int(h[:8], 16) % self.dim, 1.0 if int(h[8], 16) % 2 == 0 else -1.0)
            if len(self._memo) >= MEMO_TERMS:
                self._memo.clear()
            self._memo[term] = hit
        return hit

    def encode(self, token_lists) -> list:
        out = []
        for toks in token_lists:
            if toks is None or len(toks) == 0:
                out.append(None)
                continue
            vec = np.zeros(self.dim, dtype=np.float64)
            for term, tf in Counter(toks).items():
                b, s = self._slot(term)
                vec[b] += s * (1.0 + math.log(tf))
            norm = math.sqrt(float(vec @ vec))
            out.append(None if norm == 0.0 else (vec / norm).astype(np.float32))
        return out


def _encoder_udf(encoder):
    @F.arrow_udf(VECTOR_TYPE)
    def encode(col: pa.Array) -> pa.Array:
        parts = [_vectors(encoder.encode(col.slice(at, ENCODE_ROWS).to_pylist()))
                 for at in range(0, len(col), ENCODE_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))
    return encode


def _vectors(vectors) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, dtype=np.float32) for v in vectors], pa.list_(pa.float32()))


def embed(df: DataFrame, text: Column | str, encoder=None,
          out_col: str = "embedding") -> DataFrame:
    """Append ``out_col`` (array<float>) computed from ``text`` by ``encoder`` (M1)."""
    encoder = encoder or HashingEncoder()
    src = F.col(text) if isinstance(text, str) else text
    arg = tokenize(src) if getattr(encoder, "tokens_input", False) else src
    return df.withColumn(out_col, _encoder_udf(encoder)(arg))


def text_key(text: Column | str) -> Column:
    """Cache key of a text: SHA-256 of its UTF-8 bytes."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def cache_misses(df: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """Distinct texts of ``df`` whose vector is not cached (J6, q28)."""
    keys = df.select(text_key(text).alias("text_hash"), F.col(text).alias("text")) \
        .dropDuplicates(["text_hash"])
    return keys.join(cache.select("text_hash"), "text_hash", "left_anti")


def embed_cached(df: DataFrame, text: str, cache: DataFrame | None, encoder=None,
                 model: str = "hashing", out_col: str = "embedding"
                 ) -> tuple[DataFrame, DataFrame]:
    """Vectors for ``df[text]`` reusing ``cache``; returns (result, new cache rows) (M2).

    Only distinct texts missing from the cache are encoded; ``new_rows`` is
    what to append to the cache table (K2).
    """
    encoder = encoder or HashingEncoder()
    if cache is None:
        cache = df.sparkSession.createDataFrame([], CACHE_SCHEMA)
    cache = cache.filter(F.col("model") == model)
    misses = cache_misses(df, text, cache)
    new_rows = embed(misses, "text", encoder, "embedding").select(
        "text_hash", "text", F.lit(model).alias("model"), "embedding")
    known = cache.select("text_hash", "embedding").unionByName(
        new_rows.select("text_hash", "embedding"))
    out = (df.withColumn("_text_hash", text_key(text))
           .join(known.withColumnRenamed("text_hash", "_text_hash")
                 .withColumnRenamed("embedding", out_col), "_text_hash", "left")
           .drop("_text_hash"))
    return out, new_rows


CACHE_SCHEMA = T.StructType([
    T.StructField("text_hash", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("model", T.StringType(), False),
    T.StructField("embedding", VECTOR_TYPE, True),
])


def hash_embed_sparse(df: DataFrame, id_col: str, text: Column | str, dim: int = 384
                      ) -> DataFrame:
    """The ``HashingEncoder`` computed JVM-side, in sparse form: (id, bucket,
    weight) for every bucket hit by at least one term of a row with tokens,
    weights already divided by the row's L2 norm (float32 values).

    Bucket and sign come from ``md5`` in SQL. Terms are counted within the row;
    what is exchanged, once, by id, is (id, bucket, weight), never a text or a
    term. The bucket sums and the norm (a window over the same id) share that
    partitioning, and every group is bounded by one row's terms. No tokens move
    into Python workers.
    """
    src = F.col(text) if isinstance(text, str) else text
    h = F.md5(F.col("term"))
    bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sign = F.when(F.pmod(F.conv(F.substring(h, 9, 1), 16, 10).cast("int"), F.lit(2)) == 0,
                  F.lit(1.0)).otherwise(F.lit(-1.0))
    # A number of partitions by the input's size: joined to fewer, one task would sum vectors of many documents.
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(df.sparkSession.sparkContext.defaultParallelism, min(MAX_PARTS, math.ceil(size / SUM_BYTES)))
    tf = counted_terms(spread_scan(df).select(F.col(id_col).alias("_id"), tokenize(src).alias("_tokens")),
                       "_tokens", "_id")
    w = (tf.select("_id", bucket.alias("bucket"),
                   (sign * (F.lit(1.0) + F.log(F.col("tf")))).alias("w"))
         .repartition(parts, "_id").groupBy("_id", "bucket").agg(F.sum("w").alias("w")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("_id")))
    return (w.withColumn("norm", norm).filter(F.col("norm") > 0)
            .select(F.col("_id").alias(id_col), "bucket",
                    (F.col("w") / F.col("norm")).cast("float").alias("weight")))


def hash_embed(df: DataFrame, id_col: str, text: Column | str, dim: int = 384,
               out_col: str = "embedding") -> DataFrame:
    """Dense ``array<float>`` form of ``hash_embed_sparse`` (same vectors as
    the Python ``HashingEncoder``); rows without tokens are absent."""
    sparse = hash_embed_sparse(df, id_col, text, dim)
    # The zeros before each bucket and its weight, by bucket, then those after the last: linear in ``dim``, where
    # a lookup of every bucket in a map is ``dim`` times the row's terms.
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))
    per = sparse.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("_held"))
    before = F.concat(F.array(F.lit(-1)), F.col("_held.bucket"))
    spans = F.zip_with(F.col("_held"), F.slice(before, F.lit(1), F.size("_held")), lambda e, b: F.concat(
        zeros(e["bucket"] - b - 1), F.array(e["weight"])))
    dense = F.concat(F.flatten(spans), zeros(F.lit(dim - 1) - F.element_at("_held.bucket", -1)))
    return per.select(id_col, dense.alias(out_col))
