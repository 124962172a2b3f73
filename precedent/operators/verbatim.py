"""Exact containment of passages of any length (A7): a positional gram index, rarest gram first.

A passage is covered by its grams of ``GRAM`` characters at offsets 0, 3, 6, ... and at its end
(a shorter passage is one gram of its own length).  It stands in a document at ``start`` exactly
if each of these grams stands there at ``start`` plus its offset.  So:

1. every document's characters are cut into grams with their positions, in the scan, and only
   grams of some passage's cover are kept (``occurrences``, written once);
2. each passage starts from the places of the gram of its cover that stands least often;
3. the other grams are looked up at the places that follow from it, by (document, place, gram).

No text is joined, shuffled or broadcast.  The hot key is a gram that stands nearly everywhere:
its places are split by a salt of the document, and only such grams' passages are repeated, once
a salt.  Equal passages are searched once.  The lookup's key holds document and place, so no key
of it is hot.

Few passages (``SCAN_PASSAGES`` distinct texts of ``SCAN_BYTES`` in all) need no index: short ones stand nearly
everywhere, and their places are far more than the text. They are broadcast and looked for in every text where
it lies; a document's finds are one bit a passage, joined by document with ``bit_or``.

Defined results: null and empty passages and texts hold nothing and stand nowhere; rows that
share an id are searched each, and give one pair; a null id is kept as null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.operators.sizing import DEFAULT_BROADCAST_ROWS, maybe_broadcast
from precedent.session import materialize

GRAM = 3
ROWS_PER_SALT = 1_000_000
# Passages that are looked for in every text, and their bytes.
SCAN_PASSAGES = 2_000
SCAN_BYTES = 1 << 20
# Passages told by one long.
BITS = 63


def _chars(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _at(chars: str, at: Column, size: int) -> Column:
    """``size`` characters from the 0-based place ``at``."""
    return F.array_join(F.slice(F.col(chars), at + 1, size), "")


def covers(passages: DataFrame, ptext: str) -> DataFrame:
    """``(ptext, size, cover)``: each distinct passage with its grams as ``array<struct<gram, off>>``."""
    chars = passages.select(F.col(ptext).alias("ptext")).where("ptext <> ''").distinct().withColumn("c", _chars("ptext"))
    sized = chars.withColumn("n", F.size("c")).withColumn("size", F.least(F.col("n"), F.lit(GRAM)))
    offsets = F.array_union(F.sequence(F.lit(0), F.col("n") - F.col("size"), F.col("size")),
                            F.array(F.col("n") - F.col("size")))
    return sized.select("ptext", "size", F.transform(offsets, lambda i: F.struct(
        F.array_join(F.slice("c", i + 1, F.col("size")), "").alias("gram"), i.alias("off"))).alias("cover"))


def occurrences(docs: DataFrame, did: str, dtext: str, wanted: DataFrame, sizes: list[int],
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``(gram, row, did, pos)``: the places of the ``wanted(gram)`` in every document; ``row`` numbers documents."""
    chars = docs.select(F.col(did).alias("did"), F.monotonically_increasing_id().alias("row"),
                        _chars(dtext).alias("c"))
    grams = None
    for size in sizes:
        last = F.size("c") - size
        # No place at all in a text that is shorter than the gram.
        places = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                               lambda i: _at("c", i, size)))
        one = chars.select("row", "did", F.posexplode(places).alias("pos", "gram"))
        grams = one if grams is None else grams.unionAll(one)
    # A gram has three characters at most, so rows bound the bytes of what is broadcast.
    return grams.join(maybe_broadcast(wanted, broadcast_rows).df, "gram").select("gram", "row", "did", "pos")


def _holds(bc, rows_at_once: int = 512):
    def fn(batches):
        passages = bc.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                words = []
                for text in part.column(1).to_pylist():
                    held = [0] * -(-len(passages) // BITS)
                    for i, passage in enumerate(passages):
                        if passage in text:
                            held[i // BITS] |= 1 << (i % BITS)
                    words.append(held)
                columns = [pa.array(w, pa.int64()) for w in zip(*words)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns],
                                                 names=["did", *[f"w{i}" for i in range(len(columns))]])
    return fn


def scanned_truth(passages: DataFrame, pid: str, ptext: str, texts: list[str], docs: DataFrame, did: str,
                  dtext: str) -> DataFrame:
    """``verbatim_truth`` for the few distinct ``texts``: each is looked for in every document."""
    spark = docs.sparkSession
    bc = spark.sparkContext.broadcast(texts)
    words = [f"w{i}" for i in range(-(-len(texts) // BITS))]
    body = docs.select(F.col(did).alias("did"), F.col(dtext).alias("dtext")).where("dtext is not null")
    found = body.mapInArrow(_holds(bc), T.StructType([T.StructField("did", docs.schema[did].dataType),
                                                      *[T.StructField(w, T.LongType()) for w in words]]))
    found = materialize(found.where(" or ".join(f"{w} <> 0" for w in words)), "verbatim-found")
    per = found.groupBy("did").agg(*[F.bit_or(w).alias(w) for w in words])
    pairs = per.select("did", F.explode(F.expr(
        f"filter(sequence(0, {len(texts) - 1}), i -> getbit(array({', '.join(words)})[cast(i div {BITS} as int)], "
        f"i % {BITS}) = 1)")).alias("nth"))
    numbers = spark.createDataFrame(list(enumerate(texts)), "nth int, ptext string")
    own, m = materialize(passages.select(F.col(pid).alias("_pid"), F.col(ptext).alias("ptext"))
                         .join(F.broadcast(numbers), "ptext").select("_pid", "nth").distinct(), "verbatim-passages",
                         {"n": F.count(F.lit(1))})
    # A document is told once for each text, so only a passage id with several texts can give a pair twice.
    several = own.groupBy("_pid").count().where("count > 1").limit(1).count()
    out = pairs.join(F.broadcast(own) if m["n"] <= DEFAULT_BROADCAST_ROWS else own, "nth").select(
        F.col("_pid").alias(pid), F.col("did").alias(did))
    return out.distinct() if several else out


def verbatim_truth(passages: DataFrame, pid: str, ptext: str, docs: DataFrame, did: str, dtext: str,
                   rows_per_salt: int = ROWS_PER_SALT,
                   broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``(pid, did)`` wherever the document's text holds the passage, of any length and any characters."""
    distinct = passages.select(F.col(ptext).alias("ptext")).where("ptext <> ''").distinct()
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("ptext")).alias("bytes")).first()
    if 0 < size["n"] <= min(SCAN_PASSAGES, broadcast_rows) and size["bytes"] <= SCAN_BYTES:
        texts = sorted(r["ptext"] for r in distinct.collect())
        return scanned_truth(passages, pid, ptext, texts, docs, did, dtext)
    cover = materialize(covers(passages, ptext), "verbatim-covers")
    sizes = sorted(r["size"] for r in cover.select("size").distinct().collect())        # GRAM values at most
    if not sizes:
        return passages.select(pid).join(docs.select(did).limit(0), F.lit(False))
    grams = cover.select("ptext", F.explode("cover").alias("g")).select("ptext", "g.gram", "g.off")
    # Row numbers are fixed by the written table; a passage has grams of one size, so its rows are numbered alike.
    numbered = materialize(occurrences(docs, did, dtext, grams.select("gram").distinct(), sizes, broadcast_rows),
                           "verbatim-places")
    counts = materialize(numbered.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).withColumn(
        "salts", F.ceil(F.col("held") / rows_per_salt).cast("int")), "verbatim-counts")
    # A passage with a gram that stands nowhere goes.
    rarest = (grams.join(counts, "gram", "left").groupBy("ptext")
              .agg(F.min_by(F.struct("gram", "off", "salts"), F.struct(F.coalesce("held", F.lit(0)), "off")).alias("r"))
              .where("r.salts is not null").select("ptext", "r.gram", "r.off", "r.salts"))
    start = rarest.join(cover.select("ptext", "cover"), "ptext").select(
        "ptext", "gram", "off", F.filter("cover", lambda g: g["off"] != F.col("off")).alias("rest"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = numbered.join(maybe_broadcast(counts.select("gram", "salts"), broadcast_rows).df, "gram").withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    found = salted.join(start, ["gram", "salt"]).select(
        "ptext", "row", "did", (F.col("pos") - F.col("off")).alias("start"), "rest").where("start >= 0")
    whole = found.where(F.size("rest") == 0).select("ptext", "did")
    asked = found.where(F.size("rest") > 0).select(
        "ptext", "row", "did", "start", F.size("rest").alias("asked"), F.explode("rest").alias("g")).select(
        "ptext", "row", "did", "start", "asked", F.col("g.gram").alias("gram"),
        (F.col("start") + F.col("g.off")).alias("pos"))
    held = (asked.join(numbered.select("row", "pos", "gram"), ["row", "pos", "gram"])
            .groupBy("ptext", "row", "did", "start", "asked").agg(F.count(F.lit(1)).alias("there"))
            .where("there = asked").select("ptext", "did"))
    pairs = whole.unionAll(held).distinct()
    return (passages.select(F.col(pid).alias("_pid"), F.col(ptext).alias("ptext")).join(pairs, "ptext")
            .select(F.col("_pid").alias(pid), F.col("did").alias(did)).distinct())
