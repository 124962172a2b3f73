"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents fall into blocks (a hash prefix of the document id).
A source's target, in words, is cut into draws of its permuted blocks: whole
passes over all blocks first, then the permuted blocks up to the target, the
last of them in part.  The draws are dealt to the output shards by a binary
tree: at each node the left child takes half of the draws, and how many of
them come from each source is a multivariate-hypergeometric draw (the sources
of a uniformly random half).  That fixes an exact quota of blocks for every
(shard, source); each shard then takes its quota as the next run of the
source's permuted draws, so shards are disjoint.  Every copy has a place in its
shard by a hash of its own (seed, shard, copy, document id); ``mix`` returns shard and
place of each copy, and whoever writes the shards (the pipeline) sorts by them.

Randomness is MD5 of ids and a seed: reruns agree, and so does any other
engine.  All of it is DataFrame code; documents are read once, and what moves
are narrow rows.  A source may hold any share of all rows: it is cut into
4,096 blocks, sums are taken per block before anything is ordered, and
running totals go by bucket (``prefix_sum``), so no task gathers a source.

Defined results: null text has size 0; null source is a source of its own,
after all others; rows with a null ``doc_id`` are dealt to
blocks by their text's hash (or row number); repeated rows are each a document; empty table gives no rows; other columns,
whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from precedent.llm.common import WORD_RE, materialize, prefix_sum

#: Hex digits of the hash that name a document's block: 16 ** 3 blocks for each source.
BLOCK_DIGITS = 3
SHARD_LEVELS = 3
MAX_REPEATS = 3


def _md5(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string")
                                    for p in parts]))


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(src, no_src, source_size, weight, target)`` from per-document sizes.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  The
    resharing until nothing is above its limit has one end: target =
    min(limit, level * weight).  Sources are taken in the order of limit /
    weight; those before the level stop at their limit.  One narrow row per
    source, so the windows over all of them stay small."""
    per = sizes.groupBy("src", "no_src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("no_src", "src")
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    per = per.withColumn("limit", F.lit(float(max_repeats)) * F.col("source_size"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "no_src", "src")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(Window.partitionBy()) - F.coalesce(
        F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source in this order that its limit does not stop gives the level of all after it.
    per = per.withColumn("try", F.when(level * F.col("weight") <= F.col("limit"), level))
    # Later sources give a lower level, as those before them are taken at their limit.
    per = per.withColumn("level", F.max("try").over(Window.partitionBy()))
    return per.select("src", "no_src", "source_size", "weight",
                      F.least(F.col("limit"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
                      .alias("target"))


def block_draws(sizes: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """``(src, no_src, block, words, passes, rest)``: whole passes over the block, and the words
    that a last, partial pass takes from it."""
    blocks = sizes.groupBy("src", "no_src", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("perm", _md5(seed, "block", F.col("src"), F.col("block")))
    blocks = prefix_sum(blocks, ["src", "no_src"], F.substring("perm", 1, 2),
                        [F.col("perm"), F.col("block")], "words", "before")
    want = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0)
    t = targets.select("src", "no_src", "source_size", "target", whole.cast("long").alias("passes"),
                       (want - whole * F.col("source_size")).cast("long").alias("remain"))
    return (blocks.join(t, ["src", "no_src"])
            .withColumn("rest", F.greatest(F.lit(0), F.least("words", F.col("remain") - F.col("before"))))
            .drop("before", "remain"))


def splitting_tree(draws: DataFrame, levels: int, seed: str) -> DataFrame:
    """``(src, no_src, shard, quota)`` for draws with columns ``src, no_src, token``.

    Each level orders a node's tokens by a fresh hash and sends the first half
    left: the numbers per source on either side are then a multivariate
    hypergeometric draw.  Ranks come from running totals by bucket."""
    node = draws.withColumn("node", F.lit(0)).withColumn("one", F.lit(1))
    for level in range(levels):
        node = node.withColumn("key", _md5(seed, "tree", F.lit(level), F.col("src"), F.col("token")))
        node = prefix_sum(node, ["node"], F.substring("key", 1, 2),
                          [F.col("key"), F.col("no_src"), F.col("src"), F.col("token")], "one", "rank", "n")
        node = node.withColumn("node", F.col("node") * 2 + F.when(F.col("rank") * 2 < F.col("n"), 0).otherwise(1))
        node = materialize(node.drop("n", "rank", "key"), "mix-tree")       # the next level reads it twice
    return node.groupBy("src", "no_src", F.col("node").alias("shard")).agg(
        F.sum("one").alias("quota"))


def mix(docs: DataFrame, seed: str = "mix", levels: int = SHARD_LEVELS, row: str | None = None) -> DataFrame:
    """One row per document: ``doc_id`` (and ``row``, a unique number of the row, if it is named), ``size, source_size, target, taken, repeats`` (whole
    copies taken), ``part`` (words of a further, partial copy), ``shards`` (the shard of
    each whole or partial copy, in order) and ``places`` (the shard of each copy and its place in it)."""
    own = ["doc_id", row] if row else ["doc_id"]
    # Rows without an id are told apart by their number or, without one, by their text.
    no_id = F.concat(F.lit("null:"), F.col(row).cast("string") if row else F.md5(F.coalesce("text", F.lit(""))))
    name = F.coalesce(F.col("doc_id").cast("string"), no_id)
    sizes = docs.select(
        *own, F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
        _md5(seed, "doc", name).alias("key"))
    sizes = sizes.withColumn("block", F.substring("key", 1, BLOCK_DIGITS))
    # Text is read once; all later steps read these narrow rows.
    sizes = materialize(sizes, "mix-sizes")
    targets = materialize(source_targets(sizes).coalesce(1), "mix-targets")
    blocks = materialize(block_draws(sizes, targets, seed), "mix-blocks")

    # One token per draw of a block: its whole passes, and its partial pass if it has one.
    n_draws = (F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int")
    draws = (blocks.where((F.col("words") > 0) & (n_draws > 0))
             .select("src", "no_src", "block", "perm", F.explode(F.sequence(F.lit(1), n_draws)).alias("nth"))
             .withColumn("token", F.concat("block", F.lit("/"), F.col("nth"))))
    draws = materialize(draws, "mix-draws")
    quotas = splitting_tree(draws.select("src", "no_src", "token"), levels, seed)
    ends = Window.partitionBy("src", "no_src").orderBy("shard")
    quotas = quotas.withColumn("upto", F.sum("quota").over(
        ends.rowsBetween(Window.unboundedPreceding, 0)))
    quotas = quotas.groupBy("src", "no_src").agg(
        F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("quotas"))   # 2 ** levels at most
    # The source's draws in permuted order (pass by pass) go to the shards by quota.
    draws = prefix_sum(draws.withColumn("one", F.lit(1)), ["src", "no_src"],
                       F.concat(F.col("nth").cast("string"), F.substring("perm", 1, 2)),
                       [F.col("nth"), F.col("perm"), F.col("block")], "one", "rank")
    shard = F.expr("filter(quotas, q -> q.upto > rank)[0].shard")
    shards = (draws.join(quotas, ["src", "no_src"]).withColumn("shard", shard)
              .groupBy("src", "no_src", "block")
              .agg(F.sort_array(F.collect_list(F.struct("nth", "shard"))).alias("s"))    # 4 at most
              .select("src", "no_src", "block", F.expr("transform(s, x -> x.shard)").alias("shards")))
    blocks = blocks.join(shards, ["src", "no_src", "block"], "left").drop("perm", "words")

    # Within a block documents are taken in the order of their hash; the last one in part.
    inner = (Window.partitionBy("src", "no_src", "block").orderBy("key", "size", *own)
             .rowsBetween(Window.unboundedPreceding, -1))
    rows = sizes.join(blocks, ["src", "no_src", "block"]).withColumn(
        "before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))).cast("long")
    rows = rows.withColumn("part", part)
    n_here = (F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    rows = rows.withColumn("shards", F.slice(F.coalesce("shards", F.array().cast("array<int>")), 1, n_here))
    places = F.transform("shards", lambda shard, nth: F.struct(shard.alias("shard"), _md5(
        seed, "place", shard, nth, F.col("key")).alias("place")))
    return rows.select(
        *own, "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("part")).alias("taken"),
        F.col("passes").alias("repeats"), "part", "shards", places.alias("places"))
