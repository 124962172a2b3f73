"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t.  Vectors are rotated
(one fixed random orthogonal matrix per width) and split into blocks of about eight
dimensions.  If every block's squared distance were above the block's share (in
proportion to its dimensions) of that budget, the total would be too; so each linked
pair is within its share in some block.  Each block is range-joined on its own: a grid
over its first two dimensions, cells as wide as the block's radius, so that partners
stand in the same or a neighbouring cell (each vector goes to its own cell and to the
half of the neighbours that come after it).  Pairs within the share in any block are
the candidates; their union is verified on the whole vectors, in double precision.

Equal vectors of a label are one class with a count before any join, so copies are
never compared with each other.  A cell with many vectors is cut into chunks of about
``CHUNK`` vectors and every two chunks meet in a task of their own: no task grows with
a cell.  Components of the verified links are found on written tables.

Cost: in 64 dimensions of even variance the two grid dimensions prune by a factor of
two only, and the work per label grows with the square of its distinct vectors; the
blocks' shares cut what must be verified to a small multiple of the links.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with null labels, link with nothing: 0 links, their own component;
vectors of different lengths do not link; rows with the same ``vec_id`` are vectors of
their own and share a component id; null ``vec_id`` stays null and never names a
component unless all of it is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import components, materialize, spread

THRESHOLD = 0.93
BLOCK_DIMS = 8
GRID_DIMS = 2
CHUNK = 4_000
#: Slack for single-precision blocks; candidates are verified exactly.
SLACK = 1e-5


def rotation(width: int):
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def blocks_of(width: int, block_dims: int):
    """``[(first, last + 1), ...]`` of near-equal blocks."""
    m = max(1, round(width / block_dims))
    edges = [width * i // m for i in range(m + 1)]
    return list(zip(edges, edges[1:]))


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: valid rows, and distinct vectors per label ``(cid, label, embedding, mult)``."""
    fine = F.expr("label is not null and embedding is not null and size(embedding) > 0 "
                  "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) "
                  "and exists(embedding, x -> x <> 0)")
    members = rows.where(F.coalesce(fine, F.lit(False)))
    classes = members.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("mult"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "emb-classes")
    return members, classes


def candidates(classes: DataFrame, threshold: float, block_dims: int = BLOCK_DIMS,
               grid_dims: int = GRID_DIMS, chunk: int = CHUNK) -> DataFrame:
    """Distinct pairs ``(a, b)`` within the budget share of some block."""
    budget = 2 - 2 * threshold
    schema = pa.schema([("cell", pa.string()), ("home", pa.bool_()), ("cid", pa.int64()),
                        ("sub", pa.list_(pa.float32()))])

    def place(batches):
        import itertools

        import numpy as np

        for batch in batches:
            by_width: dict[int, list] = {}
            for cid, label, vec in zip(*[batch.column(c).to_pylist() for c in ("cid", "label", "embedding")]):
                by_width.setdefault(len(vec), []).append((cid, label, vec))
            for width, rows in by_width.items():
                ids = [r[0] for r in rows]
                x = np.array([r[2] for r in rows], float)
                x = x / np.abs(x).max(1, keepdims=True)        # first, so that squares stay finite
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(width)
                for k, (i, j) in enumerate(blocks_of(width, block_dims)):
                    radius = np.sqrt(budget * (j - i) / width + SLACK)
                    g = min(grid_dims, j - i)
                    cells = np.floor(x[:, i:i + g] / radius).astype(int)
                    sub = x[:, i:j].astype(np.float32)
                    ahead = [d for d in itertools.product((-1, 0, 1), repeat=g) if d >= (0,) * g]
                    flat = pa.array(sub.ravel(), pa.float32())
                    subs = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(rows) + 1) * (j - i), pa.int32()), flat)
                    for d in ahead:
                        names = [f"{r[1]}|{width}|{k}|" + ",".join(map(str, c))
                                 for r, c in zip(rows, (cells + np.array(d)).tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names), pa.array([not any(d)] * len(rows)), pa.array(ids, pa.int64()), subs],
                            schema=schema)

    placed = spread(classes.select("cid", "label", "embedding")).mapInArrow(
        place, "cell string, home boolean, cid long, sub array<float>")
    placed = materialize(placed, "emb-cells")
    # Cells with one home and nobody else have no pair; the rest are cut in chunks.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum(F.col("home").cast("int")).alias("homes")).where("n > 1 and homes > 0")
    cells = cells.select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")
    met = (placed.join(cells, "cell").withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
           .withColumn("task", F.concat_ws("/", "cell", F.least("own", "other"), F.greatest("own", "other")))
           .select("task", "own", "home", "cid", "sub", (F.col("own") == F.col("other")).alias("same")))

    def compare(key, table):
        import numpy as np

        ids = table.column("cid").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        own = table.column("own").to_numpy()
        same = bool(table.column("same")[0].as_py())
        sub = table.column("sub").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        label, width, k, _ = key[0].as_py().split("|")
        i, j = blocks_of(int(width), block_dims)[int(k)]
        share = budget * (j - i) / int(width) + SLACK
        square = (sub * sub).sum(1)
        left, right = [], []
        at = np.flatnonzero(home)
        for s in range(0, len(at), 512):
            part = at[s:s + 512]
            near = square[part, None] + square[None, :] - 2 * (sub[part] @ sub.T) <= share
            near &= ~home[None, :] | (ids[part, None] < ids[None, :])
            if not same:
                near &= own[part, None] != own[None, :]
            a, b = np.nonzero(near)
            left.append(ids[part[a]])
            right.append(ids[b])
        left = np.concatenate(left) if left else np.empty(0, np.int64)
        right = np.concatenate(right) if right else np.empty(0, np.int64)
        return pa.table({"a": np.minimum(left, right), "b": np.maximum(left, right)})

    return met.groupBy("task").applyInArrow(compare, "a long, b long").where("a <> b").distinct()


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, mult_a, mult_b)`` of the pairs whose cosine, in double precision, reaches ``threshold``."""
    one = classes.select(F.col("cid").alias("a"), F.col("embedding").alias("va"), F.col("mult").alias("mult_a"))
    two = classes.select(F.col("cid").alias("b"), F.col("embedding").alias("vb"), F.col("mult").alias("mult_b"))

    def check(batches):
        import numpy as np

        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                va, vb = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, w)
                          for c in ("va", "vb"))
                # A scale of each vector's own leaves the cosine as it is and keeps squares finite.
                va = va / np.abs(va).max(1, keepdims=True)
                vb = vb / np.abs(vb).max(1, keepdims=True)
                cos = (va * vb).sum(1) / np.sqrt((va * va).sum(1) * (vb * vb).sum(1))
                keep = pa.array(cos >= threshold)
                names = ["a", "b", "mult_a", "mult_b"]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in names], names=names)

    joined = (pairs.join(one, "a").join(two, "b").where(F.size("va") == F.size("vb"))
              .withColumn("width", F.size("va")))
    return joined.mapInArrow(check, "a long, b long, mult_a long, mult_b long")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``rows(vec_id, embedding, label)``."""
    rows = rows.select("vec_id", "embedding", "label")
    members, classes = classes_of(rows)
    links = materialize(verified(candidates(classes, threshold, chunk=chunk), classes, threshold), "emb-links")
    sums = links.select("a", F.col("mult_b").alias("m")).unionAll(
        links.select("b", F.col("mult_a").alias("m"))).groupBy(F.col("a").alias("cid")).agg(F.sum("m").alias("others"))
    comp = components(links.select("a", "b"), "emb").select(F.col("id").alias("cid"), F.col("component").alias("root"))
    info = (classes.join(sums, "cid", "left").join(comp, "cid", "left")
            .select("label", "embedding", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                    F.coalesce("root", "cid").alias("root")))
    placed = materialize(members.join(info, ["label", "embedding"]).select("vec_id", "n_links", "root"), "emb-members")
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = placed.join(least, "root").select("vec_id", "n_links", "component_id")
    fine = F.expr("label is not null and embedding is not null and size(embedding) > 0 "
                  "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) "
                  "and exists(embedding, x -> x <> 0)")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
