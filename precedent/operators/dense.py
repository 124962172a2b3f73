"""Dense (cosine) retrieval: per-query top-k over a vector corpus.

Plan
* A small query set (at most ``max_broadcast_bytes``: rows x dim x 8 bytes) is
  collected with a ``limit`` of one row more as the size check and broadcast as
  one float64 matrix (one job).
* A larger one never reaches the driver: queries and corpus are cut in blocks of
  four times that size (and in enough blocks to give every core some cells) and
  meet in a grid of cells by an equi-join key. A cell multiplies its two blocks
  and keeps the best ``k`` per query, so the shuffle carries each vector once per
  block of the other side, and k rows per query and cell.
* The width searched is the common one (or ``dim``); ``width_rejects`` lists
  the rows of any other width.
* With the broadcast the corpus is never shuffled: ``mapInArrow`` scans its
  partitions where they are, turns each Arrow batch into a matrix without
  per-row Python, multiplies it with the query block (BLAS), and keeps only
  the best candidates per query in a buffer that is reduced as it grows.
  A task therefore emits at most about ``k`` rows per query (plus exact
  ties), never the query x corpus pairs.
* The global top-k is a ``row_number`` window whose partial group limit
  runs before the shuffle (see ``ranking``).

Candidates are found with a product in float32, lowered by its error bound, and
scored as exact cosines in float64. What a pair may still reach is bounded by the
query's best ``k`` so far, so that few pairs pass after the first rows. Zero or
wrongly sized vectors get no score and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.operators.ranking import top_k
from precedent.schema import RetrievalParams

# A broadcast matrix is held by every Python worker of an executor.
DEFAULT_MAX_BROADCAST_BYTES = 32 << 20
# Bytes of a block of the grid, as a multiple of what may be broadcast.
GRID_BLOCK = 4
# Queries and corpus rows multiplied at a time (bounds the score block).
QUERY_BLOCK = 1024
DOC_BLOCK = 4096
# Pairs scored in float64 at a time.
EXACT_PAIRS = 16_384
# Cells of a grid for each core. Blocks are dealt by a hash, so cells are even; each more sends every row to more cells.
CELLS_PER_CORE = 2

_ARROW_TYPES = {
    T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
    T.ShortType: pa.int16(), T.ByteType: pa.int8(),
}


def _arrow_type(dt: T.DataType) -> pa.DataType:
    for spark_type, arrow_type in _ARROW_TYPES.items():
        if isinstance(dt, spark_type):
            return arrow_type
    raise TypeError(f"unsupported id type {dt}")


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, valid mask) from a list<float|double> column; invalid = NULL or size != dim."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    valid = lens == dim
    if not valid.any():
        return np.zeros((0, dim)), valid
    sub = col.filter(pa.array(valid))
    flat = pc.fill_null(sub.flatten(), 0.0).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(-1, dim), valid


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    nz = norms > 0
    return m[nz] / norms[nz, None], nz


def _keep_best(qi, ids, s, r, k, tol):
    """Per query index keep every candidate whose rounded score can reach the top k."""
    if len(qi) == 0:
        return qi, ids, s, r
    order = np.lexsort((-r, qi))
    qi, ids, s, r = qi[order], ids[order], s[order], r[order]
    start = np.r_[True, qi[1:] != qi[:-1]]
    starts = np.flatnonzero(start)
    grp = np.cumsum(start) - 1
    sizes = np.diff(np.r_[starts, len(qi)])
    kth = np.where(sizes >= k, r[np.minimum(starts + k - 1, len(qi) - 1)], -np.inf)
    keep = r >= kth[grp] - tol
    qi, ids, s, r = qi[keep], ids[keep], s[keep], r[keep]
    if len(qi) > 2 * k * len(starts):
        # Many exact ties (duplicate vectors): among candidates with the same
        # query and the same raw score only the k smallest ids can be ranked,
        # so the buffer stays bounded by k per distinct score.
        f = pd.DataFrame({"qi": qi, "s": s, "id": ids, "r": r})
        f = f.sort_values(["qi", "s", "id"], ascending=[True, False, True], kind="mergesort")
        f = f.groupby(["qi", "s"], sort=False).head(k)
        qi, ids = f["qi"].to_numpy(), f["id"].to_numpy()
        s, r = f["s"].to_numpy(), f["r"].to_numpy()
    return qi, ids, s, r


def _first_copies(m: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Rows left of equal vectors: those with the ``n`` smallest ids (null first) of each; others cannot be ranked,
    as their scores are equal."""
    rows = np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel()
    _, code = np.unique(rows, return_inverse=True)
    if code.max() + 1 > len(code) // 2:
        return np.arange(len(ids))
    f = pd.DataFrame({"code": code, "id": ids}).sort_values(["code", "id"], kind="mergesort", na_position="first")
    last = f.shift()
    other = (f["id"] != last["id"]) & ~(f["id"].isna() & last["id"].isna())
    nth = (other | (f["code"] != last["code"])).groupby(f["code"]).cumsum()
    return np.sort(f.index[nth <= n].to_numpy())


def _exact(q: np.ndarray, m: np.ndarray, qi: np.ndarray, di: np.ndarray) -> np.ndarray:
    """Cosines of the pairs in float64."""
    s = np.empty(len(qi))
    for a in range(0, len(qi), EXACT_PAIRS):
        b = a + EXACT_PAIRS
        s[a:b] = np.einsum("ij,ij->i", q[qi[a:b]], m[di[a:b]])
    return s


def _scan_fn(bc, k: int, digits: int, min_score: float | None, exclude_self: bool,
             grouped: bool, q_arrow: pa.DataType, d_arrow: pa.DataType):
    tol = 2.0 * 10.0 ** (-digits)

    def fn(batches):
        payload = bc.value
        qmat, qids, dim = payload["mat"], payload["ids"], payload["dim"]
        qgrp, gcode, idpos = payload["grp"], payload["gcode"], payload["idpos"]
        nq = qmat.shape[0]
        # Error of a float32 product of two unit vectors.
        margin = np.float32(2.0 * (dim + 2) * np.finfo(np.float32).eps + tol)
        q32 = qmat.astype(np.float32)
        # What a query's k-th best score is at least.
        least = -np.inf if min_score is None else min_score
        floor = np.full(nq, least)
        members = {}
        if grouped:
            order = np.argsort(qgrp, kind="stable")
            cuts = np.flatnonzero(np.diff(qgrp[order])) + 1
            members = {int(qgrp[part[0]]): part for part in np.split(order, cuts) if len(part)}
        buf = ([], [], [], [])
        held, limit = 0, 0

        def best():
            """The buffer reduced to what can be ranked; the floors raised to each query's k-th."""
            nonlocal buf, held, limit
            qi, ids, s, r = _keep_best(*(np.concatenate(b) for b in buf), k, tol)
            buf, held = tuple([p] for p in (qi, ids, s, r)), len(qi)
            limit = 2 * held + 10_000
            order = np.lexsort((-r, qi))
            first = np.flatnonzero(np.r_[True, qi[order][1:] != qi[order][:-1]])
            full = np.diff(np.r_[first, held]) >= k
            kth = order[first[full] + k - 1]
            floor[qi[kth]] = np.maximum(floor[qi[kth]], r[kth] - tol)

        def meet(rows, m, m32, ids, self_pos):
            """Candidates among the queries ``rows`` (positions) and a block of the corpus."""
            nonlocal held
            for a in range(0, len(rows), QUERY_BLOCK):
                at = rows[a:a + QUERY_BLOCK]
                s = q32[at] @ m32.T
                if exclude_self:
                    place = np.full(nq + 1, -1)
                    place[at] = np.arange(len(at))
                    cols = np.flatnonzero(place[self_pos] >= 0)
                    s[place[self_pos[cols]], cols] = -np.inf
                low = floor[at]
                new = np.flatnonzero(low <= least)
                if len(new) and len(ids) >= k:
                    kth = np.partition(s[new], len(ids) - k, axis=1)[:, len(ids) - k] - margin
                    low[new] = np.maximum(least, kth)
                # Never as low as minus infinity, the score of a row's own id.
                low = np.maximum(low - margin, np.finfo(np.float32).min).astype(np.float32)
                pairs = np.flatnonzero(s >= low[:, None])
                if len(pairs) == 0:
                    continue
                qi, di = np.divmod(pairs, s.shape[1])
                qi = at[qi]
                score = _exact(qmat, m, qi, di)
                if min_score is not None:
                    on = score >= min_score
                    qi, di, score = qi[on], di[on], score[on]
                parts = (qi, ids[di], score, np.round(score, digits))
                if len(qi) > 4 * k * len(at):
                    parts = _keep_best(*parts, k, tol)  # many exact ties in this block
                for b, part in zip(buf, parts):
                    b.append(part)
                held += len(parts[0])

        for rb in batches:
            if nq == 0 or rb.num_rows == 0:
                continue
            for at in range(0, rb.num_rows, DOC_BLOCK):
                part = rb.slice(at, DOC_BLOCK)
                m, valid = _matrix(part.column(1), dim)
                if len(m) == 0:
                    continue
                m, nz = _unit(m)
                ids = part.column(0).to_numpy(zero_copy_only=False)[valid][nz]
                if len(ids) == 0:
                    continue
                dcode = np.zeros(len(ids), dtype=np.int64)
                if grouped:
                    dcode = gcode.get_indexer(part.column(2).to_numpy(zero_copy_only=False)[valid][nz]).astype(np.int64)
                # Position of each corpus id among the query ids, nq if absent.
                self_pos = np.full(len(ids), nq)
                if exclude_self:
                    found = idpos.get_indexer(ids)
                    self_pos[found >= 0] = found[found >= 0]
                for code, rows in (members.items() if grouped else [(-1, np.arange(nq))]):
                    # A query without a group meets every row, one with a group the rows of that group.
                    on = np.flatnonzero(dcode == code) if code >= 0 else np.arange(len(ids))
                    if len(on) == 0:
                        continue
                    on = on[_first_copies(m[on], ids[on], k + 1)]
                    meet(rows, m[on], m[on].astype(np.float32), ids[on], self_pos[on])
                if held > limit:
                    best()
        if held == 0:
            return
        qi, ids, s, _ = _keep_best(*(np.concatenate(b) for b in buf), k, tol)
        yield pa.RecordBatch.from_arrays(
            [pa.array(qids[qi], type=q_arrow), pa.array(ids, type=d_arrow),
             pa.array(s, type=pa.float64())],
            names=["query_id", "doc_id", "score"])

    return fn


def _payload(rows: pa.Table, dim: int, grouped: bool, exclude_self: bool) -> dict:
    m, valid = _matrix(rows.column("qv"), dim)
    ids = rows.column("qid").to_numpy(zero_copy_only=False)[valid]
    m, nz = _unit(m)
    ids = ids[nz]
    # One row per query id (the first): a repeated id would rank twice.
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)
    if len(keep) < len(ids):
        sel = np.flatnonzero(valid)[nz][keep]
        m, ids = m[keep], ids[keep]
    else:
        sel = np.flatnonzero(valid)[nz]
    # Hash indexes (vectorised lookups in the tasks): group value -> code,
    # query id -> row. NULL groups keep code -1 (no filter).
    qgrp = np.full(len(ids), -1, dtype=np.int64)
    gcode = pd.Index([], dtype=object)
    if grouped:
        g = pd.Series(rows.column("qg").to_numpy(zero_copy_only=False)[sel], dtype=object)
        codes, uniques = pd.factorize(g, use_na_sentinel=True)
        qgrp = codes.astype(np.int64)
        gcode = pd.Index(uniques, dtype=object)
    idpos = pd.Index(ids) if exclude_self else pd.Index([])
    return {"mat": np.ascontiguousarray(m), "ids": ids, "dim": dim, "grp": qgrp,
            "gcode": gcode, "idpos": idpos}


def dense_candidates(queries: DataFrame, corpus: DataFrame, k: int, *,
                     query_id: str, q_vec: str, doc_id: str, d_vec: str,
                     query_group: str | None = None, doc_group: str | None = None,
                     exclude_self: bool = False, min_score: float | None = None,
                     dim: int | None = None, digits: int = 9,
                     max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """(query_id, doc_id, score): per corpus task, the best-``k`` candidates per query."""
    spark = queries.sparkSession
    grouped = query_group is not None
    if grouped and doc_group is None:
        raise ValueError("doc_group is required with query_group")
    qcols = [F.col(query_id).alias("qid"), F.col(q_vec).alias("qv")]
    if grouped:
        qcols.append(F.col(query_group).cast("string").alias("qg"))
    qsel = queries.select(*qcols)
    # One bounded job in the common case: at most max_rows + 1 query rows are
    # collected (the limit guards the driver); only a larger query set pays a
    # count and is processed in chunks.
    dim = dim or common_width(queries, q_vec)
    max_rows = max(1, max_broadcast_bytes // (8 * max(dim, 1)))
    first = qsel.limit(max_rows + 1).toArrow()
    q_arrow = _arrow_type(queries.schema[query_id].dataType)
    d_arrow = _arrow_type(corpus.schema[doc_id].dataType)
    out_schema = T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType),
        T.StructField("doc_id", corpus.schema[doc_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    dcols = [F.col(doc_id), F.col(d_vec)]
    if grouped:
        dcols.append(F.col(doc_group).cast("string"))
    scan = corpus.select(*dcols)
    if first.num_rows <= max_rows:
        bc = spark.sparkContext.broadcast(_payload(first, dim, grouped, exclude_self))
        return scan.mapInArrow(_scan_fn(bc, k, digits, min_score, exclude_self, grouped, q_arrow,
                                        d_arrow), out_schema)

    # More queries than may be broadcast: a grid of query blocks by corpus blocks. Each block
    # goes to the cells of its row or column by an equi-join key, and each cell keeps the best k.
    # Enough blocks that every core has some cells to work on, and no more: each sends all rows of the other side again.
    cells = CELLS_PER_CORE * spark.sparkContext.defaultParallelism
    wide = grid_width(cells, math.sqrt(cells))

    def blocks(df, id_col, least):
        n = max(least, math.ceil(df.count() / (GRID_BLOCK * max_rows)))
        return n, F.pmod(F.xxhash64(id_col), F.lit(n))

    dnames = ["did", "dv", "dg"][:len(dcols)]
    docs = scan.toDF(*dnames)
    n_q, q_block = blocks(qsel, "qid", wide)
    n_d, d_block = blocks(docs, "did", cells // wide)
    key = cell_keys(spark, n_q * n_d)
    left = qsel.withColumn("_cell", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(n_d - 1)), lambda d: key(q_block * n_d + d))))
    right = docs.withColumn("_cell", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(n_q - 1)), lambda q: key(q * n_d + d_block))))

    def cell(left_rows, right_rows):
        payload = SimpleNamespace(value=_payload(left_rows, dim, grouped, exclude_self))
        fn = _scan_fn(payload, k, digits, min_score, exclude_self, grouped, q_arrow, d_arrow)
        found = list(fn(right_rows.select(dnames).to_batches(max_chunksize=10_000)))
        schema = pa.schema([("query_id", q_arrow), ("doc_id", d_arrow), ("score", pa.float64())])
        return pa.Table.from_batches(found, schema=schema)

    cells = n_q * n_d
    return (left.repartition(cells, "_cell").groupBy("_cell")
            .cogroup(right.repartition(cells, "_cell").groupBy("_cell")).applyInArrow(cell, out_schema))


def grid_width(cells: int, wanted: float) -> int:
    """The divisor of ``cells`` next to ``wanted`` (the larger one on a tie): a grid of that width has just as many
    cells, so that the last of them do not keep a few cores busy while the others wait."""
    fits = [d for d in range(1, cells + 1) if cells % d == 0]
    return min(fits, key=lambda d: (round(abs(math.log(d / wanted)), 9), -d))


def cell_keys(spark: SparkSession, n: int) -> Callable[[Column], Column]:
    """From a cell's number (0 to ``n`` - 1) to its key: keys that ``repartition(n, key)`` deals to ``n`` different
    partitions. Numbers themselves share partitions, so that one task gets several cells and others none."""
    at = F.pmod(F.hash("id"), F.lit(n))
    first = spark.range(0, 64 * n, 1, 1).groupBy(at.alias("at")).agg(F.min("id").alias("id")).collect()
    keys = {r["at"]: r["id"] for r in first}
    if len(keys) < n:
        return lambda cell: cell.cast("long")
    held = F.array(*[F.lit(keys[i]).cast("long") for i in range(n)])
    return lambda cell: F.element_at(held, (cell + 1).cast("int"))


def common_width(df: DataFrame, vec: str) -> int:
    """The width that most vectors of ``df`` have (the smaller one on a tie); 0 without vectors."""
    row = (df.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("w")).count()
           .orderBy(F.desc("count"), "w").first())
    return int(row["w"]) if row else 0


def width_rejects(df: DataFrame, id_col: str, vec: str, dim: int) -> DataFrame:
    """``(id, width, reason)`` of the rows that a search of width ``dim`` leaves out."""
    width = F.size(vec)
    return df.where(F.col(vec).isNull() | (width != dim)).select(
        id_col, F.when(F.col(vec).isNotNull(), width).alias("width"),
        F.when(F.col(vec).isNull(), F.lit("no vector")).otherwise(
            F.concat(F.lit(f"width is not {dim}"))).alias("reason"))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, *,
               params: RetrievalParams = RetrievalParams(), **kw) -> DataFrame:
    """(query_id, doc_id, score, rank) cosine top-``k`` per query."""
    kw.setdefault("digits", params.rank_digits)
    if params.min_score is not None:
        kw.setdefault("min_score", params.min_score)
    cands = dense_candidates(queries, corpus, k, **kw)
    return top_k(cands, "query_id", "score", "doc_id", k, digits=params.rank_digits)
