"""Keyword retrieval: BM25 index (P6, A5) and per-query top-k.

Index layout (long form, one row per distinct (term, doc)):
    postings(term, salt, doc_id, tf, doc_len[, grp])
    terms(term, df, n_salts)
    n_docs, avgdl (scalars)

Scale notes
* Term frequency is counted within each document's row, so postings are made
  in the scan without an exchange and stored clustered by document.
* Frequent terms are hot keys: a term in a third of all documents owns a third
  of all postings. At build time every term gets ``n_salts =
  ceil(df / rows_per_salt)`` (capped), and each of its postings a salt
  ``pmod(xxhash64(doc_id), n_salts)``. A shuffle join on ``(term, salt)``
  therefore splits a hot term over ``n_salts`` tasks; the query side
  replicates only hot terms, ``n_salts`` times.
* When the query terms are few (checked by a count), they are broadcast and
  the postings are only scanned: no shuffle of the index at all.
* Scores are summed with a partial ``HashAggregate`` per ``(query, doc)``
  before their shuffle; the top-k uses a partial group limit (see
  ``ranking``).
* Frequent terms pair nearly every query with nearly every document. Where the
  statistics tell more than ``GRID_PAIRS`` such rows, none of them is made: queries
  and weighted postings meet block by block in a grid of cells, each cell adds the
  postings of a query's terms up in one array of scores and gives the best ``k``
  per query on (``grid_candidates``). The work is the same and exact; what is
  exchanged and held is postings and k rows per query and cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.functions.text import tokenize
from precedent.operators.dense import CELLS_PER_CORE, _arrow_type, _keep_best, cell_keys, grid_width
from precedent.operators.ranking import top_k
from precedent.operators.sizing import DEFAULT_BROADCAST_ROWS, Sized, maybe_broadcast
from precedent.schema import RetrievalParams
from precedent.session import materialize as materialize_table

# Query vocabularies up to this many distinct terms are pushed into the
# postings scan as an IN filter (collected with a limit: bounded).
PUSHDOWN_VOCABULARY = 1024
# Postings per (term, salt) group a task should hold at most.
DEFAULT_ROWS_PER_SALT = 1_000_000
# Bytes of text of a task whose texts are dealt, and of a split that is read as it lies (on average).
DEALT_BYTES = 32 << 20
SPLIT_BYTES = 128 << 20
# Rows of (query term, posting) beyond which a top-k search goes through the grid.
GRID_PAIRS = 10_000_000
# Query terms, and postings, of a block of the grid.
GRID_BLOCK_ROWS = 1_000_000
# A cell holds a term's weights as a row over its documents where more than one in this many hold the term: at most
# this many numbers for each posting of the cell.
GRID_DENSE_SHARE = 16
# Weights of terms up to this many are broadcast to the postings.
GRID_BROADCAST_TERMS = 500_000


@dataclass
class KeywordIndex:
    postings: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: float
    has_group: bool = False
    stop_words: tuple[str, ...] = ()


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def counted_terms(rows: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """``keep`` columns with (term, tf) for every distinct term of a row's ``tokens`` array, counted within the
    row: the sorted tokens' runs, so nothing is exchanged and a text never leaves its scan."""
    held = rows.select(*keep, F.sort_array(tokens).alias("_sorted"))
    # First places of the runs, 1-based, and the place after the last.
    starts = F.filter(F.sequence(F.lit(1), F.size("_sorted")), lambda i: (i == 1) | (
        F.element_at("_sorted", i) != F.element_at("_sorted", F.greatest(i - 1, F.lit(1)))))
    runs = held.select(*keep, "_sorted", F.when(F.size("_sorted") > 0, starts).alias("_starts"))
    nexts = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_sorted") + 1))
    pairs = F.zip_with("_starts", nexts, lambda i, j: F.struct(
        F.element_at("_sorted", i).alias("term"), (j - i).cast("long").alias("tf")))
    # explode_outer and a filter on the term: a plain explode makes the optimizer add a
    # "non-empty array" filter that evaluates the whole tokeniser a second time.
    return (runs.select(*keep, F.explode_outer(pairs).alias("_run")).select(*keep, "_run.term", "_run.tf")
            .where(F.col("term").isNotNull()))


def spread_scan(df: DataFrame, text: Column | str | None = None) -> DataFrame:
    """``df`` dealt round robin when Spark's size estimate says that its scan has fewer splits than there are
    cores, so that a small table in one file is still tokenised by all of them. With ``text`` the bytes of the texts
    are summed: tasks that are dealt get ``DEALT_BYTES`` each, and a scan of more than ``SPLIT_BYTES`` a split is
    dealt too, so that what a task sorts does not grow with the table. Other large tables are not exchanged."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if text is None:
        return df if size >= cores * split else df.repartition(cores)
    held = df.agg(F.sum(F.octet_length(_c(text)))).first()[0] or 0
    if size >= cores * split and held <= SPLIT_BYTES * df.rdd.getNumPartitions():
        return df
    return df.repartition(max(cores, math.ceil(held / DEALT_BYTES)))


def term_postings(docs: DataFrame, doc_id: str, text: Column | str,
                  group: str | None = None, stop_words=None) -> DataFrame:
    """(doc_id, doc_len[, grp], term, tf) for every distinct term of every document.

    Terms are counted within the row (``counted_terms``): neither the text nor
    the postings are exchanged, and the postings come out clustered by
    document as the documents lie in the scan.
    """
    cols = [F.col(doc_id).alias("doc_id"), tokenize(_c(text), stop_words).alias("_tokens")]
    if group:
        cols.append(F.col(group).alias("grp"))
    keys = ["doc_id", "doc_len"] + (["grp"] if group else [])
    rows = spread_scan(docs, text).select(*cols).withColumn("doc_len", F.size("_tokens").cast("long"))
    return counted_terms(rows, "_tokens", *keys)


def term_counts(docs: DataFrame, text: Column | str) -> DataFrame:
    """(term, n) occurrences over all documents (q05)."""
    return (docs.select(F.explode_outer(tokenize(text)).alias("term"))
            .filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def corpus_stats(docs: DataFrame, text: Column | str, stop_words=None) -> tuple[int, float]:
    """Number of documents and mean document length in terms (A5)."""
    row = docs.select(F.size(tokenize(text, stop_words)).alias("dl")) \
        .agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return int(row["n"]), float(row["avgdl"] or 0.0)


def document_frequency(postings: DataFrame,
                       rows_per_salt: int = DEFAULT_ROWS_PER_SALT) -> DataFrame:
    """(term, df, n_salts) from postings."""
    return (postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .withColumn("n_salts", F.ceil(F.col("df") / F.lit(rows_per_salt)).cast("int")))


def build_keyword_index(docs: DataFrame, doc_id: str, text: Column | str, *,
                        group: str | None = None, stop_words: list[str] | None = None,
                        rows_per_salt: int = DEFAULT_ROWS_PER_SALT,
                        broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                        materialize: bool = True) -> KeywordIndex:
    """BM25 index over ``docs``.

    With ``materialize`` the postings and the term table are written once as
    Parquet under the shared checkpoint folder (survives the loss of
    executors; cuts lineage) so that statistics, the hot-term check and every
    query read them instead of re-tokenising the corpus.
    """
    stops = tuple(sorted(set(w.lower() for w in (stop_words or []))))
    raw = term_postings(docs, doc_id, text, group, stops)
    hot_cond = F.col("n_salts") > 1
    if materialize:
        # The token total (for avgdl) is observed while the postings are
        # written, the hot-term count while the term table is written: no
        # extra passes. N comes from the documents.
        # Sorted by term inside each document-clustered file: Parquet min/max
        # statistics and page indexes then let a small query vocabulary skip
        # most of the postings (see PUSHDOWN_VOCABULARY).
        raw, m = materialize_table(raw.sortWithinPartitions("term"), "postings",
                                   {"tokens": F.sum("tf")})
        n_docs = docs.count()
        avgdl = float(m["tokens"] or 0) / n_docs if n_docs else 0.0
        terms, m = materialize_table(document_frequency(raw, rows_per_salt), "terms",
                                     {"hot": F.count_if(hot_cond)})
        n_hot = int(m["hot"] or 0)
    else:
        n_docs, avgdl = corpus_stats(docs, text, stops)
        terms = document_frequency(raw, rows_per_salt)
        n_hot = terms.filter(hot_cond).count()
    # Terms that need more than one salt: at most total_postings / rows_per_salt.
    hot = terms.filter(hot_cond).select("term", F.col("n_salts").alias("hot_salts"))
    if n_hot == 0:
        postings = raw.withColumn("salt", F.lit(0))
    else:
        hot = F.broadcast(hot) if n_hot <= broadcast_rows else hot
        postings = (raw.join(hot, "term", "left")
                    .withColumn("salt", F.when(F.col("hot_salts").isNull(), F.lit(0))
                                .otherwise(F.pmod(F.xxhash64("doc_id"), F.col("hot_salts")))
                                .cast("int"))
                    .drop("hot_salts"))
    return KeywordIndex(postings, terms, n_docs, avgdl, has_group=group is not None,
                        stop_words=stops)


def query_terms(queries: DataFrame, query_id: str, text: Column | str,
                group: str | None = None, stop_words=None, once: bool = True) -> DataFrame:
    """(query_id, term[, qgrp]) with each term once per query row, and per query with ``once`` (which exchanges them)."""
    cols = [F.col(query_id).alias("query_id"),
            F.explode_outer(F.array_distinct(tokenize(text, stop_words))).alias("term")]
    if group:
        cols.append(F.col(group).alias("qgrp"))
    found = queries.select(*cols).filter(F.col("term").isNotNull())
    # Each (query, term) once, also when a query id repeats.
    return found.dropDuplicates(["query_id", "term"]) if once else found


def bm25_scores(queries: DataFrame, index: KeywordIndex, *, query_id: str,
                text: Column | str, query_group: str | None = None,
                exclude_self: bool = False,
                params: RetrievalParams = RetrievalParams(),
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(query_id, doc_id, score) for every document sharing a term with the query.

    ``query_group`` applies the category pre-filter (F2): a query with a
    non-NULL group only matches documents of the same group; corpus
    statistics stay global.
    """
    if query_group and not index.has_group:
        raise ValueError("index was built without a group column")
    qt = query_terms(queries, query_id, text, query_group, index.stop_words)
    # One bounded collect decides the small case: those rows are both the
    # size check and the vocabulary pushed into the postings scan. Only a
    # larger query side pays a count for the broadcast decision.
    head = qt.select("term").limit(PUSHDOWN_VOCABULARY + 1).collect()
    vocab = None
    if len(head) <= PUSHDOWN_VOCABULARY:
        vocab = sorted({r["term"] for r in head})
        sized = Sized(F.broadcast(qt), len(head), True) if len(head) <= broadcast_rows \
            else Sized(qt, len(head), False)
    else:
        sized = maybe_broadcast(qt, broadcast_rows)
    # IDF per query term; terms absent from the corpus drop out here.
    qidf = index.terms.join(sized.df, "term").withColumn("idf", _idf(index)).drop("df")
    postings = index.postings
    if vocab is not None:
        # A small query side (one ticket, a few tickets) becomes a term filter
        # that Spark pushes into the Parquet scan of the stored postings.
        postings = postings.filter(F.col("term").isin(vocab))
    if sized.broadcast:
        # Few query terms: probe a broadcast table while scanning postings.
        # The postings that pass the term filter are dealt by document first: the sum per
        # (query, document) is then complete within a task, and the only exchange after it
        # carries the task's best k per query, not every (query, document) pair.
        probe = F.broadcast(qidf.drop("n_salts"))
        joined = postings.join(F.broadcast(qidf.select("term").distinct()), "term", "left_semi") \
            .repartition("doc_id").join(probe, "term")
    else:
        # Many query terms: shuffle join on (term, salt) so hot terms split.
        salted = qidf.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1))) \
            .drop("n_salts")
        joined = postings.join(salted, ["term", "salt"])
    if exclude_self:
        joined = joined.filter(F.col("query_id") != F.col("doc_id"))
    if query_group:
        joined = joined.filter(F.col("qgrp").isNull() | (F.col("qgrp") == F.col("grp")))
    return (joined.select("query_id", "doc_id", _weight(index, params).alias("c"))
            .groupBy("query_id", "doc_id").agg(F.sum("c").alias("score")))


def _weight(index: KeywordIndex, params: RetrievalParams) -> Column:
    """What a posting adds to the score of a query that holds its term."""
    k1, b = params.bm25_k1, params.bm25_b
    tf = F.col("tf").cast("double")
    avgdl = index.avgdl if index.avgdl > 0 else 1.0
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / F.lit(avgdl))
    return F.col("idf") * tf * F.lit(k1 + 1.0) / (tf + norm)


def _idf(index: KeywordIndex) -> Column:
    n = F.lit(float(index.n_docs))
    return F.log(F.lit(1.0) + (n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))


def _postings_by(key: np.ndarray, n: int, rows: np.ndarray, w: np.ndarray):
    """(starts, rows, weights) of the postings in the order of ``key``."""
    order = np.lexsort((rows, key))
    starts = np.searchsorted(key[order], np.arange(n + 1))
    return starts, rows[order], w[order]


def _codes(col: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(codes in the order of the values, values); null has the first code."""
    col = pa.chunked_array([col]) if isinstance(col, pa.Array) else col
    col = col.combine_chunks().dictionary_encode()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    order = pc.sort_indices(col.dictionary)
    rank = np.empty(len(order) + 1, dtype=np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    rank[-1] = 0
    at = pc.fill_null(col.indices, len(order)).to_numpy()
    return rank[at], pa.concat_arrays([pa.nulls(1, col.dictionary.type), col.dictionary.take(order)])


def _reaching(total: np.ndarray, k: int, tol: float) -> np.ndarray:
    """Places of the scores above 0 that are at most ``tol`` below the ``k``-th best."""
    n = len(total)
    least = 0.0
    if n > k:
        # The k-th of the best of some stretches is no more than the k-th of all, and far fewer are to be sorted.
        parts = min(n, max(64, 8 * k))
        tops = total[:n // parts * parts].reshape(parts, -1).max(1)
        least = np.partition(tops, parts - k)[parts - k] - tol
    sel = np.flatnonzero(total >= least) if least > 0 else np.flatnonzero(total > 0)
    if len(sel) > k:
        held = total[sel]
        sel = sel[held >= np.partition(held, len(held) - k)[len(held) - k] - tol]
    return sel


def _grid_cell(k: int, digits: int, grouped: bool, exclude_self: bool, schema: pa.Schema):
    """The function of a cell: (query_id, tids[, qgrp]) x (doc_id, tid, w[, grp]) -> best ``k`` documents per query."""
    tol = 2.0 * 10.0 ** (-digits)

    def cell(queries: pa.Table, postings: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or postings.num_rows == 0:
            return schema.empty_table()
        docs, ids = _codes(postings["doc_id"])
        vocab, term = np.unique(postings["tid"].to_numpy(), return_inverse=True)
        w = postings["w"].to_numpy()
        n_docs, n_terms = len(ids), len(vocab)
        # Documents are numbered by group, then id, so that a group's scores are one stretch.
        whole = (*_postings_by(term, n_terms, docs, w), 0, 0, n_docs, np.arange(n_docs))
        # Terms of many documents: a row of weights each, which a query of no group adds up instead of the postings.
        often = np.flatnonzero(np.diff(whole[0]) * GRID_DENSE_SHARE > n_docs)
        if grouped and not queries["qgrp"].null_count:
            often = often[:0]
        row_of = np.full(n_terms, -1)
        row_of[often] = np.arange(len(often))
        dense = np.empty((len(often), n_docs))
        for r, t in zip(dense, often):
            at = slice(whole[0][t], whole[0][t + 1])
            r[:] = np.bincount(whole[1][at], whole[2][at], minlength=n_docs)
        stretch = {}
        if grouped:
            code, names = _codes(postings["grp"])
            held, row = np.unique(code * n_docs + docs, return_inverse=True)
            cuts = np.searchsorted(held // n_docs, np.arange(len(names) + 1))
            by_group = _postings_by(code * n_terms + term, len(names) * n_terms, row, w)
            stretch = {name: (*by_group, g * n_terms, cuts[g], cuts[g + 1], held % n_docs)
                       for g, name in enumerate(names.to_pylist()) if g}
        lists = queries["tids"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        asked = lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(vocab, asked), n_terms - 1)
        place[vocab[place] != asked] = -1
        ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        qcode, qids = _codes(queries["query_id"])
        own = np.full(len(qids), -1)
        if exclude_self:
            at = pc.index_in(qids, ids, skip_nulls=True)
            own = pc.fill_null(at, -1).to_numpy()
        groups = queries["qgrp"].to_pylist() if grouped else None
        order = np.argsort(qcode, kind="stable")
        out = ([], [], [])
        for nth, i in enumerate(order):
            name = groups[i] if grouped else None
            starts, rows, weights, base, lo, hi, doc = whole if name is None else stretch.get(name, (None,) * 7)
            last = nth + 1 == len(order) or qcode[order[nth + 1]] != qcode[i]
            alone = last and (nth == 0 or qcode[order[nth - 1]] != qcode[i])
            if nth == 0 or qcode[order[nth - 1]] != qcode[i]:
                total = None
            if starts is not None:
                t = place[ends[i]:ends[i + 1]]
                t = t[t >= 0]
                full = row_of[t] if name is None else np.full(len(t), -1)
                t = t[full < 0] + base
                cuts_ = [(a, b) for a, b in zip(starts[t], starts[t + 1]) if b > a]
                full = full[full >= 0]
                if cuts_ or len(full):
                    score = np.zeros(hi - lo) if not cuts_ else np.bincount(
                        np.concatenate([rows[a:b] for a, b in cuts_]) - lo,
                        np.concatenate([weights[a:b] for a, b in cuts_]), minlength=hi - lo)
                    for r in full:
                        score += dense[r]
                    if alone:
                        total, of = score, doc[lo:hi]
                    else:
                        # A query id with several groups: its rows' scores add up by document.
                        total = np.zeros(n_docs) if total is None else total
                        of = np.arange(n_docs)
                        total[doc[lo:hi]] += score
            if not last or total is None:
                continue
            q = qcode[i]
            if own[q] >= 0:
                total[of == own[q] if len(of) < n_docs else own[q]] = 0.0
            sel = _reaching(total, k, tol)
            part = (np.full(len(sel), q), of[sel], total[sel], np.round(total[sel], digits))
            if len(sel) > 4 * k:
                part = _keep_best(*part, k, tol)
            for b, x in zip(out, part):
                b.append(x)
        if not out[0]:
            return schema.empty_table()
        q, d, s = (np.concatenate(x) for x in out)
        return pa.Table.from_arrays([qids.take(pa.array(q)).cast(schema.field(0).type),
                                     ids.take(pa.array(d)).cast(schema.field(1).type), pa.array(s)], schema=schema)

    return cell


def _asked(qt: DataFrame, index: KeywordIndex) -> DataFrame:
    """(term, df, n_salts, asked): the query terms of the index and the number of queries that hold each."""
    return index.terms.join(qt.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("asked")), "term")


def grid_candidates(qt: DataFrame, index: KeywordIndex, k: int, *, exclude_self: bool, grouped: bool,
                    params: RetrievalParams, broadcast_terms: int = GRID_BROADCAST_TERMS,
                    block_rows: int = GRID_BLOCK_ROWS) -> DataFrame:
    """(query_id, doc_id, score): per cell of the grid, the documents that can be among a query's best ``k``.

    A posting's weight holds the idf, so a query is the list of its terms' numbers. The blocks of a side
    are dealt by a hash of the id; a document's equal terms are added up before, so that rows which share an
    id, or have none, weigh no more than one document."""
    spark = qt.sparkSession
    # The number of a term is its place in its partition and the partition (33 bits and more of Spark's id).
    at, part = F.col("_id") % (1 << 33), F.shiftright("_id", 33)
    terms, m = materialize_table(
        _asked(qt, index).withColumn("idf", _idf(index)).withColumn("_id", F.monotonically_increasing_id()),
        "asked-terms", {"n": F.count(F.lit(1)), "rows": F.sum("df"), "place": F.max(at), "part": F.max(part)})
    # Interleaved, the numbers of even partitions are small: a posting carries 4 bytes of them, not 8.
    parts = (m["part"] or 0) + 1
    small = ((m["place"] or 0) + 1) * parts < 1 << 31
    terms = terms.withColumn("tid", (at * parts + part).cast("int" if small else "long"))
    by_query = ["query_id"] + (["qgrp"] if grouped else [])
    by_doc = ["doc_id"] + (["grp"] if grouped else [])
    queries, q = materialize_table(
        qt.join(terms.select("term", "tid"), "term").groupBy(*by_query).agg(F.sort_array(F.collect_list("tid")).alias("tids")),
        "queries", {"n": F.count(F.lit(1)), "terms": F.sum(F.size("tids"))})
    # Weights of the postings, joined by broadcast or by (term, salt) as in ``bm25_scores``.
    weights = terms.select("term", "n_salts", "idf", "tid")
    if m["n"] <= broadcast_terms:
        found = index.postings.join(F.broadcast(weights.drop("n_salts")), "term")
    else:
        found = index.postings.join(weights.withColumn("salt", F.explode(F.sequence(
            F.lit(0), F.col("n_salts") - 1))).drop("n_salts"), ["term", "salt"])
    if exclude_self:
        # Null equals no id and is not unequal to one either.
        queries, found = queries.where("query_id is not null"), found.where("doc_id is not null")
    found = found.select(*by_doc, "tid", _weight(index, params).alias("w")).groupBy(*by_doc, "tid").agg(F.sum("w").alias("w"))
    # Enough cells for every core, dealt so that little is sent twice: a query is sent once a block of documents.
    cells = CELLS_PER_CORE * spark.sparkContext.defaultParallelism
    n_terms, n_rows = max(1, q["terms"] or 0), max(1, m["rows"] or 0)
    n_q = max(math.ceil(n_terms / block_rows), grid_width(cells, math.sqrt(cells * n_terms / n_rows)))
    n_d = max(math.ceil(n_rows / block_rows), math.ceil(cells / n_q))
    key = cell_keys(spark, n_q * n_d)
    left = queries.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_d - 1)), lambda d: key(F.pmod(
        F.xxhash64("query_id"), F.lit(n_q)) * n_d + d))))
    right = found.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_q - 1)), lambda i: key(
        i * n_d + F.pmod(F.xxhash64("doc_id"), F.lit(n_d))))))
    kinds = [qt.schema["query_id"].dataType, index.postings.schema["doc_id"].dataType]
    out = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("doc_id", kinds[1]),
                        T.StructField("score", T.DoubleType())])
    schema = pa.schema([("query_id", _arrow_type(kinds[0])), ("doc_id", _arrow_type(kinds[1])), ("score", pa.float64())])
    fn = _grid_cell(k, params.rank_digits, grouped, exclude_self, schema)
    return (left.repartition(n_q * n_d, "_cell").groupBy("_cell")
            .cogroup(right.repartition(n_q * n_d, "_cell").groupBy("_cell")).applyInArrow(fn, out))


def bm25_topk(queries: DataFrame, index: KeywordIndex, k: int, *, grid_pairs: int = GRID_PAIRS, **kw) -> DataFrame:
    """(query_id, doc_id, score, rank) best ``k`` documents per query."""
    params = kw.get("params", RetrievalParams())
    group, exclude_self = kw.get("query_group"), kw.get("exclude_self", False)
    if group and not index.has_group:
        raise ValueError("index was built without a group column")
    qt = query_terms(queries, kw["query_id"], kw["text"], group, index.stop_words)
    scores = None
    same = qt.schema["query_id"].dataType == index.postings.schema["doc_id"].dataType
    # The pairs follow from the term statistics; a few query terms are not even counted.
    rows = query_terms(queries, kw["query_id"], kw["text"], group, index.stop_words, once=False)
    if (same or not exclude_self) and len(rows.select("term").limit(PUSHDOWN_VOCABULARY + 1).collect()) > PUSHDOWN_VOCABULARY:
        qt = materialize_table(qt, "query-terms")
        pairs = _asked(qt, index).agg(F.sum(F.col("df") * F.col("asked"))).first()[0] or 0
        if pairs > grid_pairs:
            scores = grid_candidates(qt, index, k, exclude_self=exclude_self, grouped=bool(group), params=params)
    if scores is None:
        scores = bm25_scores(queries, index, **kw)
    return top_k(scores, "query_id", "score", "doc_id", k, digits=params.rank_digits)
