"""Searches of many queries: blocks of queries and documents meet in cells; no pair of all is made."""

import numpy as np
import pyarrow as pa
import pytest

from precedent.operators import bm25, dense
from precedent.operators.dense import dense_topk


def _texts(spark, n=300):
    rng = np.random.default_rng(5)
    words = ["the", "of", *[f"w{i}" for i in range(80)]]
    rows = []
    for i in range(n):
        text = " ".join([*rng.choice(words, 8), "the"][: 1 + i % 9]) if i % 10 else "the of the"
        rows.append((f"t{i}", text, None if i % 7 == 0 else f"g{i % 3}"))
    rows += [(None, "the w1 w2", "g1"), (None, "of w1", None), ("t5", "w3 w3 the", "g0")]
    return spark.createDataFrame(rows, "id string, text string, g string")


def _rows(df):
    return sorted((r.query_id or "", r.doc_id or "", r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("group,exclude_self,salted", [(None, True, False), (None, False, True), ("g", True, True)])
def test_bm25_grid_equals_pairs(spark, monkeypatch, group, exclude_self, salted):
    docs = _texts(spark)
    idx = bm25.build_keyword_index(docs, "id", "text", group="g", rows_per_salt=20 if salted else 1_000_000)
    monkeypatch.setattr(bm25, "PUSHDOWN_VOCABULARY", 10)
    if salted:
        grid = bm25.grid_candidates
        monkeypatch.setattr(bm25, "grid_candidates", lambda *a, **kw: grid(*a, broadcast_terms=0, block_rows=100, **kw))
    # Query ids are unique but for those without one; every one of these has its own group.
    queries = docs.where("id <> 't5' or id is null").where("id is not null or g is not null")
    kw = dict(query_id="id", text="text", query_group=group, exclude_self=exclude_self)
    found = bm25.bm25_topk(queries, idx, 4, grid_pairs=0, **kw)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert _rows(found) == _rows(bm25.bm25_topk(queries, idx, 4, **kw))


def test_dense_grid_with_copies_and_repeated_ids(spark):
    """A vector that most rows share, rows that share an id, and small blocks: the same as every pair scored."""
    rng = np.random.default_rng(2)
    m = rng.standard_normal((90, 6)).astype(np.float32)
    m[20:80] = m[20]
    ids = [*range(85), 30, 30, 31, 1, 2]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], "id long, v array<float>")
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    first = {i: unit[ids.index(i)] for i in ids}
    queries = spark.createDataFrame([(i, [float(x) for x in m[ids.index(i)]]) for i in sorted(set(ids))], "id long, v array<float>")
    want = set()
    for i, q in first.items():
        scores = sorted((-round(float(q @ d), 9), j) for j, d in zip(ids, unit) if j != i)[:4]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(scores)}
    for size in (1 << 20, 7 * 8 * 6):
        hits = dense_topk(queries, df, 4, query_id="id", q_vec="v", doc_id="id", d_vec="v", exclude_self=True,
                          max_broadcast_bytes=size)
        assert {(r.query_id, r.doc_id, r["rank"]) for r in hits.collect()} == want


def test_few_pairs_pass_after_the_first_rows(monkeypatch):
    """Pairs are scored in double precision only where they can still be ranked."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    m = rng.standard_normal((20_000, 16)).astype(np.float32)
    table = pa.table({"qid": pa.array(range(500)), "qv": pa.array(list(m[:500]))})
    scored = []
    exact = dense._exact
    monkeypatch.setattr(dense, "_exact", lambda q, d, qi, di: (scored.append(len(qi)), exact(q, d, qi, di))[1])
    payload = dense._payload(table, 16, False, False)
    bc = type("B", (), {"value": payload})
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(list(m))], names=["id", "v"])
    out = list(dense._scan_fn(bc, 3, 9, None, False, False, pa.int64(), pa.int64())([batch]))
    assert out[0].num_rows >= 1500 and sum(scored) < 500 * 3 * 12


def _cell_tables(n):
    ids = pa.array([f"d{i:03}" for i in range(n)])
    # Terms 0 and 1 are in all and half of the documents, the others in one each.
    held = [[0, *([1] if i % 2 else []), i + 2] for i in range(n)]
    queries = pa.table({"query_id": ids, "tids": pa.array(held, pa.list_(pa.int32()))})
    rows = [(f"d{i:03}", t, 1.0 + (i * 7 + t) % 11 / 11) for i, terms in enumerate(held) for t in terms]
    return queries, pa.table({"doc_id": pa.array([r[0] for r in rows]), "tid": pa.array([r[1] for r in rows], pa.int32()),
                              "w": pa.array([r[2] for r in rows])})


def test_postings_of_frequent_terms_are_not_added_for_each_query(monkeypatch):
    queries, postings = _cell_tables(200)
    added, plain = [], np.bincount
    monkeypatch.setattr(bm25.np, "bincount", lambda x, *a, **kw: added.append(len(x)) or plain(x, *a, **kw))
    schema = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])
    found = bm25._grid_cell(3, 9, False, True, schema)(queries, postings).to_pylist()
    # Each posting once, and a query's own rare term; before, 200 queries had 300 postings each.
    assert sum(added) <= 2 * postings.num_rows
    w = {(r["doc_id"], r["tid"]): r["w"] for r in postings.to_pylist()}
    docs = queries["query_id"].to_pylist()
    for q in queries.to_pylist()[::17]:
        score = {d: sum(w.get((d, t), 0.0) for t in q["tids"]) for d in docs if d != q["query_id"]}
        first = sorted(score, key=lambda d: (-round(score[d], 9), d))[:3]
        best = {r["doc_id"]: r["score"] for r in found if r["query_id"] == q["query_id"]}
        assert set(first) <= set(best)
        assert all(abs(score[d] - s) < 1e-12 for d, s in best.items())


def test_scores_that_reach_the_best():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 63, 64, 65, 200, 1000):
        for k in (1, 3, 40):
            total = rng.integers(0, 9, n) * (rng.random(n) < rng.choice([0.02, 0.5, 1.0])) / 3
            kth = np.sort(total)[-k] - 1e-9 if n > k else 0.0
            assert bm25._reaching(total, k, 1e-9).tolist() == np.flatnonzero((total >= kth) & (total > 0)).tolist()
