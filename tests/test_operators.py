"""Operator properties and brute-force checks on small inputs."""

import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from precedent.functions.flags import parse_flag
from precedent.functions.text import clean_text, parse_label, choice_label, preview, tokenize
from precedent.operators import bm25
from precedent.operators.dedupe import latest_by_key
from precedent.operators.dense import dense_topk
from precedent.operators.fusion import rrf_fuse
from precedent.operators.generate import generate
from precedent.operators.ranking import top_k
from pyspark import cloudpickle

# Test-local classes travel to the Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_clean_text_idempotent_and_unicode(spark):
    df = spark.createDataFrame([("  a  b\t\nc  ",), ("x",)], "t string")
    once = df.select(clean_text("t").alias("t"))
    twice = once.select(clean_text("t").alias("t"))
    assert [r.t for r in once.collect()] == ["a b c", "x"]
    assert once.collect() == twice.collect()


def test_tokenize_letters_digits(spark):
    df = spark.createDataFrame([("Hello, WORLD-42 ça_va!",)], "t string")
    assert df.select(tokenize("t").alias("t")).first().t == ["hello", "world", "42", "ça", "va"]


def test_parse_flag(spark):
    vals = ["True", " yes", "1", "1.0", "2", "0", "no", "", None, "NaN", "false"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.f for r in df.select(parse_flag("v").alias("f")).collect()]
    assert got == [True, True, True, True, True, False, False, False, False, False, False]


def test_label_round_trip_and_preview(spark):
    df = spark.createDataFrame([("T-1", "Disk: full"), ("T-2", "x" * 70)], "id string, issue string")
    out = df.select(parse_label(choice_label("id", "issue")).alias("id"),
                    preview("issue", 60).alias("p")).collect()
    assert [r.id for r in out] == ["T-1", "T-2"]
    assert out[1].p == "x" * 60 + "..." and out[0].p == "Disk: full"


def test_top_k_ties_and_no_gaps(spark):
    rows = [("q", d, s) for d, s in [(5, 1.0), (3, 1.0), (4, 0.5), (1, 0.2), (2, 1.0)]]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, score double")
    got = [(r.doc_id, r["rank"]) for r in top_k(df, "query_id", "score", "doc_id", 4)
           .orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2), (5, 3), (4, 4)]


def test_rrf_symmetric(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rank long")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, doc_id long, rank long")
    ab = {r.doc_id: r.score for r in rrf_fuse([a, b]).collect()}
    ba = {r.doc_id: r.score for r in rrf_fuse([b, a]).collect()}
    assert ab == ba
    assert math.isclose(ab[2], 1 / 62 + 1 / 61)


def _vectors(spark, n=60, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[5] = 0.0                      # zero vector: no score
    rows = [(i, [float(x) for x in m[i]], int(i % 3)) for i in range(n)]
    rows.append((999, [1.0, 2.0], 0))  # wrong width: excluded
    return spark.createDataFrame(rows, "id long, v array<float>, g int"), m


@pytest.mark.parametrize("chunk_bytes", [256 << 20, 1000])
def test_dense_topk_brute_force(spark, chunk_bytes):
    df, m = _vectors(spark)
    m = m.astype(np.float32).astype(np.float64)
    got = dense_topk(df, df, 3, query_id="id", q_vec="v", doc_id="id", d_vec="v",
                     exclude_self=True, max_broadcast_bytes=chunk_bytes, dim=8).collect()
    norms = np.linalg.norm(m, axis=1)
    want = set()
    for q in range(len(m)):
        if norms[q] == 0:
            continue
        scores = [(-round(float(m[q] @ m[d] / (norms[q] * norms[d])), 9), d)
                  for d in range(len(m)) if d != q and norms[d] > 0]
        want |= {(q, d, r + 1) for r, (_, d) in enumerate(sorted(scores)[:3])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == want


def test_dense_self_match_first(spark):
    df, _ = _vectors(spark)
    got = dense_topk(df, df, 1, query_id="id", q_vec="v", doc_id="id", d_vec="v").collect()
    assert all(r.query_id == r.doc_id and abs(r.score - 1) < 1e-9 for r in got)


def test_dense_group_filter(spark):
    df, _ = _vectors(spark)
    got = dense_topk(df, df, 3, query_id="id", q_vec="v", doc_id="id", d_vec="v",
                     query_group="g", doc_group="g", exclude_self=True).collect()
    assert all(r.query_id % 3 == r.doc_id % 3 for r in got)


def _bm25_inputs(spark):
    docs = spark.createDataFrame(
        [(1, "the cat sat"), (2, "the cat cat sat"), (3, "a dog"), (4, "the the the"),
         (5, "")], "doc_id long, text string")
    qs = spark.createDataFrame([(10, "cat"), (11, "the dog"), (12, "zebra")],
                               "qid long, text string")
    return docs, qs


def test_bm25_salted_equals_broadcast(spark):
    docs, qs = _bm25_inputs(spark)
    idx_salted = bm25.build_keyword_index(docs, "doc_id", "text", rows_per_salt=1)
    a = bm25.bm25_scores(qs, idx_salted, query_id="qid", text="text", broadcast_rows=0)
    b = bm25.bm25_scores(qs, idx_salted, query_id="qid", text="text")
    ra = sorted((r.query_id, r.doc_id, round(r.score, 12)) for r in a.collect())
    rb = sorted((r.query_id, r.doc_id, round(r.score, 12)) for r in b.collect())
    assert ra == rb and len(ra) == 6
    assert idx_salted.terms.filter("n_salts > 1").count() > 0


def test_bm25_monotone_in_tf_and_formula(spark):
    docs, qs = _bm25_inputs(spark)
    idx = bm25.build_keyword_index(docs, "doc_id", "text")
    s = {(r.query_id, r.doc_id): r.score
         for r in bm25.bm25_scores(qs, idx, query_id="qid", text="text").collect()}
    assert s[(10, 2)] > s[(10, 1)]                       # more "cat" scores higher
    n, avgdl, df, k1, b = 5, 12 / 5, 2, 1.2, 0.75
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = idf * 1 * (k1 + 1) / (1 + k1 * (1 - b + b * 3 / avgdl))
    assert math.isclose(s[(10, 1)], want, rel_tol=1e-12)
    assert not any(q == 12 for q, _ in s)                 # no shared term, no row


def test_latest_by_key_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(300)] + [("cold", 1, "c")]
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(8)
    got = {r.k: r.v for r in latest_by_key(df, "k", ["o"]).collect()}
    assert got == {"hot": "v299", "cold": "c"}


class _Flaky:
    def generate(self, prompts):
        return [p.upper() if "bad" not in p else 1 / 0 for p in prompts]


def test_generate_isolates_failures(spark):
    df = spark.createDataFrame([("a", "fine"), ("b", "bad one")], "id string, prompt string")
    got = {r.id: (r.recommendation, r.error) for r in generate(df, "prompt", _Flaky()).collect()}
    assert got["a"] == ("FINE", None)
    assert got["b"][0] is None and "ZeroDivisionError" in got["b"][1]


def test_result_invariant_under_repartition(spark):
    docs, qs = _bm25_inputs(spark)
    idx = bm25.build_keyword_index(docs.repartition(3), "doc_id", "text")
    a = bm25.bm25_topk(qs, idx, 2, query_id="qid", text="text").collect()
    idx2 = bm25.build_keyword_index(docs.coalesce(1), "doc_id", "text")
    b = bm25.bm25_topk(qs.repartition(4), idx2, 2, query_id="qid", text="text").collect()
    key = lambda r: (r.query_id, r["rank"], r.doc_id)
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_python_and_jvm_hashing_encoders_agree(spark):
    from precedent.operators.embed import HashingEncoder, embed, hash_embed
    docs = spark.createDataFrame([(1, "The cat sat on the mat, the end."), (2, "Ça va? Ça va!"),
                                  (3, "")], "id long, text string")
    py = {r.id: r.embedding for r in embed(docs, "text", HashingEncoder(16)).collect()}
    jvm = {r.id: r.embedding for r in hash_embed(docs, "id", "text", 16).collect()}
    assert py[3] is None and 3 not in jvm
    for i in (1, 2):
        assert np.allclose(py[i], jvm[i], atol=1e-7)
        assert abs(float(np.dot(py[i], py[i])) - 1) < 1e-6


@pytest.mark.parametrize("bcast", [0, 1000])
def test_containment_truth_brute_force(spark, bcast):
    from precedent.operators.evaluate import containment_truth
    docs = spark.createDataFrame(
        [(1, "alpha beta gamma delta"), (2, "xbeta gamma delt"), (3, "the the the"),
         (4, "zeta beta gamma deltaish")], "doc_id long, text string")
    ps = spark.createDataFrame([(10, "beta gamma delt"), (11, "the the"), (12, "omega")],
                               "item_id long, text string")
    idx = bm25.build_keyword_index(docs, "doc_id", "text")
    got = {(r.item_id, r.doc_id) for r in containment_truth(
        ps, "item_id", "text", docs, "doc_id", "text", idx, broadcast_rows=bcast).collect()}
    want = {(p, d) for p, pt in [(10, "beta gamma delt"), (11, "the the"), (12, "omega")]
            for d, dt in [(1, "alpha beta gamma delta"), (2, "xbeta gamma delt"),
                          (3, "the the the"), (4, "zeta beta gamma deltaish")] if pt in dt}
    assert got == want


def test_bm25_stop_words(spark):
    docs, qs = _bm25_inputs(spark)
    plain = bm25.build_keyword_index(docs, "doc_id", "text")
    stop = bm25.build_keyword_index(docs, "doc_id", "text", stop_words=["The"])
    assert stop.terms.filter("term = 'the'").count() == 0
    assert math.isclose(stop.avgdl, 7 / 5)            # "the" no longer counted
    s_stop = {(r.query_id, r.doc_id) for r in
              bm25.bm25_scores(qs, stop, query_id="qid", text="text").collect()}
    assert (11, 4) not in s_stop and (11, 3) in s_stop  # only "dog" matches now



def test_repeated_query_ids_rank_once(spark):
    df, _ = _vectors(spark)
    twice = df.unionByName(df.filter("id < 5"))
    got = dense_topk(twice, df, 3, query_id="id", q_vec="v", doc_id="id", d_vec="v",
                     exclude_self=True).collect()
    per = {}
    for r in got:
        per.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    assert all(sorted(x[0] for x in v) == [1, 2, 3] for v in per.values())
    assert all(q != d for q, v in per.items() for _, d in v)
    docs, qs = _bm25_inputs(spark)
    idx = bm25.build_keyword_index(docs, "doc_id", "text")
    one = {(r.query_id, r.doc_id): r.score for r in
           bm25.bm25_scores(qs, idx, query_id="qid", text="text").collect()}
    two = {(r.query_id, r.doc_id): r.score for r in
           bm25.bm25_scores(qs.unionByName(qs), idx, query_id="qid", text="text").collect()}
    assert one == two


def test_generate_skips_rows_without_neighbours(spark):
    df = spark.createDataFrame([("a", "fine", False), ("b", "bad", True)],
                               "id string, prompt string, skip boolean")
    got = {r.id: (r.recommendation, r.error) for r in
           generate(df, "prompt", _Flaky(), skip_col="skip", fallback="none").collect()}
    assert got == {"a": ("FINE", None), "b": ("none", None)}


def test_dense_many_duplicate_vectors(spark):
    """A third of the corpus is one repeated vector: exact ties broken by id, buffer bounded."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    dup = rng.normal(size=8)
    rows = [(i, [float(x) for x in (dup if i % 3 == 0 else base[i])]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = dense_topk(df, df.repartition(1), 4, query_id="id", q_vec="v", doc_id="id", d_vec="v",
                     exclude_self=True).collect()
    m = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q in range(60):
        sc = sorted((-round(float(m[q] @ m[d]), 9), d) for d in range(60) if d != q)
        want |= {(q, d, i + 1) for i, (_, d) in enumerate(sc[:4])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == want
