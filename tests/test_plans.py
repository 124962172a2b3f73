"""Plan-shape checks: the physical plans keep the properties the design relies on."""

import __spark_entry__ as entry
from precedent.plans import registry
from settings import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + \
        df._jdf.queryExecution().sparkPlan().toString()


def test_topk_uses_partial_group_limit(spark):
    plan = _plan(entry.queries()["q17_bm25_topk"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_pushed_and_columns_pruned(spark):
    df = entry.queries()["q13_union_files"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    # the large text column is never read for this projection
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan
    assert "text:string" not in plan


def test_dense_scan_is_in_place(spark):
    plan = _plan(entry.queries()["q14_dense_topk"](spark, SF_SMALL))
    assert "MapInArrow" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_cartesian_anywhere(spark):
    entry.queries()
    for name, fn in registry.QUERIES.items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_small_vocabulary_is_pushed_to_postings_scan(spark):
    from precedent.operators import bm25
    from precedent.sources.tables import read_table
    docs = read_table(spark, SF_SMALL, "documents")
    idx = bm25.build_keyword_index(docs, "doc_id", "text")
    q = spark.createDataFrame([(1, "shared drive error")], "qid long, text string")
    plan = _plan(bm25.bm25_topk(q, idx, 3, query_id="qid", text="text"))
    assert "PushedFilters: [IsNotNull(term), In(term, [drive,error,shared])]" in plan


def test_no_text_is_exchanged_on_a_large_table(spark):
    """Postings and vectors of a table with enough splits: no exchange above the text (a small one is dealt first)."""
    from precedent.operators import bm25
    from precedent.operators.embed import hash_embed_sparse
    from precedent.sources.tables import read_table
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        docs = read_table(spark, SF_SMALL, "documents")
        assert "Exchange" not in _plan(bm25.term_postings(docs, "doc_id", "text"))
        lines = hash_embed_sparse(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString().splitlines()
        at = [i for i, line in enumerate(lines) if "Exchange" in line]
        assert len(at) == 1 and "hashpartitioning(_id" in lines[at[0]]
        # below the exchange the row holds id, bucket and weight only
        assert "Project [_id" in lines[at[0] + 1] and "text" not in lines[at[0] + 1].split("AS bucket")[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_terms_are_counted_within_the_row(spark):
    from collections import Counter

    from precedent.operators import bm25
    texts = {1: None, 2: "", 3: "the", 4: "Bb bb aa", 5: "... --", 6: "b a b a b c " * 50}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {(r.doc_id, r.term, r.tf, r.doc_len) for r in bm25.term_postings(docs, "doc_id", "text").collect()}
    want = set()
    for i, text in texts.items():
        words = [w for w in (text or "").lower().split() if w.isalnum()]
        want |= {(i, w, n, len(words)) for w, n in Counter(words).items()}
    assert got == want
