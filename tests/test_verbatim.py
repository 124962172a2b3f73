"""Containment of passages of any length against brute force."""

import pytest

from precedent.operators.verbatim import verbatim_truth

TEXTS = ["password: aaaa bbbb", "", None, "a", "ab", "aaa", "aaaaaaa", "x--=>y", "¿qué? 😀😀 end", "line\nnext\tcell",
         "the cat sat on the mat", "at", "password: aaaa bbbb"]
PASSAGES = ["", None, "a", "aa", "aaa", "aaaa", "aaaaa", "at", "--", "--=>", "😀", "😀😀 e", "\n", "e\nn", "assw",
            "the cat sat on the mat", "the cat sat on the mat!", "zz", "the", "the"]


def _frames(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(10, "a mat")],
                                 "doc_id int, body string")
    return spark.createDataFrame(list(enumerate(PASSAGES)), "item int, passage string"), docs


def _truth(passages, docs):
    return sorted({(p.item, d.doc_id) for p in passages.collect() for d in docs.collect()
                   if p.passage and d.body is not None and p.passage in d.body}, key=str)


@pytest.mark.parametrize("rows_per_salt,broadcast_rows", [(1_000_000, 2_000_000), (2, 0)])
def test_against_brute_force(spark, rows_per_salt, broadcast_rows):
    passages, docs = _frames(spark)
    got = verbatim_truth(passages, "item", "passage", docs, "doc_id", "body", rows_per_salt, broadcast_rows)
    assert got.columns == ["item", "doc_id"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == _truth(passages, docs)


def test_same_key_name_and_empty_tables(spark):
    passages, docs = _frames(spark)
    got = verbatim_truth(passages, "item", "passage", docs.withColumnRenamed("body", "passage"), "doc_id", "passage")
    assert sorted([tuple(r) for r in got.collect()], key=str) == _truth(passages, docs)
    none = verbatim_truth(passages.limit(0), "item", "passage", docs, "doc_id", "body")
    assert none.columns == ["item", "doc_id"] and none.count() == 0
    assert verbatim_truth(passages, "item", "passage", docs.limit(0), "doc_id", "body").count() == 0


def test_no_text_is_moved(spark):
    passages, docs = _frames(spark)
    plan = verbatim_truth(passages, "item", "passage", docs, "doc_id", "body")._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_few_passages_are_looked_for_without_places(spark, monkeypatch):
    """Short passages stand nearly everywhere: no place of theirs is written, and ids that repeat give one pair."""
    from precedent.operators import verbatim
    monkeypatch.setattr(verbatim, "occurrences", None)
    words = [f"p{i}" for i in range(150)]
    passages = spark.createDataFrame([*[(i % 140, w) for i, w in enumerate(words)], (3, "p3"), (7, "")], "item int, passage string")
    docs = spark.createDataFrame([(i // 2 if i % 9 else None, " ".join(words[i:i + 80])) for i in range(60)], "doc_id int, body string")
    got = verbatim_truth(passages, "item", "passage", docs, "doc_id", "body")
    assert sorted([tuple(r) for r in got.collect()], key=str) == _truth(passages, docs)
