"""Positive-unlabelled quality: prior, risk, held-out accuracy and odd rows."""

import random
import zlib

import numpy as np

from precedent.llm import op11_quality as op11

SF = "/root/testdata/sf0.1"


def corpus(rng, n):
    """(doc_id, text, quality): a fifth is junk of three kinds."""
    rows = []
    for i in range(n):
        words = [f"{rng.choice('bcdfgm')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeiou')}"
                 for _ in range(rng.randrange(30, 120))]
        text = " ".join(w + rng.choice(["", "", ",", ".", ""]) for w in words)
        good = rng.random() < 0.8
        if not good:
            text = rng.choice([lambda: text.upper().replace(" ", "!! "), lambda: " ".join(words[:2] * 40),
                               lambda: text.replace(" ", " | ")])()
        rows.append((i, text, int(good)))
    return rows


def test_prior_is_near_the_share_of_positives():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, 8000)
        u = np.where(rng.random(8000) < share, rng.normal(2, 1, 8000), rng.normal(-3, 1, 8000))
        assert share - 0.03 < op11.class_prior(p, u) < share + 0.03
    assert op11.class_prior(np.zeros(5), np.zeros(5)) == 0.98


def test_risk_is_the_non_negative_one():
    """Against the risk written out plainly: no small move of the weights lowers it by much."""
    rng = np.random.default_rng(5)
    p = rng.normal(1.0, 1, (600, 2))
    u = np.vstack([rng.normal(1.0, 1, (300, 2)), rng.normal(-2.0, 1, (300, 2))])
    w, b = op11.minimise_risk(p, u, 0.5, batch=10_000, steps=4_000, decay=0.0)

    def risk(w, b):
        own = np.logaddexp(0, -(p @ w + b)).mean()
        rest = np.logaddexp(0, u @ w + b).mean() - 0.5 * np.logaddexp(0, p @ w + b).mean()
        return 0.5 * own + max(0.0, rest)
    here = risk(w, b)
    for _ in range(200):
        assert risk(w + rng.normal(0, 0.05, 2), b + rng.normal(0, 0.05)) > here - 2e-3
    assert ((p @ w + b) > 0).mean() > 0.9 and ((u[300:] @ w + b) < 0).mean() > 0.95


def test_labels_of_zero_and_of_the_held_fold_are_not_used(spark, make):
    rows = corpus(random.Random(6), 900)
    docs = make([(i, t) for i, t, _ in rows])
    some = [(i, q) for i, _, q in rows if i % 3 == 0]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    plain = op11.quality(docs, spark.createDataFrame(some, "doc_id long, quality int")).collect()
    flipped = [(i, 1 - q if i in held else q) for i, q in some]
    again = op11.quality(docs, spark.createDataFrame(flipped, "doc_id long, quality int")).collect()
    assert sorted(plain) == sorted(again)
    truth = {i: q for i, _, q in rows}
    tested = [r for r in plain if r.held_out]
    assert {r.doc_id for r in tested} == held
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert all(r.predicted == (r.score >= 0.7) for r in plain)


def test_held_out_accuracy_on_the_supplied_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = op11.quality(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good = [r for r in got if r.quality == 1]
    poor = [r for r in got if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert sum(r.predicted for r in poor) / len(poor) < 0.03


def test_quality_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = op11.quality(odd.selectExpr("*", "1 as score", "2 as quality", "3 as th"), none).collect()
    assert len(got) == 9 and {r.score for r in got} == {0.0} and {r.predicted for r in got} == {0}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    # Every training text is labelled: all of them are the unlabelled ones.
    labels = spark.createDataFrame([(i, 1) for i in range(1, 8)] + [(None, 1), (99, 0), (5, None)], "doc_id long, quality int")
    got = op11.quality(odd, labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[5]) == 1 and by[1] == by[2]               # repeated rows; null and empty texts
    assert op11.quality(odd.limit(0), labels).count() == 0
