"""Incremental index, pinned stream versions, timed generator calls."""

import os

import pytest

from precedent.operators.generate import generate
from precedent.plans.case_index import build_case_index, search
from precedent.sources import index_store
from precedent.sources.index_store import drop_old, load_index, upsert_index, write_index
from precedent.streaming.recommend_stream import batch_version

SCHEMA = "ticket_id string, issue string, description string, category string, date string, " \
         "resolution string, agent_name string, resolved boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, d, "Network", "", "fix", "a", True) for i, t, d in rows], SCHEMA)


def hits(index):
    found = search(index.cases, index, exclude_self=True).collect()
    return sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in found)


FIRST = [(f"T-{i}", f"vpn drop {i % 3}", f"word{i} shared text") for i in range(12)]
SECOND = [("T-1", "printer jam", "paper tray"), ("T-2", "printer jam again", "paper word3"), ("T-99", "vpn new", "shared")]


@pytest.mark.parametrize("most", [8, 2])
def test_upserts_equal_a_rebuild(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(index_store, "MAX_SEGMENTS", most)
    root = str(tmp_path / "index")
    write_index(build_case_index(frame(spark, FIRST)), root)
    upsert_index(spark, root, build_case_index(frame(spark, SECOND)))
    third = [("T-99", "disk slow", "shared again"), ("T-2", "", "")]
    upsert_index(spark, root, build_case_index(frame(spark, third)))
    final = {r[0]: r for r in [*FIRST, *SECOND, *third]}
    got, want = load_index(spark, root), build_case_index(frame(spark, list(final.values())))
    assert (got.keywords.n_docs, round(got.keywords.avgdl, 9)) == (13, round(want.keywords.avgdl, 9))
    assert sorted((r.term, r.df) for r in got.keywords.terms.collect()) == \
        sorted((r.term, r.df) for r in want.keywords.terms.collect())
    assert {r.ticket_id: r.issue for r in got.cases.collect()} == {k: v[1] for k, v in final.items()}
    assert hits(got) == hits(want)
    folders = os.listdir(f"{root}/versions")
    segments = index_store._stats(spark, root)["segments"]
    assert len(segments) == (3 if most == 8 else 1)
    # An upsert writes its own cases only.
    newest = spark.read.parquet(f"{root}/versions/{segments[-1]}/cases").count()
    assert newest == (2 if most == 8 else 13)
    gone = drop_old(spark, root, keep=1)
    assert set(os.listdir(f"{root}/versions")) == set(folders) - set(gone) == set(segments) | {
        index_store.current_version(spark, root)}
    assert hits(load_index(spark, root)) == hits(want)


def test_a_replayed_batch_searches_the_same_version(spark, tmp_path):
    root, out = str(tmp_path / "index"), str(tmp_path / "out")
    one = write_index(build_case_index(frame(spark, FIRST)), root)
    assert batch_version(spark, root, out, 0) == one
    two = upsert_index(spark, root, build_case_index(frame(spark, SECOND)))
    assert batch_version(spark, root, out, 0) == one and batch_version(spark, root, out, 1) == two
    assert {r.issue for r in load_index(spark, root, one).cases.where("ticket_id = 'T-1'").collect()} == {"vpn drop 1"}


def test_each_prompt_is_timed(spark):
    class Slow:
        now = 0.0

        def generate(self, prompts):
            self.now += len(prompts[0])
            if prompts[0] == "bad":
                raise ValueError("no")
            return [p.upper() for p in prompts]

    slow = Slow()
    df = spark.createDataFrame([("a", False), ("bad", False), ("four", True)], "p string, skip boolean").coalesce(1)
    got = {r.p: (r.recommendation, r.error, r.seconds) for r in generate(
        df, "p", slow, skip_col="skip", fallback="none", clock=lambda: slow.now).collect()}
    assert got == {"a": ("A", None, 1.0), "bad": (None, "ValueError: no", 3.0), "four": ("none", None, 0.0)}
    assert "seconds" not in generate(df, "p", slow).columns
