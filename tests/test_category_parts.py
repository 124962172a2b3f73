"""An index stored by category, and the payload joined where it lies."""

import pytest

from precedent.operators.lookup import hydrate
from precedent.plans.case_index import PART, build_case_index, pruned, search
from precedent.sources.index_store import load_index, upsert_index, write_index

SCHEMA = "ticket_id string, issue string, description string, category string, date string, " \
         "resolution string, agent_name string, resolved boolean"
CATEGORIES = ["Network", "", None, "a=b/c d", "7", "07", "Netzé", "Hardware"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "shared words here", c, "", f"fix {i}", "a", True) for i, t, c in rows], SCHEMA)


ROWS = [(f"T-{i:02}", f"vpn drop {i % 5}", CATEGORIES[i % len(CATEGORIES)]) for i in range(32)]


def hits(index, queries, **kw):
    found = search(queries, index, exclude_self=True, category_filter=True, **kw).collect()
    return sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in found)


@pytest.fixture(scope="module")
def plain(spark):
    return build_case_index(frame(spark, ROWS))


@pytest.fixture(scope="module")
def stored(spark, plain, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("parts") / "index")
    write_index(plain, root, category_parts=5)
    return load_index(spark, root)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_hits_for_any_category(spark, plain, stored):
    assert stored.category_parts == 5
    assert sorted(stored.vectors.select("ticket_id", "category").collect(), key=str) == \
        sorted(plain.vectors.select("ticket_id", "category").collect(), key=str)
    for category in CATEGORIES:
        queries = frame(spark, [r for r in ROWS if r[2] == category])
        assert hits(stored, queries) == hits(plain, queries) != []


def test_only_asked_folders_are_read(spark, stored):
    queries = frame(spark, [("Q", "vpn", "Network"), ("R", "vpn", "07")])
    cut = pruned(stored, queries)
    for rows in (cut.vectors, cut.keywords.postings):
        scan = [line for line in plan_of(rows).splitlines() if "FileScan" in line]
        assert len(scan) == 1 and f"PartitionFilters: [{PART}" in scan[0]
        read = {r[0] for r in rows.select(PART).distinct().collect()}
        assert read < {r[0] for r in stored.vectors.select(PART).distinct().collect()} and len(read) <= 2
    # A query without a category searches all.
    assert pruned(stored, frame(spark, [("Q", "vpn", "Network"), ("R", "vpn", None)])) is stored
    assert hits(stored, frame(spark, [])) == []


def test_layout_stays_through_upserts_and_empty_tables(spark, plain, tmp_path):
    root = str(tmp_path / "index")
    write_index(build_case_index(frame(spark, [])), root, category_parts=5)
    assert load_index(spark, root).vectors.count() == 0
    upsert_index(spark, root, build_case_index(frame(spark, ROWS[:20])))
    upsert_index(spark, root, build_case_index(frame(spark, ROWS[10:])))
    index = load_index(spark, root)
    assert index.category_parts == 5 and PART in index.vectors.columns
    queries = frame(spark, ROWS)
    assert hits(index, queries) == hits(plain, queries)
    write_index(index, root, category_parts=0)
    assert PART not in load_index(spark, root).vectors.columns


def test_needs_a_group_column(spark, plain, tmp_path):
    from dataclasses import replace
    bare = replace(plain, keywords=replace(plain.keywords, has_group=False))
    with pytest.raises(ValueError):
        write_index(bare, str(tmp_path / "index"), category_parts=5)


def test_payload_is_not_exchanged(spark, stored):
    found = search(frame(spark, ROWS), stored, exclude_self=True)
    small, large = hydrate(found, stored.cases), hydrate(found, stored.cases, max_broadcast_bytes=-1)
    plan = plan_of(small)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert "ticket_id" in plan and sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    empty = found.where("rank > 1000")
    assert hydrate(empty, stored.cases).count() == 0
