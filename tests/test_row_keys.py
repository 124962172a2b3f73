"""Rows without ids, the query grid, vector widths, rejects and generator results."""

import numpy as np
from pyspark.sql import functions as F

from precedent.operators.dense import dense_topk, width_rejects
from precedent.operators.generate import generate
from precedent.operators.render import manual_ticket
from precedent.plans.case_index import build_case_index
from precedent.plans.recommend import recommend
from precedent.schema import RetrievalParams


def _vectors(spark, n=60, dim=8):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(dim)], i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<float>, g int")


def test_grid_equals_broadcast(spark):
    df = _vectors(spark)
    kw = dict(query_id="id", q_vec="v", doc_id="id", d_vec="v", exclude_self=True,
              query_group="g", doc_group="g")
    whole = {(r.query_id, r.rank): r.doc_id for r in dense_topk(df, df, 4, **kw).collect()}
    # 7 rows of 8 doubles may be broadcast: the 60 queries go through the grid.
    grid = dense_topk(df, df, 4, max_broadcast_bytes=7 * 8 * 8, **kw)
    assert "FlatMapCoGroupsInArrow" in grid._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.rank): r.doc_id for r in grid.collect()} == whole


def test_odd_widths_are_left_out_and_listed(spark):
    df = _vectors(spark).withColumn("v", F.when(F.col("id") == 5, F.array_append(
        "v", F.lit(1.0).cast("float"))).when(F.col("id") == 6, None).otherwise(F.col("v")))
    hits = dense_topk(df, df, 2, query_id="id", q_vec="v", doc_id="id", d_vec="v").collect()
    assert {r.query_id for r in hits} == set(range(60)) - {5, 6}
    assert {(r.id, r.width) for r in width_rejects(df, "id", "v", 8).collect()} == {(5, 9), (6, None)}


def test_tickets_without_ids_stay_apart(spark):
    old = spark.createDataFrame(
        [("UNKNOWN", "vpn down", "vpn does not connect", "Network", "", "restart vpn", "a", True),
         ("UNKNOWN", "printer jam", "printer paper jam", "Hardware", "", "clear tray", "b", True)],
        "ticket_id string, issue string, description string, category string, date string, "
        "resolution string, agent_name string, resolved boolean")
    index = build_case_index(old.withColumn("case_key", F.monotonically_increasing_id()),
                             params=RetrievalParams(k=1), key="case_key")
    new = spark.createDataFrame([("UNKNOWN", "vpn", "vpn vpn", "Network"),
                                 ("UNKNOWN", "printer", "paper jam", "Hardware")],
                                "ticket_id string, issue string, description string, category string")
    got = {r.issue: [n.issue for n in r.similar_tickets] for r in recommend(new, index).collect()}
    assert got == {"vpn": ["vpn down"], "printer": ["printer jam"]}


def test_fetch_is_twice_k():
    assert RetrievalParams(k=20).fetch == 40 and RetrievalParams(k=20, candidates_per_list=6).fetch == 6


def test_generator_none_stays_none_on_retry(spark):
    class Odd:
        def generate(self, prompts):
            if len(prompts) > 1:
                raise ValueError("one at a time")
            return [None if prompts[0] == "x" else prompts[0]]

    df = spark.createDataFrame([("x",), ("y",)], "p string").coalesce(1)
    got = {r.p: (r.recommendation, r.error) for r in generate(df, "p", Odd()).collect()}
    assert got == {"x": (None, None), "y": ("y", None)}


def test_manual_ticket_strips_any_white_space(spark):
    df = spark.createDataFrame([("\t vpn\n", " down \n", "All Categories")],
                               "issue string, description string, category string")
    r = df.select(*manual_ticket()).first()
    assert (r.issue, r.description, r.category) == ("vpn", "down", None)
