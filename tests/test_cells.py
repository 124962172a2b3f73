"""What a search of many queries sends and where its cells land."""

import numpy as np
from pyspark.sql import functions as F

from precedent.operators import bm25, embed
from precedent.operators.dense import cell_keys, grid_width


def test_each_cell_has_a_task_of_its_own(spark):
    for n in (1, 7, 12, 25):
        key = cell_keys(spark, n)
        cells = spark.range(n).repartition(1).withColumn("key", key(F.col("id")))
        dealt = cells.repartition(n, "key").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sorted(r["count"] for r in dealt) == [1] * n


def test_a_grid_has_as_many_cells_as_asked():
    assert [grid_width(c, c ** 0.5) for c in (1, 2, 12, 16, 24)] == [1, 2, 4, 4, 6]
    assert grid_width(24, 0.01) == 1 and grid_width(24, 900) == 24


def test_vectors_are_put_together_without_a_lookup_of_every_bucket(spark):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(i % 40)), ) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = embed.hash_embed(df, "id", "text", 384)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "mapfromentries" not in plan
    tokens = [[t for t in text.split(" ") if t] for _, text in rows]
    want = dict(enumerate(embed.HashingEncoder(384).encode(tokens)))
    got = {r.id: r.embedding for r in found.collect()}
    assert set(got) == {i for i, v in want.items() if v is not None}
    for i, v in got.items():
        assert len(v) == 384 and np.allclose(v, want[i], atol=1e-7)


def test_grid_terms_are_numbered_in_four_bytes(spark, monkeypatch):
    seen = []
    write = bm25.materialize_table
    monkeypatch.setattr(bm25, "materialize_table", lambda df, name, *a: (seen.append((name, df)), write(df, name, *a))[1])
    docs = spark.createDataFrame([(f"t{i}", f"w{i % 9} w{i % 11} the") for i in range(60)], "id string, text string")
    idx = bm25.build_keyword_index(docs, "id", "text")
    qt = bm25.query_terms(docs, "id", "text")
    hits = bm25.grid_candidates(qt, idx, 3, exclude_self=True, grouped=False, params=bm25.RetrievalParams())
    assert hits.count() >= 180
    tids = next(df for name, df in seen if name == "queries").select(F.explode("tids").alias("t"))
    assert dict(tids.dtypes)["t"] == "int"
    assert tids.distinct().count() == idx.terms.count()
