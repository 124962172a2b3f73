"""What one task or worker holds does not grow with the table."""

from pyspark.sql import functions as F

from precedent.operators import bm25 as B
from precedent.operators import embed as E


def test_encoder_gets_few_rows_at_a_time(spark):
    class Sizes:
        def encode(self, texts):
            return [None if t is None else [float(len(texts))] for t in texts]

    rows = spark.range(3000).select("id", F.when(F.col("id") != 7, F.lit("a")).alias("text")).coalesce(1)
    got = {r.id: r.embedding for r in E.embed(rows, "text", Sizes()).collect()}
    assert got.pop(7) is None and len(got) == 2999
    assert max(v[0] for v in got.values()) <= E.ENCODE_ROWS


def test_encoder_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(E, "MEMO_TERMS", 10)
    enc = E.HashingEncoder(8)
    enc.encode([[f"t{i}" for i in range(100)]])
    assert len(enc._memo) <= 10


def test_vectors_are_summed_in_partitions_by_size(spark, monkeypatch):
    monkeypatch.setattr(E, "SUM_BYTES", 1)
    monkeypatch.setattr(E, "MAX_PARTS", 37)
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(50)], "id int, text string")
    plan = E.hash_embed_sparse(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert ", 37)" in plan and "REPARTITION_BY_NUM" in plan


def test_texts_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    spark.createDataFrame([(i, f"a b c{i}") for i in range(50)], "id int, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert B.spread_scan(docs, "text").rdd.getNumPartitions() == cores
    monkeypatch.setattr(B, "DEALT_BYTES", 4)
    held = sum(len(f"a b c{i}") for i in range(50))
    assert B.spread_scan(docs, "text").rdd.getNumPartitions() == max(cores, -(-held // 4))
    assert {(r.doc_id, r.term, r.tf) for r in B.term_postings(docs, "id", "text").collect()} >= {(7, "c7", 1), (49, "a", 1)}
    # Splits with more text than a task may have are dealt, also where there are enough of them.
    monkeypatch.setattr(B, "SPLIT_BYTES", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        assert B.spread_scan(docs, "text").rdd.getNumPartitions() == max(cores, -(-held // 4))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
