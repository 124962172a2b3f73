"""The pipeline's stages, each against brute force on its own input."""

import re

import corpus_pipeline
from precedent.llm import op2_toxicity, op3_mix
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    tables = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if k < 4:
            assert tables[-1].columns == docs.columns
    model = op2_toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = op2_toxicity.score(docs, model).where("_score >= 0.5").count()
    assert tables[1].count() == docs.count() - toxic
    near = {r.doc_id: r.text for r in tables[3].collect()}
    sets = {}
    for i, t in near.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    assert not any(sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
                   for k, x in enumerate(ids) for y in ids[k + 1:])
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    before, after = (t.agg(F.sum(words)).first()[0] for t in tables[3:5])
    n_sources = tables[3].select("source").distinct().count()
    assert abs(before - after) <= n_sources
    pieces = tables[5].agg(F.sum("length"), F.count("*")).first()
    assert pieces[0] > 0 and tables[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_near_copies_leave_one_row(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (1, text, "de", "a", 5),      # repeated rows
            (None, "null " + text, "en", "a", 5),                                           # near copy without id
            (2, text.upper(), "en", "b", 5), (2, "quite another text", "en", "b", 5),       # two texts, one id
            (None, "copy of no id", "en", "a", 5), (None, "copy of no id", "en", "a", 5), (None, "Copy of  no id", "fr", "a", 5),
            (None, "alone", "en", "a", 5), (7, None, "en", "a", 5), (8, " ", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), SF)
    assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    of_none = [r for r in kept if r[0] is None and "copy" in (r[1] or "").lower()]
    assert len(of_none) == 1
    assert [r for r in kept if r not in of_none] == sorted(
        [(1, text, "de", "a", 5), (2, "quite another text", "en", "b", 5), (None, "alone", "en", "a", 5),
         (7, None, "en", "a", 5), (8, " ", "en", "a", 5)], key=str)


def test_mixed_copies_lie_by_shard_and_place(spark):
    rows = [(i, f"word{i} text", "en", "a", 5) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    places = {r.doc_id: tuple(r.places[0]) for r in op3_mix.mix(docs).collect()}
    assert len({p[1] for p in places.values()}) == 200
    parts = {}
    for r in corpus_pipeline.mix_sources(spark, docs, SF).withColumn("at", F.spark_partition_id()).collect():
        parts.setdefault(r.at, []).append(places[r.doc_id])
    assert sum(map(len, parts.values())) == 200 and all(p == sorted(p) for p in parts.values())


def test_stages_keep_clashing_columns_and_every_row(spark):
    """Null ids, one id on two texts, repeated rows and columns named like the stages' own."""
    long = " ".join(f"tok{i}" for i in range(30))
    rows = [(i, f"{long} own{i}", "en", "a", 9) for i in range(3)]
    rows += [(None, f"no id {i % 2}\nsecond line {i}\nthird {i}", "en", None, 5) for i in range(6)]
    rows += [(7, "one text here", "en", "b", 5), (7, "two texts under it", "de", "b", 5), (8, None, "en", "b", None),
             (9, "", "en", "b", 0), (9, "", "en", "b", 0)]
    names = ["th", "_flags", "_words", "_score", "_n_lines", "_row", "row", "size", "part", "places", "n", "key"]
    docs = spark.createDataFrame([(*r, *[f"{k}:{i}" for i in range(len(names))]) for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{n} string" for n in names)).repartition(3)
    given = {r["th"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        for r in got.collect():
            whole = given[r["th"]]
            assert [r[n] for n in names] == [whole[n] for n in names] and r.doc_id == whole.doc_id
            assert name in ("mixing", "line_dedup") or r == whole
        assert got.limit(0).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert pack_total(spark, docs) == docs.count()


def pack_total(spark, docs):
    got = corpus_pipeline.pack_sequences(spark, docs, SF)
    return got.where("start = 0").count()


def test_mixing_without_ids_takes_what_the_mix_takes(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, f"w{i % 40} x y z v u t s r q", "en", "ab"[i % 2], 9) for i in range(200)]
    rows += [(5, f"w{i} x y z v u t s r q", "en", "ab"[i % 2], 9) for i in range(200)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    words = F.sum(F.regexp_count("text", F.lit(r"\S+")))
    targets = [r.target for r in op3_mix.mix(docs).select("source_size", "target").distinct().collect()]
    got = [r[1] for r in corpus_pipeline.mix_sources(spark, docs, SF).groupBy("source").agg(words).collect()]
    # Weights 1 and 2 of 3,800 words, whatever the ids.
    total = docs.agg(words).first()[0]
    assert sorted(map(round, targets)) == sorted(got) == [round(total / 3), round(total * 2 / 3)]
