"""End-to-end jobs: build the index (E1), recommend for new tickets (E2),
recommend for one ticket typed into a form (E3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.operators.dedupe import latest_by_key
from precedent.operators.embed import HashingEncoder, embed_cached
from precedent.operators.filters import validate_cases
from precedent.operators.render import manual_ticket, markdown
from precedent.operators.stats import category_counts, resolution_counts
from precedent.plans.case_index import build_case_index, with_row_key, with_texts
from precedent.plans.recommend import recommend
from precedent.schema import CASE_FIELDS, DEFAULT_TICKET_ID, RetrievalParams
from precedent.session import materialize
from precedent.sources.files import read_cases, read_new
from precedent.sources.index_store import load_index, write_index
from precedent.sources.sinks import (load_cache, save_cache, write_results_json,
                                     write_results_text)


def build_index_job(spark: SparkSession, cases_dir: str, index_root: str, *,
                    cache_path: str | None = None, only_resolved: bool = False,
                    latest_only: bool = False, encoder=None, params: RetrievalParams = RetrievalParams()) -> dict:
    """Read every case file, embed with the cache, index, persist. Returns counts
    for the caller to report. Every row is a case of its own; with ``latest_only``
    the last row of each given ticket id stays (rows without an id all stay)."""
    encoder = encoder or HashingEncoder(params.dim)
    cases, rejects = read_cases(spark, cases_dir, only_resolved=only_resolved)
    if latest_only:
        given = F.col("ticket_id") != DEFAULT_TICKET_ID
        cases = latest_by_key(cases.where(given), "ticket_id", ["_source_file", "_row"]) \
            .unionByName(cases.where(~given))
    cases = with_row_key(cases.select(*CASE_FIELDS), "case_key", "cases")
    texts = with_texts(cases)
    cache = load_cache(spark, cache_path) if cache_path else None
    vec, new_rows = embed_cached(texts, "dense_text", cache, encoder)
    if cache_path:
        new_rows = materialize(new_rows, "new-cache-rows")
        save_cache(new_rows, cache_path)
        vec, _ = embed_cached(texts, "dense_text", load_cache(spark, cache_path), encoder)
    vectors = materialize(vec.select("case_key", "category", "embedding"), "vectors")
    index = build_case_index(cases, encoder, params, vectors=vectors, store_cases=False,
                             key="case_key")
    version = write_index(index, index_root)
    counts = resolution_counts(cases).first().asDict()
    return {"version": version, **counts,
            "categories": {r["category"]: r["n"] for r in category_counts(cases).collect()},
            "rejects": rejects.count()}


def recommend_job(spark: SparkSession, new_path: str, index_root: str, out_dir: str, *,
                  generator=None, category_filter: bool = False) -> DataFrame:
    """Recommend for every new ticket; write JSON Lines and the text report;
    return the one-row run summary."""
    index = load_index(spark, index_root)
    new = read_new(spark, new_path).select(*CASE_FIELDS)
    ok = F.col("error").isNull()
    # The run summary (A4) is observed while the results are written: no
    # extra pass over them.
    results, m = materialize(
        recommend(new, index, generator=generator, category_filter=category_filter), "results",
        {"total": F.count(F.lit(1)), "succeeded": F.count_if(ok), "failed": F.count_if(~ok),
         "mean_seconds": F.avg(F.when(ok, F.col("processing_time_seconds")))})
    write_results_json(results, f"{out_dir.rstrip('/')}/recommendations.json")
    write_results_text(results, f"{out_dir.rstrip('/')}/recommendations.txt")
    return spark.createDataFrame(
        [(m["total"], m["succeeded"], m["failed"], m["mean_seconds"])],
        "total long, succeeded long, failed long, mean_seconds double")


def recommend_one(spark: SparkSession, index, issue: str, description: str,
                  category: str | None = None, generator=None) -> DataFrame:
    """One ticket from a form: validate, shape, recommend, render markdown.

    ``index`` is a loaded ``CaseIndex`` (load once, ask many, as an
    interactive service does) or the root folder of a stored index. An
    invalid entry returns its message in ``markdown`` without a search.
    """
    form = spark.createDataFrame([(issue, description, category)],
                                 "issue string, description string, category string")
    good, bad = validate_cases(form)
    ticket = good.select(*manual_ticket()).withColumn("date", F.lit("")) \
        .withColumn("resolution", F.lit(None).cast("string")) \
        .withColumn("agent_name", F.lit(None).cast("string")) \
        .withColumn("resolved", F.lit(None).cast("boolean"))
    if ticket.count() == 0:
        return bad.select(F.concat(F.lit("Error: "), F.col("reason")).alias("markdown"))
    if isinstance(index, str):
        index = load_index(spark, index)
    res = recommend(ticket, index, generator=generator, category_filter=True)
    return res.select("ticket_id", markdown().alias("markdown"))
