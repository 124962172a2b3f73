import json
import os

from fixture_files import write_case_dir

from precedent.plans.jobs import build_index_job, recommend_job, recommend_one
from precedent.sources.index_store import IndexNotFound, load_index, point_count
from precedent.sources.sinks import load_cache

NEW_CSV = ("Ticket ID,Issue,Description,Category,Date\n"
           "TCKT-2004,Cannot open files in shared drive,"
           "User reports an error when trying to open files in the shared drive.,Network,d\n"
           "TCKT-2005,VPN keeps dropping,Cannot connect from home over VPN,Network,d\n")


def test_build_and_recommend(spark, tmp_path):
    cases_dir = write_case_dir(tmp_path / "old")
    root, cache = str(tmp_path / "index"), str(tmp_path / "cache")
    info = build_index_job(spark, str(cases_dir), root, cache_path=cache)
    assert info["rejects"] == 2 and info["total"] == 14
    idx = load_index(spark, root)
    assert point_count(idx) == 14
    assert load_cache(spark, cache).count() == 14
    # second build reuses the cache: nothing new appended
    build_index_job(spark, str(cases_dir), root, cache_path=cache)
    assert load_cache(spark, cache).count() == 14
    (tmp_path / "new.csv").write_text(NEW_CSV)
    out = str(tmp_path / "out")
    summary = recommend_job(spark, str(tmp_path / "new.csv"), root, out).first()
    assert summary["total"] == 2 and summary["failed"] == 0
    rows = [json.loads(line) for f in sorted(os.listdir(out + "/recommendations.json"))
            if f.endswith(".json") for line in open(f"{out}/recommendations.json/{f}")]
    assert {r["ticket_id"] for r in rows} == {"TCKT-2004", "TCKT-2005"}
    for r in rows:
        ranks = [n["rank"] for n in r["similar_tickets"]]
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 3
    vpn = next(r for r in rows if r["ticket_id"] == "TCKT-2005")
    assert vpn["similar_tickets"][0]["ticket_id"] == "T-1"  # the VPN case
    text = "".join(open(f"{out}/recommendations.txt/{f}").read()
                   for f in sorted(os.listdir(out + "/recommendations.txt"))
                   if f.startswith("part-"))
    assert text.index("TICKET 1: TCKT-2004") < text.index("TICKET 2: TCKT-2005")
    assert "Total tickets processed: 2" in text


def test_missing_index_is_an_error(spark, tmp_path):
    try:
        load_index(spark, str(tmp_path / "none"))
        raise AssertionError("expected IndexNotFound")
    except IndexNotFound:
        pass


def test_recommend_one(spark, tmp_path):
    cases_dir = write_case_dir(tmp_path / "old")
    root = str(tmp_path / "index")
    build_index_job(spark, str(cases_dir), root)
    md = recommend_one(spark, root, "  VPN down ", "cannot connect from home",
                       "All Categories").first()
    assert md["ticket_id"].startswith("MANUAL-")
    assert "<details open>" in md["markdown"]
    bad = recommend_one(spark, root, "   ", "x").first()
    assert bad["markdown"].startswith("Error: Please provide an issue title.")


def test_rebuild_switches_version_and_upsert(spark, tmp_path):
    from precedent.plans.case_index import build_case_index
    from precedent.sources.files import read_cases
    from precedent.sources.index_store import upsert_cases, write_index
    from precedent.schema import CASE_FIELDS
    cases, _ = read_cases(spark, str(write_case_dir(tmp_path / "old")))
    cases = cases.select(*CASE_FIELDS).filter("ticket_id <> 'D-1'")
    root = str(tmp_path / "idx")
    v1 = write_index(build_case_index(cases), root)
    fewer = cases.filter("ticket_id <> 'T-1'")
    v2 = write_index(build_case_index(fewer), root)
    assert v2 > v1
    idx = load_index(spark, root)
    assert point_count(idx) == 13 and idx.cases.filter("ticket_id = 'T-1'").count() == 0
    new = spark.createDataFrame([("T-2", "new issue", "d", "Hardware", "", "r", "a", True)],
                                cases.schema)
    merged = upsert_cases(cases, new)
    assert merged.count() == cases.count()
    assert merged.filter("ticket_id = 'T-2'").first()["issue"] == "new issue"


def test_cli_round_trip(spark, tmp_path, capsys):
    from precedent.cli import main
    cases_dir = write_case_dir(tmp_path / "old")
    root = str(tmp_path / "index")
    assert main(["build-index", "--cases", str(cases_dir), "--index", root]) == 0
    (tmp_path / "new.csv").write_text(NEW_CSV)
    assert main(["recommend", "--new", str(tmp_path / "new.csv"), "--index", root,
                 "--out", str(tmp_path / "out")]) == 0
    assert main(["ask", "--index", root, "--issue", "VPN down",
                 "--description", "cannot connect from home"]) == 0
    out = capsys.readouterr().out
    assert '"total": 2' in out and "## Recommendation" in out


class _Echo:
    def generate(self, prompts):
        return [f"  steps for {len(p)} chars  " for p in prompts]


def test_recommend_with_generator_and_no_match(spark, tmp_path):
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    from precedent.plans.case_index import build_case_index
    from precedent.plans.recommend import recommend
    from precedent.schema import CASE_FIELDS, NO_MATCH_MESSAGE
    from precedent.sources.files import read_cases
    cases, _ = read_cases(spark, str(write_case_dir(tmp_path / "old")))
    idx = build_case_index(cases.select(*CASE_FIELDS))
    q = spark.createDataFrame(
        [("Q-1", "VPN down", "cannot connect", "Network", "", None, None, None),
         ("Q-2", "Alien", "zzz qqq", "Nowhere", "", None, None, None)], cases.select(*CASE_FIELDS).schema)
    got = {r.ticket_id: r for r in recommend(q, idx, generator=_Echo(), category_filter=True).collect()}
    assert got["Q-1"]["recommendation"].startswith("steps for") and got["Q-1"]["error"] is None
    assert len(got["Q-1"]["similar_tickets"]) >= 1
    assert got["Q-2"]["recommendation"] == NO_MATCH_MESSAGE and got["Q-2"]["similar_tickets"] == []


def test_report_numbering_across_partitions(spark, tmp_path):
    from pyspark.sql import functions as F
    from precedent.sources.sinks import number_results, write_results_text
    from precedent.plans.recommend import RESULT_FIELDS
    from precedent.schema import NEIGHBOUR_SCHEMA
    from pyspark.sql import types as T
    df = (spark.range(50).repartition(7)
          .select(F.format_string("T-%03d", F.col("id")).alias("ticket_id"),
                  F.lit("i").alias("issue"), F.lit("d").alias("description"),
                  F.lit("c").alias("category"),
                  F.array().cast(T.ArrayType(NEIGHBOUR_SCHEMA)).alias("similar_tickets"),
                  F.lit("r").alias("recommendation"),
                  F.lit(None).cast("double").alias("processing_time_seconds"),
                  F.when(F.col("id") == 7, F.lit("boom")).alias("error")))
    nums = {r.ticket_id: r.result_no for r in number_results(df).collect()}
    assert nums == {f"T-{i:03d}": i + 1 for i in range(50)}
    out = tmp_path / "rep"
    write_results_text(df.select(*RESULT_FIELDS), str(out))
    text = "".join(open(p).read() for p in sorted(out.glob("part-*")))
    pos = [text.index(f"TICKET {i + 1}: T-{i:03d}") for i in range(50)]
    assert pos == sorted(pos) and "ERROR: boom" in text
    assert text.rstrip().endswith("=" * 80) and "Total tickets processed: 50" in text
