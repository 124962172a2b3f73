import json
import os

from fixture_files import write_case_dir

from precedent.plans.jobs import build_index_job
from precedent.plans.recommend import recommend
from precedent.sources.files import read_csv
from precedent.sources.index_store import load_index
from precedent.streaming.recommend_stream import recommend_stream

A = ("Ticket ID,Issue,Description,Category,Date\n"
     "S-1,VPN down,cannot connect from home,Network,d\n")
B = ("Ticket ID,Issue,Description,Category,Date\n"
     "S-2,Printer jam,paper stuck again,Hardware,d\n")


def _read(out):
    rows = {}
    for d in os.listdir(out):
        for f in os.listdir(f"{out}/{d}"):
            if f.endswith(".json"):
                for line in open(f"{out}/{d}/{f}"):
                    r = json.loads(line)
                    rows[r["ticket_id"]] = [n["ticket_id"] for n in r["similar_tickets"]]
    return rows


def test_stream_matches_batch(spark, tmp_path):
    root = str(tmp_path / "index")
    build_index_job(spark, str(write_case_dir(tmp_path / "old")), root)
    index = load_index(spark, root)
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "a.csv").write_text(A)
    (src / "b.csv").write_text(B)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = recommend_stream(spark, str(src), index, out, checkpoint=ckpt)
    q.awaitTermination(120)
    got = _read(out)
    batch = recommend(read_csv(spark, str(src)), index).collect()
    want = {r["ticket_id"]: [n["ticket_id"] for n in r["similar_tickets"]] for r in batch}
    assert got == want
    # a rerun over the same checkpoint adds nothing
    n_dirs = len(os.listdir(out))
    q = recommend_stream(spark, str(src), index, out, checkpoint=ckpt)
    q.awaitTermination(120)
    assert len(os.listdir(out)) == n_dirs
