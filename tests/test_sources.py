from fixture_files import DUPES_CSV, write_case_dir

from precedent.sources.files import read_cases, read_csv, read_new


def _by_id(df):
    return {r["ticket_id"]: r.asDict() for r in df.collect()}


def test_read_cases_all_formats(spark, tmp_path):
    d = write_case_dir(tmp_path)
    cases, rejects = read_cases(spark, str(d))
    got = _by_id(cases)
    # CSV with quoted newline, Title headers, blank/no flags
    assert got["T-1"]["description"] == "Cannot connect\nfrom home"
    assert got["T-1"]["resolved"] is True
    assert got["T-2"]["resolved"] is False and got["T-2"]["resolution"] == ""
    assert got["T-3"]["category"] == "Unknown" and got["T-3"]["resolved"] is False
    # snake headers, no resolution group
    assert got["N-1"]["resolution"] is None and got["N-1"]["resolved"] is None
    # records: Title form wins, missing keys default
    assert got["J-1"]["issue"] == "Title wins" and got["J-1"]["resolved"] is True
    assert got["J-2"]["category"] == "Unknown" and got["J-2"]["resolution"] is None
    # index-oriented, numeric order 9 before 20
    ids = [r["ticket_id"] for r in cases.filter("_source_file like '%indexed.json'")
           .orderBy("_row").collect()]
    assert ids == ["I-9", "I-20"]
    assert got["I-9"]["resolution"] == "" and got["I-20"]["resolved"] is True
    # column arrays, mixed flags
    assert [got[f"C-{i}"]["resolved"] for i in (1, 2, 3)] == [True, False, True]
    # single object, empty object
    assert got["S-1"]["issue"] == "single"
    assert cases.filter("_source_file like '%empty.json'").count() == 0
    # workbook (S2)
    assert got["X-1"]["description"] == "Screen flickers" and got["X-1"]["resolved"] is True
    assert got["X-2"]["resolved"] is False
    # broken and ragged files are rejected, others still load
    bad = {r["source_file"].rsplit("/", 1)[-1]: r["reason"] for r in rejects.collect()}
    assert set(bad) == {"broken.json", "ragged.json"}


def test_only_resolved(spark, tmp_path):
    d = write_case_dir(tmp_path)
    cases, _ = read_cases(spark, str(d), only_resolved=True)
    assert all(r["resolved"] for r in cases.collect())
    assert cases.count() == 6  # T-1, J-1, I-20, C-1, C-3, X-1


def test_read_new_missing_is_empty(spark, tmp_path):
    df = read_new(spark, str(tmp_path / "nothing.csv"))
    assert df.count() == 0 and "ticket_id" in df.columns


def test_dupes_keep_both_rows(spark, tmp_path):
    (tmp_path / "dupes.csv").write_text(DUPES_CSV)
    df = read_csv(spark, str(tmp_path / "dupes.csv"))
    assert df.filter("ticket_id = 'D-1'").count() == 2


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"Ticket ID": "L-1", "Issue": "one", "Resolution": "r", "Resolved": "yes"}\n'
        '\n'
        '{"ticket_id": "L-2", "issue": "two"}\n'
        '[1, 2]\n')
    cases, rejects = read_cases(spark, str(tmp_path))
    got = _by_id(cases)
    assert set(got) == {"L-1", "L-2"}
    assert got["L-1"]["resolved"] is True and got["L-2"]["resolution"] is None
    assert [r["reason"] for r in rejects.collect()] == ["line is not a JSON object"]
