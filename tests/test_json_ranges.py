"""Arrays of objects cut by byte ranges, against the standard library's parser."""

import json

import pytest

from precedent.sources.files import _json_records
from precedent.sources.json_ranges import json_chunks, json_elements

ROWS = [{"Ticket ID": f"T-{i}", "Issue": "a } b { ] [ \" \\ " * (i % 4) + "é😀\n", "Description": None if i % 5 else "x" * 90,
         "n": {"deep": [{"k": "}"}, []]}} for i in range(14)]


@pytest.fixture
def small_ranges(spark):
    keys = ["spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]      # every scan in 24 ranges
    for k, v in zip(keys, ("0", "24")):
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_", [True, False])
def test_elements_across_ranges(spark, tmp_path, small_ranges, indent, ascii_):
    (tmp_path / "a.json").write_text(json.dumps(ROWS, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(ROWS[:1], indent=indent) + "\n")
    rows, broken, single = json_elements(spark, str(tmp_path / "*.json"))
    got = rows.orderBy("f", "row").collect()
    assert [json.loads(r.text) for r in got] == ROWS + ROWS[:1]
    assert broken.count() == 0 and single.count() == 0
    assert json_chunks(spark, str(tmp_path / "*.json")).select("f", "b").distinct().count() > 8


def test_shapes_and_rejects(spark, tmp_path, small_ranges):
    files = {"empty.json": "[]", "blank.json": " [ \n ] ", "number.json": "[1, 2]", "mixed.json": '[{"a": 1}, 2, {"a": 2}]',
             "nested.json": '[[{"a": 1}]]', "cut.json": '[{"a": 1}, {"a": 2', "open.json": '[{"a": 1}',
             "tail.json": '[{"a": 1}] x', "comma.json": '[{"a": 1} {"a": 2}]', "wrong.json": '[{"a": 1}, {"a" 2}]',
             "one.json": '{"a": {"b": {}}}', "object.json": '{"a": "x}", "b": "y"}\n', "good.json": '[{"a": "]"}, {}]'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows, _, single = json_elements(spark, str(tmp_path / "*.json"))
    assert {r.f.rsplit("/", 1)[1]: r.value for r in single.collect()} == {k: files[k] for k in ("one.json", "object.json")}
    recs, rejects = _json_records(spark, str(tmp_path / "*.json"))
    assert {r.source_file.rsplit("/", 1)[1] for r in rejects.collect()} >= {
        "number.json", "mixed.json", "nested.json", "cut.json", "open.json", "tail.json", "comma.json", "wrong.json"}
    got = sorted((r._source_file.rsplit("/", 1)[1], r._row, dict(r.rec)) for r in recs.collect())
    assert [(f, r) for f, _, r in got if f in ("good.json", "object.json")] == [
        ("good.json", {"a": "]"}), ("good.json", {}), ("object.json", {"a": "x}", "b": "y"})]
    assert not [g for g in got if g[0] in ("empty.json", "blank.json")]


def test_other_shapes_are_parsed_once(spark, tmp_path):
    """Rows of index-oriented and column files come from written columns, not from a parse for each lookup."""
    want = {"Ticket ID": [f"T-{i}" for i in range(12)], "Issue": [f"i{i}" for i in range(12)]}
    (tmp_path / "c.json").write_text(json.dumps(want))
    (tmp_path / "i.json").write_text(json.dumps({c: {str(i): x for i, x in enumerate(v)} for c, v in want.items()}))
    recs, rejects = _json_records(spark, str(tmp_path / "*.json"))
    assert "from_json" not in recs._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["_source_file"][-6:], r["_row"], r["rec"]["Ticket ID"], r["rec"]["Issue"]) for r in recs.collect())
    assert got == [(f, i, f"T-{i}", f"i{i}") for f in ("c.json", "i.json") for i in range(12)]
    assert rejects.count() == 0
