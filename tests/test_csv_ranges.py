"""CSV records across byte ranges, against Python's csv module."""

import csv
import io
import random

import pytest

from precedent.sources.csv_ranges import line_state
from precedent.sources.files import read_cases, read_csv_records


@pytest.fixture
def ranges_of(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def set_to(n):
        for k in keys:
            spark.conf.set(k, str(n))
    yield set_to
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def test_line_state():
    assert not line_state('a,"b,c",d"e,', False) and line_state('a,"b ""', False)
    assert not line_state('x"",y",z', True) and line_state('no end ""', True) and line_state('end",a,"open', True)
    assert not line_state("", False) and line_state("", True) and not line_state('5" disk,2" tape', False)


def written(rng, n):
    words = ["plain", "with, comma", 'a "quoted" word', "two\nlines", "blank\n\nline", '"', "", "é😀", "tab\t", ",\n,", '""\n"']
    rows = [["Ticket ID", "Issue", "Description, long"]]
    rows += [[f"T-{i}", rng.choice(words), " ".join(rng.choices(words, k=rng.randrange(1, 5)))] for i in range(n)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    return text.getvalue()


@pytest.mark.parametrize("size", [37, 1 << 20])
def test_ranges_smaller_than_a_record(spark, tmp_path, ranges_of, size):
    rng = random.Random(size)
    want = set()
    for k in range(2):
        text = written(rng, 15)
        (tmp_path / f"f{k}.csv").write_text(text)
        for i, r in enumerate(list(csv.reader(io.StringIO(text)))[1:]):
            want.add((f"f{k}.csv", r[0], r[1], r[2]))
    ranges_of(size)
    got = read_csv_records(spark, str(tmp_path / "*.csv")).collect()
    found = {(r._source_file.rsplit("/", 1)[-1], r.rec["Ticket ID"], r.rec["Issue"] or "", r.rec["Description, long"] or "")
             for r in got}
    assert found == want and len(got) == 30
    order = [r.rec["Ticket ID"] for r in sorted(got, key=lambda r: r._row) if r._source_file.endswith("f1.csv")]
    assert order == [f"T-{i}" for i in range(15)]


def test_unclosed_quote_and_stray_quotes(spark, tmp_path, ranges_of):
    (tmp_path / "open.csv").write_text('Ticket ID,Issue\nA-1,5" disk\nA-2,"never closed\nA-3,x\n')
    (tmp_path / "crlf.csv").write_bytes(b'Ticket ID,Issue\r\nB-1,"two\nlines"\r\nB-2,end\r\n')
    ranges_of(16)
    cases, rejects = read_cases(spark, str(tmp_path))
    got = {r.ticket_id: r.issue for r in cases.collect()}
    assert (got["A-1"], got["B-1"], got["B-2"]) == ('5" disk', "two\nlines", "end")
    assert got["A-2"].startswith("never closed\nA-3,x") and set(got) == {"A-1", "A-2", "B-1", "B-2"}
    assert rejects.count() == 0


def test_bytes_that_are_not_utf8(spark, tmp_path, ranges_of):
    (tmp_path / "bad.csv").write_bytes(b"Ticket ID,Issue\nA-1,ok\nA-2,caf\xe9\nA-3,ok\n")
    (tmp_path / "good.csv").write_text("Ticket ID,Issue\nB-1,café\n")
    ranges_of(16)
    cases, rejects = read_cases(spark, str(tmp_path))
    assert [(r.ticket_id, r.issue) for r in cases.collect()] == [("B-1", "café")]
    assert [(r.source_file.rsplit("/", 1)[-1], r.reason) for r in rejects.collect()] == [("bad.csv", "line 3 is not UTF-8")]
