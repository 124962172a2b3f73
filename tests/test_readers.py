"""Odd case files: header clashes, ragged and empty CSV, date cells, JSON kinds."""

import json
import zipfile

from fixture_files import write_xlsx

from precedent.sources.files import column_names, parse_xlsx, read_cases
from precedent.sources.sinks import number_results


def _reasons(rejects):
    return {r["source_file"].rsplit("/", 1)[-1]: r["reason"] for r in rejects.collect()}


def test_column_names():
    assert column_names('a,"b,c",a,,a') == ["a", "b,c", "a.1", "Unnamed: 3", "a.2"]


def test_csv_headers_that_clash(spark, tmp_path):
    (tmp_path / "clash.csv").write_text(
        "Ticket ID,Issue,issue,Resolution,resolution\nT-1,title,snake,fixed,other\n")
    cases, rejects = read_cases(spark, str(tmp_path))
    row = cases.first()
    assert (row["issue"], row["resolution"]) == ("title", "fixed")
    assert rejects.count() == 0


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "long.csv").write_text("Ticket ID,Issue\nT-1,ok\nT-2,a,b,c\n")
    (tmp_path / "trailing.csv").write_text("Ticket ID,Issue\nT-1,ok\nT-2,a,\n")
    (tmp_path / "nothing.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "short.csv").write_text('Ticket ID,Issue,Category\nS-1,"one, two"\nS-2,"a\nb",Network\n')
    cases, rejects = read_cases(spark, str(tmp_path))
    assert {r["ticket_id"]: r["issue"] for r in cases.collect()} == {"S-1": "one, two", "S-2": "a\nb"}
    assert _reasons(rejects) == {
        "long.csv": "row has more fields than the header", "trailing.csv": "row has more fields than the header",
        "nothing.csv": "no header line", "blank.csv": "no header line"}


def test_json_kind_by_type(spark, tmp_path):
    (tmp_path / "text.json").write_text(json.dumps({"Issue": "[urgent] vpn"}))
    (tmp_path / "null.json").write_text(json.dumps({"Ticket ID": None, "Issue": ["a", "b"]}))
    (tmp_path / "mixed.json").write_text(json.dumps({"Issue": ["a"], "Category": {"1": "x"}}))
    cases, rejects = read_cases(spark, str(tmp_path))
    by_file = {r["_source_file"].rsplit("/", 1)[-1]: r["issue"] for r in cases.collect()}
    assert by_file["text.json"] == "[urgent] vpn"
    assert set(by_file) == {"text.json", "null.json"} and cases.count() == 2
    assert set(_reasons(rejects)) == {"mixed.json"}


def test_xlsx_date_cells(tmp_path):
    path = tmp_path / "dates.xlsx"
    write_xlsx(path, [["Ticket ID", "Date"], ["X-1", "@"]])
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    styles = (f'<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    text = '<c r="B2" t="inlineStr"><is><t>@</t></is></c>'
    for style, serial, want in ((0, "45293", "45293"), (1, "45293", "2024-01-02 00:00:00"),
                                (2, "45293.5", "2024-01-02 12:00:00"), (1, "0.25", "06:00:00")):
        with zipfile.ZipFile(path, "w") as z:
            for n, data in parts.items():
                z.writestr(n, data.decode().replace(text, f'<c r="B2" s="{style}"><v>{serial}</v></c>'))
            z.writestr("xl/styles.xml", styles)
        assert parse_xlsx(path.read_bytes()) == [{"Ticket ID": "X-1", "Date": want}]


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("format_string('%05d', (id * 37) % 1000) as ticket_id").repartition(7)
    got = number_results(rows).collect()
    assert sorted((r["result_no"], r["ticket_id"]) for r in got) == [
        (i + 1, f"{i:05d}") for i in range(1000)]
