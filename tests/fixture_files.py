"""Small hand-written case files (FIXTURES.md §2)."""

import json
import zipfile

TITLE_CSV = (
    "Ticket ID,Issue,Description,Category,Date,Resolution,Agent Name,Resolved\n"
    'T-1,VPN down,"Cannot connect\nfrom home",Network,2024-01-02,Restart client,Ann,True\n'
    "T-2,Printer jam,Paper stuck,Hardware,2024-01-03,,Bob,\n"
    "T-3,Slow disk,Disk at 100%,,2024-01-04,Defrag,Cy,no\n"
)
SNAKE_CSV = (
    "ticket_id,issue,description,category,date\n"
    "N-1,Email bounce,Mails return,Software,2024-02-01\n"
)
DUPES_CSV = (
    "Ticket ID,Issue,Description,Category,Date,Resolution,Agent Name,Resolved\n"
    "D-1,first,one,Network,d,r1,a,1\n"
    "D-1,second,two,Network,d,r2,a,0\n"
)
RECORDS = [
    {"Ticket ID": "J-1", "Issue": "Title wins", "issue": "snake loses", "Description": "d",
     "Category": "Software", "Resolution": "fix", "Agent Name": "Dee", "Resolved": True},
    {"ticket_id": "J-2", "issue": "no category", "description": "d2"},
]
INDEXED = {"Ticket ID": {"20": "I-20", "9": "I-9"},
           "Issue": {"20": "twenty", "9": "nine"},
           "Resolution": {"20": "r", "9": None},
           "Resolved": {"20": True, "9": False}}
COLUMNS = {"ticket_id": ["C-1", "C-2", "C-3"], "issue": ["a", "b", "c"],
           "resolution": ["x", "y", "z"], "resolved": ["yes", "0", "2.5"]}
SINGLE = {"Ticket ID": "S-1", "Issue": "single"}
RAGGED = {"Ticket ID": {"1": "R-1", "2": "R-2"}, "Issue": {"1": "only one"}}


def write_xlsx(path, rows):
    """Minimal one-sheet workbook with inline strings (no Excel package needed)."""
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        esc = str(v).replace("&", "&amp;").replace("<", "&lt;")
        return f'<c r="{ref}" t="inlineStr"><is><t>{esc}</t></is></c>'
    xml_rows = []
    for i, r in enumerate(rows, 1):
        cells = "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(r))
        xml_rows.append(f'<row r="{i}">{cells}</row>')
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.'
             'openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
             + "".join(xml_rows) + "</sheetData></worksheet>")
    wb = ('<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats'
          '.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/'
          'officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/>'
          '</sheets></workbook>')
    rels = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.'
            'openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://'
            'schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def write_case_dir(d):
    d.mkdir(parents=True, exist_ok=True)
    (d / "title.csv").write_text(TITLE_CSV)
    (d / "snake.csv").write_text(SNAKE_CSV)
    (d / "records.json").write_text(json.dumps(RECORDS))
    (d / "indexed.json").write_text(json.dumps(INDEXED))
    (d / "columns.json").write_text(json.dumps(COLUMNS))
    (d / "single.json").write_text(json.dumps(SINGLE))
    (d / "empty.json").write_text("{}")
    (d / "broken.json").write_text("{not json")
    (d / "ragged.json").write_text(json.dumps(RAGGED))
    write_xlsx(d / "book.xlsx", [
        ["Ticket ID", "Issue", "Description", "Category", "Resolution", "Agent Name", "Resolved"],
        ["X-1", "Laptop", "Screen flickers", "Hardware", "Driver update", "Eve", True],
        ["X-2", "Account", "Locked out", "Account Management", None, "Eve", False],
    ])
    return d
