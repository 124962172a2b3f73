"""Case files: CSV, JSON, XLSX → normalised cases + rejects.

Each reader yields ``(rec map<string,string>, _source_file, _row)`` rows;
``operators.normalize`` turns ``rec`` into the case schema. Files that
cannot be read are not fatal: they go to a ``rejects(source_file, reason)``
table and the other files still load (S7).

* CSV: ``csv_ranges`` cuts files into records, many tasks a file, quoted
  newlines included; a file's header names its columns, read as text by place.
* JSON: ``json_ranges`` cuts lists of records into elements, many tasks a
  file; files of the other shapes (index-oriented, column arrays, single
  object) are one value each, detected with ``from_json`` under three
  schemas and expanded with higher-order functions.
* JSON Lines (``*.jsonl``): one object per line, read as splittable text;
  the scale path for very large inputs.
* XLSX: ``binaryFile`` + ``mapInPandas``; each workbook is parsed in the
  task with the standard library (zip + XML); no Excel package is needed.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.operators.normalize import normalize_records
from precedent.schema import CASE_SCHEMA, REJECT_SCHEMA
from precedent.session import materialize
from precedent.sources.csv_ranges import csv_rows
from precedent.sources.json_ranges import json_elements

SOURCE_COLS = ["_source_file", "_row"]
#: A quoted CSV field; commas inside it part no fields.
QUOTED = r'"[^"]*("|\z)'
RECORD_SCHEMA = T.StructType([
    T.StructField("rec", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_source_file", T.StringType()),
    T.StructField("_row", T.LongType()),
])


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _glob(path: str, ext: str) -> str:
    return path if path.endswith(ext) else path.rstrip("/") + f"/*{ext}"


def _exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(conf).globStatus(p)
    return found is not None and len(found) > 0


# ------------------------------------------------------------------ CSV
def _empty_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files of no bytes, which Spark's readers pass over."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [s.getPath().toString() for s in found or [] if s.isFile() and s.getLen() == 0]


def column_names(header: str) -> list[str]:
    """Names of a header line: a blank name is called by its place, a repeated one numbered."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([header]))):
        name = new = name or f"Unnamed: {i}"
        n = 0
        while new in names:
            n += 1
            new = f"{name}.{n}"
        names.append(new)
    return names


def _header_names(batches):
    import pyarrow as pa

    for batch in batches:
        names = [column_names(h) for h in batch.column("header").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("at"), pa.array(names, pa.list_(pa.string()))],
                                         names=["f", "at", "names"])


def _csv_records(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Columns are read by place and named by the file's header, so names that differ only in
    case stay apart. A file without a header, with a row of more fields than its header, or with
    bytes that are not UTF-8 is rejected whole; shorter rows are filled with NULL. Headers are a
    table, a row a file; only the greatest number of columns reaches the driver."""
    if not _exists(spark, pattern):
        return _empty(spark, RECORD_SCHEMA), _empty(spark, REJECT_SCHEMA)
    rows, states = csv_rows(spark, pattern)
    first = rows.where(F.trim("text") != "").groupBy("f").agg(F.min(F.struct("row", "text")).alias("h"))
    headers, width = materialize(
        first.select("f", F.col("h.row").alias("at"), F.col("h.text").alias("header"))
        .mapInArrow(_header_names, "f string, at long, names array<string>"), "csv-headers",
        {"width": F.max(F.size("names"))})
    files = states.groupBy("f").agg(F.min("bad_line").alias("bad_line"))
    empty = spark.createDataFrame([(f, "no header line") for f in _empty_files(spark, pattern)], REJECT_SCHEMA)
    rejects = empty.unionByName(files.join(headers, "f", "left_anti").where("bad_line is null").select(
        F.col("f").alias("source_file"), F.lit("no header line").alias("reason")))
    broken = files.where("bad_line is not null").select(F.col("f").alias("source_file"), F.concat(
        F.lit("line "), F.col("bad_line").cast("string"), F.lit(" is not UTF-8")).alias("reason"))
    rejects = rejects.unionByName(broken)
    if not width["width"]:
        return _empty(spark, RECORD_SCHEMA), rejects
    schema = ", ".join(f"c{i} string" for i in range(width["width"]))
    parsed = F.from_csv("text", schema, {"escape": '"'})
    fields = F.array(*[F.col("p")[f"c{i}"] for i in range(width["width"])])
    n_fields = F.size(F.split(F.regexp_replace("text", QUOTED, ""), ",", -1))
    data = rows.join(headers, "f").where("row > at").withColumn("p", parsed).select(
        F.map_from_arrays("names", F.slice(fields, 1, F.size("names"))).alias("rec"),
        F.col("f").alias("_source_file"), F.col("row").alias("_row"), (n_fields > F.size("names")).alias("_long"))
    # Parsed once; both results read the written rows.
    data = materialize(data, "csv-records")
    long = data.where("_long").select("_source_file").distinct()
    rejects = rejects.unionByName(long.join(broken, F.col("_source_file") == F.col("source_file"), "left_anti").select(
        F.col("_source_file").alias("source_file"), F.lit("row has more fields than the header").alias("reason")))
    out = long.unionAll(broken.select("source_file")).distinct()
    return data.join(out, "_source_file", "left_anti").select("rec", "_source_file", "_row"), rejects


def read_csv_records(spark: SparkSession, pattern: str) -> DataFrame:
    return _csv_records(spark, pattern)[0]


def csv_rejects(spark: SparkSession, pattern: str) -> DataFrame:
    """``(source_file, reason)`` of the CSV files that cannot be read."""
    return _csv_records(spark, pattern)[1]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV(s) → normalised cases (S1 + P1)."""
    return normalize_records(read_csv_records(spark, _glob(path, ".csv")), keep=SOURCE_COLS)


# ------------------------------------------------------------------ JSON
def _json_records(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Arrays of objects are cut by byte ranges, many tasks a file; the other shapes are one value a file."""
    elements, broken, single = json_elements(spark, pattern)
    # Parsed once; records and rejects read the written rows.
    listed = materialize(elements.select("f", "row", F.from_json("text", "map<string,string>").alias("rec")), "json-list")
    broken = broken.unionAll(listed.where("rec is null").select("f")).distinct()
    raw = single.select(F.col("f").alias("_source_file"), "value")
    v = F.col("value")
    idx = F.from_json(v, "map<string,map<string,string>>")
    cols = F.from_json(v, "map<string,array<string>>")
    obj = F.from_json(v, "map<string,string>")
    # By JSON type, not by the text: a string may begin with a bracket.
    types = F.transform(F.map_values(F.try_parse_json(v).cast("map<string,variant>")), F.schema_of_variant)
    nested = F.coalesce(F.forall(types, lambda t: t.startswith("ARRAY") | t.startswith("OBJECT")), F.lit(False))
    # Parsed once and written: as expressions, the lookups of every row and column below would each parse the file.
    parsed = materialize(raw.select("_source_file", idx.alias("idx"), cols.alias("cols"), obj.alias("obj"),
                                    nested.alias("nested")), "json-parsed")
    names_i = F.map_keys("idx")
    first_i = F.element_at("idx", F.element_at(names_i, 1))
    keys_i = F.array_sort(F.transform(F.map_keys(first_i),
                                      lambda k: F.struct(k.try_cast("int").alias("i"),
                                                         k.alias("k"))))
    idx_missing = F.exists(names_i, lambda c: F.exists(
        F.map_keys(first_i), lambda k: ~F.map_contains_key(F.element_at("idx", c), k)))
    idx_badkey = F.exists(keys_i, lambda e: e["i"].isNull())
    idx_rows = F.transform(keys_i, lambda e: F.map_from_arrays(
        names_i, F.transform(names_i, lambda c: F.element_at(F.element_at("idx", c), e["k"]))))
    names_c = F.map_keys("cols")
    first_c = F.element_at("cols", F.element_at(names_c, 1))
    col_short = F.exists(names_c, lambda c: F.size(F.element_at("cols", c)) < F.size(first_c))
    col_rows = F.transform(first_c, lambda x, i: F.map_from_arrays(
        names_c, F.transform(names_c, lambda c: F.try_element_at(F.element_at("cols", c), i + 1))))

    def whole(c: str):
        """All values have the type asked for; a null among them makes the file one record."""
        return F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(F.map_values(c), lambda x: x.isNotNull())

    kind = (F.when(whole("idx"), "indexed")
            .when(whole("cols"), "columns")
            .when(F.col("obj").isNotNull() & (F.size("obj") == 0), "empty")
            .when(F.col("obj").isNotNull() & F.col("nested"), "mixed")
            .when(F.col("obj").isNotNull(), "object")
            .otherwise("invalid"))
    shaped = parsed.withColumn("kind", kind).withColumn(
        "reason",
        F.when(F.col("kind") == "invalid", F.lit("not a JSON object or list of objects"))
        .when(F.col("kind") == "mixed", F.lit("columnar file mixes arrays and objects"))
        .when((F.col("kind") == "indexed") & idx_badkey, F.lit("row index is not an integer"))
        .when((F.col("kind") == "indexed") & idx_missing, F.lit("row index missing in a column"))
        .when((F.col("kind") == "columns") & col_short, F.lit("column shorter than the first")))
    good = shaped.filter(F.col("reason").isNull()).withColumn(
        "records",
        F.when(F.col("kind") == "indexed", idx_rows)
        .when(F.col("kind") == "columns", col_rows)
        .when(F.col("kind") == "object", F.array(F.col("obj")))
        .otherwise(F.array().cast("array<map<string,string>>")))
    recs = good.select("_source_file", F.posexplode("records").alias("_row", "rec")) \
        .select("rec", "_source_file", F.col("_row").cast("long"))
    recs = recs.unionByName(listed.join(broken, "f", "left_anti").select(
        "rec", F.col("f").alias("_source_file"), F.col("row").alias("_row")))
    rejects = shaped.filter(F.col("reason").isNotNull()) \
        .select(F.col("_source_file").alias("source_file"), "reason")
    rejects = rejects.unionByName(broken.select(
        F.col("f").alias("source_file"), F.lit("not a JSON object or list of objects").alias("reason")))
    return recs, rejects


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON file(s) of any of the four shapes → normalised cases (S3-S6 + P1); ``path`` is a folder or a pattern."""
    records = _json_records(spark, path if "*" in path else _glob(path, ".json"))[0]
    return normalize_records(records, keep=SOURCE_COLS)


def _jsonl_records(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """JSON Lines: one object per line, read line by line (splittable, the
    scale path); a line that is not an object becomes a reject."""
    lines = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("_source_file"),
        F.monotonically_increasing_id().alias("_row"), "value")
    lines = lines.filter(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("rec", F.from_json("value", "map<string,string>"))
    recs = parsed.filter(F.col("rec").isNotNull()).select("rec", "_source_file", "_row")
    rejects = parsed.filter(F.col("rec").isNull()).select(
        F.col("_source_file").alias("source_file"),
        F.lit("line is not a JSON object").alias("reason"))
    return recs, rejects


# ------------------------------------------------------------------ XLSX
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Fixed values of the file format: built-in number formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _col_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indices of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or ""
           for f in root.findall("m:numFmts/m:numFmt", _NS)}

    def shows_date(fmt: int) -> bool:
        if fmt not in own:
            return fmt in DATE_FORMATS
        # Quoted text, escaped characters and bracketed colours hold no date letters.
        return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own[fmt].lower())))

    return {k for k, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS))
            if shows_date(int(xf.get("numFmtId") or 0))}


def _date_text(serial: float, epoch: datetime) -> str:
    """A date cell's serial number as timestamp text; below one it is a time of day."""
    if epoch.year == 1899 and 1 <= serial < 60:
        serial += 1          # the format counts a 29 February 1900
    at = epoch + timedelta(milliseconds=round(serial * 86_400_000))
    return str(at.time() if 0 <= serial < 1 else at)


def parse_xlsx(data: bytes) -> list[dict]:
    """Rows of the first worksheet as dicts keyed by the header row."""
    z = zipfile.ZipFile(io.BytesIO(data))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    props = wb.find("m:workbookPr", _NS)
    late = props is not None and props.get("date1904") in ("1", "true")
    epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
    dates = _date_styles(z)
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels.findall("p:Relationship", _NS)
                  if r.get("Id") == rid)
    target = target.lstrip("/")
    path = target if target.startswith("xl/") else "xl/" + target
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in sst.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    grid: list[list] = []
    for row in ET.fromstring(z.read(path)).iter(f"{{{_NS['m']}}}row"):
        vals: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s":
                val = shared[int(v.text)] if v is not None else None
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            elif t == "b":
                val = None if v is None else ("true" if v.text == "1" else "false")
            elif t in (None, "n") and v is not None and v.text and int(c.get("s") or 0) in dates:
                val = _date_text(float(v.text), epoch)
            else:
                val = None if v is None else v.text
            vals[_col_index(c.get("r"))] = val
        if vals:
            grid.append([vals.get(i) for i in range(max(vals) + 1)])
    if not grid:
        return []
    header = [h for h in grid[0]]
    out = []
    for r in grid[1:]:
        if all(x is None for x in r):
            continue
        out.append({h: (r[i] if i < len(r) else None)
                    for i, h in enumerate(header) if h is not None})
    return out


XLSX_OUT = T.StructType([
    T.StructField("_source_file", T.StringType()),
    T.StructField("_row", T.LongType()),
    T.StructField("rec_json", T.StringType()),
    T.StructField("reason", T.StringType()),
])


def _xlsx_rows(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                recs = parse_xlsx(bytes(content))
                rows += [(path, i, json.dumps(r), None) for i, r in enumerate(recs)]
            except Exception as e:  # noqa: BLE001 - a bad workbook becomes a reject
                rows.append((path, None, None, f"unreadable workbook: {type(e).__name__}"))
        yield pd.DataFrame(rows, columns=["_source_file", "_row", "rec_json", "reason"])


def _xlsx_records(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    rows = files.mapInPandas(_xlsx_rows, XLSX_OUT)
    recs = rows.filter(F.col("reason").isNull()).select(
        F.from_json("rec_json", "map<string,string>").alias("rec"), "_source_file", "_row")
    rejects = rows.filter(F.col("reason").isNotNull()).select(
        F.col("_source_file").alias("source_file"), "reason")
    return recs, rejects


# ------------------------------------------------------------------ directory
def read_records(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """All ``*.csv``, ``*.xlsx``, ``*.json``, ``*.jsonl`` under ``directory`` →
    (records, rejects)."""
    first = _csv_records(spark, _glob(directory, ".csv"))
    recs, rejects = [first[0]], [first[1]]
    for ext, reader in ((".xlsx", _xlsx_records), (".json", _json_records),
                        (".jsonl", _jsonl_records)):
        pattern = _glob(directory, ext)
        if _exists(spark, pattern):
            r, j = reader(spark, pattern)
            recs.append(r)
            rejects.append(j)
    out, bad = recs[0], rejects[0]
    for r in recs[1:]:
        out = out.unionByName(r)
    for j in rejects[1:]:
        bad = bad.unionByName(j)
    return out, bad


def read_cases(spark: SparkSession, directory: str, only_resolved: bool = False
               ) -> tuple[DataFrame, DataFrame]:
    """Normalised cases of every supported file + rejects."""
    recs, rejects = read_records(spark, directory)
    cases = normalize_records(recs, keep=SOURCE_COLS)
    if only_resolved:
        cases = cases.filter(F.coalesce(F.col("resolved"), F.lit(False)))
    return cases, rejects


def read_new(spark: SparkSession, path: str) -> DataFrame:
    """New tickets from CSV; an unreadable or missing source gives an empty frame."""
    try:
        return read_csv(spark, path)
    except Exception:  # noqa: BLE001 - the reference returns an empty list here
        schema = T.StructType(CASE_SCHEMA.fields + [
            T.StructField("_source_file", T.StringType()), T.StructField("_row", T.LongType())])
        return _empty(spark, schema)
