"""Persistent case index: versioned Parquet tables + manifest switch.

Layout under ``root``::

    versions/<version>/cases      payload, keyed by ticket_id
    versions/<version>/vectors    ticket_id, category, embedding
    versions/<version>/postings   term, salt, doc_id, tf, doc_len, grp
    versions/<version>/terms      term, df, n_salts
    versions/<version>/stats.json n_docs, avgdl, params
    _manifests/<version>.json     {"version": ...}  (newest name wins)

An index is a list of segments, each the tables of one write; a case lives in the last segment
that has its key, and load hides the rows of earlier ones (an anti-join with the later segments'
keys; none for a single segment). ``upsert_index`` writes one new segment with the new cases only,
and the term table, whose counts are the old ones less those of the replaced cases. A version with
more than ``MAX_SEGMENTS`` is written anew as one segment. ``drop_old`` removes what no version of
the last few needs.

With ``category_parts`` the vectors and postings of every segment lie in that many folders by a hash of
the category, so that a search within categories reads the folders of these alone.

A rebuild writes a whole new version, then adds its manifest with a
rename, so readers never see a half-written index and a shorter rebuild
leaves no stale points (the index is replaced by ticket_id, not by list
position). ``upsert_cases`` merges new cases into old ones by ticket_id.
All I/O goes through Hadoop's FileSystem, so the root can be any shared
store the cluster mounts.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from precedent.operators.bm25 import KeywordIndex
from precedent.plans.case_index import PART, CaseIndex, category_part
from precedent.schema import RetrievalParams
from precedent.session import materialize

MANIFESTS = "_manifests"
#: An upsert that would leave more segments merges them into one.
MAX_SEGMENTS = 8


class IndexNotFound(RuntimeError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    lines = []
    line = reader.readLine()
    while line is not None:
        lines.append(line)
        line = reader.readLine()
    reader.close()
    return "\n".join(lines)


def _versions(root: str) -> str:
    return f"{root.rstrip('/')}/versions"


def _new_version() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # sorts by creation time


def _publish(spark: SparkSession, root: str, version: str, stats: dict) -> None:
    write_text(spark, f"{_versions(root)}/{version}/stats.json", json.dumps(stats))
    # A new manifest file per version, renamed into place: readers take the
    # newest name, so there is never a moment without a valid manifest.
    mdir = f"{root.rstrip('/')}/{MANIFESTS}"
    tmp = f"{mdir}/.{version}.tmp"
    write_text(spark, tmp, json.dumps({"version": version}))
    fs, p_tmp, jvm = _fs(spark, tmp)
    fs.rename(p_tmp, jvm.org.apache.hadoop.fs.Path(f"{mdir}/{version}.json"))


def _write_segment(index: CaseIndex, vdir: str, parts: int) -> dict:
    """Write the tables; returns the schemas of those in folders, which an empty table could not tell."""
    index.cases.write.parquet(f"{vdir}/cases")
    schemas = {}
    for name, rows, category, order in (("vectors", index.vectors, "category", []),
                                        ("postings", index.keywords.postings, "grp", ["term"])):
        rows, path = rows.drop(PART), f"{vdir}/{name}"
        if parts:
            rows = rows.withColumn(PART, category_part(category, parts))
            schemas[name] = rows.schema.json()
            rows.sortWithinPartitions(PART, *order).write.partitionBy(PART).parquet(path)
        else:
            rows.write.parquet(path)
    return schemas


def write_index(index: CaseIndex, root: str, category_parts: int | None = None) -> str:
    """Write every table of ``index`` as a new version of one segment and switch the manifest.

    ``category_parts``: number of folders by category (default: as the index has; 0: none)."""
    parts = index.category_parts if category_parts is None else category_parts
    if parts and not index.keywords.has_group:
        raise ValueError("index was built without a group column")
    spark = index.cases.sparkSession
    version = _new_version()
    vdir = f"{_versions(root)}/{version}"
    schemas = _write_segment(index, vdir, parts)
    index.keywords.terms.write.parquet(f"{vdir}/terms")
    stats = {"n_docs": index.keywords.n_docs, "avgdl": index.keywords.avgdl, "segments": [version],
             "has_group": index.keywords.has_group, "params": asdict(index.params),
             "stop_words": list(index.keywords.stop_words), "key": index.key,
             "category_parts": parts, "schemas": schemas}
    _publish(spark, root, version, stats)
    return version


def upsert_index(spark: SparkSession, root: str, new: CaseIndex) -> str:
    """Add the cases of ``new`` (an index over the new cases alone) to the index at ``root``; cases whose key
    is there already are replaced. Only the new segment and the term table are written."""
    old, stats = load_index(spark, root), _stats(spark, root)
    if new.key != old.key:
        raise ValueError(f"cases are keyed by {old.key}, the new ones by {new.key}")
    keys = new.cases.select(F.col(new.key).alias("doc_id")).distinct()
    gone = old.keywords.postings.join(keys, "doc_id", "left_semi")
    per_term = materialize(gone.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")),
                           "replaced-terms")
    n_gone = old.cases.join(keys, F.col(old.key) == keys["doc_id"], "left_semi").count()
    gone_terms = per_term.agg(F.sum("tf")).first()[0] or 0
    counts = (old.keywords.terms.select("term", "df", "n_salts")
              .unionByName(new.keywords.terms.select("term", "df", "n_salts"))
              .unionByName(per_term.select("term", (-F.col("df")).alias("df"), F.lit(1).alias("n_salts"))))
    # A posting keeps the salt of its segment; queries ask for all salts up to the greatest number.
    terms = counts.groupBy("term").agg(F.sum("df").alias("df"), F.max("n_salts").alias("n_salts")).where("df > 0")
    length = (round(old.keywords.n_docs * old.keywords.avgdl) - gone_terms
              + round(new.keywords.n_docs * new.keywords.avgdl))
    n_docs = old.keywords.n_docs - n_gone + new.keywords.n_docs
    version = _new_version()
    vdir = f"{_versions(root)}/{version}"
    _write_segment(new, vdir, old.category_parts)
    terms.write.parquet(f"{vdir}/terms")
    stats |= {"n_docs": n_docs, "avgdl": length / n_docs if n_docs else 0.0,
              "segments": [*stats["segments"], version]}
    _publish(spark, root, version, stats)
    if len(stats["segments"]) > MAX_SEGMENTS:
        return write_index(load_index(spark, root), root)
    return version


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the manifests before the last ``keep`` and the folders that none of these needs."""
    names = _manifest_names(spark, root)
    needed: set[str] = set()
    for name in names[-keep:]:
        needed |= {name, *_stats(spark, root, name)["segments"]}
    fs, p, jvm = _fs(spark, _versions(root))
    gone = sorted({st.getPath().getName() for st in fs.listStatus(p)} - needed)
    for name in names[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{MANIFESTS}/{name}.json"), False)
    for name in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{_versions(root)}/{name}"), True)
    return gone


def _manifest_names(spark: SparkSession, root: str) -> list[str]:
    fs, p, _ = _fs(spark, f"{root.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))


def current_version(spark: SparkSession, root: str) -> str | None:
    names = _manifest_names(spark, root)
    return json.loads(read_text(spark, f"{root.rstrip('/')}/{MANIFESTS}/{names[-1]}.json"))["version"] if names else None


def index_exists(spark: SparkSession, root: str) -> bool:
    return current_version(spark, root) is not None


def _stats(spark: SparkSession, root: str, version: str | None = None) -> dict:
    version = version or current_version(spark, root)
    if version is None:
        raise IndexNotFound(f"no case index at {root}; build it first")
    stats = json.loads(read_text(spark, f"{_versions(root)}/{version}/stats.json"))
    return {"segments": [version], **stats, "version": version}


def load_index(spark: SparkSession, root: str, version: str | None = None) -> CaseIndex:
    """The current version (or the one named); a missing index is an explicit error."""
    stats = _stats(spark, root, version)
    segments, key = stats["segments"], stats.get("key", "ticket_id")
    schemas = {n: T.StructType.fromJson(json.loads(s)) for n, s in stats.get("schemas", {}).items()}

    def table(name: str, id_col: str) -> DataFrame:
        """Rows of all segments whose key no later segment has."""
        out, later = None, None
        for seg in reversed(segments):
            read = spark.read if name not in schemas else spark.read.schema(schemas[name])
            rows = read.parquet(f"{_versions(root)}/{seg}/{name}")
            if later is not None:
                rows = rows.join(later.withColumnRenamed("_key", id_col), id_col, "left_anti")
            out = rows if out is None else out.unionByName(rows)
            if seg != segments[0]:
                keys = spark.read.parquet(f"{_versions(root)}/{seg}/cases").select(F.col(key).alias("_key"))
                later = keys if later is None else later.unionAll(keys)
        return out

    kw = KeywordIndex(table("postings", "doc_id"), spark.read.parquet(f"{_versions(root)}/{stats['version']}/terms"),
                      int(stats["n_docs"]), float(stats["avgdl"]), bool(stats["has_group"]),
                      tuple(stats.get("stop_words", [])))
    return CaseIndex(table("cases", key), table("vectors", key), kw, RetrievalParams(**stats["params"]), key,
                     int(stats.get("category_parts", 0)))


def point_count(index: CaseIndex) -> int:
    """Number of indexed cases (the reference reports it after loading)."""
    return index.vectors.count()


def upsert_cases(old: DataFrame, new: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Old cases whose key is not in ``new``, plus all of ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
