"""Normalisation of heterogeneous case records to one schema (P1, P2; N1-N7).

Every reader turns a source row into ``rec: map<string,string>`` holding
exactly the keys its file (CSV/XLSX header) or its JSON object has, so key
*presence* is per file or per record, never widened by a union (N2).

A key matches a field when ``lower(replace(key, ' ', '_'))`` equals the
field name (so ``Ticket ID``, ``ticket_id`` and ``TICKET ID`` all match);
when several keys match, a non-snake spelling ("Title form") wins (N1).
A missing key or NULL cell gets the field default (N3, N4). The resolution
group (resolution, agent_name, resolved) exists only when a resolution key
is present; otherwise the three are NULL (N5). ``resolved`` goes through
``parse_flag`` (N6, N7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precedent.functions.flags import parse_flag
from precedent.schema import DEFAULT_CATEGORY, DEFAULT_TICKET_ID

FIELD_DEFAULTS = {
    "ticket_id": DEFAULT_TICKET_ID,
    "issue": "",
    "description": "",
    "category": DEFAULT_CATEGORY,
    "date": "",
}


def _matches(rec: Column, field: str) -> Column:
    """Entries of ``rec`` whose key names ``field``, Title-form spellings first."""
    hits = F.filter(F.map_entries(rec),
                    lambda e: F.lower(F.replace(e["key"], F.lit(" "), F.lit("_"))) == field)
    # Sort key: snake spelling last, then by key text for determinism.
    keyed = F.transform(hits, lambda e: F.struct((e["key"] == field).alias("snake"),
                                                 e["key"].alias("key"), e["value"].alias("value")))
    return F.array_sort(keyed)


def field_present(rec: Column, field: str) -> Column:
    return F.size(_matches(rec, field)) > 0


def field_value(rec: Column, field: str) -> Column:
    """Value of the winning key, or NULL when absent."""
    return F.get(_matches(rec, field), 0)["value"]


def normalize_records(df: DataFrame, rec: str = "rec", keep: list[str] | None = None
                      ) -> DataFrame:
    """``rec`` map → normalised case columns (P1). ``keep`` columns pass through."""
    m = F.col(rec)
    cols = [F.coalesce(field_value(m, f), F.lit(d)).alias(f) for f, d in FIELD_DEFAULTS.items()]
    has_res = field_present(m, "resolution")
    cols += [
        F.when(has_res, F.coalesce(field_value(m, "resolution"), F.lit(""))).alias("resolution"),
        F.when(has_res, F.coalesce(field_value(m, "agent_name"), F.lit(""))).alias("agent_name"),
        F.when(has_res, parse_flag(field_value(m, "resolved"))).alias("resolved"),
    ]
    return df.select(*cols, *[F.col(c) for c in (keep or [])])


def row_to_record(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A flat row's columns as ``map<string,string>`` (NULL cells kept as NULL)."""
    names = columns or df.columns
    pairs = []
    for n in names:
        pairs += [F.lit(n), F.col(f"`{n}`").cast("string")]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
