"""Column functions over text. All are built-in Spark expressions (JVM side,
whole-stage codegen), usable in ``select``/``withColumn`` or from SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators and patterns that define the text forms.
# Any run of Unicode white space (``(?U)`` makes ``\s`` Unicode aware, so that
# U+00A0 is white space as it is for Python's ``str.split``).
WHITESPACE_RUN = r"(?U)\s+"
EDGE_WHITESPACE = r"(?U)^\s+|\s+$"
# A term is a maximal run of Unicode letters and digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Labelled form of the text that is embedded.
DENSE_TEXT_ISSUE_LABEL = "Issue: "
DENSE_TEXT_DESCRIPTION_LABEL = ". Description: "
# Separator of the dropdown label "id: issue".
LABEL_SEPARATOR = ": "
ELLIPSIS = "..."


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(_c(c), EDGE_WHITESPACE, "")


def clean_text(c: Column | str) -> Column:
    """Strip, and collapse every white-space run to one space."""
    return F.trim(F.regexp_replace(_c(c), WHITESPACE_RUN, " "))


def dense_text(issue: Column | str, description: Column | str) -> Column:
    """Labelled issue + description, cleaned (P4): the text that is embedded."""
    return clean_text(F.concat(
        F.lit(DENSE_TEXT_ISSUE_LABEL), F.coalesce(_c(issue), F.lit("")),
        F.lit(DENSE_TEXT_DESCRIPTION_LABEL), F.coalesce(_c(description), F.lit(""))))


def sparse_text(issue: Column | str, description: Column | str) -> Column:
    """``issue + ' ' + description`` uncleaned (P5): the keyword-search text."""
    return F.concat(F.coalesce(_c(issue), F.lit("")), F.lit(" "),
                    F.coalesce(_c(description), F.lit("")))


def tokenize(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-cased letter/digit runs, empty strings removed.

    ``stop_words`` (optional, off by default) are dropped as well; document
    lengths then count only the remaining terms, as an analyser would.
    """
    if not stop_words:
        return F.filter(F.split(F.lower(_c(c)), TOKEN_SPLIT), lambda t: t != "")
    stops = F.array(*[F.lit(w.lower()) for w in sorted(set(stop_words))])
    return F.filter(F.split(F.lower(_c(c)), TOKEN_SPLIT),
                    lambda t: (t != "") & ~F.array_contains(stops, t))


def first_line(c: Column | str) -> Column:
    return F.split_part(_c(c), F.lit("\n"), F.lit(1))


def preview(c: Column | str, n: int) -> Column:
    """First ``n`` characters followed by '...' when the text is longer."""
    col = _c(c)
    return (F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(ELLIPSIS)))
            .otherwise(col))


def choice_label(ticket_id: Column | str, issue: Column | str) -> Column:
    """``"id: issue"`` dropdown label."""
    return F.concat_ws(LABEL_SEPARATOR, _c(ticket_id), _c(issue))


def parse_label(c: Column | str) -> Column:
    """The id back from a label: text before the first ':' stripped."""
    return strip(F.split_part(_c(c), F.lit(":"), F.lit(1)))


def fmt_fixed(c: Column | str, digits: int) -> Column:
    """Fixed-point text of a double with ``digits`` decimals (``%.2f``)."""
    return F.format_string(f"%.{digits}f", _c(c).cast("double"))


def or_missing(c: Column | str, missing: str) -> Column:
    """NULL shown as ``missing``; booleans and numbers shown as text."""
    return F.coalesce(_c(c).cast("string"), F.lit(missing))

