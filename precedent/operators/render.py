"""Rendering of prompts, reports and markdown (R1-R6, P7) as column expressions.

Each renderer turns a result row (query fields + ``similar_tickets`` array,
ordered by rank) into text with built-in functions only: ``transform`` with
the element index numbers the neighbours, ``array_join`` concatenates them.
NULL values are shown as ``N/A``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precedent.functions.text import or_missing, preview, strip
from precedent.schema import ALL_CATEGORIES, MISSING, NO_MATCH_MESSAGE

# Text-report layout (rules of 80 '=' or '-', section titles).
_RULE, _DASH = "=" * 80, "-" * 80
REPORT_BANNER = f"{_RULE}\nIT HELPDESK TICKET RECOMMENDATIONS\n{_RULE}"
REPORT_HEAD = f"\n{_RULE}\nTICKET %d: %s\n{_RULE}"
REPORT_FIELDS = "\nIssue: %s\nDescription: %s\nCategory: %s\n"
REPORT_SIMILAR = f"\n{_DASH}\nSIMILAR TICKETS:\n{_DASH}"
REPORT_NEIGHBOUR = ("\n%d. %s (similarity %.3f)\n   Issue: %s\n   Category: %s\n"
                    "   Resolution: %s\n   Handled by: %s")
REPORT_RECOMMENDATION = f"\n\n{_DASH}\nRECOMMENDATION:\n{_DASH}\n"
REPORT_TIME = "\n\nProcessing time: %s"
REPORT_ERROR = "\n\nERROR: %s\n"
REPORT_FOOTER = f"\n{_RULE}\nTotal tickets processed: %d\n{_RULE}"
# Status words and markdown colours.
RESOLVED_WORD = "RESOLVED"
UNRESOLVED_WORD = "UNRESOLVED"
RESOLVED_COLOUR = "#28a745"
UNRESOLVED_COLOUR = "#ffc107"
MANUAL_ID_PREFIX = "MANUAL-"
MANUAL_ID_FORMAT = "yyyyMMdd-HHmmss"

PROMPT_HEAD = ("You support an IT service desk. Recommend how to resolve the new ticket "
               "below, using the similar past tickets listed after it.\n\n")
PROMPT_NEIGHBOUR = ("[%d] similarity %.2f, status %s\n"
                    "Ticket ID: %s\nIssue: %s\nDescription: %s\nCategory: %s\n"
                    "Resolution: %s\nHandled by: %s\n%s")
PROMPT_CAUTION = "Caution: this ticket was never fully resolved; its resolution is unproven.\n"
MD_HEAD = ("## Recommendation\n\n%s\n\n---\n\n**Processing time:** %s | "
           "**Similar tickets found:** %d\n\n---\n\n## Similar tickets\n")
MD_BLOCK = ("\n<details%s>\n<summary><b>Similar ticket #%d - %s (similarity %.1f%%)</b> "
            "<span style=\"color: %s; font-weight: bold;\">[%s]</span></summary>\n\n"
            "**Issue:** %s\n\n**Category:** %s\n\n**Description:** %s\n\n"
            "**Resolution:** %s\n\n**Handled by:** %s\n\n</details>\n")
MD_EMPTY = "\n*No similar tickets found in the database.*\n"
NO_RECOMMENDATION = "No recommendation available"
PROMPT_QUERY = ("NEW TICKET\nTicket ID: %s\nIssue: %s\nDescription: %s\n"
                "Category: %s\n\nSIMILAR PAST TICKETS\n\n")
REC_NONE = "No resolved similar ticket is available; review the similar tickets before acting."
REC_LEAD = "Apply the resolution of %s (similarity %.2f): %s"
REC_CAUTION_HEAD = " Caution: "
REC_CAUTION_TAIL = " not fully resolved; use those steps with care."
PROMPT_TAIL = ("\nGive concrete steps the agent can take. If a similar ticket is "
               "unresolved, say so and advise care with its steps.\n\nRECOMMENDATION:")


def _m(c: Column) -> Column:
    return or_missing(c, MISSING)


def _status(resolved: Column) -> Column:
    return F.when(F.coalesce(resolved, F.lit(False)), F.lit(RESOLVED_WORD)) \
        .otherwise(F.lit(UNRESOLVED_WORD))


def build_prompt(ticket_id="ticket_id", issue="issue", description="description",
                 category="category", similar="similar_tickets") -> Column:
    """Prompt text for one query and its ranked neighbours."""
    def block(x, i):
        caution = F.when(F.coalesce(x["resolved"], F.lit(False)), F.lit("")) \
            .otherwise(F.lit(PROMPT_CAUTION))
        return F.format_string(
            PROMPT_NEIGHBOUR, (i + 1).cast("int"), F.coalesce(x["similarity_score"], F.lit(0.0)),
            _status(x["resolved"]), _m(x["ticket_id"]), _m(x["issue"]),
            _m(x["description"]), _m(x["category"]), _m(x["resolution"]),
            _m(x["agent_name"]), caution)
    head = F.format_string(PROMPT_QUERY,
                           _m(F.col(ticket_id)), _m(F.col(issue)), _m(F.col(description)),
                           _m(F.col(category)))
    blocks = F.array_join(F.transform(F.col(similar), block), "\n")
    return F.concat(F.lit(PROMPT_HEAD), head, blocks, F.lit(PROMPT_TAIL))


def extractive_recommendation(similar="similar_tickets") -> Column:
    """Default generator (M3) with the no-match fallback (M4).

    The resolution of the best-ranked resolved neighbour with a non-empty
    resolution, plus a caution naming the unresolved neighbours.
    """
    s = F.col(similar)
    usable = F.filter(s, lambda x: F.coalesce(x["resolved"], F.lit(False))
                      & (F.length(x["resolution"]) > 0))
    best = F.get(usable, 0)
    open_ids = F.transform(F.filter(s, lambda x: ~F.coalesce(x["resolved"], F.lit(False))),
                           lambda x: _m(x["ticket_id"]))
    lead = F.when(best.isNull(), F.lit(REC_NONE)) \
        .otherwise(F.format_string(REC_LEAD,
                                   best["ticket_id"], best["similarity_score"],
                                   best["resolution"]))
    caution = F.when(F.size(open_ids) > 0, F.concat(
        F.lit(REC_CAUTION_HEAD), F.array_join(open_ids, ", "),
        F.when(F.size(open_ids) == 1, F.lit(" was")).otherwise(F.lit(" were")),
        F.lit(REC_CAUTION_TAIL))).otherwise(F.lit(""))
    return F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, F.lit(NO_MATCH_MESSAGE)) \
        .otherwise(F.concat(lead, caution))


def markdown(recommendation="recommendation", similar="similar_tickets",
             seconds="processing_time_seconds") -> Column:
    """Markdown view of one result (R3): recommendation, counts, one collapsible
    block per neighbour (the first open), status badge and colour."""
    s = F.col(similar)

    def block(x, i):
        ok = F.coalesce(x["resolved"], F.lit(False))
        badge = F.when(ok, F.lit("RESOLVED")).otherwise(F.lit("UNRESOLVED"))
        colour = F.when(ok, F.lit(RESOLVED_COLOUR)).otherwise(F.lit(UNRESOLVED_COLOUR))
        return F.format_string(
            MD_BLOCK,
            F.when(i == 0, F.lit(" open")).otherwise(F.lit("")), (i + 1).cast("int"),
            _m(x["ticket_id"]), F.coalesce(x["similarity_score"], F.lit(0.0)) * 100.0,
            colour, badge, _m(x["issue"]), _m(x["category"]), _m(x["description"]),
            _m(x["resolution"]), _m(x["agent_name"]))
    head = F.format_string(
        MD_HEAD,
        F.coalesce(F.col(recommendation), F.lit(NO_RECOMMENDATION)),
        F.when(F.col(seconds).isNotNull(), F.format_string("%.2f s", F.col(seconds)))
        .otherwise(F.lit(MISSING)),
        F.coalesce(F.size(s), F.lit(0)))
    empty = F.when(F.coalesce(F.size(s), F.lit(0)) <= 0,
                   F.lit(MD_EMPTY)).otherwise(F.lit(""))
    return F.concat(head, F.array_join(F.transform(s, block), ""), empty)


def report_block(ordinal="result_no", ticket_id="ticket_id", issue="issue",
                 description="description", category="category", similar="similar_tickets",
                 recommendation="recommendation", seconds="processing_time_seconds",
                 error="error") -> Column:
    """One result of the text report (R2); the error variant when ``error`` is set."""
    def nb(x, i):
        return F.format_string(REPORT_NEIGHBOUR, (i + 1).cast("int"), _m(x["ticket_id"]),
                               F.coalesce(x["similarity_score"], F.lit(0.0)), _m(x["issue"]),
                               _m(x["category"]), _m(x["resolution"]), _m(x["agent_name"]))
    head = F.format_string(REPORT_HEAD, F.col(ordinal).cast("int"), _m(F.col(ticket_id)))
    ok = F.concat(
        F.format_string(REPORT_FIELDS, _m(F.col(issue)), _m(F.col(description)),
                        _m(F.col(category))),
        F.lit(REPORT_SIMILAR),
        F.array_join(F.transform(F.col(similar), nb), ""),
        F.lit(REPORT_RECOMMENDATION),
        _m(F.col(recommendation)),
        F.format_string(REPORT_TIME, _m(F.col(seconds))))
    bad = F.format_string(REPORT_ERROR, F.col(error))
    return F.concat(head, F.when(F.col(error).isNotNull(), bad).otherwise(ok))


def report_footer(total: Column) -> Column:
    return F.format_string(REPORT_FOOTER, total.cast("long"))


def recommendation_preview(c="recommendation", n: int = 500) -> Column:
    """First 500 characters of a recommendation."""
    return preview(c, n)


def manual_ticket(issue="issue", description="description", category="category",
                  seq: Column | None = None) -> list[Column]:
    """Columns of a ticket typed into a form (R6): stripped fields, a time-based
    id (with a row suffix so two tickets in the same second differ), and the
    'All Categories' choice turned into NULL (no category filter)."""
    stamp = F.date_format(F.current_timestamp(), MANUAL_ID_FORMAT)
    tid = F.concat(F.lit(MANUAL_ID_PREFIX), stamp)
    if seq is not None:
        tid = F.concat(tid, F.lit("-"), seq.cast("string"))
    return [tid.alias("ticket_id"), strip(F.col(issue)).alias("issue"),
            strip(F.col(description)).alias("description"),
            F.nullif(F.col(category), F.lit(ALL_CATEGORIES)).alias("category")]
