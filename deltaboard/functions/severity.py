"""Line status severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltaboard.functions.lookups import CODES_BY_PRIORITY, GOOD_SERVICE, GOOD_SERVICE_MESSAGES
from deltaboard.functions.text import strip_blanks


def parse_severity(raw: Column) -> Column:
    """Severity code of a number or a numeric text, else null."""
    text = raw.cast("string")
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def severity_priority(code: Column) -> Column:
    rank = F.lit(0)
    for priority, codes in CODES_BY_PRIORITY.items():
        rank = F.when(code.isin(codes), F.lit(priority)).otherwise(rank)
    return rank


def is_good_service(description: Column) -> Column:
    return F.coalesce(F.lower(description) == GOOD_SERVICE.lower(), F.lit(False))


def has_text(c: Column) -> Column:
    return F.coalesce(strip_blanks(c), F.lit("")) != ""


def good_service_message(index: Column) -> Column:
    """Message number ``index`` modulo the number of messages."""
    messages = F.array(*[F.lit(text) for text in GOOD_SERVICE_MESSAGES])
    return F.element_at(messages, (F.pmod(index, F.lit(len(GOOD_SERVICE_MESSAGES))) + 1).cast("int"))


def message_index(line_id: Column, sync_id: Column) -> Column:
    """A stable choice of message: the same line and sync always get the same one."""
    return F.xxhash64(line_id, sync_id)


def worst_status(statuses: Column) -> Column:
    """Status to show out of the statuses of one line, as STRUCT<description, reason>.

    The highest priority wins and the first one on a tie. Entries whose severity
    cannot be read are passed over; if none can be read the first entry is
    shown, and a line without entries is 'Unknown'.
    """
    ranked = F.transform(
        statuses,
        lambda s, i: F.struct(
            severity_priority(parse_severity(s["statusSeverity"])).alias("priority"),
            (-i).alias("nearness"),
            parse_severity(s["statusSeverity"]).isNotNull().alias("readable"),
            s["statusSeverityDescription"].alias("description"),
            s["reason"].alias("reason"),
        ),
    )
    best = F.array_max(F.filter(ranked, lambda s: s["readable"]))
    chosen = F.coalesce(best, F.try_element_at(ranked, F.lit(1)))
    empty = F.coalesce(F.size(statuses), F.lit(0)) <= 0
    return F.struct(
        F.when(empty, "Unknown").otherwise(chosen["description"]).alias("description"),
        F.when(~empty, chosen["reason"]).alias("reason"),
    )
