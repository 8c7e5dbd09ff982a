"""Clocks, watermarks and instants. The session time zone must be UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltaboard.functions.text import strip_blanks

_DATE_TIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
_FRACTION = r"(?:\.\d{1,9})?"


def clock(now: Column | datetime | str) -> Column:
    """A fixed instant, or a column such as the fetch time of each snapshot."""
    if isinstance(now, Column):
        return now
    text = now.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(now, datetime) else now
    return F.lit(text).cast("timestamp")


def to_epoch_ms(value: Column) -> Column:
    """Epoch milliseconds of a watermark: number, instant, or zoneless UTC; else 0.

    The shapes of texts are checked first because a plain cast also accepts partial
    dates. Columns of fractional types lose their fraction.
    """
    text = F.upper(strip_blanks(value.cast("string")))
    number = F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("bigint"))
    instant = F.when(
        text.rlike(rf"^{_DATE_TIME}:\d{{2}}{_FRACTION}(?:Z|[+-]\d{{2}}:\d{{2}})$"),
        F.unix_millis(text.try_cast("timestamp")),
    )
    to_seconds = F.when(text.rlike(rf"^{_DATE_TIME}$"), F.concat(text, F.lit(":00"))).otherwise(text)
    zoneless = F.when(
        text.rlike(rf"^{_DATE_TIME}(?::\d{{2}}{_FRACTION})?$"),
        F.unix_millis(F.concat(to_seconds, F.lit("Z")).try_cast("timestamp")),
    )
    fractional = F.when(
        F.typeof(value).rlike("^(double|float|decimal)"), value.cast("string").try_cast("double").try_cast("bigint")
    )
    return F.coalesce(fractional, number, instant, zoneless, F.lit(0).cast("bigint"))


def numeric_prefix(value: Column) -> Column:
    """Leading integer of a text, 0 without one, held to the BIGINT range."""
    digits = F.regexp_extract(value, r"^\s*([+-]?\d+)", 1)
    edge = F.when(digits.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(
        F.coalesce(digits.try_cast("bigint"), edge)
    )


def _fraction(ts: Column) -> Column:
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return (
        F.when(micros == 0, "")
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("bigint").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    )


def iso_local(ts: Column) -> Column:
    """Zoneless ISO stamp with 0, 3 or 6 fraction digits."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), _fraction(ts))


def iso_instant(ts: Column) -> Column:
    return F.concat(iso_local(ts), F.lit("Z"))


def whole_minutes_until(later: Column, earlier: Column) -> Column:
    """Full minutes from ``earlier`` to ``later``, cut towards zero."""
    return ((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000)).cast("bigint")
