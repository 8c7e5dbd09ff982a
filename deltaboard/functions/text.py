"""Text rules for keys, destinations and platforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw texts that mean "no platform yet" (compared in lower case).
UNASSIGNED_PLATFORMS = ["null", "unknown", "platform unknown", "no platform"]
# Suffixes removed from destination names, in this order.
DESTINATION_NOISE = [" Underground Station", " Station", " DLR"]
PLATFORM_NOT_ASSIGNED = "Platform not assigned"

_BLANKS = "".join(chr(code) for code in range(0x21))


def strip_blanks(c: Column) -> Column:
    """Trim every character up to U+0020 on both ends (``trim`` takes spaces only)."""
    return F.btrim(c, F.lit(_BLANKS))


def is_blank(c: Column) -> Column:
    """True for null, empty and blank text."""
    return F.coalesce(strip_blanks(c), F.lit("")) == ""


def normalize_key(c: Column) -> Column:
    """Upper-case key text; characters a topic cannot hold become ``~``."""
    return F.coalesce(F.regexp_replace(F.upper(c), r"[^A-Z0-9\-_.~%]", "~"), F.lit(""))


def station_topic(c: Column) -> Column:
    return F.concat(F.lit("Station_"), normalize_key(c))


def station_of_topic(c: Column) -> Column:
    return F.replace(c, F.lit("Station_"), F.lit(""))


def status_topic(mode: Column, line_id: Column) -> Column:
    return F.concat(F.lit("LineStatus_"), mode, F.lit("_"), line_id)


def capitalise_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def clean_destination(c: Column) -> Column:
    for noise in DESTINATION_NOISE:
        c = F.replace(c, F.lit(noise), F.lit(""))
    return strip_blanks(c)


def display_name(towards: Column, destination: Column) -> Column:
    """``towards`` when it says something, else the destination; both cleaned."""
    said = strip_blanks(towards)
    usable = (said != "") & (F.lower(said) != "null")
    return clean_destination(F.when(usable, said).otherwise(destination))


def is_unassigned_platform(raw: Column) -> Column:
    text = F.lower(F.coalesce(strip_blanks(raw), F.lit("")))
    return text.isin("", *UNASSIGNED_PLATFORMS)


def presentable_platform(mode: Column, raw: Column) -> Column:
    """Label shown to riders. The rules apply in order; the first that fits wins."""
    is_bus = F.coalesce(F.lower(mode) == "bus", F.lit(False))
    text = strip_blanks(raw)

    has_word = F.lower(text).startswith("stop ")
    stop_code = F.when(has_word, strip_blanks(F.substring(text, 6, 1 << 30))).otherwise(text)

    halves = F.split(text, " - ")
    described = strip_blanks(halves.getItem(0))
    second = strip_blanks(F.try_element_at(halves, F.lit(2)))
    named = F.when(F.lower(second).startswith("platform"), second).otherwise(
        F.concat(F.lit("Platform "), second)
    )

    return (
        F.when(is_unassigned_platform(raw), F.when(is_bus, "").otherwise(PLATFORM_NOT_ASSIGNED))
        .when(is_bus, F.concat(F.lit("Stop "), F.upper(stop_code)))
        .when(text.contains(" - "), F.concat(named, F.lit(" ("), described, F.lit(")")))
        .when(text.rlike(r"^\d+$"), F.concat(F.lit("Platform "), text))
        .when(text.rlike(r"(?i)^plat \d+$"), F.concat(F.lit("Platform "), F.substring(text, 6, 1 << 30)))
        .when(text.rlike(r"^(?:[A-Za-z]|\d+[A-Za-z]+)$"), F.concat(F.lit("Platform "), F.upper(text)))
        .otherwise(text)
    )


def direction_or_default(direction: Column, platform: Column) -> Column:
    """Lower-cased direction; a blank one is guessed from the platform text."""
    guessed = F.when(F.lower(platform).contains("inbound"), "inbound").otherwise("outbound")
    return F.when(is_blank(direction), guessed).otherwise(F.lower(direction))
