"""Countdown arrivals: terminus relabel, filters, items and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard.functions.text import direction_or_default, display_name, is_blank, presentable_platform
from deltaboard.functions.timing import iso_instant
from deltaboard.operators.filters import far_future_unassigned, not_long_departed
from deltaboard.operators.ranking import first_k
from deltaboard.settings import DEFAULTS, Settings

KEYS = ["mode", "cycle", "naptan_id"]
FRONT_OF_TRAIN = "Check Front of Train"
UNKNOWN_DESTINATION = "unknown"


def relabel_termini(arrivals: DataFrame, departing: DataFrame | None) -> DataFrame:
    """Vehicles that end here turn around: hide the destination, find the way out.

    Only the rows with a blank direction need the lookup; they carry its key,
    all others carry null and so match nothing.
    """
    ends_here = F.coalesce(F.col("dest_id") == F.col("naptan_id"), F.lit(False))
    undirected = is_blank(F.col("direction"))
    rows = arrivals
    if departing is not None:
        lookup = departing.select(
            F.col("line_id").alias("_line"), F.col("naptan_id").alias("_station"), F.col("departing").alias("_departing")
        )
        wanted = F.when(ends_here & undirected, F.lower("line_id"))
        rows = rows.withColumn("_want", wanted)
        rows = rows.join(
            lookup, (rows["_want"] == lookup["_line"]) & (rows["naptan_id"] == lookup["_station"]), "left"
        ).drop("_want", "_line", "_station")
    else:
        rows = rows.withColumn("_departing", F.lit(None).cast("string"))
    return rows.withColumns(
        {
            "towards": F.when(ends_here, FRONT_OF_TRAIN).otherwise(F.col("towards")),
            "dest_name": F.when(~ends_here, F.col("dest_name")),
            "direction": F.when(ends_here & undirected, F.col("_departing")).otherwise(F.col("direction")),
            "dest_id": F.when(ends_here, UNKNOWN_DESTINATION).otherwise(F.col("dest_id")),
        }
    ).drop("_departing")


def live_arrivals(arrivals: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Drop long-departed rows and far-off rows without a platform."""
    keep = not_long_departed(F.col("eta"), now, settings.departed_minutes) & ~far_future_unassigned(
        F.col("mode"), F.col("platform"), F.col("eta"), now, settings.unassigned_horizon_minutes
    )
    return arrivals.where(keep)


def item_columns() -> list[Column]:
    """Columns of one published prediction."""
    return [
        F.col("dest_id"),
        presentable_platform(F.col("mode"), F.col("platform")).alias("platform"),
        iso_instant(F.col("eta")).alias("eta_text"),
        display_name(F.col("towards"), F.col("dest_name")).alias("display"),
    ]


def next_departures(rows: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The ``k`` soonest rows per station, line and direction; ``pos`` is 1-based."""
    group = [*(keys or KEYS), "line_id", "direction"]
    return first_k(rows, group, [F.col("eta").asc_nulls_last(), F.col("feed_seq").asc()], k, "pos")


def countdown_items(
    arrivals: DataFrame, now: Column, departing: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Published rows of the countdown path. Rows without station or line never group.

    Labels are made after the top-k, for the rows that are left.
    """
    grouped = arrivals.where(F.col("naptan_id").isNotNull() & F.col("line_id").isNotNull())
    live = live_arrivals(grouped, now, settings)
    turned = relabel_termini(live, departing).withColumn(
        "direction", direction_or_default(F.col("direction"), F.col("platform"))
    )
    top = next_departures(turned, settings.top_k)
    return top.select(*KEYS, "line_id", "direction", "pos", "eta", *item_columns())
