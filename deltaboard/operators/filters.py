"""Row filters and alias rewrites of the two prediction feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard.functions.lookups import LATE_PLATFORM_MODES, STATION_ALIASES
from deltaboard.functions.text import is_unassigned_platform
from deltaboard.functions.timing import whole_minutes_until

SKIPPED_STATUSES = ["Cancelled", "NotStoppingAtStation"]  # fixed values
DELAYED = "Delayed"

Alias = tuple[str, str, str, str]


def active_of_counts(counts: DataFrame) -> DataFrame:
    """Stations with a count above zero, from rows (naptan_id, n)."""
    return counts.where(F.col("n").try_cast("int") > 0).select("naptan_id")


def active_stations(doc: DataFrame) -> DataFrame:
    """The same from the counts map of a subscription document."""
    return active_of_counts(doc.select(F.explode("stationCounts").alias("naptan_id", "n")))


def subscribed_ids(live: DataFrame | None, mirror: DataFrame) -> DataFrame:
    """The live document's active ids if it has counts at all, else the mirror.

    Counts without any above zero are an empty set, not a reason to fall back.
    Nothing runs until the result is asked for: the mirror meets one flag.
    """
    if live is None:
        return mirror.select("naptan_id")
    counted = live.where(F.col("stationCounts").isNotNull())
    flag = counted.agg((F.count(F.lit(1)) == 0).alias("_missing"))
    fallback = mirror.select("naptan_id").join(F.broadcast(flag.where("_missing")))
    return active_stations(counted).unionByName(fallback.select("naptan_id"))


def subscribed_only(rows: DataFrame, subscribed: DataFrame | None, key: str = "naptan_id") -> DataFrame:
    """Keep rows of subscribed stations; ``None`` keeps all. An empty set keeps none."""
    if subscribed is None:
        return rows
    return rows.join(subscribed.select(F.col("naptan_id").alias(key)), key, "left_semi")


def remap_aliases(arrivals: DataFrame, aliases: Sequence[Alias] = tuple(STATION_ALIASES)) -> DataFrame:
    """Publish the usable twin record under the subscribed id and name.

    Rows of the unusable record are dropped. The alias list is a constant of a
    few entries, so it becomes an expression and needs no join. Apply it before
    the subscription filter: the twin's own id is not subscribed.
    """
    dropped, station, name = F.lit(False), F.col("naptan_id"), F.col("station_name")
    for mode, published, source, label in aliases:
        of_mode = F.col("mode") == mode
        dropped = dropped | (of_mode & (F.col("naptan_id") == published))
        hit = of_mode & (F.col("naptan_id") == source)
        station = F.when(hit, published).otherwise(station)
        name = F.when(hit, label).otherwise(name)
    return arrivals.where(~F.coalesce(dropped, F.lit(False))).withColumns({"naptan_id": station, "station_name": name})


def board_source_station(mode: Column, station: Column, aliases: Sequence[Alias] = tuple(STATION_ALIASES)) -> Column:
    """Record whose board has to be read for a station."""
    source = station
    for alias_mode, published, twin, _ in aliases:
        source = F.when((mode == alias_mode) & (station == published), twin).otherwise(source)
    return source


def publish_board_aliases(board: DataFrame, aliases: Sequence[Alias] = tuple(STATION_ALIASES)) -> DataFrame:
    """Rows read from the twin record go out under the station they stand for.

    The other record's own board is not read, so its rows are dropped.
    """
    dropped, station = F.lit(False), F.col("naptan_id")
    for mode, published, source, _ in aliases:
        of_mode = F.col("mode") == mode
        dropped = dropped | (of_mode & (F.col("naptan_id") == published))
        station = F.when(of_mode & (F.col("naptan_id") == source), published).otherwise(station)
    return board.where(~F.coalesce(dropped, F.lit(False))).withColumn("naptan_id", station)


def not_long_departed(eta: Column, now: Column, minutes: int = 2) -> Column:
    """False once the expected time is more than ``minutes`` ago; null is kept."""
    return eta.isNull() | (eta >= now - F.make_dt_interval(mins=F.lit(minutes)))


def far_future_unassigned(mode: Column, platform: Column, eta: Column, now: Column, minutes: int = 20) -> Column:
    """A late-platform mode, no platform yet, and too far off or of unknown time."""
    late = F.coalesce(F.lower(mode).isin(LATE_PLATFORM_MODES), F.lit(False))
    far = eta.isNull() | (whole_minutes_until(eta, now) > minutes)
    return late & is_unassigned_platform(platform) & far


def boardable(status: Column) -> Column:
    return F.coalesce(~status.isin(SKIPPED_STATUSES), F.lit(True))


def usable_board_rows(board: DataFrame, now: Column, departed_minutes: int = 2) -> DataFrame:
    """Board rows fit to publish, with ``eta``: estimated, else scheduled time."""
    eta = F.coalesce("estimated", "scheduled")
    same_line = F.coalesce(F.lower("entry_line_id") == F.lower("line_id"), F.col("entry_line_id").isNull())
    elsewhere = F.coalesce(F.col("dest_id") != F.col("naptan_id"), F.lit(True))
    live = (F.coalesce(F.col("status") == DELAYED, F.lit(False))) | not_long_departed(eta, now, departed_minutes)
    return board.where(same_line & boardable(F.col("status")) & eta.isNotNull() & elsewhere & live).withColumn("eta", eta)


# Lookups on the station table.


def where_equal(df: DataFrame, field: str, value: object) -> DataFrame:
    return df.where(F.col(field) == F.lit(value))


def where_not_equal(df: DataFrame, field: str, value: object) -> DataFrame:
    """Rows that have the field, with another value."""
    return df.where(F.col(field) != F.lit(value))


def where_except(df: DataFrame, field: str, value: object) -> DataFrame:
    """Rows with another value or none."""
    return df.where(F.col(field).isNull() | (F.col(field) != F.lit(value)))


def where_contains(df: DataFrame, field: str, value: object) -> DataFrame:
    return df.where(F.array_contains(field, F.lit(value)))


def where_has_mode(stations: DataFrame, mode: str) -> DataFrame:
    """Stations that serve ``mode``: the canonical form of a map-key lookup."""
    return stations.where(F.exists("modes", lambda m: m["mode"] == F.lit(mode)))


def where_map_key(df: DataFrame, field: str, key: str) -> DataFrame:
    return df.where(F.map_contains_key(field, F.lit(key)))
