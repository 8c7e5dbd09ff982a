"""Landed snapshots of the upstream feeds, as batch or stream.

A landing job writes each fetched row with its mode, cycle, place in the feed
and fetch time. A call that failed has simply no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.schemas import Schema


def land(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Append fetched rows, in folders by mode and cycle, so that a reader of some polls lists and reads only theirs.

    A null mode or cycle has a folder of its own and comes back as null.
    """
    rows.write.mode("append").partitionBy("mode", "cycle").format(fmt).save(path)


def read_feed(
    spark: SparkSession, path: str, schema: str, fmt: str = "json", stream: bool = False,
    modes: Sequence[str] | None = None, cycles: tuple[int, int] | None = None,
) -> DataFrame:
    """A landed feed, in folders by mode and cycle or flat.

    ``modes`` and ``cycles`` (first and last) name the polls to read; of a feed in
    folders no other file is opened.
    """
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(schema).format(fmt).load(path)
    if modes is not None:
        raw = raw.where(F.col("mode").isin(list(modes)))
    if cycles is not None:
        raw = raw.where(F.col("cycle").between(*cycles))
    # Folder columns come last; the schema's order holds for either layout.
    return raw.select(*[name for name in Schema(schema).names])


def arrivals(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False, **polls) -> DataFrame:
    return normalise_arrivals(read_feed(spark, path, schemas.RAW_ARRIVAL, fmt, stream, **polls))


def normalise_arrivals(raw: DataFrame) -> DataFrame:
    """Raw arrival rows to engine columns; the destination id has two spellings."""
    return raw.select(
        F.coalesce("modeName", "mode").alias("mode"),
        "cycle",
        "feed_seq",
        "fetched_at",
        F.col("naptanId").alias("naptan_id"),
        F.col("stationName").alias("station_name"),
        F.col("lineId").alias("line_id"),
        F.col("lineName").alias("line_name"),
        F.col("platformName").alias("platform"),
        "direction",
        F.coalesce("destinationNaptanId", "destinationId").alias("dest_id"),
        F.col("destinationName").alias("dest_name"),
        "towards",
        F.col("expectedArrival").alias("eta"),
    )


def polls(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    """The poll log: a landing job writes a poll's row after the poll's rows."""
    return read_feed(spark, path, schemas.POLL, fmt, stream)


def boards(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False, **polls) -> DataFrame:
    return normalise_boards(read_feed(spark, path, schemas.RAW_BOARD, fmt, stream, **polls))


def normalise_boards(raw: DataFrame) -> DataFrame:
    return raw.select(
        "mode",
        "cycle",
        "feed_seq",
        "fetched_at",
        F.col("requestedStation").alias("naptan_id"),
        F.col("requestedLine").alias("line_id"),
        F.col("lineId").alias("entry_line_id"),
        F.col("platformName").alias("platform"),
        F.col("destinationNaptanId").alias("dest_id"),
        F.col("destinationName").alias("dest_name"),
        F.col("departureStatus").alias("status"),
        F.col("estimatedTimeOfDeparture").alias("estimated"),
        F.col("scheduledTimeOfDeparture").alias("scheduled"),
    )


def lines(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_feed(spark, path, schemas.RAW_LINE, fmt).select("mode", F.col("id").alias("line_id"), "name")


def stop_points(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_feed(spark, path, schemas.RAW_STOP_POINT, fmt).select(
        "line_id",
        F.col("naptanId").alias("naptan_id"),
        F.col("commonName").alias("common_name"),
        "lat",
        "lon",
        F.col("stopType").alias("stop_type"),
        "indicator",
        F.col("stopLetter").alias("stop_letter"),
        F.col("icsCode").alias("ics_code"),
        "towards",
        F.col("compassPoint").alias("compass_point"),
        F.col("stationNaptan").alias("station_naptan"),
    )


def route_sequences(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_feed(spark, path, schemas.RAW_ROUTE_SEQUENCE, fmt)


def line_statuses(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    return read_feed(spark, path, schemas.RAW_LINE_STATUS, fmt, stream)


def change_feed(
    spark: SparkSession, path: str, document: str, fmt: str = "json", stream: bool = False
) -> DataFrame:
    """Change events: the document's columns, ``op`` and ``change_seq``."""
    return read_feed(spark, path, f"{document}, op string, change_seq bigint", fmt, stream)


def mode_list(text: str) -> list[str]:
    """Comma-separated modes of a setting: trimmed, empty ones left out."""
    return [part.strip() for part in text.split(",") if part.strip()]
