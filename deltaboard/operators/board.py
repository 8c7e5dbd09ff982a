"""Departure boards: deduplication, direction resolution, per-line fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaboard.functions.text import (
    capitalise_first,
    clean_destination,
    is_blank,
    is_unassigned_platform,
    presentable_platform,
    strip_blanks,
)
from deltaboard.functions.timing import iso_instant
from deltaboard.operators.countdown import KEYS, UNKNOWN_DESTINATION, next_departures
from deltaboard.operators.filters import usable_board_rows
from deltaboard.operators.ranking import first_k
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS, Settings

DEFAULT_DIRECTION = "outbound"


def agreed(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Value per key on which all rows agree; a key with a conflict has none.

    The values are grouped by, so the rows combine in hash tables before the
    shuffle, and a hot key is as many rows as it has values. A key that is left
    with one row agrees.
    """
    told = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows"))
    return (
        told.withColumn("_values", F.count(F.lit(1)).over(W.partitionBy(*keys)))
        .where(F.col("_values") == 1)
        .select(*keys, F.col(value).alias(out))
    )


def learned_directions(
    arrivals: DataFrame, planned: DataFrame | None = None, stage: Staging | None = None
) -> tuple[DataFrame, DataFrame]:
    """Directions by destination and by assigned platform, learned from arrivals in one pass."""
    platform = F.coalesce(strip_blanks(F.col("platform")), F.lit(""))
    told = F.filter(
        F.array(
            F.struct(F.lit("destination").alias("kind"), F.col("dest_id").alias("value")),
            F.struct(F.lit("platform").alias("kind"), F.when(~is_unassigned_platform(platform), platform).alias("value")),
        ),
        lambda t: t["value"].isNotNull(),
    )
    if planned is not None:
        arrivals = arrivals.join(planned.select(*KEYS).distinct(), KEYS, "left_semi")
    taught = arrivals.where(~is_blank(F.col("direction"))).select(
        *KEYS, F.lower(strip_blanks(F.col("direction"))).alias("_dir"), F.explode(told).alias("_t")
    )
    learned = agreed(taught.select(*KEYS, "_t.kind", "_t.value", "_dir"), [*KEYS, "kind", "value"], "_dir", "dir")
    if stage is not None:
        learned = stage(learned, "learned")

    def of(kind: str, value: str, out: str) -> DataFrame:
        return learned.where(F.col("kind") == kind).select(*KEYS, F.col("value").alias(value), F.col("dir").alias(out))

    return of("destination", "dest_id", "dest_dir"), of("platform", "raw_platform", "platform_dir")


def board_rows(board: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Usable board rows in published form, identical workings collapsed.

    ``match_dest`` keeps the destination as it came, for the direction lookup.
    """
    rows = usable_board_rows(board, now, settings.departed_minutes).select(
        *KEYS,
        "line_id",
        "feed_seq",
        "eta",
        F.coalesce(strip_blanks(F.col("platform")), F.lit("")).alias("raw_platform"),
        F.col("dest_id").alias("match_dest"),
        F.coalesce("dest_id", F.lit(UNKNOWN_DESTINATION)).alias("dest_id"),
        "dest_name",
    )
    once = first_k(rows, [*KEYS, "line_id", "dest_id", "eta", "raw_platform"], [F.col("feed_seq").asc()], 1)
    return once.withColumns(
        {
            "platform": presentable_platform(F.col("mode"), F.col("raw_platform")),
            "display": clean_destination(F.col("dest_name")),
        }
    ).drop("dest_name")


def resolve_directions(
    rows: DataFrame, by_destination: DataFrame, by_platform: DataFrame, departing: DataFrame | None,
    stage: Staging | None = None,
) -> DataFrame:
    """Four passes; each only fills what the ones before left open. ``stage`` keeps the first, which the others share.

    1 destination, platform text, learned platform; 2 directions already found
    on the same assigned platform; 3 the line's only direction; 4 the terminus'
    way out, else outbound.
    """
    real_platform = ~is_unassigned_platform(F.col("raw_platform"))
    first = (
        rows.join(by_destination.withColumnRenamed("dest_id", "match_dest"), [*KEYS, "match_dest"], "left")
        .join(by_platform, [*KEYS, "raw_platform"], "left")
        .withColumn(
            "_d1",
            F.coalesce(
                F.col("dest_dir"),
                F.when(F.lower("raw_platform").contains("inbound"), "inbound"),
                F.when(real_platform, F.col("platform_dir")),
            ),
        )
        .drop("dest_dir", "platform_dir")
    )
    if stage is not None:
        first = stage(first, "directed")
    by_shared = agreed(first.where(real_platform), [*KEYS, "raw_platform"], "_d1", "shared_dir")
    second = first.join(by_shared, [*KEYS, "raw_platform"], "left").withColumn(
        "_d2", F.coalesce("_d1", "shared_dir")
    )
    by_line = agreed(second, [*KEYS, "line_id"], "_d2", "line_dir")
    third = second.join(by_line, [*KEYS, "line_id"], "left").withColumn("_d3", F.coalesce("_d2", "line_dir"))
    if departing is not None:
        lookup = departing.select(
            F.col("line_id").alias("_line"), F.col("naptan_id").alias("_station"), F.col("departing").alias("_departing")
        )
        third = third.join(
            lookup, (F.lower(third["line_id"]) == lookup["_line"]) & (third["naptan_id"] == lookup["_station"]), "left"
        ).drop("_line", "_station")
    else:
        third = third.withColumn("_departing", F.lit(None).cast("string"))
    return third.withColumn(
        "direction", F.coalesce("_d3", "_departing", F.lit(DEFAULT_DIRECTION))
    ).drop("_d1", "_d2", "_d3", "shared_dir", "line_dir", "_departing")


def board_items(directed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Published rows of the board path: the soonest per line and direction."""
    top = next_departures(directed, settings.top_k)
    return top.select(
        *KEYS, "line_id", "direction", "pos", "eta", "dest_id", "platform", iso_instant(F.col("eta")).alias("eta_text"), "display"
    )


def uncovered_arrivals(arrivals: DataFrame, covered: DataFrame) -> DataFrame:
    """Arrivals of lines the board had no usable row for, letter case included."""
    return arrivals.join(covered.select(*KEYS, "line_id").distinct(), [*KEYS, "line_id"], "left_anti")


def board_line_names(covered: DataFrame, arrivals: DataFrame, planned: DataFrame) -> DataFrame:
    """Line names: first arrival's (any letter case), then planned, then the id."""
    lines = covered.select(*KEYS, "line_id").distinct().withColumn("_fold", F.lower("line_id"))
    told = (
        arrivals.where(F.col("line_name").isNotNull() & F.col("line_id").isNotNull())
        .groupBy(*KEYS, F.lower("line_id").alias("_fold"))
        .agg(F.min_by("line_name", "feed_seq").alias("_told"))
    )
    known = (
        planned.where(~is_blank(F.col("line_name")))
        .groupBy(*KEYS, "line_id")
        .agg(F.min("line_name").alias("_known"))
    )
    return (
        lines.join(told, [*KEYS, "_fold"], "left")
        .join(known, [*KEYS, "line_id"], "left")
        .select(
            *KEYS,
            "line_id",
            F.coalesce("_told", "_known", capitalise_first(F.col("line_id"))).alias("line_name"),
        )
    )
